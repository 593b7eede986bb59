"""Reading CSV and Parquet inputs: yearly readings, the site table, sequences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.scalar import blank_to_null
from sensorloom.schema import READING_SCHEMA, SITE, YEAR


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def canonical_nulls(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, so averages and extremes skip it."""
    floating = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floating})


def read_declared_schema(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType = READING_SCHEMA
) -> DataFrame:
    """CSV with declared types; a malformed field becomes null and keeps its row."""
    return canonical_nulls(spark.read.csv(paths, schema=schema, header=True, mode="PERMISSIVE"))


def read_readings(
    spark: SparkSession,
    input_path: str,
    year_begin: int,
    year_end: int,
    prefix: str = "Data_",
    suffix: str = ".csv",
    schema: T.StructType = READING_SCHEMA,
    skip_absent: bool = False,
) -> DataFrame:
    """Yearly files ``{prefix}{year}{suffix}`` of ``[year_begin, year_end)`` with ``data_year``.

    The year comes from the file name; repeated header lines are removed.
    """
    paths = [f"{input_path}/{prefix}{year}{suffix}" for year in range(year_begin, year_end)]
    if skip_absent:
        paths = [p for p in paths if path_exists(spark, p)]
    raw = spark.read.csv(paths, schema=schema, header=True, mode="PERMISSIVE")
    found = F.regexp_extract(F.col("_metadata.file_path"), f"{prefix}([0-9]{{4}})", 1)
    rows = raw.withColumn(YEAR, found.cast("int"))
    return canonical_nulls(drop_repeated_headers(rows, schema.fieldNames()[0], ["AQS_Code"]))


def drop_repeated_headers(df: DataFrame, column: str, spellings: Sequence[str] = ()) -> DataFrame:
    """Remove header lines that leaked into the data: a text column that holds its own name."""
    names = [column, *spellings]
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(names))


def drop_index_columns(df: DataFrame) -> DataFrame:
    """Drop index columns a pandas export left behind (``Unnamed: 0`` or a blank header)."""
    junk = [c for c in df.columns if c.startswith("Unnamed") or (c.startswith("_c") and c[2:].isdigit())]
    return df.drop(*junk)


def concat_site_years(
    spark: SparkSession, path: str, sites: Sequence[str], year_begin: int, year_end: int
) -> DataFrame:
    """All years of each site from a site-partitioned table; absent years are simply not there.

    Both filters prune directories before any file is opened.
    """
    rows = spark.read.parquet(path)
    return rows.filter(F.col(SITE).isin(list(sites)) & F.col(YEAR).between(year_begin, year_end - 1))


def cached_transform(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], reset: bool = False
) -> DataFrame:
    """The table at ``path`` if it is complete, else build and write it; ``reset`` rebuilds."""
    if reset or not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# Raw layout of the site table, one text column per field.
SITE_TABLE_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in (SITE, "name", "longitude", "latitude", "region", "activation", "deactivation")
    ]
)


def site_dimension(raw: DataFrame) -> DataFrame:
    """Typed site table: dates from ``d-MMM-yy``, blank dates null, zero coordinates unknown."""
    lat, long = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    date = lambda c: F.to_date(blank_to_null(c), "d-MMM-yy")
    return raw.select(
        SITE, "name",
        F.when(lat != 0, lat).alias("latitude"),
        F.when(long != 0, long).alias("longitude"),
        F.col("region").cast("string").alias("region"),
        date("activation").alias("activation"),
        date("deactivation").alias("deactivation"),
    )


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return site_dimension(spark.read.csv(path, schema=SITE_TABLE_SCHEMA, header=True))
