"""Writing readings, site partitions, sequences and the site table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.rowwindows import describe_shape
from sensorloom.schema import SITE, YEAR


def write_by_site(
    df: DataFrame, path: str, by: Sequence[str] = (SITE, YEAR), max_records: int = 5_000_000, mode: str = "overwrite"
) -> None:
    """One directory per site and year.

    Rebalancing gathers a directory's rows into few files and splits a hot site
    over several tasks.
    """
    (
        df.hint("rebalance", *by)
        .write.mode(mode).option("maxRecordsPerFile", max_records)
        .partitionBy(*by).parquet(path)
    )


def write_yearly_csv(
    df: DataFrame, path: str, years: Sequence[int], prefix: str = "Data_", suffix: str = ".csv", year: str = YEAR
) -> None:
    """One CSV directory ``{prefix}{year}{suffix}`` per year, without the year column."""
    for y in years:
        rows = df.filter(F.col(year) == y).drop(year)
        rows.write.mode("overwrite").csv(f"{path}/{prefix}{y}{suffix}", header=True)


def write_sequences(sequences: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Save sequences with their labels and features; returns the shape (rows, steps, features)."""
    sequences.write.mode(mode).parquet(path)
    return describe_shape(sequences.sparkSession.read.parquet(path))


def site_dim_export(sites: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The site table, one file; what makes the table still runs in parallel."""
    sites.repartition(1).write.mode(mode).parquet(path)


def mask_sequences(sequences: DataFrame, features: Sequence[str], mask: float) -> DataFrame:
    """Null steps and null labels become ``mask``."""
    steps = F.transform(
        "seq", lambda s: F.struct(*[F.coalesce(s[f], F.lit(mask)).alias(f) for f in features])
    )
    return sequences.withColumn("seq", steps).na.fill(mask)
