"""Sources, sinks, filters and null policies."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.catalog.base import HISTORY, READINGS, SITES, TIMED, Tables, query, r, rs, sql
from sensorloom.operators import filters as op
from sensorloom.operators.joins import fill_site_gps
from sensorloom.operators.rowwindows import sequence_build, tumble_rows
from sensorloom.plans.staging import new_path
from sensorloom.schema import READING_SCHEMA
from sensorloom.sources import readings as src
from sensorloom.sources import sinks

CODES = ["48_201_0001", "48_201_0004", "48_201_0009"]
IN_CODES = ", ".join(f"'{c}'" for c in CODES)
MEASURES = ["no", "no2", "nox", "o3", "temp", "winddir", "windspd"]
FLAGS = ["o3_flag", "no_flag", "no2_flag", "nox_flag", "temp_flag"]
BASE = ["event_id", "aqs_code", "epoch", "data_year"]
ALL = BASE + MEASURES + FLAGS
RAW = ["aqs_code", "epoch", "data_year", *MEASURES, *FLAGS]


def cols(*names: str) -> str:
    """SQL column list, measures rounded."""
    return ", ".join(r(f'"{n}"', n) if n in MEASURES else f'"{n}"' for n in names)


def raw_layout(df):
    """Readings in the layout of a yearly file; absent columns are empty."""
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in READING_SCHEMA.fields
        ],
        "data_year",
    )


# --- sources and sinks ------------------------------------------------------

@query("read_readings", sql(READINGS, f"SELECT {cols(*RAW)} FROM readings"))
def _(t: Tables):
    path = new_path(t.spark, "yearly-csv")
    sinks.write_yearly_csv(raw_layout(t.readings), path, [2013, 2015])
    # 2014 has no file and is skipped.
    return src.read_readings(t.spark, path, 2013, 2016, skip_absent=True).select(*RAW)


@query("read_declared_schema", sql(READINGS, f"SELECT {cols('event_id', 'aqs_code', 'epoch', 'o3', 'o3_flag')} FROM readings"))
def _(t: Tables):
    path = new_path(t.spark, "typed-csv")
    columns = ["event_id", "aqs_code", "epoch", "o3", "o3_flag"]
    t.readings.select(*columns).write.csv(path, header=True)
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.DoubleType(), T.StringType()]
    return src.read_declared_schema(t.spark, path, T.StructType(list(map(T.StructField, columns, kinds))))


@query("drop_repeated_headers", sql(READINGS, f"""
SELECT {cols('event_id', 'o3', 'temp')} FROM readings WHERE event_id % 50 <> 0"""))
def _(t: Tables):
    # Every fiftieth line is a header line again.
    header = F.col("event_id") % 50 == 0
    text = t.readings.select(
        *[F.when(header, c).otherwise(F.col(c).cast("string")).alias(c) for c in ("event_id", "o3", "temp")]
    )
    clean = src.drop_repeated_headers(text, "temp")
    return clean.select(F.col("event_id").cast("long"), F.col("o3").cast("double"), F.col("temp").cast("double"))


@query("drop_index_columns", sql(READINGS, f"SELECT {cols(*ALL)} FROM readings"))
def _(t: Tables):
    junk = {"Unnamed: 0": F.col("event_id"), "Unnamed: 0.1": F.col("epoch")}
    return src.drop_index_columns(t.readings.withColumns(junk))


@query("write_by_site", sql(READINGS, f"SELECT {cols(*ALL)} FROM readings"))
def _(t: Tables):
    path = new_path(t.spark, "by-site")
    sinks.write_by_site(t.readings, path)
    return t.spark.read.parquet(path).select(*ALL)


@query("concat_site_years", sql(READINGS, f"""
SELECT {cols(*ALL)} FROM readings WHERE aqs_code IN ({IN_CODES}) AND data_year BETWEEN 2010 AND 2014"""))
def _(t: Tables):
    path = new_path(t.spark, "by-site")
    sinks.write_by_site(t.readings, path)
    return src.concat_site_years(t.spark, path, CODES, 2010, 2015).select(*ALL)


@query("write_sequences", sql(READINGS, """
sizes AS (SELECT aqs_code, count(*) // 12 AS n FROM readings GROUP BY 1),
full_sites AS (SELECT n - 24 - 6 + 1 AS s FROM sizes WHERE n - 24 - 6 + 1 > 0)""", """
SELECT CAST(coalesce(sum(s), 0) AS BIGINT) AS n_sequences,
  CAST(CASE WHEN count(*) > 0 THEN 24 END AS BIGINT) AS n_steps, CAST(3 AS BIGINT) AS n_features FROM full_sites"""))
def _(t: Tables):
    features = ["o3", "no", "temp"]
    built = sequence_build(tumble_rows(t.readings, features), features, 24, 6, with_labels=["o3"], enrich=["temp", "o3"])
    return sinks.write_sequences(built, new_path(t.spark, "sequences"))


@query("site_dim_export", sql(SITES, f"SELECT aqs_code, region, {rs('latitude', 'longitude')} FROM sites"))
def _(t: Tables):
    path = new_path(t.spark, "sites")
    sinks.site_dim_export(t.sites, path)
    return t.spark.read.parquet(path)


# --- filters ----------------------------------------------------------------

@query("filter_sites", sql(READINGS, f"SELECT {cols(*ALL)} FROM readings WHERE aqs_code IN ({IN_CODES})"))
def _(t: Tables):
    return op.filter_sites(t.readings, CODES)


VALID_BY_ERA = """CASE WHEN data_year < 2014
  THEN nox_flag = 'VAL' AND no_flag = 'VAL' AND no2_flag = 'VAL' AND o3_flag = 'VAL' AND temp_flag = 'VAL'
  ELSE nox_flag = 'K' AND no_flag = 'K' AND o3_flag = 'K' AND temp_flag = 'K' END
  AND winddir IS NOT NULL AND aqs_code IS NOT NULL"""


@query("filter_valid_flags", sql(READINGS, f"SELECT {cols(*ALL)} FROM readings WHERE {VALID_BY_ERA}"))
def _(t: Tables):
    return op.filter_valid_flags(t.readings)


@query("cached_transform", sql(READINGS, f"SELECT {cols(*ALL)} FROM readings WHERE {VALID_BY_ERA}"))
def _(t: Tables):
    path = new_path(t.spark, "cache")
    src.cached_transform(t.spark, path, lambda: op.filter_valid_flags(t.readings))
    # The second call finds the complete table and reads it.
    return src.cached_transform(t.spark, path, lambda: t.readings)


@query("filter_valid_o3_temp", sql(READINGS, f"""
SELECT {cols(*ALL)} FROM readings WHERE o3_flag = 'K' AND temp_flag = 'K' AND winddir IS NOT NULL"""))
def _(t: Tables):
    return op.filter_valid_o3_temp(t.readings, code="K")


@query("filter_valid_2000_2013", sql(READINGS, f"""
SELECT {cols(*ALL)} FROM readings WHERE nox_flag = 'VAL' AND no_flag = 'VAL' AND o3_flag = 'VAL'
  AND temp_flag = 'VAL' AND winddir IS NOT NULL"""))
def _(t: Tables):
    return op.filter_valid_2000_2013(t.readings)


@query("filter_stage_counts", sql(READINGS, """
SELECT 'all' AS stage, count(*) AS n_rows FROM readings UNION ALL
SELECT 'nox', count(*) FROM readings WHERE nox_flag = 'VAL' UNION ALL
SELECT 'no', count(*) FROM readings WHERE nox_flag = 'VAL' AND no_flag = 'VAL' UNION ALL
SELECT 'o3', count(*) FROM readings WHERE nox_flag = 'VAL' AND no_flag = 'VAL' AND o3_flag = 'VAL' UNION ALL
SELECT 'winddir', count(*) FROM readings
WHERE nox_flag = 'VAL' AND no_flag = 'VAL' AND o3_flag = 'VAL' AND winddir IS NOT NULL"""))
def _(t: Tables):
    stages = [(m, F.col(f"{m}_flag") == "VAL") for m in ("nox", "no", "o3")]
    return op.filter_stage_counts(t.readings, [*stages, ("winddir", F.col("winddir").isNotNull())])


@query("mark_valid", sql(READINGS, f"""
SELECT {cols(*ALL)}, CASE WHEN winddir IS NOT NULL AND CASE WHEN data_year < 2014
  THEN nox_flag = 'VAL' AND no_flag = 'VAL' AND o3_flag = 'VAL' AND temp_flag = 'VAL'
  ELSE nox_flag = 'VAL' AND no_flag = 'VAL' AND o3_flag = 'K' AND temp_flag = 'K' END THEN 'y' ELSE 'n' END AS val
FROM readings"""))
def _(t: Tables):
    return op.mark_valid(t.readings)


ERA_CODE = "CASE WHEN data_year < 2014 THEN 'VAL' ELSE 'K' END"


@query("invalid_to_null", sql(READINGS, f"""
SELECT event_id, aqs_code, {r(f"CASE WHEN o3_flag = {ERA_CODE} THEN o3 END", "o3")},
  {r(f"CASE WHEN nox_flag = {ERA_CODE} THEN nox END", "nox")} FROM readings"""))
def _(t: Tables):
    return op.invalid_to_null(t.readings, ["o3", "nox"]).select("event_id", "aqs_code", "o3", "nox")


@query("fill_site_gps", sql(SITES, f"""
SELECT event_id, aqs_code, {r('coalesce(s.latitude, CAST(10 AS DOUBLE))', 'latitude')}, {r('s.longitude', 'longitude')}
FROM readings LEFT JOIN sites s USING (aqs_code)"""))
def _(t: Tables):
    rows = t.readings.select(
        "event_id", "aqs_code", F.lit(10.0).alias("latitude"), F.lit(None).cast("double").alias("longitude")
    )
    return fill_site_gps(rows, t.sites)


@query("drop_any_null", sql(READINGS, f"""
SELECT {cols(*ALL)} FROM readings
WHERE "no" IS NOT NULL AND no2 IS NOT NULL AND nox IS NOT NULL AND o3 IS NOT NULL AND winddir IS NOT NULL"""))
def _(t: Tables):
    return op.drop_any_null(t.readings)


_HAS_NULL = '("no" IS NULL OR no2 IS NULL OR nox IS NULL OR o3 IS NULL OR winddir IS NULL)'


@query("mask_null_rows", sql(READINGS, f"""
SELECT aqs_code, CASE WHEN {_HAS_NULL} THEN 1000 ELSE epoch END AS epoch,
  {', '.join(r(f'CASE WHEN {_HAS_NULL} THEN 1000 ELSE "{m}" END', m) for m in MEASURES)} FROM readings"""))
def _(t: Tables):
    return op.mask_null_rows(t.readings.select("aqs_code", "epoch", *MEASURES), 1000.0)


@query("fill_null_const", sql(READINGS, f"""
SELECT event_id, aqs_code, {', '.join(r(f'coalesce("{m}", 10000)', m) for m in MEASURES)} FROM readings"""))
def _(t: Tables):
    return op.fill_null_const(t.readings.select("event_id", "aqs_code", *MEASURES), 10000.0)


@query("project_features", sql(READINGS, f"SELECT event_id, aqs_code, epoch, {cols('nox', 'temp', 'windspd', 'o3')} FROM readings"))
def _(t: Tables):
    return op.project_features(t.readings, ["nox", "temp", "windspd", "o3"], keep=["event_id", "aqs_code", "epoch"])


@query("drop_all_null_columns", sql(HISTORY, f"""
SELECT epoch, data_year, {rs('o3', 'no', 'nox', 'temp')} FROM history"""))
def _(t: Tables):
    return op.drop_all_null_columns(
        t.history.select("aqs_code", "epoch", "data_year", "o3", "no", "nox", "temp", "co", "l_returnflag")
    )


@query("downcast_types", sql(READINGS, f"""
SELECT event_id, CAST(epoch AS INTEGER) AS epoch, {', '.join(r(f'CAST("{m}" AS FLOAT)', m) for m in MEASURES)}
FROM readings"""))
def _(t: Tables):
    return op.downcast_types(t.readings.select("event_id", "epoch", *MEASURES))


for _name, _fn, _where in [
    ("subset_daytime", op.subset_daytime, '"hour" BETWEEN 7 AND 19'),
    ("subset_nighttime", op.subset_nighttime, '("hour" < 7 OR "hour" > 20)'),
    ("subset_high_o3_rows", op.subset_high_o3_rows, "o3 > 40"),
]:
    @query(_name, sql(TIMED, f'SELECT event_id, aqs_code, epoch, "hour", {cols("o3", "temp")} FROM timed WHERE {_where}'))
    def _(t: Tables, fn=_fn):
        return fn(t.timed).select("event_id", "aqs_code", "epoch", "hour", "o3", "temp")


@query("subset_highpol_months", sql(HISTORY, f"""
SELECT aqs_code, epoch, "month", {rs('o3', 'no')} FROM history WHERE "month" BETWEEN 4 AND 10"""))
def _(t: Tables):
    return op.subset_highpol_months(t.history).select("aqs_code", "epoch", "month", "o3", "no")


@query("rows_with_any_null", sql(READINGS, f"""
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN '  ' ELSE aqs_code END AS aqs_code, {cols('no', 'o3', 'winddir')}
FROM readings WHERE "no" IS NULL OR o3 IS NULL OR winddir IS NULL OR event_id % 17 = 0"""))
def _(t: Tables):
    blank = F.when(F.col("event_id") % 17 == 0, F.lit("  ")).otherwise(F.col("aqs_code")).alias("aqs_code")
    return op.rows_with_any_null(t.readings.select("event_id", blank, "no", "o3", "winddir"))
