"""Scalar functions, reshape, set operations, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalog.base import HISTORY, READINGS, SITES, STATIONS, TIMED, Tables, query, r, sql
from sensorloom.functions import scalar as fn
from sensorloom.operators import filters as flt
from sensorloom.operators import reshape as rsh
from sensorloom.operators import sets as st
from sensorloom.operators.impute import neighbor_weights
from sensorloom.operators.joins import nearest_k_sites
from sensorloom.operators.profile import global_minmax, minmax_scale, minmax_scale_as
from sensorloom.operators.rowwindows import label_next_row, tumble_rows
from sensorloom.plans.staging import staged

# --- scalar functions -------------------------------------------------------

@query("wind_vector", sql(READINGS, f"""
SELECT event_id, {r('windspd * cos(radians(winddir))', 'wind_x_dir')}, {r('windspd * sin(radians(winddir))', 'wind_y_dir')}
FROM readings"""))
def _(t: Tables):
    return fn.wind_vector(t.readings).select("event_id", "wind_x_dir", "wind_y_dir")


@query("time_parts", sql(TIMED, 'SELECT event_id, epoch, "hour", day_of_year FROM timed'))
def _(t: Tables):
    return fn.time_parts(t.readings).select("event_id", "epoch", "hour", "day_of_year")


@query("time_parts_full", sql(HISTORY, """
SELECT aqs_code, epoch, "time", "date", "day", "month", "year", "hour" FROM history"""))
def _(t: Tables):
    return fn.time_parts_full(t.history).select("aqs_code", "epoch", "time", "date", "day", "month", "year", "hour")


@query("site_code_to_number", sql(READINGS, """
SELECT event_id, CAST(replace(aqs_code, '_', '') AS BIGINT) AS site_no FROM readings"""))
def _(t: Tables):
    return t.readings.select("event_id", fn.site_code_to_number("aqs_code").alias("site_no"))


@query("site_number_to_code", sql(READINGS, "SELECT event_id, aqs_code AS code FROM readings"))
def _(t: Tables):
    return t.readings.select("event_id", fn.site_number_to_code(fn.site_code_to_number("aqs_code")).alias("code"))


@query("site_in_region", sql(READINGS, """
SELECT event_id, coalesce(CASE WHEN event_id % 9 <> 0 THEN aqs_code END IN ('48_201_0002', '48_201_0005'), false) AS inside
FROM readings"""))
def _(t: Tables):
    code = F.when(F.col("event_id") % 9 != 0, F.col("aqs_code"))
    return t.readings.select("event_id", fn.site_in_region(code, ["48_201_0002", "48_201_0005"]).alias("inside"))


@query("clock_to_minutes", sql("""
SELECT event_id, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minutes FROM events"""))
def _(t: Tables):
    clock = F.date_format("ts", "HH:mm:ss")
    return t.read("events").select("event_id", fn.clock_to_minutes(clock).alias("minutes"))


@query("blank_to_null", sql("""
SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind FROM events"""))
def _(t: Tables):
    text = F.when(F.col("event_type") == "view", F.lit(" \t ")).otherwise(F.col("event_type"))
    return t.read("events").select("event_id", fn.blank_to_null(text).alias("kind"))


_ONEHOT = [f'CAST("{c}" = {v} AS INTEGER) AS {c}_{v}' for c, vs in
           {"hour": range(24), "month": range(1, 13), "year": range(1995, 2002)}.items() for v in vs]


@query("onehot_time", sql(HISTORY, f"SELECT aqs_code, epoch, {', '.join(_ONEHOT)} FROM history"))
def _(t: Tables):
    values = {"hour": range(24), "month": range(1, 13), "year": range(1995, 2002)}
    return fn.onehot_time(t.history.select("aqs_code", "epoch", "hour", "month", "year"), values)


@query("scale_latlong", sql(SITES, f"""
SELECT event_id, {r('(latitude + 90) / 180', 'lat_scaled')}, {r('(longitude + 180) / 360', 'long_scaled')}
FROM readings JOIN sites USING (aqs_code)"""))
def _(t: Tables):
    return t.readings.join(t.sites, "aqs_code").select(
        "event_id", fn.scale_lat("latitude").alias("lat_scaled"), fn.scale_long("longitude").alias("long_scaled")
    )


@query("minmax_scale", sql(READINGS, """
bounds AS (SELECT min(o3) AS o3_min, max(o3) AS o3_max, min(temp) AS temp_min, max(temp) AS temp_max FROM readings)""",
f"""
SELECT event_id, {r('(o3 - o3_min) / abs(o3_max - o3_min)', 'o3')}, {r('(temp - temp_min) / abs(temp_max - temp_min)', 'temp')},
  {r('0', 'flat')}
FROM readings, bounds"""))
def _(t: Tables):
    rows = t.readings.select("event_id", "o3", "temp", F.lit(7.0).alias("flat"))
    return minmax_scale(rows, ["o3", "temp", "flat"], global_minmax(rows, ["o3", "temp", "flat"]))


WINDOWS = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY aqs_code ORDER BY epoch, event_id) - 1 AS rn FROM readings),
windows AS (
  SELECT aqs_code, rn // 12 AS window_no,
    CASE WHEN 12 - count(o3) <= 3 THEN avg(o3) ELSE 0 END AS o3, CASE WHEN 12 - count("no") <= 3 THEN avg("no") ELSE 0 END AS "no",
    CASE WHEN 12 - count(temp) <= 3 THEN avg(temp) ELSE 0 END AS temp,
    CASE WHEN 12 - count(windspd) <= 3 THEN avg(windspd) ELSE 0 END AS windspd
  FROM numbered GROUP BY 1, 2 HAVING count(*) = 12)"""


@query("minmax_scale_labels", sql(READINGS, WINDOWS, """
bounds AS (SELECT min(o3) AS lo, max(o3) AS hi FROM windows),
labels AS (SELECT aqs_code, window_no, lead(o3) OVER (PARTITION BY aqs_code ORDER BY window_no) AS label_o3,
  lead(window_no) OVER (PARTITION BY aqs_code ORDER BY window_no) AS ahead FROM windows)""", f"""
SELECT aqs_code, window_no, {r('(label_o3 - lo) / abs(hi - lo)', 'label_o3')} FROM labels, bounds WHERE ahead IS NOT NULL"""))
def _(t: Tables):
    windows = staged(tumble_rows(t.readings, ["o3"]), "windows")
    labels = label_next_row(windows, ["o3"])
    return minmax_scale_as(labels, {"label_o3": "o3"}, global_minmax(windows, ["o3"]))


NEAREST = """
pairs AS (
  SELECT a.aqs_code, b.aqs_code AS neighbor,
    round(sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2)), 9) AS distance
  FROM stations a JOIN stations b ON a.aqs_code <> b.aqs_code),
nearest AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY aqs_code ORDER BY distance, neighbor) AS INTEGER) AS rank FROM pairs)
  WHERE rank <= 4),
shares AS (SELECT *, 1 - distance / sum(distance) OVER (PARTITION BY aqs_code) AS score FROM nearest),
powers AS (SELECT *, exp(score - max(score) OVER (PARTITION BY aqs_code)) AS e FROM shares),
weights AS (SELECT aqs_code, neighbor, distance, rank, e / sum(e) OVER (PARTITION BY aqs_code) AS weight FROM powers)"""


@query("softmax_weights", sql(STATIONS, NEAREST, f"""
SELECT aqs_code, neighbor, {r('e2 / sum(e2) OVER (PARTITION BY aqs_code)', 'weight')}
FROM (SELECT *, exp(-distance - max(-distance) OVER (PARTITION BY aqs_code)) AS e2 FROM nearest)"""))
def _(t: Tables):
    near = nearest_k_sites(t.stations, 4)
    return fn.softmax_weights(near, ["aqs_code"], -F.col("distance")).select("aqs_code", "neighbor", "weight")


@query("neighbor_weights", sql(STATIONS, NEAREST, f"""
SELECT aqs_code, neighbor, rank, {r('distance', 'distance')}, {r('weight', 'weight')} FROM weights"""))
def _(t: Tables):
    return neighbor_weights(nearest_k_sites(t.stations, 4))


@query("euclid_distance", sql(STATIONS, f"""
SELECT event_id, {r('sqrt(pow(latitude - 29.75, 2) + pow(longitude + 95.25, 2))', 'distance')}
FROM station_readings JOIN stations USING (aqs_code)"""))
def _(t: Tables):
    placed = t.station_readings.join(t.stations, "aqs_code")
    return placed.select(
        "event_id", fn.euclid_distance("latitude", "longitude", F.lit(29.75), F.lit(-95.25)).alias("distance")
    )


# --- reshape ----------------------------------------------------------------

SITE_CODES = [f"48_201_{i:04d}" for i in range(12)]
_PIVOT = ", ".join(
    r(f"max_by({c}, event_id) FILTER (WHERE aqs_code = '{s}' AND {c} IS NOT NULL AND event_id = last_id)", f"{s}_{c}")
    for s in SITE_CODES for c in ("o3", "temp")
)


@query("pivot_wide", sql(TIMED, """
last_rows AS (SELECT *, max(event_id) OVER (PARTITION BY aqs_code, epoch) AS last_id FROM timed)""", f"""
SELECT epoch, "hour", day_of_year, {_PIVOT} FROM last_rows GROUP BY 1, 2, 3"""))
def _(t: Tables):
    return rsh.pivot_wide(t.timed, ["o3", "temp"], SITE_CODES)


_HOURLY_PIVOT = ", ".join(
    r(f"avg({c}) FILTER (WHERE aqs_code = '{s}')", f"{s}_{c}") for s in SITE_CODES for c in ("o3", "temp")
)
_HOUR_KEYS = '"year", "month", "day", "hour"'


@query("pivot_hourly_wide", sql(TIMED, f"SELECT {_HOUR_KEYS}, {_HOURLY_PIVOT} FROM timed GROUP BY {_HOUR_KEYS}"))
def _(t: Tables):
    return rsh.pivot_hourly_wide(t.timed, ["o3", "temp"], SITE_CODES, ["year", "month", "day", "hour"])


GRID = """
span AS (SELECT aqs_code, min(epoch) AS lo, max(epoch) AS hi FROM readings GROUP BY 1),
grid AS (SELECT aqs_code, unnest(generate_series(lo, hi, 300)) AS epoch FROM span)"""


@query("time_grid", sql(READINGS, GRID, "SELECT aqs_code, epoch FROM grid"))
def _(t: Tables):
    return rsh.time_grid(t.readings)


@query("unpivot_columns", sql(READINGS, " UNION ALL ".join(
    f"SELECT event_id, '{c}' AS \"column\", {r(c, 'value')} FROM readings" for c in ("o3", "nox", "temp"))))
def _(t: Tables):
    return rsh.unpivot_columns(t.readings, ["event_id"], ["o3", "nox", "temp"])


# --- sets and order ---------------------------------------------------------

@query("union_years", sql(READINGS, f"""
SELECT event_id, aqs_code, data_year, {r('CASE WHEN data_year = 2013 THEN o3 END', 'o3')}, {r('temp', 'temp')}
FROM readings"""))
def _(t: Tables):
    columns = ["event_id", "aqs_code", "data_year", "temp"]
    early = t.readings.filter("data_year = 2013").select(*columns, "o3")
    late = t.readings.filter("data_year = 2015").select(*columns)
    return st.union_years(early, late)


@query("dedup_rows", sql(TIMED, 'SELECT DISTINCT aqs_code, "hour", "day", o3_flag, event_id % 3 AS part FROM timed'))
def _(t: Tables):
    return st.dedup_rows(t.timed.select("aqs_code", "hour", "day", "o3_flag", (F.col("event_id") % 3).alias("part")))


@query("except_valid_rows", sql(READINGS, f"""
SELECT event_id, aqs_code, {r('o3', 'o3')} FROM readings
WHERE NOT (nox_flag = 'VAL' AND no_flag = 'VAL' AND o3_flag = 'VAL' AND temp_flag = 'VAL' AND winddir IS NOT NULL)"""))
def _(t: Tables):
    rest = st.except_valid_rows(t.readings, flt.filter_valid_2000_2013(t.readings), "event_id")
    return rest.select("event_id", "aqs_code", "o3")


@query("intersect_columns_union", sql(READINGS, f"""
SELECT event_id, {r('o3', 'o3')} FROM readings UNION ALL
SELECT event_id, {r('o3', 'o3')} FROM readings WHERE o3 > 40"""))
def _(t: Tables):
    first = t.readings.select("event_id", "aqs_code", "o3")
    return st.intersect_columns_union(first, t.readings.filter("o3 > 40").select("temp", "o3", "event_id"))


@query("sort_rows", sql(READINGS, f"SELECT event_id, aqs_code, {r('o3', 'o3')} FROM readings ORDER BY aqs_code, event_id"))
def _(t: Tables):
    return st.sort_rows(t.readings.select("event_id", "aqs_code", "o3"), ["aqs_code", "event_id"])


@query("head_n", sql(READINGS, f"""
SELECT event_id, aqs_code, epoch, {r('temp', 'temp')} FROM readings ORDER BY epoch, event_id LIMIT 288"""))
def _(t: Tables):
    return st.head_n(t.readings.select("event_id", "aqs_code", "epoch", "temp"), 288, ["epoch", "event_id"])


@query("sample_rows", sql(READINGS, f"""
SELECT event_id, aqs_code, {r('o3', 'o3')} FROM readings WHERE (event_id * 7919 + 104729) % 1000 < 100"""))
def _(t: Tables):
    return st.sample_rows(t.readings.select("event_id", "aqs_code", "o3"), 0.1, "event_id")
