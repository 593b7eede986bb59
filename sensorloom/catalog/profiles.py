"""Joins, aggregates and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalog.base import HISTORY, READINGS, SITES, STATIONS, TIMED, Tables, query, r, rs, sql
from sensorloom.catalog.scalars import GRID, NEAREST
from sensorloom.operators import joins as jn
from sensorloom.operators import profile as pf
from sensorloom.operators.reshape import time_grid
from sensorloom.operators.rowwindows import complete_runs, tumble_rows

HOUR_KEYS = '"year", "month", "day", "hour"'


# --- joins ------------------------------------------------------------------

@query("join_site_coords", sql(SITES, f"""
SELECT event_id, aqs_code, {rs('o3', 'latitude', 'longitude')} FROM readings LEFT JOIN sites USING (aqs_code)"""))
def _(t: Tables):
    return jn.join_site_coords(t.readings.select("event_id", "aqs_code", "o3"), t.sites)


@query("semi_join_valid_sites", sql(HISTORY, f"""
valid AS (SELECT aqs_code FROM (SELECT aqs_code, "month", count(o3) AS a, count(nox) AS b FROM history GROUP BY 1, 2)
  WHERE a > 0 AND b > 0 GROUP BY 1 HAVING count(*) >= 12)""", f"""
SELECT aqs_code, epoch, {rs('o3', 'temp')} FROM history WHERE aqs_code IN (SELECT aqs_code FROM valid)"""))
def _(t: Tables):
    valid = pf.sites_with_monthly_data(t.history, ["o3", "nox"])
    return jn.semi_join_valid_sites(t.history.select("aqs_code", "epoch", "o3", "temp"), valid)


@query("semi_join_high_o3_days", sql(TIMED, f"""
SELECT event_id, aqs_code, epoch, {r('o3', 'o3')} FROM timed
WHERE (aqs_code, "date") IN (SELECT aqs_code, "date" FROM timed WHERE o3 > 100)"""))
def _(t: Tables):
    return jn.semi_join_high_o3_days(t.readings.select("event_id", "aqs_code", "epoch", "o3"), 100.0)


@query("left_join_time_grid", sql(READINGS, GRID, f"""
SELECT aqs_code, epoch, event_id, {rs('o3', 'temp')} FROM grid LEFT JOIN readings USING (aqs_code, epoch)"""))
def _(t: Tables):
    rows = t.readings.select("aqs_code", "epoch", "event_id", "o3", "temp")
    return jn.left_join_time_grid(time_grid(t.readings), rows)


@query("neighbor_pairs", sql(STATIONS, f"""
SELECT aqs_code, neighbor, {r('distance', 'distance')} FROM (
  SELECT a.aqs_code, b.aqs_code AS neighbor,
    round(sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2)), 9) AS distance
  FROM stations a JOIN stations b ON a.aqs_code <> b.aqs_code) WHERE distance <= 0.25"""))
def _(t: Tables):
    return jn.neighbor_pairs(t.stations, 0.25)


@query("neighbor_places", sql(STATIONS, """
places AS (SELECT latitude, longitude, count(DISTINCT aqs_code) AS n FROM stations GROUP BY 1, 2)""", f"""
SELECT {r('latitude', 'latitude')}, {r('longitude', 'longitude')}, {r('lat2', 'lat2')}, {r('long2', 'long2')}, {r('distance', 'distance')}, n_sites, n_neighbors
FROM (SELECT a.latitude, a.longitude, b.latitude AS lat2, b.longitude AS long2, a.n AS n_sites, b.n AS n_neighbors,
    round(sqrt(pow(a.latitude - b.latitude, 2) + pow(a.longitude - b.longitude, 2)), 9) AS distance
  FROM places a, places b) WHERE distance <= 0.25 AND (n_sites > 1 OR latitude <> lat2 OR longitude <> long2)"""))
def _(t: Tables):
    return jn.neighbor_places(t.stations, 0.25)


@query("nearest_k_sites", sql(STATIONS, NEAREST, f"""
SELECT aqs_code, neighbor, {r('distance', 'distance')}, rank FROM nearest"""))
def _(t: Tables):
    return jn.nearest_k_sites(t.stations, 4)


DAILY = """
daily_values AS (SELECT aqs_code, epoch // 86400 AS "day", avg("no") AS "no", avg(o3) AS o3 FROM station_readings GROUP BY 1, 2)"""


@query("neighbor_lookup", sql(STATIONS, NEAREST, DAILY, f"""
SELECT w.aqs_code, n.neighbor, w."day", n.rank, {r('v."no"', 'neighbor_no')}, {r('v.o3', 'neighbor_o3')}
FROM daily_values w JOIN nearest n USING (aqs_code)
LEFT JOIN daily_values v ON v.aqs_code = n.neighbor AND v."day" = w."day" """))
def _(t: Tables):
    rows = t.station_readings.withColumn("day", F.floor(F.col("epoch") / 86400))
    near = jn.nearest_k_sites(t.stations, 4).drop("distance")
    return jn.neighbor_lookup(rows, near, ["no", "o3"], at="day")


RUNS = """
instants AS (SELECT DISTINCT aqs_code, epoch // 3600 * 3600 AS epoch FROM readings),
islands AS (SELECT aqs_code, epoch // 86400 AS "day", epoch,
  epoch - 3600 * row_number() OVER (PARTITION BY aqs_code, epoch // 86400 ORDER BY epoch) AS run FROM instants),
runs AS (SELECT aqs_code, "day", min(epoch) AS run_start, max(epoch) AS run_end, count(*) AS n_rows
  FROM islands GROUP BY aqs_code, "day", run HAVING count(*) >= 6)"""


@query("complete_runs", sql(READINGS, RUNS, 'SELECT aqs_code, "day", run_start, run_end, n_rows FROM runs'))
def _(t: Tables):
    return complete_runs(t.readings, min_rows=6, step=3600)


@query("ground_truth_rows", sql(READINGS, RUNS, f"""
SELECT event_id, aqs_code, h.epoch, {r('h.o3', 'o3')} FROM (SELECT * REPLACE (epoch // 3600 * 3600 AS epoch) FROM readings) h
WHERE EXISTS (SELECT 1 FROM runs u WHERE u.aqs_code = h.aqs_code AND h.epoch BETWEEN u.run_start AND u.run_end)"""))
def _(t: Tables):
    hour = (F.floor(F.col("epoch") / 3600) * 3600).alias("epoch")
    rows = t.readings.select("event_id", "aqs_code", hour, "o3")
    return jn.ground_truth_rows(rows, complete_runs(t.readings, 6, 3600), by_site=True, step=3600)


@query("pair_site_features", sql(READINGS, f"""
SELECT epoch, 0 AS site_no, {r('o3', 'a_o3')}, {r('temp', 'a_temp')}, {r('NULL', 'b_o3')}, {r('NULL', 'b_temp')}
FROM readings WHERE aqs_code = '48_201_0001' UNION ALL
SELECT epoch, 1, NULL, NULL, {r('o3', 'b_o3')}, {r('temp', 'b_temp')} FROM readings WHERE aqs_code = '48_201_0002'"""))
def _(t: Tables):
    return jn.pair_site_features(t.readings, "48_201_0001", "48_201_0002", ["o3", "temp"])


@query("pair_site_features_joined", sql(READINGS, f"""
SELECT epoch, {r('a.o3', 'a_o3')}, {r('a.temp', 'a_temp')}, {r('b.o3', 'b_o3')}, {r('b.temp', 'b_temp')}
FROM (SELECT epoch, avg(o3) AS o3, avg(temp) AS temp FROM readings WHERE aqs_code = '48_201_0001' GROUP BY 1) a
JOIN (SELECT epoch, avg(o3) AS o3, avg(temp) AS temp FROM readings WHERE aqs_code = '48_201_0002' GROUP BY 1) b
USING (epoch)"""))
def _(t: Tables):
    return jn.pair_site_features(t.readings, "48_201_0001", "48_201_0002", ["o3", "temp"], join=True)


# --- means ------------------------------------------------------------------

@query("hourly_mean_all_sites", sql(TIMED, f"""
SELECT {HOUR_KEYS}, {r('avg("no")', 'no')}, {r('avg(o3)', 'o3')}, {r('avg(temp)', 'temp')} FROM timed GROUP BY {HOUR_KEYS}"""))
def _(t: Tables):
    return pf.hourly_mean_all_sites(t.timed, ["no", "o3", "temp"])


@query("hourly_mean_by_site", sql(TIMED, f"""
SELECT aqs_code, {HOUR_KEYS}, {r('avg("no")', 'no')}, {r('avg(o3)', 'o3')}, {r('avg(temp)', 'temp')}
FROM timed GROUP BY aqs_code, {HOUR_KEYS}
HAVING count(*) - count("no") <= 9 AND count(*) - count(o3) <= 9 AND count("no") > 0 AND count(o3) > 0"""))
def _(t: Tables):
    return pf.hourly_mean_by_site(t.timed, ["no", "o3", "temp"])


@query("daily_coverage_filter", sql(READINGS, f"""
SELECT event_id, aqs_code, epoch, {r('o3', 'o3')} FROM readings WHERE (aqs_code, epoch // 86400) IN (
  SELECT aqs_code, epoch // 86400 FROM readings GROUP BY 1, 2 HAVING count(DISTINCT epoch // 3600) >= 0.75 * 24)"""))
def _(t: Tables):
    return pf.daily_coverage_filter(t.readings.select("event_id", "aqs_code", "epoch", "o3"), 0.75)


# --- missing values ---------------------------------------------------------

def _missing(columns, source, extra="", group=""):
    return " UNION ALL ".join(
        f"SELECT {extra} '{c}' AS \"column\", "
        + r(f"round(avg(CASE WHEN \"{c}\" IS NULL THEN 1.0 ELSE 0.0 END), 4) * 100", "percent")
        + f" FROM {source} {group}"
        for c in columns
    )


PROFILED = ["o3", "no", "nox", "temp", "co"]


@query("percent_missing", sql(HISTORY, _missing(["aqs_code", "epoch", *PROFILED], "history")))
def _(t: Tables):
    return pf.percent_missing(t.history, ["aqs_code", "epoch", *PROFILED])


@query("percent_missing_by_month", sql(HISTORY, _missing(PROFILED, "history", '"month",', 'GROUP BY "month"')))
def _(t: Tables):
    return pf.percent_missing_by_month(t.history, PROFILED)


@query("percent_missing_year_matrix", sql(HISTORY, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", " + ", ".join(
        r(f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE data_year = {y}), 4) * 100", str(y))
        for y in range(1995, 2002)) + " FROM history WHERE aqs_code = '48_201_0007'" for c in ("o3", "nox", "co"))))
def _(t: Tables):
    return pf.percent_missing_year_matrix(t.history, "48_201_0007", ["o3", "nox", "co"], range(1995, 2002))


@query("all_null_site_columns", sql(HISTORY, " UNION ALL ".join(
    f"SELECT aqs_code, '{c}' AS \"column\" FROM history GROUP BY 1 HAVING count({c}) = 0" for c in ("o3", "nox", "co"))))
def _(t: Tables):
    return pf.all_null_site_columns(t.history, ["o3", "nox", "co"])


@query("null_rows_per_site", sql(READINGS, """
SELECT aqs_code, count(*) AS n_rows FROM readings WHERE o3 IS NULL OR nox IS NULL GROUP BY 1"""))
def _(t: Tables):
    return pf.null_rows_per_site(t.readings, ["o3", "nox"])


@query("null_hour_tally", sql(TIMED, """
cells AS (SELECT aqs_code, "month", "day", "hour", count("no") AS a, count(nox) AS b, count(o3) AS c
  FROM timed GROUP BY 1, 2, 3, 4)""", """
SELECT aqs_code, "hour", count(*) FILTER (WHERE a = 0) AS "no", count(*) FILTER (WHERE b = 0) AS nox,
  count(*) FILTER (WHERE c = 0) AS o3 FROM cells GROUP BY 1, 2"""))
def _(t: Tables):
    return pf.null_hour_tally(t.timed, ["no", "nox", "o3"])


@query("sites_with_monthly_data", sql(HISTORY, """
SELECT aqs_code FROM (SELECT aqs_code, "month" FROM history GROUP BY 1, 2 HAVING count(o3) > 0 AND count(nox) > 0)
GROUP BY 1 HAVING count(*) >= 12"""))
def _(t: Tables):
    return pf.sites_with_monthly_data(t.history, ["o3", "nox"])


# --- counts -----------------------------------------------------------------

@query("value_counts", sql(READINGS, """
SELECT CASE WHEN nox_flag = 'LST' THEN NULL ELSE nox_flag END AS nox_flag, count(*) AS n FROM readings GROUP BY 1"""))
def _(t: Tables):
    flag = F.when(F.col("nox_flag") != "LST", F.col("nox_flag")).alias("nox_flag")
    return pf.value_counts(t.readings.select(flag), "nox_flag")


@query("distinct_values", sql(READINGS, "SELECT DISTINCT aqs_code FROM readings"))
def _(t: Tables):
    return pf.distinct_values(t.readings, "aqs_code")


@query("hour_value_counts_where", sql(TIMED, 'SELECT "hour", count(*) AS n FROM timed WHERE o3 IS NULL GROUP BY 1'))
def _(t: Tables):
    return pf.hour_value_counts_where(t.timed, F.col("o3").isNull())


@query("subset_row_counts", sql(HISTORY, """
days AS (SELECT DISTINCT aqs_code, "date" FROM history WHERE o3 > 70),
tagged AS (SELECT h.*, d."date" IS NOT NULL AS high FROM history h LEFT JOIN days d USING (aqs_code, "date"))""", """
SELECT data_year, 'overall' AS subset, count(*) AS n_rows FROM tagged GROUP BY 1 UNION ALL
SELECT data_year, 'daytime', count(*) FROM tagged WHERE "hour" BETWEEN 7 AND 19 GROUP BY 1 UNION ALL
SELECT data_year, 'nighttime', count(*) FROM tagged WHERE "hour" < 7 OR "hour" > 20 GROUP BY 1 UNION ALL
SELECT data_year, 'highpol_months', count(*) FROM tagged WHERE "month" BETWEEN 4 AND 10 GROUP BY 1 UNION ALL
SELECT data_year, 'higho3_days', count(*) FROM tagged WHERE high GROUP BY 1"""))
def _(t: Tables):
    return pf.subset_row_counts(t.history, limit=70.0)


# --- distributions ----------------------------------------------------------

def _numeric_stats(c: str) -> str:
    return (
        f'count("{c}") AS "count", ' + r(f'avg("{c}")', "mean") + ", " + r(f'stddev_samp("{c}")', "std") + ", "
        + r(f'min("{c}")', "min") + ", "
        + ", ".join(r(f'quantile_cont("{c}", {q})', n) for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
        + ", " + r(f'max("{c}")', "max")
    )


def _text_stats(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS \"count\", count(*) AS \"unique\", "
        "first(v ORDER BY n DESC, v) AS top, first(n ORDER BY n DESC, v) AS freq, NULL AS mean, NULL AS std, "
        'NULL AS "min", NULL AS p25, NULL AS p50, NULL AS p75, NULL AS "max" '
        f"FROM (SELECT {c} AS v, count(*) AS n FROM readings WHERE {c} IS NOT NULL GROUP BY 1)"
    )


DESCRIBED = ["epoch_day", "no", "o3", "temp", "winddir"]


# The epoch in days: its deviation in seconds has more digits than sums of doubles keep.
@query("describe_columns", sql(READINGS, "placed AS (SELECT *, epoch / 86400.0 AS epoch_day FROM readings)", " UNION ALL ".join(
    [_text_stats("aqs_code"), _text_stats("nox_flag")]
    + [f"SELECT '{c}', count(\"{c}\"), NULL, NULL, NULL, " + _numeric_stats(c).split(", ", 1)[1] + " FROM placed" for c in DESCRIBED])))
def _(t: Tables):
    placed = t.readings.withColumn("epoch_day", F.col("epoch") / 86400)
    return pf.describe_columns(placed, DESCRIBED, ["aqs_code", "nox_flag"])


_SUBSETS = {
    "overall": "true", "daytime": '"hour" BETWEEN 7 AND 19', "nighttime": '("hour" < 7 OR "hour" > 20)',
    "highpol_months": '"month" BETWEEN 4 AND 10', "higho3_days": "high",
}


@query("describe_by_site_year", sql(HISTORY, """
days AS (SELECT DISTINCT aqs_code, "date" FROM history WHERE o3 > 70),
tagged AS (SELECT h.*, d."date" IS NOT NULL AS high FROM history h LEFT JOIN days d USING (aqs_code, "date"))""",
" UNION ALL ".join(
    f"SELECT aqs_code, data_year, '{s}' AS subset, '{c}' AS \"column\", {_numeric_stats(c)} FROM tagged WHERE {w} "
    f"GROUP BY 1, 2 HAVING count({c}) > 0" for s, w in _SUBSETS.items() for c in ("o3", "nox"))))
def _(t: Tables):
    return pf.describe_by_site_year(t.history, ["o3", "nox"], limit=70.0)


def _limits(columns, source):
    return "limits AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, quantile_cont({c}, 0.5) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lim, "
        f"quantile_cont({c}, 0.5) + 3 * stddev_samp({c}) AS lim3, stddev_samp({c}) * pow(count({c}), -0.2) AS h, "
        f"count({c}) AS total FROM {source}" for c in columns) + "), vals AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, {c} AS v FROM {source} WHERE {c} IS NOT NULL" for c in columns) + ")"


_HIST = """
binned AS (SELECT c, least(CAST(floor(v * 10 / lim) AS BIGINT), 9) AS bin, count(*) AS n
  FROM vals JOIN limits USING (c) WHERE v >= 0 AND v <= lim GROUP BY 1, 2),
hist AS (SELECT l.c, b.bin, lim * b.bin / 10 AS bin_start, lim * (b.bin + 1) / 10 AS bin_end, coalesce(n, 0) AS n
  FROM limits l CROSS JOIN (SELECT unnest(generate_series(0, 9)) AS bin) b LEFT JOIN binned g ON g.c = l.c AND g.bin = b.bin)"""


@query("histogram_iqr", sql(READINGS, _limits(["o3", "nox", "temp"], "readings"), _HIST, f"""
SELECT c AS "column", bin, {rs('bin_start', 'bin_end')}, n FROM hist"""))
def _(t: Tables):
    return pf.histogram_iqr(t.readings, ["o3", "nox", "temp"])


@query("histogram_density", sql(READINGS, _limits(["o3", "nox", "temp"], "readings"), _HIST, f"""
SELECT c AS "column", bin, {rs('bin_start', 'bin_end')},
  {r('n / (sum(n) OVER (PARTITION BY c) * (bin_end - bin_start))', 'density')} FROM hist"""))
def _(t: Tables):
    return pf.histogram_density(t.readings, ["o3", "nox", "temp"])


@query("upper_limit_3std", sql(READINGS, _limits(["o3", "nox", "temp"], "readings"), f"""
SELECT c AS "column", {r('lim3', 'limit')} FROM limits"""))
def _(t: Tables):
    return pf.upper_limit_3std(t.readings, ["o3", "nox", "temp"])


@query("kernel_density", sql(READINGS, _limits(["o3", "temp"], "readings"), f"""
points AS (SELECT unnest(generate_series(0, 31)) AS point)""", f"""
SELECT c AS "column", CAST(point AS INTEGER) AS point, {r('lim * point / 31', 'x')},
  {r('sum(exp(-0.5 * pow((lim * point / 31 - v) / h, 2))) / (total * h * sqrt(2 * pi()))', 'density')}
FROM vals JOIN limits USING (c) CROSS JOIN points GROUP BY c, point, lim, h, total"""))
def _(t: Tables):
    return pf.kernel_density(t.readings, ["o3", "temp"], points=32)


@query("flag_outliers", sql(READINGS, _limits(["o3", "nox"], "readings"), f"""
SELECT event_id, {rs('o3', 'nox')},
  coalesce(o3 < 0 OR o3 > (SELECT lim FROM limits WHERE c = 'o3'), false) AS o3_outlier,
  coalesce(nox < 0 OR nox > (SELECT lim FROM limits WHERE c = 'nox'), false) AS nox_outlier FROM readings"""))
def _(t: Tables):
    return pf.flag_outliers(t.readings.select("event_id", "o3", "nox"), ["o3", "nox"])


CORRELATED = ["no", "no2", "nox", "o3", "temp", "winddir", "windspd"]


@query("correlation_matrix", sql(READINGS, " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + r(f'corr("{a}", "{b}")', "r") + " FROM readings"
    for a in CORRELATED for b in CORRELATED)))
def _(t: Tables):
    return pf.correlation_matrix(t.readings, CORRELATED)


@query("global_minmax", sql(READINGS, """
numbered AS (SELECT *, row_number() OVER (PARTITION BY aqs_code ORDER BY epoch, event_id) - 1 AS rn FROM readings),
windows AS (SELECT CASE WHEN 12 - count(o3) <= 3 THEN avg(o3) END AS o3, CASE WHEN 12 - count(temp) <= 3 THEN avg(temp) END AS temp
  FROM numbered GROUP BY aqs_code, rn // 12 HAVING count(*) = 12)""", f"""
SELECT {r('min(o3)', 'o3_min')}, {r('max(o3)', 'o3_max')}, {r('min(temp)', 'temp_min')}, {r('max(temp)', 'temp_max')}
FROM windows"""))
def _(t: Tables):
    return pf.global_minmax(tumble_rows(t.readings, ["o3", "temp"], mask=None), ["o3", "temp"])
