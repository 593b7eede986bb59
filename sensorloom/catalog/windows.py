"""Row windows, sequences, labels, imputation, the configured chain and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalog.base import READINGS, SITES, STATIONS, TIMED, Tables, query, r, rs, sql
from sensorloom.catalog.scalars import NEAREST, WINDOWS
from sensorloom.functions.scalar import time_parts, wind_vector
from sensorloom.operators import impute as im
from sensorloom.operators import ml
from sensorloom.operators import profile as pf
from sensorloom.operators import rowwindows as rw
from sensorloom.operators.filters import filter_valid_flags
from sensorloom.operators.joins import nearest_k_sites
from sensorloom.plans.chain import chain_from_config, pipeline_from_config
from sensorloom.plans.prepare import prepare_sequences
from sensorloom.plans.staging import new_path, staged
from sensorloom.sources.sinks import write_yearly_csv

FEATURES = ["o3", "no", "temp", "windspd"]
QUOTED = ', '.join(f'"{f}"' for f in FEATURES)
LENGTH, AHEAD = 24, 6

NUMBERED = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY aqs_code ORDER BY epoch, event_id) - 1 AS rn,
  count(*) OVER (PARTITION BY aqs_code) AS n_site FROM readings)"""
# Sequences end at window e and hold the windows e - 23 .. e; six windows follow.
ENDS = f"""
placed AS (SELECT *, count(*) OVER (PARTITION BY aqs_code) AS n,
  lead(o3) OVER (PARTITION BY aqs_code ORDER BY window_no) AS label_o3 FROM windows),
ends AS (SELECT aqs_code, window_no, label_o3 FROM placed WHERE window_no >= {LENGTH - 1} AND window_no + {AHEAD} < n),
steps AS (SELECT e.aqs_code, e.window_no, e.label_o3, CAST(w.window_no - e.window_no + {LENGTH - 1} AS INTEGER) AS step,
  {', '.join(f'w."{f}"' for f in FEATURES)}
  FROM ends e JOIN windows w ON w.aqs_code = e.aqs_code AND w.window_no BETWEEN e.window_no - {LENGTH - 1} AND e.window_no)"""
OVER = f"OVER (PARTITION BY aqs_code ORDER BY window_no ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW)"


def windows_of(t: Tables):
    return rw.tumble_rows(t.readings, FEATURES)


def sequences_of(t: Tables, **options):
    return rw.sequence_build(windows_of(t), FEATURES, LENGTH, AHEAD, **options)


# --- tumbling and sliding ---------------------------------------------------

@query("tumble_rows", sql(READINGS, WINDOWS, f"SELECT aqs_code, window_no, {rs(*FEATURES)} FROM windows"))
def _(t: Tables):
    return windows_of(t)


@query("tumble_rows_plain", sql(READINGS, NUMBERED, f"""
SELECT aqs_code, rn // 12 AS window_no, {r('avg(o3)', 'o3')}, {r('avg(temp)', 'temp')} FROM numbered
WHERE (rn // 12 + 1) * 12 < n_site GROUP BY 1, 2"""))
def _(t: Tables):
    return rw.tumble_rows_plain(t.readings, ["o3", "temp"], drop_last_full=True)


@query("tumble_rows_mean_mode", sql(READINGS, NUMBERED, f"""
counts AS (SELECT aqs_code, rn // 12 AS window_no, o3_flag, count(*) AS c FROM numbered GROUP BY 1, 2, 3),
modes AS (SELECT aqs_code, window_no, first(o3_flag ORDER BY c DESC, o3_flag) AS o3_flag FROM counts GROUP BY 1, 2),
means AS (SELECT aqs_code, rn // 12 AS window_no, avg(o3) AS o3 FROM numbered GROUP BY 1, 2 HAVING count(*) = 12)""", f"""
SELECT aqs_code, window_no, {r('o3', 'o3')}, o3_flag FROM means JOIN modes USING (aqs_code, window_no)"""))
def _(t: Tables):
    return rw.tumble_rows_mean_mode(t.readings, ["o3"], ["o3_flag"])


@query("slide_window", sql(READINGS, NUMBERED, f"""
framed AS (SELECT aqs_code, rn AS window_no, n_site,
  avg(o3) OVER w AS o3, avg(temp) OVER w AS temp, lead(epoch, 6) OVER (PARTITION BY aqs_code ORDER BY rn) AS epoch
  FROM numbered WINDOW w AS (PARTITION BY aqs_code ORDER BY rn ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))""", f"""
SELECT aqs_code, window_no, {rs('o3', 'temp')}, epoch FROM framed WHERE window_no + 12 <= n_site"""))
def _(t: Tables):
    return rw.slide_window(t.readings, ["o3", "temp"], ["epoch"], 12)


# --- sequences --------------------------------------------------------------

@query("sequence_build", sql(READINGS, WINDOWS, ENDS, f"""
SELECT aqs_code, window_no, step, {r('label_o3', 'label_o3')}, {rs(*FEATURES)} FROM steps"""))
def _(t: Tables):
    return rw.sequence_unnest(sequences_of(t, with_labels=["o3"]), label="label_o3")


@query("sequence_flatten", sql(READINGS, WINDOWS, ENDS, f"""
cells AS ({' UNION ALL '.join(f"SELECT aqs_code, window_no, CAST(step * 4 + {i} AS INTEGER) AS pos, {f} AS value FROM steps" for i, f in enumerate(['o3', '"no"', 'temp', 'windspd']))})""",
f"SELECT aqs_code, window_no, pos, {r('value', 'value')} FROM cells"))
def _(t: Tables):
    flat = rw.sequence_flatten(sequences_of(t), FEATURES)
    return flat.select("aqs_code", "window_no", F.posexplode("flat").alias("pos", "value"))


@query("sequence_unnest", sql(READINGS, WINDOWS, ENDS, f"""
SELECT aqs_code, window_no, CAST(window_no % 3 AS BIGINT) AS cluster, step, {rs(*FEATURES)} FROM steps"""))
def _(t: Tables):
    labeled = sequences_of(t).withColumn("cluster", F.col("window_no") % 3)
    return rw.sequence_unnest(labeled, label="cluster")


@query("unrolled_feature_names", sql(READINGS, WINDOWS, ENDS, " UNION ALL ".join(
    f"SELECT aqs_code, window_no, concat(CAST(step AS VARCHAR), '_{f}') AS name, {r(chr(34) + f + chr(34), 'value')} FROM steps"
    for f in FEATURES)))
def _(t: Tables):
    return rw.unrolled_features(sequences_of(t), FEATURES)


@query("features_with_sequence", sql(READINGS, WINDOWS, ENDS, f"""
extras AS (SELECT aqs_code, window_no, sum(o3) {OVER} / 276.0 AS m, first(o3) {OVER} AS b, stddev_pop(o3) {OVER} AS s FROM windows),
cells AS ({' UNION ALL '.join(f"SELECT aqs_code, window_no, CAST(step * 4 + {i} AS INTEGER) AS pos, {f} AS value FROM steps" for i, f in enumerate(['o3', '"no"', 'temp', 'windspd']))}
  UNION ALL {' UNION ALL '.join(f"SELECT aqs_code, window_no, {LENGTH * 4 + i}, {c} FROM extras SEMI JOIN ends USING (aqs_code, window_no)" for i, c in enumerate("mbs"))})""",
f"SELECT aqs_code, window_no, pos, {r('value', 'value')} FROM cells"))
def _(t: Tables):
    built = sequences_of(t, enrich=["o3"])
    joined = rw.features_with_sequence(built, FEATURES, ["o3_m", "o3_b", "o3_std"])
    return joined.select("aqs_code", "window_no", F.posexplode("features").alias("pos", "value"))


@query("seq_regression_features", sql(READINGS, WINDOWS, f"""
parts AS (SELECT aqs_code, window_no, sum(temp) {OVER} / 276.0 AS temp_m, first(temp) {OVER} AS temp_b,
  sum(o3) {OVER} / 276.0 AS o3_m, first(o3) {OVER} AS o3_b FROM windows)""", f"""
SELECT aqs_code, window_no, {rs('temp_m', 'temp_b', 'o3_m', 'o3_b')} FROM parts WHERE window_no >= {LENGTH - 1}"""))
def _(t: Tables):
    return rw.seq_regression_features(windows_of(t), ["temp", "o3"], LENGTH)


@query("seq_std_features", sql(READINGS, WINDOWS, f"""
parts AS (SELECT aqs_code, window_no, stddev_pop(temp) {OVER} AS temp_std, stddev_pop(o3) {OVER} AS o3_std FROM windows)""", f"""
SELECT aqs_code, window_no, {rs('temp_std', 'o3_std')} FROM parts WHERE window_no >= {LENGTH - 1}"""))
def _(t: Tables):
    return rw.seq_std_features(windows_of(t), ["temp", "o3"], LENGTH)


# --- labels -----------------------------------------------------------------

@query("label_future_mean", sql(READINGS, WINDOWS, f"""
future AS (SELECT aqs_code, window_no, count(*) OVER (PARTITION BY aqs_code) AS n,
  avg(o3) OVER w AS u_o3, avg("no") OVER w AS u_no FROM windows
  WINDOW w AS (PARTITION BY aqs_code ORDER BY window_no ROWS BETWEEN 1 FOLLOWING AND {AHEAD} FOLLOWING))""", f"""
SELECT aqs_code, window_no, {rs('u_o3', 'u_no')} FROM future WHERE window_no + {AHEAD} < n"""))
def _(t: Tables):
    return rw.label_future_mean(windows_of(t), ["o3", "no"], AHEAD)


@query("label_next_row", sql(READINGS, WINDOWS, f"""
SELECT a.aqs_code, a.window_no, {r('b.o3', 'label_o3')} FROM windows a
JOIN windows b ON a.aqs_code = b.aqs_code AND b.window_no = a.window_no + 1"""))
def _(t: Tables):
    return rw.label_next_row(windows_of(t), ["o3"])


@query("label_threshold_or", sql(READINGS, WINDOWS, f"""
hits AS (SELECT aqs_code, window_no, count(*) OVER (PARTITION BY aqs_code) AS n,
  NOT max(o3 > 60 OR "no" > 30) OVER (PARTITION BY aqs_code ORDER BY window_no ROWS BETWEEN 1 FOLLOWING AND {AHEAD} FOLLOWING) AS label
  FROM windows)""", f"""
SELECT aqs_code, window_no, label FROM hits WHERE window_no + {AHEAD} < n"""))
def _(t: Tables):
    labeled = rw.label_threshold_or(windows_of(t), {"o3": 60.0, "no": 30.0}, AHEAD, invert=True)
    return labeled.select("aqs_code", "window_no", "label")


@query("lookback_dataset", sql(READINGS, WINDOWS, f"""
rows_ AS (SELECT *, count(*) OVER (PARTITION BY aqs_code) AS n FROM windows)""", f"""
SELECT y.aqs_code, y.window_no, CAST(x.window_no - y.window_no + 4 AS INTEGER) AS step, {r('x."no"', 'no')}, {r('x.temp', 'temp')}, {r('x.windspd', 'windspd')}, {r('y.o3', 'y')}
FROM rows_ y JOIN rows_ x ON x.aqs_code = y.aqs_code AND x.window_no BETWEEN y.window_no - 4 AND y.window_no - 1
WHERE y.window_no >= 4 AND y.window_no < y.n - 1"""))
def _(t: Tables):
    data = rw.lookback_dataset(windows_of(t), FEATURES, "o3", 4)
    return data.select("aqs_code", "window_no", "y", F.posexplode("x").alias("step", "x")).select(
        "aqs_code", "window_no", "step", "x.*", "y"
    )


# --- lags, rolling values, spectra ------------------------------------------

_LAGS = ["windspd", "no", "no2", "nox", "o3"]


@query("lag_features", sql(READINGS, NUMBERED, f"""
lagged AS (SELECT event_id, rn, {', '.join(f'lag("{c}") OVER (PARTITION BY aqs_code ORDER BY rn) AS last_{c}' for c in _LAGS)} FROM numbered)""",
f"SELECT event_id, {rs(*[f'last_{c}' for c in _LAGS])} FROM lagged WHERE rn > 0"))
def _(t: Tables):
    return rw.lag_features(t.readings).select("event_id", *[f"last_{c}" for c in _LAGS])


@query("prev_hour_o3", sql(READINGS, """
hourly AS (SELECT aqs_code, epoch // 3600 AS hour_no, avg(o3) AS o3 FROM readings GROUP BY 1, 2),
lagged AS (SELECT *, lag(o3) OVER (PARTITION BY aqs_code ORDER BY hour_no) AS prev_o3 FROM hourly)""", f"""
SELECT aqs_code, hour_no, {rs('o3', 'prev_o3')} FROM lagged"""))
def _(t: Tables):
    hour = F.floor(F.col("epoch") / 3600).alias("hour_no")
    hourly = t.readings.groupBy("aqs_code", hour).agg(F.avg("o3").alias("o3"))
    return rw.prev_hour_o3(hourly, ["hour_no"])


@query("rolling_std", sql(READINGS, NUMBERED, """
rolled AS (SELECT event_id, rn, CASE WHEN count(winddir) OVER w = 12 THEN stddev_samp(winddir) OVER w END AS winddir_std
  FROM numbered WINDOW w AS (PARTITION BY aqs_code ORDER BY rn ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""", f"""
SELECT event_id, {r('winddir_std', 'winddir_std')} FROM rolled WHERE rn >= 12"""))
def _(t: Tables):
    return rw.rolling_std(t.readings).select("event_id", "winddir_std")


@query("rolling_forecast_frame", sql(READINGS, WINDOWS, f"""
bands AS (SELECT aqs_code, window_no, count(*) OVER (PARTITION BY aqs_code) AS n, o3 AS actual,
  avg(o3) OVER (PARTITION BY aqs_code ORDER BY window_no ROWS BETWEEN 1 FOLLOWING AND {AHEAD} FOLLOWING) AS future_mean,
  avg(o3) {OVER} AS rolling_mean, stddev_pop(o3) {OVER} AS s FROM windows),
wide AS (SELECT *, rolling_mean - s AS band_low, rolling_mean + s AS band_high FROM bands
  WHERE window_no >= {LENGTH - 1} AND window_no + {AHEAD} < n)""", " UNION ALL ".join(
    f"SELECT aqs_code, window_no, '{c}' AS series, {r(c, 'value')} FROM wide"
    for c in ("actual", "future_mean", "rolling_mean", "band_low", "band_high"))))
def _(t: Tables):
    return rw.rolling_forecast_frame(windows_of(t), "o3", LENGTH, AHEAD)


@query("dft_amplitude", sql(READINGS, """
slots AS (SELECT aqs_code, epoch // 86400 AS "day", epoch // 300 AS slot, 'o3' AS measure, avg(o3) AS value FROM readings GROUP BY ALL UNION ALL
  SELECT aqs_code, epoch // 86400, epoch // 300, 'windspd', avg(windspd) FROM readings GROUP BY ALL),
samples AS (SELECT *, row_number() OVER (PARTITION BY aqs_code, "day", measure ORDER BY slot) - 1 AS j,
  count(*) OVER (PARTITION BY aqs_code, "day", measure) AS n FROM slots WHERE value IS NOT NULL),
waves AS (SELECT *, unnest(generate_series(0, n // 2 - 1)) AS k FROM samples WHERE n >= 2),
spectrum AS (SELECT aqs_code, "day", measure, n, k, sum(value * cos(2 * pi() * ((k * j) % n) / n)) AS re,
  sum(value * sin(2 * pi() * ((k * j) % n) / n)) AS im FROM waves GROUP BY ALL)""", f"""
SELECT aqs_code, "day", measure, n, k, {r('sqrt(re * re + im * im) / n', 'amplitude')}, {r('k / (n * 300.0)', 'frequency')},
  {r('CASE WHEN k > 0 THEN n * 300.0 / (k * 3600) END', 'period_hours')} FROM spectrum"""))
def _(t: Tables):
    return rw.dft_amplitude(t.readings, ["o3", "windspd"])


# --- imputation -------------------------------------------------------------

DAILY = """
rows_ AS (SELECT event_id, aqs_code, epoch // 86400 AS "day", "no", o3 FROM station_readings),
daily_values AS (SELECT aqs_code, "day", avg("no") AS "no", avg(o3) AS o3 FROM rows_ GROUP BY 1, 2),
near AS (SELECT w.aqs_code, w."day", sum(n.weight * v."no") AS no_sum, sum(CASE WHEN v."no" IS NOT NULL THEN n.weight END) AS no_w,
  count(*) - count(v."no") AS no_miss, sum(n.weight * v.o3) AS o3_sum, sum(CASE WHEN v.o3 IS NOT NULL THEN n.weight END) AS o3_w,
  count(*) - count(v.o3) AS o3_miss
  FROM daily_values w JOIN weights n USING (aqs_code)
  LEFT JOIN daily_values v ON v.aqs_code = n.neighbor AND v."day" = w."day" GROUP BY 1, 2)"""


def _neighbor_sql(guess):
    parts = []
    for m in ("no", "o3"):
        g = guess.format(m=m)
        parts.append(r(f'coalesce(q."{m}", {g})', m))
        parts.append(
            f"CASE WHEN q.\"{m}\" IS NOT NULL THEN 'present' WHEN ({g}) IS NOT NULL THEN 'filled' ELSE 'insufficient' END AS {m}_status"
        )
    return f'SELECT event_id, aqs_code, "day", {", ".join(parts)} FROM rows_ q LEFT JOIN near USING (aqs_code, "day")'


def _impute_neighbors(t: Tables, renormalize: bool):
    rows = t.station_readings.select(
        "event_id", "aqs_code", F.floor(F.col("epoch") / 86400).alias("day"), "no", "o3"
    )
    weights = im.neighbor_weights(nearest_k_sites(t.stations, 4))
    return im.impute_neighbors(rows, weights, ["no", "o3"], at="day", renormalize=renormalize)


@query("impute_neighbors", sql(STATIONS, NEAREST, DAILY, _neighbor_sql("CASE WHEN {m}_miss = 0 THEN {m}_sum END")))
def _(t: Tables):
    return _impute_neighbors(t, False)


@query("impute_neighbors_rescaled", sql(STATIONS, NEAREST, DAILY, _neighbor_sql("CASE WHEN {m}_miss < 3 THEN {m}_sum / {m}_w END")))
def _(t: Tables):
    return _impute_neighbors(t, True)


@query("impute_bracket_mean", sql(READINGS, NUMBERED, """
around AS (SELECT event_id, o3, "no",
  last_value(o3 IGNORE NULLS) OVER a AS p1, first_value(o3 IGNORE NULLS) OVER b AS n1,
  last_value("no" IGNORE NULLS) OVER a AS p2, first_value("no" IGNORE NULLS) OVER b AS n2 FROM numbered
  WINDOW a AS (PARTITION BY aqs_code ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY aqs_code ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", f"""
SELECT event_id, {r('coalesce(o3, (p1 + n1) / 2)', 'o3')}, {r('coalesce("no", (p2 + n2) / 2)', 'no')} FROM around"""))
def _(t: Tables):
    rows = t.readings.select("event_id", "aqs_code", "epoch", "o3", "no")
    return im.impute_bracket_mean(rows, ["o3", "no"]).select("event_id", "o3", "no")


@query("impute_column_mean", sql(READINGS, f"""
SELECT event_id, {r('coalesce(o3, (SELECT avg(o3) FROM readings))', 'o3')},
  {r('coalesce(nox, (SELECT avg(nox) FROM readings))', 'nox')} FROM readings"""))
def _(t: Tables):
    rows = t.readings.select("event_id", "o3", "nox", F.lit(None).cast("double").alias("co"))
    return im.impute_column_mean(rows, ["o3", "nox", "co"])


# --- splits and metrics -----------------------------------------------------

@query("split_random", sql(READINGS, """
SELECT event_id, aqs_code, CASE WHEN (event_id * 7919 + 104729) % 1000 < 750 THEN 'train' ELSE 'test' END AS part FROM readings"""))
def _(t: Tables):
    return ml.split_random(t.readings, "event_id", 0.75).select("event_id", "aqs_code", "part")


def _chronological(share: str) -> str:
    return sql(READINGS, "ordered AS (SELECT event_id, row_number() OVER (ORDER BY epoch, event_id) - 1 AS rn, count(*) OVER () AS n FROM readings)",
               f"SELECT event_id, CASE WHEN rn < floor(n * CAST({share} AS DOUBLE)) THEN 'train' ELSE 'validate' END AS part FROM ordered")


@query("split_chronological", _chronological("0.66"))
def _(t: Tables):
    return ml.split_chronological(t.readings, ["epoch", "event_id"]).select("event_id", "part")


@query("split_tail_validation", _chronological("(1 - CAST(0.2 AS DOUBLE))"))
def _(t: Tables):
    return ml.split_tail_validation(t.readings, ["epoch", "event_id"]).select("event_id", "part")


_PREDICTED = """scored AS (SELECT o3 AS y, CASE WHEN "no" IS NOT NULL THEN 2 * "no" + temp / 100 END AS p FROM readings)"""


def _scored(t: Tables):
    return t.readings.select(F.col("o3").alias("y"), (F.col("no") * 2 + F.col("temp") / 100).alias("p"))


@query("metric_r2", sql(READINGS, _PREDICTED, f"""
SELECT {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y) + 1e-7)', 'r2')} FROM scored WHERE y IS NOT NULL AND p IS NOT NULL"""))
def _(t: Tables):
    return ml.metric_r2(_scored(t), "y", "p")


@query("metric_mae", sql(READINGS, _PREDICTED, f"SELECT {r('avg(abs(p - y))', 'mae')} FROM scored"))
def _(t: Tables):
    return ml.metric_mae(_scored(t), "y", "p")


@query("metric_mse", sql(READINGS, _PREDICTED, f"SELECT {r('avg((p - y) * (p - y))', 'mse')} FROM scored"))
def _(t: Tables):
    return ml.metric_mse(_scored(t), "y", "p")


# --- chains -----------------------------------------------------------------

CONFIG = {
    "years": [2013, 2015],
    "nanhandling": {"method": "fill", "value": 10000.0},
    "dependent_generation": [
        {"name": "high", "function": "threshold_or", "future_samples": 10, "keys": ["no", "o3"],
         "thresholds": [40.0, 80.0], "invert": False}
    ],
    "windowers": [
        {"name": "short", "samples": 6, "sequencer": {"samples": 8}, "keys": [
            {"name": "epoch", "type": "discrete"}, {"name": "temp", "type": "continuous"}, {"name": "o3", "type": "continuous"}]}
    ],
}


_CHAIN = sql(READINGS, """
filled AS (SELECT aqs_code, epoch, event_id, temp, coalesce(o3, 10000) AS o3, coalesce("no", 10000) AS "no" FROM readings),
numbered AS (SELECT *, row_number() OVER (PARTITION BY aqs_code ORDER BY epoch, event_id) - 1 AS rn FROM filled),
labeled AS (SELECT *, max("no" > 40 OR o3 > 80) OVER (PARTITION BY aqs_code ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS high,
  lead(rn, 10) OVER (PARTITION BY aqs_code ORDER BY rn) AS ahead FROM numbered),
kept AS (SELECT * FROM labeled WHERE ahead IS NOT NULL),
slid AS (SELECT aqs_code, rn AS window_no, avg(temp) OVER w AS temp, avg(o3) OVER w AS o3, lead(epoch, 3) OVER o AS epoch,
  lead(high, 3) OVER o AS high, lead(rn, 5) OVER o AS last_rn FROM kept
  WINDOW w AS (PARTITION BY aqs_code ORDER BY rn ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), o AS (PARTITION BY aqs_code ORDER BY rn)),
full_windows AS (SELECT * FROM slid WHERE last_rn IS NOT NULL)""", f"""
SELECT e.aqs_code, e.window_no, CAST(s.window_no - e.window_no + 7 AS INTEGER) AS step, {r('s.temp', 'temp')}, {r('s.o3', 'o3')}, s.epoch, s.high
FROM full_windows e JOIN full_windows s ON s.aqs_code = e.aqs_code AND s.window_no BETWEEN e.window_no - 7 AND e.window_no
WHERE e.window_no >= 7""")


@query("chain_from_config", _CHAIN)
def _(t: Tables):
    return rw.sequence_unnest(chain_from_config(t.readings, CONFIG)["short"])


@query("pipeline_from_config", _CHAIN)
def _(t: Tables):
    """Yearly files in, one written table per windower out."""
    path, columns = new_path(t.spark, "configured"), ["aqs_code", "event_id", "epoch", "no", "o3", "temp"]
    rows = t.readings.select(*columns, "data_year")
    write_yearly_csv(rows, f"{path}/in", CONFIG["years"])
    config = CONFIG | {"input_path": f"{path}/in", "input_prefix": "Data_", "output_path": f"{path}/out"}
    return rw.sequence_unnest(pipeline_from_config(t.spark, config, rows.select(*columns).schema)["short"])


_VALID = """CASE WHEN data_year < 2014
  THEN nox_flag = 'VAL' AND no_flag = 'VAL' AND no2_flag = 'VAL' AND o3_flag = 'VAL' AND temp_flag = 'VAL'
  ELSE nox_flag = 'K' AND no_flag = 'K' AND o3_flag = 'K' AND temp_flag = 'K' END AND winddir IS NOT NULL"""
_FLAGSHIP = ["o3", "temp", "wind_x_dir", "wind_y_dir", "hour", "day_of_year"]


def _block(c):
    return f'CASE WHEN 12 - count("{c}") <= 3 THEN avg("{c}") END AS "{c}"'


def _scale(c):
    return r(f'CASE WHEN b."{c}_min" = b."{c}_max" THEN 0 ELSE coalesce((w."{c}" - b."{c}_min") / abs(b."{c}_max" - b."{c}_min"), 0) END', c)


@query("flagship_scaled_windows", sql(TIMED, f"""
valid AS (SELECT *, windspd * cos(radians(winddir)) AS wind_x_dir, windspd * sin(radians(winddir)) AS wind_y_dir FROM timed WHERE {_VALID}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY aqs_code ORDER BY epoch, event_id) - 1 AS rn FROM valid),
windows AS (SELECT aqs_code, rn // 12 AS window_no, {', '.join(map(_block, _FLAGSHIP))} FROM numbered GROUP BY 1, 2 HAVING count(*) = 12),
bounds AS (SELECT {', '.join(f'min("{c}") AS "{c}_min", max("{c}") AS "{c}_max"' for c in _FLAGSHIP)} FROM windows)""", f"""
SELECT aqs_code, window_no, {', '.join(map(_scale, _FLAGSHIP))} FROM windows w, bounds b"""))
def _(t: Tables):
    rows = time_parts(wind_vector(filter_valid_flags(t.readings)))
    # Written once: the bounds and the scaled rows both read it.
    windows = staged(rw.tumble_rows(rows, _FLAGSHIP, mask=None), "windows")
    scaled = pf.minmax_scale(windows, _FLAGSHIP, pf.global_minmax(windows, _FLAGSHIP))
    return scaled.na.fill(0.0)


def _step(c):
    return f'CASE WHEN b."{c}_min" = b."{c}_max" THEN 0 ELSE coalesce((w."{c}" - b."{c}_min") / abs(b."{c}_max" - b."{c}_min"), 0) END'


def _as_o3(expression: str, name: str) -> str:
    return r(f"coalesce(({expression} - o3_min) / nullif(abs(o3_max - o3_min), 0), 0)", name)


@query("prepare_sequences", sql(TIMED, SITES[len(READINGS) + 1 :], f"""
valid AS (SELECT *, windspd * cos(radians(winddir)) AS wind_x_dir, windspd * sin(radians(winddir)) AS wind_y_dir FROM timed WHERE {_VALID}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY aqs_code ORDER BY epoch, event_id) - 1 AS rn FROM valid),
windows AS (SELECT aqs_code, rn // 12 AS window_no, {', '.join(map(_block, _FLAGSHIP))} FROM numbered GROUP BY 1, 2 HAVING count(*) = 12),
bounds AS (SELECT {', '.join(f'min("{c}") AS "{c}_min", max("{c}") AS "{c}_max"' for c in _FLAGSHIP)} FROM windows),
placed AS (SELECT *, count(*) OVER (PARTITION BY aqs_code) AS n, lead(o3) OVER (PARTITION BY aqs_code ORDER BY window_no) AS label_o3,
  coalesce(sum(o3) {OVER}, 0) / {float(sum(range(LENGTH)))} AS o3_m, first(o3) {OVER} AS o3_b, stddev_pop(o3) {OVER} AS o3_std FROM windows),
ends AS (SELECT * FROM placed WHERE window_no >= {LENGTH - 1} AND window_no + {AHEAD} < n)""", f"""
SELECT e.aqs_code, e.window_no, CAST(w.window_no - e.window_no + {LENGTH - 1} AS INTEGER) AS step,
  {', '.join(r(_step(c), c) for c in _FLAGSHIP)}, {_as_o3('e.label_o3', 'label_o3')}, {_as_o3('e.o3_m', 'o3_m')}, {_as_o3('e.o3_b', 'o3_b')},
  {_as_o3('e.o3_std', 'o3_std')}, {r('(latitude + 90) / 180', 'lat_scaled')}, {r('(longitude + 180) / 360', 'long_scaled')}
FROM ends e JOIN windows w ON w.aqs_code = e.aqs_code AND w.window_no BETWEEN e.window_no - {LENGTH - 1} AND e.window_no
  LEFT JOIN sites ON sites.aqs_code = e.aqs_code, bounds b"""))
def _(t: Tables):
    """The whole run, from readings to saved sequences."""
    saved = prepare_sequences(t.readings, t.sites, new_path(t.spark, "prepared"), _FLAGSHIP, ["o3"], ["o3"], length=LENGTH, prediction=AHEAD)
    steps = saved.select("*", F.posexplode("seq").alias("step", "s"))
    return steps.select("aqs_code", "window_no", "step", "s.*", "label_o3", "o3_m", "o3_b", "o3_std", "lat_scaled", "long_scaled")
