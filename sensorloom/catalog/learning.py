"""Streams, matrix completion and machine-learning data work."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from sensorloom.catalog.base import READINGS, TIMED, Tables, query, r, rs, sql
from sensorloom.catalog.cleaning import ALL, VALID_BY_ERA, cols
from sensorloom.catalog.scalars import WINDOWS
from sensorloom.catalog.windows import AHEAD, ENDS, FEATURES, LENGTH
from sensorloom.functions.scalar import time_parts, wind_vector
from sensorloom.operators import cluster, ml, spectral
from sensorloom.operators import completion as co
from sensorloom.operators.filters import filter_valid_flags
from sensorloom.operators.forest import rf_regress_multi
from sensorloom.operators.rowwindows import sequence_unnest
from sensorloom.operators.sets import top_importances
from sensorloom.plans.staging import new_path, staged
from sensorloom.streaming import streams

INPUTS = ["temp", "windspd", "winddir", "hour", "no2"]


# --- streams ----------------------------------------------------------------

@query("stream_transform", sql(TIMED, f"""
SELECT {cols(*ALL)}, {r('windspd * cos(radians(winddir))', 'wind_x_dir')}, {r('windspd * sin(radians(winddir))', 'wind_y_dir')},
  "hour", day_of_year FROM timed WHERE {VALID_BY_ERA}"""))
def _(t: Tables):
    path = new_path(t.spark, "stream")
    steps = [filter_valid_flags, wind_vector, time_parts]
    streams.stream_transform(t.stream_readings(), steps, f"{path}/rows", f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/rows")


@query("stream_tumble_rows", sql(READINGS, WINDOWS, f"SELECT aqs_code, window_no, {rs(*FEATURES)} FROM windows"))
def _(t: Tables):
    return streams.stream_tumble_rows(t.stream_readings(), FEATURES, new_path(t.spark, "stream"), files=1)


@query("stream_sequences", sql(READINGS, WINDOWS, ENDS, f"SELECT aqs_code, window_no, step, {rs(*FEATURES)} FROM steps"))
def _(t: Tables):
    path = new_path(t.spark, "stream")
    windows = streams.stream_tumble_rows(t.stream_readings(), FEATURES, path)
    # Files of windows, not all at once.
    arriving = t.spark.readStream.schema(windows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/windows")
    built = streams.stream_sequences(arriving, FEATURES, new_path(t.spark, "stream"), length=LENGTH, prediction=AHEAD)
    return sequence_unnest(built)


@query("stream_running_minmax", sql(READINGS, f"""
SELECT aqs_code, {r('min(o3)', 'o3_min')}, {r('min(temp)', 'temp_min')}, {r('max(o3)', 'o3_max')}, {r('max(temp)', 'temp_max')}
FROM readings GROUP BY 1"""))
def _(t: Tables):
    return streams.stream_running_minmax(t.stream_readings(), ["o3", "temp"], new_path(t.spark, "stream"))


@query("stream_hourly_mean", sql(READINGS, f"""
SELECT aqs_code, epoch // 3600 * 3600 AS hour_epoch, {r('avg(o3)', 'o3')}, {r('avg(temp)', 'temp')} FROM readings
GROUP BY 1, 2"""))
def _(t: Tables):
    return streams.stream_hourly_mean(t.stream_readings(), ["o3", "temp"], new_path(t.spark, "stream"))


# --- matrix completion ------------------------------------------------------

CELLS = """
cells AS (SELECT CAST(epoch // 3600 AS INTEGER) AS "row", concat(aqs_code, '|', m) AS "col", avg(v) AS value
  FROM (SELECT aqs_code, epoch, 'o3' AS m, o3 AS v FROM readings UNION ALL SELECT aqs_code, epoch, 'temp', temp FROM readings)
  GROUP BY 1, 2)"""


#: Peels of the core and rounds of the plain alternation: enough for a fixed point on the given tables.
PEELS, ROUNDS = 8, 160


def _even(peels: int, rounds: int) -> list[str]:
    """SQL of the fixed point: ``ro`` has the offset and scale of each row, ``co`` those of each column."""
    core = ['c0 AS (SELECT "row", "col", value FROM cells WHERE value IS NOT NULL)']
    for k in range(peels):
        core.append(f"""c{k + 1} AS (SELECT * FROM c{k}
  QUALIFY count(*) OVER (PARTITION BY "row") >= 3 AND count(*) OVER (PARTITION BY "col") >= 3)""")
    return [
        *core,
        f"""o AS MATERIALIZED (SELECT c0."row" AS i, c0."col" AS j, c0.value AS x, c{peels}.value IS NOT NULL AS core
  FROM c0 LEFT JOIN c{peels} ON c0."row" = c{peels}."row" AND c0."col" = c{peels}."col")""",
        f"""st AS (
  SELECT 0 AS it, j, avg(x) AS b, CAST(0 AS DOUBLE) AS v FROM o GROUP BY j
  UNION ALL
  SELECT it, j, b, coalesce(v + g, avg(v + g) OVER (), 0) FROM (
    SELECT it + 1 AS it, j, any_value(b) + sum(e / t) / sum(1 / t) AS b, any_value(g) AS g,
      0.5 * ln(avg(power((e - d) / t, 2)) FILTER (core)) AS v
    FROM (
      SELECT *, sum(e / t) OVER (PARTITION BY j) / sum(1 / t) OVER (PARTITION BY j) AS d,
        coalesce(sum(ln(t) / nc) FILTER (core) OVER () / sum(1 / nc) FILTER (core) OVER (), 0) AS g
      FROM (
        SELECT *, coalesce(sqrt(avg(power(e * q, 2)) FILTER (core) OVER (PARTITION BY i)), 1) AS t,
          count(*) FILTER (core) OVER (PARTITION BY i) AS nc
        FROM (
          SELECT *, x - b - sum(q * (x - b)) OVER (PARTITION BY i) / sum(q) OVER (PARTITION BY i) AS e
          FROM (SELECT o.*, it, b, exp(-v) AS q FROM o JOIN st USING (j) WHERE it < {rounds}))))
    GROUP BY it, j))""",
        f"en AS (SELECT j, b, exp(-v) AS q FROM st WHERE it = {rounds})",
        """ra AS (SELECT i, sum(q * (x - b)) / sum(q) AS a FROM o JOIN en USING (j) GROUP BY i)""",
        """ro AS (SELECT i, any_value(a) - any_value(m) AS a, coalesce(sqrt(avg(power((x - a - b) * q, 2)) FILTER (core)), 1) AS t
  FROM o JOIN en USING (j) JOIN ra USING (i), (SELECT avg(a) AS m FROM ra) GROUP BY i)""",
        """co AS (SELECT j, b + m AS b, 1 / q AS s FROM en, (SELECT avg(a) AS m FROM ra))""",
    ]


@query("biscale", sql(READINGS, CELLS, *_even(PEELS, ROUNDS), """
SELECT cells."row", cells."col", round(value, 6) AS value, round((value - a - b) / t / s, 3) + 0.0 AS scaled,
  round(coalesce(a, 0) + coalesce(b, (SELECT avg(b) FROM co)), 2) + 0.0 AS shift,
  round(coalesce(t, 1) * coalesce(s, (SELECT exp(avg(ln(s))) FROM co)), 2) AS "scale", coalesce(CAST(core AS INTEGER), 0) AS core
FROM cells LEFT JOIN ro ON i = "row" LEFT JOIN co ON j = "col" LEFT JOIN o ON o.i = "row" AND "col" = o.j""").replace("WITH ", "WITH RECURSIVE ", 1))
def _(t: Tables):
    """Every cell's value, shift and scale at the fixed point; SQL gets there by plain alternation."""
    cells = co.biscale(co.matrix_cells(t.readings, ["o3", "temp"]), tolerance=1e-10)
    return cells.withColumns({"scaled": F.round("scaled", 3), "shift": F.round("shift", 2), "scale": F.round("scale", 2)})


@query("impute_low_rank")
def _(t: Tables):
    return co.impute_low_rank(co.matrix_cells(t.readings, ["o3", "nox", "temp"]))


@query("impute_by_model", sql(READINGS, """
known AS (SELECT regr_slope("no", windspd) AS slope, regr_intercept("no", windspd) AS base FROM readings
  WHERE data_year < 2014 AND "no" IS NOT NULL)""", f"""
SELECT event_id, data_year, {r('coalesce("no", slope * windspd + base)', 'no')}, "no" IS NULL AS no_imputed FROM readings, known"""))
def _(t: Tables):
    rows = t.readings.select("event_id", "data_year", "windspd", "no")
    estimator = LinearRegression(labelCol="no")
    filled = ml.impute_by_model(rows, estimator, ["windspd"], "no", F.col("data_year") < 2014)
    return filled.select("event_id", "data_year", "no", "no_imputed")


# --- regression -------------------------------------------------------------

def _examples(t: Tables, label: str = "o3"):
    """Assembled rows with the label, split by key and staged for the repeated passes of a fit."""
    rows = t.timed.filter(F.col(label).isNotNull()).select("event_id", *INPUTS, F.col(label).alias("label"))
    ready = staged(ml.split_random(ml.assemble(rows, INPUTS), "event_id"), "examples")
    return ready.filter("part = 'train'"), ready.filter("part = 'test'")


@query("fit_minmax_scaler", sql(READINGS, """
train AS (SELECT min(temp) AS a, max(temp) AS b, min(windspd) AS c, max(windspd) AS d FROM readings WHERE data_year = 2013)""", f"""
SELECT event_id, {r('(temp - a) / (b - a)', 'temp')}, {r('(windspd - c) / (d - c)', 'windspd')} FROM readings, train"""))
def _(t: Tables):
    path = new_path(t.spark, "scaler")
    rows = ml.assemble(t.readings.select("event_id", "data_year", "temp", "windspd"), ["temp", "windspd"])
    # Fitted on the training years only, then applied to all rows.
    ml.fit_minmax_scaler(rows.filter("data_year = 2013"), path)
    scaled = vector_to_array("scaled")
    return ml.load_minmax_scaler(path).transform(rows).select(
        "event_id", scaled[0].alias("temp"), scaled[1].alias("windspd")
    )


@query("rf_regress")
def _(t: Tables):
    _, scored = ml.rf_regress(*_examples(t), "label")
    return scored.select("event_id", "label", "prediction")


@query("rf_regress_multi")
def _(t: Tables):
    targets = ["no", "nox", "o3"]
    rows = t.timed.dropna(subset=[*INPUTS, *targets]).select("event_id", *INPUTS, *targets)
    ready = staged(ml.split_random(rows, "event_id"), "examples")
    _, scored = rf_regress_multi(ready.filter("part = 'train'"), ready.filter("part = 'test'"), INPUTS, targets)
    return scored.select("event_id", *targets, *[f"pred_{x}" for x in targets])


@query("rf_best_of_seeds")
def _(t: Tables):
    train, test = _examples(t)
    model, seed, r2 = ml.rf_best_of_seeds(train, test, "label", seeds=3)
    return model.transform(test).select("event_id", "label", "prediction").withColumns(
        {"seed": F.lit(seed), "r2": F.lit(r2)}
    )


@query("gbt_regress")
def _(t: Tables):
    _, scored = ml.gbt_regress(*_examples(t), "label")
    return scored.select("event_id", "label", "prediction")


@query("linear_regress", sql(TIMED, """
rows_ AS (SELECT *, (event_id * 7919 + 104729) % 1000 < 750 AS train FROM timed WHERE o3 IS NOT NULL),
line AS (SELECT regr_slope(o3, "hour") AS slope, regr_intercept(o3, "hour") AS base FROM rows_ WHERE train)""", f"""
SELECT event_id, {r('o3', 'label')}, {r('base + slope * "hour"', 'prediction')} FROM rows_, line WHERE NOT train"""))
def _(t: Tables):
    rows = t.timed.filter("o3 IS NOT NULL").select("event_id", "hour", F.col("o3").alias("label"))
    ready = staged(ml.split_random(ml.assemble(rows, ["hour"]), "event_id"), "examples")
    _, scored = ml.linear_regress(ready.filter("part = 'train'"), ready.filter("part = 'test'"), "label")
    return scored.select("event_id", "label", "prediction")


@query("feature_importance")
def _(t: Tables):
    train, test = _examples(t)
    model, _ = ml.rf_regress(train, test, "label")
    return ml.feature_importance(model, INPUTS, train)


@query("top_importances")
def _(t: Tables):
    train, test = _examples(t, label="nox")
    model, _ = ml.rf_regress(train, test, "label")
    return top_importances(ml.feature_importance(model, INPUTS, train), 3)


@query("cross_validate")
def _(t: Tables):
    train, _ = _examples(t)
    return ml.cross_validate(train, ml.random_forest(), "label")


@query("grid_search")
def _(t: Tables):
    train, _ = _examples(t)
    return ml.grid_search(train, "label", trees=[10], subsets=["onethird", "all"], leaf_rows=[1, 10, 50])


# --- clustering and components ----------------------------------------------

def _embedded(t: Tables):
    return t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))


@query("kmeans_sweep", """
SELECT CAST(k AS INTEGER) AS k, true AS converged, true AS within_total, n AS n_rows
FROM (SELECT unnest(generate_series(4, 18, 2)) AS k), (SELECT count(*) AS n FROM embeddings)""")
def _(t: Tables):
    """Every fit converges, has at most the inertia of a single cluster, and puts each row into a cluster."""
    rows = staged(_embedded(t), "embedded")
    total = cluster.kmeans_fits(rows, [1], seeds=1)[0].inertia
    return cluster.kmeans_sweep(rows).select("k", "converged", (F.col("inertia") <= total).alias("within_total"), "n_rows")


@query("cluster_sizes", """
SELECT CAST(k AS INTEGER) AS k, n AS n_rows, k AS n_clusters FROM (SELECT unnest([4, 8]) AS k), (SELECT count(*) AS n FROM embeddings)""")
def _(t: Tables):
    """Sizes of the labelled clusters add up to all rows."""
    rows = staged(_embedded(t), "embedded")
    labelled = cluster.cluster_labels(rows, cluster.kmeans_fits(rows, [4, 8]), ["vec_id"])
    sizes = cluster.cluster_sizes(labelled)
    return sizes.groupBy("k").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_clusters"))


@query("cluster_centres")
def _(t: Tables):
    rows = staged(_embedded(t), "embedded")
    return cluster.cluster_centres(rows, cluster.kmeans_fits(rows, [8])).select("k", "cluster", "n_rows", F.posexplode("centre").alias("dim", "value"))


@query("pca_variance")
def _(t: Tables):
    scaled = ml.fit_minmax_scaler(ml.vectors(_embedded(t), "features", "vector"), column="vector")
    rows = scaled.transform(ml.vectors(_embedded(t), "features", "vector")).select(vector_to_array("scaled").alias("scaled"))
    return spectral.pca_variance(staged(rows, "scaled"))
