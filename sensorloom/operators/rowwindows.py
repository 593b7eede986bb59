"""Row-count windows, sequences, labels, lags, runs and spectra.

Raw rows get an exact row number per site first; everything after that runs on
chunks of row numbers (see ``plans.ordered``), so a hot site is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.plans.ordered import number_rows, over_chunks
from sensorloom.schema import (
    BLOCK_ROWS, EPOCH, MAX_NULL_SHARE, PREDICTION_ROWS, READING_SECONDS, ROW_ID, SEQUENCE_ROWS, SITE,
)

ORDER = (EPOCH, ROW_ID)
WINDOW = "window_no"


# --- tumbling blocks --------------------------------------------------------

def _blocks(df: DataFrame, rows: int, order: Sequence[str], keep_count: bool = False) -> DataFrame:
    numbered = number_rows(df, [SITE], order, out="_rn", count="_rows" if keep_count else None)
    return numbered.withColumn(WINDOW, F.floor(F.col("_rn") / rows))


def block_means(
    df: DataFrame, features: Sequence[str], rows: int, max_null_share: float, mask: float | None
) -> DataFrame:
    """Means of the full blocks named by (site, window_no), null rule applied."""
    grouped = df.groupBy(SITE, WINDOW).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(f).alias(f) for f in features],
        *[F.count(f).alias(f"_n_{f}") for f in features],
    )
    enough = lambda f: (rows - F.col(f"_n_{f}")) <= rows * max_null_share
    values = [F.when(enough(f), F.col(f)).otherwise(F.lit(mask).cast("double")).alias(f) for f in features]
    return grouped.filter(F.col("_n") == rows).select(SITE, WINDOW, *values)


def tumble_rows(
    df: DataFrame,
    features: Sequence[str],
    rows: int = BLOCK_ROWS,
    max_null_share: float = MAX_NULL_SHARE,
    mask: float | None = 0.0,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Mean of every full block of ``rows`` rows per site.

    A feature with more than ``max_null_share`` nulls in the block gets ``mask``
    (None keeps it null, which leaves it out of later bounds).
    """
    return block_means(_blocks(df, rows, order), features, rows, max_null_share, mask)


def tumble_rows_plain(
    df: DataFrame,
    features: Sequence[str],
    rows: int = BLOCK_ROWS,
    drop_last_full: bool = False,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Block means without a null rule.

    ``drop_last_full`` leaves out a full block that ends exactly at the site's last row.
    """
    blocks = _blocks(df, rows, order, keep_count=True)
    last = (F.col(WINDOW) + 1) * rows
    fits = last < F.col("_rows") if drop_last_full else last <= F.col("_rows")
    return blocks.filter(fits).groupBy(SITE, WINDOW).agg(*[F.avg(f).alias(f) for f in features])


def tumble_rows_mean_mode(
    df: DataFrame,
    features: Sequence[str],
    categorical: Sequence[str],
    rows: int = BLOCK_ROWS,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Block mean of measures, block mode of categorical columns (smallest value on a tie)."""
    grouped = _blocks(df, rows, order).groupBy(SITE, WINDOW).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(f).alias(f) for f in features],
        *[F.mode(c, deterministic=True).alias(c) for c in categorical],
    )
    return grouped.filter(F.col("_n") == rows).drop("_n")


def slide_window(
    df: DataFrame,
    continuous: Sequence[str],
    discrete: Sequence[str] = (),
    rows: int = BLOCK_ROWS,
    order: Sequence[str] = ORDER,
    row: str | None = None,
) -> DataFrame:
    """Stride-1 window of ``rows`` rows: mean of continuous, middle row of discrete features.

    ``row`` names a dense row number per site if ``df`` already has one.
    """
    numbered = df.withColumn(WINDOW, F.col(row)) if row else number_rows(df, [SITE], order, out=WINDOW)
    needed = numbered.select(SITE, WINDOW, *dict.fromkeys([*continuous, *discrete]))
    columns = {f"_w_{c}": lambda w, c=c: F.avg(c).over(w.rowsBetween(0, rows - 1)) for c in continuous}
    columns |= {f"_w_{c}": lambda w, c=c: F.lead(c, rows // 2).over(w) for c in discrete}
    columns["_last"] = lambda w: F.lead(WINDOW, rows - 1).over(w)
    framed = over_chunks(needed, [SITE], WINDOW, columns, after=rows - 1)
    return framed.filter(F.col("_last").isNotNull()).select(
        SITE, WINDOW, *[F.col(f"_w_{c}").alias(c) for c in [*continuous, *discrete]]
    )


# --- sequences --------------------------------------------------------------

def _full(length: int) -> Column:
    return F.col(WINDOW) >= length - 1


def sequence_build(
    windows: DataFrame,
    features: Sequence[str],
    length: int = SEQUENCE_ROWS,
    prediction: int = PREDICTION_ROWS,
    drop_tail: int = 0,
    with_labels: Sequence[str] = (),
    enrich: Sequence[str] = (),
) -> DataFrame:
    """One row per sequence of ``length`` window rows that has ``prediction`` rows after it.

    ``seq`` is an array of feature structs; ``window_no`` is its last row. A site of
    n windows gives n - length - prediction + 1 sequences, ``drop_tail`` fewer if set.
    ``with_labels`` adds ``label_t``, the target in the row right after; ``enrich``
    adds slope, first value and deviation of features, all in the same pass.
    """
    reach = max(prediction + drop_tail, 1 if with_labels else 0)
    trailing = (-(length - 1), 0)
    columns = {"seq": lambda w: F.collect_list(F.struct(*features)).over(w.rowsBetween(*trailing))}
    if reach:
        columns["_ahead"] = lambda w: F.lead(WINDOW, reach).over(w)
    columns |= {f"label_{t}": lambda w, t=t: F.lead(t, 1).over(w) for t in with_labels}
    columns |= _enrichments(enrich, length)
    moments = {length: list(enrich)} if enrich else None
    framed = over_chunks(windows, [SITE], WINDOW, columns, before=length - 1, after=reach, moments=moments)
    complete = F.size("seq") == length
    if reach:
        complete = complete & F.col("_ahead").isNotNull()
    extra = [f"label_{t}" for t in with_labels] + [f"{f}_{part}" for f in enrich for part in ("m", "b", "std")]
    return framed.filter(complete).select(SITE, WINDOW, "seq", *extra)


def _enrichments(features: Sequence[str], length: int) -> dict[str, object]:
    """Slope, first value and deviation from the trailing moments of ``over_chunks``."""
    steps = float(sum(range(length)))
    columns: dict[str, object] = {}
    for f in features:
        n, mean, m2 = (F.col(f"_{part}{length}_{f}") for part in ("n", "mean", "m2"))
        total = F.coalesce(n * mean, F.lit(0.0))
        columns[f"{f}_m"] = lambda w, total=total: F.try_divide(total, F.lit(steps))
        columns[f"{f}_b"] = lambda w, f=f: F.lag(f, length - 1).over(w)
        columns[f"{f}_std"] = lambda w, n=n, m2=m2: F.when(n > 0, F.sqrt(m2 / n))
    return columns


def _enriched(windows: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    framed = over_chunks(
        windows, [SITE], WINDOW, _enrichments(features, length), before=length - 1, moments={length: list(features)}
    )
    return framed.filter(_full(length))


def seq_regression_features(windows: DataFrame, features: Sequence[str], length: int = SEQUENCE_ROWS) -> DataFrame:
    """Per sequence and feature m = sum of values / (0 + ... + L-1) and b = first value."""
    return _enriched(windows, features, length).select(SITE, WINDOW, *[f"{f}_{p}" for f in features for p in ("m", "b")])


def seq_std_features(windows: DataFrame, features: Sequence[str], length: int = SEQUENCE_ROWS) -> DataFrame:
    """Population deviation per sequence and feature, nulls skipped."""
    return _enriched(windows, features, length).select(SITE, WINDOW, *[f"{f}_std" for f in features])


def sequence_flatten(sequences: DataFrame, features: Sequence[str]) -> DataFrame:
    """``seq`` as one array of L x F doubles, time step by time step."""
    steps = F.transform("seq", lambda s: F.array(*[s[f].cast("double") for f in features]))
    return sequences.withColumn("flat", F.flatten(steps)).drop("seq")


def sequence_unnest(
    sequences: DataFrame, label: str | None = None, fraction: float | None = None, seed: int = 0
) -> DataFrame:
    """One row per time step, with the sequence's label; optionally a random share of sequences."""
    rows = sequences if fraction is None else sequences.sample(fraction=fraction, seed=seed)
    keep = [SITE, WINDOW, *([label] if label else [])]
    return rows.select(*keep, F.posexplode("seq").alias("step", "s")).select(*keep, "step", "s.*")


def unrolled_features(sequences: DataFrame, features: Sequence[str]) -> DataFrame:
    """(site, window_no, name, value) with the name ``{step}_{feature}`` of each flattened position."""
    steps = sequence_unnest(sequences).select(
        SITE, WINDOW, "step", *[F.col(f).cast("double").alias(f) for f in features]
    )
    long = steps.unpivot([SITE, WINDOW, "step"], list(features), "feature", "value")
    return long.select(SITE, WINDOW, F.concat_ws("_", "step", "feature").alias("name"), "value")


def features_with_sequence(sequences: DataFrame, features: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """Flattened sequence followed by the sequence features, one array column ``features``."""
    flat = sequence_flatten(sequences, features)
    return flat.withColumn("features", F.concat("flat", F.array(*extra))).drop("flat")


def describe_shape(sequences: DataFrame) -> DataFrame:
    """Number of sequences, steps and features of a sequence frame."""
    width = len(sequences.schema["seq"].dataType.elementType.fields)
    return sequences.agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.max(F.size("seq")).cast("long").alias("n_steps"),
        F.lit(width).cast("long").alias("n_features"),
    )


# --- labels -----------------------------------------------------------------

def label_future_mean(windows: DataFrame, targets: Sequence[str], prediction: int = PREDICTION_ROWS) -> DataFrame:
    """Mean of each target over the next ``prediction`` rows, only where all of them exist."""
    columns = {f"u_{t}": lambda w, t=t: F.avg(t).over(w.rowsBetween(1, prediction)) for t in targets}
    columns["_ahead"] = lambda w: F.lead(WINDOW, prediction).over(w)
    framed = over_chunks(windows, [SITE], WINDOW, columns, after=prediction)
    return framed.filter(F.col("_ahead").isNotNull()).select(SITE, WINDOW, *[f"u_{t}" for t in targets])


def label_next_row(windows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Target in the row right after; the last row of a site has none and goes."""
    columns = {f"label_{t}": lambda w, t=t: F.lead(t, 1).over(w) for t in targets}
    columns["_ahead"] = lambda w: F.lead(WINDOW, 1).over(w)
    framed = over_chunks(windows, [SITE], WINDOW, columns, after=1)
    return framed.filter(F.col("_ahead").isNotNull()).select(SITE, WINDOW, *[f"label_{t}" for t in targets])


def label_threshold_or(
    df: DataFrame,
    thresholds: dict[str, float],
    future: int,
    invert: bool = False,
    row: str = WINDOW,
    out: str = "label",
) -> DataFrame:
    """True when any measure exceeds its threshold in the next ``future`` rows.

    Rows without ``future`` rows after them are left out. The next exceeding row is
    carried backwards, so the cost does not depend on ``future``.
    """
    hit = F.lit(False)
    for c, t in thresholds.items():
        hit = hit | F.coalesce(F.col(c) > t, F.lit(False))
    marked = df.withColumn("_hit", F.when(hit, F.col(row)))
    columns = {
        "_next": lambda w: F.last("_hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_ahead": lambda w: F.lag(row, future).over(w),
    }
    framed = over_chunks(marked, [SITE], row, columns, after=future, descending=True)
    value = F.coalesce(F.col("_next") - F.col(row) <= future, F.lit(False))
    return framed.filter(F.col("_ahead").isNotNull()).withColumn(out, ~value if invert else value).drop(
        "_hit", "_next", "_ahead"
    )


def lookback_dataset(windows: DataFrame, features: Sequence[str], target: str, look_back: int) -> DataFrame:
    """X = the previous ``look_back`` rows without the target, y = the target; a site's last row is unused."""
    inputs = [f for f in features if f != target]
    columns = {
        "x": lambda w: F.collect_list(F.struct(*inputs)).over(w.rowsBetween(-look_back, -1)),
        "_ahead": lambda w: F.lead(WINDOW, 1).over(w),
    }
    framed = over_chunks(windows, [SITE], WINDOW, columns, before=look_back, after=1)
    usable = (F.col(WINDOW) >= look_back) & F.col("_ahead").isNotNull()
    return framed.filter(usable).select(SITE, WINDOW, "x", F.col(target).alias("y"))


# --- lags and rolling values ------------------------------------------------

def lag_features(
    df: DataFrame,
    columns: Sequence[str] = ("windspd", "no", "no2", "nox", "o3"),
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Add ``last_c``, the previous row's value; a site's first row goes."""
    numbered = number_rows(df, [SITE], order)
    lags = {f"last_{c}": lambda w, c=c: F.lag(c, 1).over(w) for c in columns}
    return over_chunks(numbered, [SITE], "_rn", lags, before=1).filter(F.col("_rn") > 0).drop("_rn")


def prev_hour_o3(hourly: DataFrame, order: Sequence[str], value: str = "o3", width: int | None = None) -> DataFrame:
    """Add ``prev_o3``, the previous hourly value of the site."""
    numbered = number_rows(hourly, [SITE], order, width=width)
    lag = {f"prev_{value}": lambda w: F.lag(value, 1).over(w)}
    return over_chunks(numbered, [SITE], "_rn", lag, before=1).drop("_rn")


def rolling_std(
    df: DataFrame, column: str = "winddir", rows: int = 12, order: Sequence[str] = ORDER
) -> DataFrame:
    """Rolling deviation (n - 1) of ``rows`` rows; null when a row is null; the first ``rows`` rows go."""
    numbered = number_rows(df, [SITE], order)
    frame = (-(rows - 1), 0)
    columns = {
        f"{column}_std": lambda w: F.when(
            F.count(column).over(w.rowsBetween(*frame)) == rows, F.stddev_samp(column).over(w.rowsBetween(*frame))
        )
    }
    return over_chunks(numbered, [SITE], "_rn", columns, before=rows - 1).filter(F.col("_rn") >= rows).drop("_rn")


def rolling_forecast_frame(
    windows: DataFrame, target: str, length: int = SEQUENCE_ROWS, prediction: int = PREDICTION_ROWS
) -> DataFrame:
    """Actual value, future mean, rolling mean and the band of one deviation, in long form."""
    columns = {
        "future_mean": lambda w: F.lead(f"_mean{prediction}_{target}", prediction).over(w),
        "_ahead": lambda w: F.lead(WINDOW, prediction).over(w),
    }
    moments = {k: [target] for k in dict.fromkeys([length, prediction])}
    framed = over_chunks(windows, [SITE], WINDOW, columns, before=length - 1, after=prediction, moments=moments)
    mean, n = F.col(f"_mean{length}_{target}"), F.col(f"_n{length}_{target}")
    deviation = F.when(n > 0, F.sqrt(F.col(f"_m2{length}_{target}") / n))
    wide = framed.filter(_full(length) & F.col("_ahead").isNotNull()).select(
        SITE, WINDOW, F.col(target).alias("actual"), "future_mean", mean.alias("rolling_mean"),
        (mean - deviation).alias("band_low"), (mean + deviation).alias("band_high"),
    )
    series = ["actual", "future_mean", "rolling_mean", "band_low", "band_high"]
    return wide.unpivot([SITE, WINDOW], series, "series", "value")


# --- runs and spectra -------------------------------------------------------

def complete_runs(df: DataFrame, min_rows: int = 287, step: int = READING_SECONDS) -> DataFrame:
    """Runs of consecutive readings (``step`` seconds apart) per site and day, at least ``min_rows`` long.

    Instants are made distinct first, so a site day has at most 86400 / step rows.
    """
    day = F.floor(F.col(EPOCH) / 86400)
    instants = df.select(SITE, (F.floor(F.col(EPOCH) / step) * step).alias(EPOCH)).distinct().withColumn("day", day)
    number = F.row_number().over(Window.partitionBy(SITE, "day").orderBy(EPOCH))
    return (
        instants.withColumn("_run", F.col(EPOCH) - number * step)
        .groupBy(SITE, "day", "_run")
        .agg(F.min(EPOCH).alias("run_start"), F.max(EPOCH).alias("run_end"), F.count(F.lit(1)).alias("n_rows"))
        .filter(F.col("n_rows") >= min_rows)
        .drop("_run")
    )


def dft_amplitude(df: DataFrame, measures: Sequence[str], rate_seconds: int = READING_SECONDS) -> DataFrame:
    """One-sided spectrum of every site day and measure over the whole day.

    Readings are averaged on the grid of ``rate_seconds``; the n slots with a value, at
    most 86400 / rate of them, are one array and are transformed by a fast Fourier
    transform. Amplitude |Y| / n, frequency k / T and period in hours for k in
    0 .. n/2 - 1; days with fewer than two slots have none.
    """
    day, slot = F.floor(F.col(EPOCH) / 86400).alias("day"), F.floor(F.col(EPOCH) / rate_seconds).alias("_slot")
    means = df.groupBy(SITE, day, slot).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in measures])
    long = means.unpivot([SITE, "day", "_slot"], list(measures), "measure", "value").filter(F.col("value").isNotNull())
    arrays = long.groupBy(SITE, "day", "measure").agg(F.sort_array(F.collect_list(F.struct("_slot", "value"))).alias("_at"))
    ready = arrays.filter(F.size("_at") >= 2).select(SITE, "day", "measure", F.col("_at.value").alias("values"))

    def transform(batches):
        for batch in batches:
            spectra = [np.abs(np.fft.rfft(v))[: len(v) // 2] / len(v) for v in map(np.asarray, batch.column("values").to_pylist())]
            sizes = pa.array([len(v) for v in batch.column("values")], pa.int64())
            columns = [*(batch.column(c) for c in (SITE, "day", "measure")), sizes, pa.array(spectra, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[SITE, "day", "measure", "n", "amplitudes"])

    schema = f"{SITE} {ready.schema[SITE].dataType.simpleString()}, day long, measure string, n long, amplitudes array<double>"
    rows = ready.mapInArrow(transform, schema).select(SITE, "day", "measure", "n", F.posexplode("amplitudes").alias("k", "amplitude"))
    total = F.col("n") * rate_seconds
    return rows.select(
        SITE, "day", "measure", "n", F.col("k").cast("long").alias("k"), "amplitude",
        (F.col("k") / total).alias("frequency"),
        F.try_divide(total, F.col("k") * 3600).alias("period_hours"),
    )
