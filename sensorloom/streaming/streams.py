"""The batch operators on streams.

Row-count windows and sequences keep what is still open in Spark's state store. A first query
numbers the rows of every site as they arrive: a batch is numbered by blocks, as in the
batch operators, and a small table carries the rows that each site has had. With its number a
row belongs to a fixed *stretch* of its site, and the state is keyed by (site, stretch): a
hot site is many keys, and a key never holds more than a stretch. What is complete goes to
a file sink, so every window and every sequence is written exactly once, across failures and
restarts too. Late rows are numbered in the batch they arrive in and never re-windowed.

Hourly means come from Spark's own event-time state. Hours that can change no more are written
once and merged in tiers of ten, so the number of folders grows with the logarithm of
the number of batches. Small tables that a batch carries to the next lie in three places used in turn: batch
b reads place b - 1 and overwrites place b, so a replayed batch overwrites what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sensorloom.operators.rowwindows import ORDER, WINDOW
from sensorloom.plans.ordered import number_rows
from sensorloom.schema import BLOCK_ROWS, EPOCH, MAX_NULL_SHARE, PREDICTION_ROWS, SEQUENCE_ROWS, SITE

#: Windows (or sequences) of a stretch.
STRETCH = 4096
#: Files that a batch writes of numbered rows and of windows, whatever its size and the number of shuffle partitions;
#: so the batches that read them are as many as those that wrote them. Numbered rows get more beyond ``FILE_ROWS`` in each.
FILES, FILE_ROWS = 12, 2_000_000
#: Folders of a tier.
TIER = 10

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything that is available, batch by batch, then return."""
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(each).start()
    )
    query.awaitTermination()


def append_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append the rows of everything that is available to a table, each exactly once."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


@contextmanager
def _state_store(spark: SparkSession):
    """Queries started inside keep arbitrary state, which needs the RocksDB store."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def _place(path: str, name: str, batch_id: int) -> str:
    """Where a batch keeps a carried table; reused by the third batch after it."""
    return f"{path}/{name}/place={batch_id % 3}"


def _kept(rows: DataFrame, place: str) -> DataFrame:
    """Write ``rows`` over what the place held and continue from the written table."""
    rows.write.mode("overwrite").parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def _mark(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remember the last batch that was written in full."""
    spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("overwrite").parquet(_place(path, "last", batch_id))


def last_batch(spark: SparkSession, path: str) -> int:
    return spark.read.schema("batch long").parquet(f"{path}/last/place=*").agg(F.max("batch")).first()[0]


# --- stateless --------------------------------------------------------------

def stream_transform(
    stream: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], out: str, checkpoint: str
) -> None:
    """Apply row-wise batch functions to a stream and append the result to a table."""
    for step in steps:
        stream = stream.transform(step)
    append_available(stream, out, checkpoint)


# --- rows that are numbered as they arrive ----------------------------------

def number_batches(path: str, columns: Sequence[str], order: Sequence[str] = ORDER) -> Callable[[DataFrame, int], None]:
    """Batch function that writes the rows of a batch with ``_rn``, their number within the site over all batches, from 0."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.select(SITE, *dict.fromkeys([*order, *columns]))
        numbered = _kept(number_rows(own, [SITE], order), _place(path, "batch", batch_id))
        n_rows = numbered.count()
        counts = numbered.groupBy(SITE).agg(F.count(F.lit(1)).alias("n_rows"))
        if batch_id > 0:
            before = spark.read.schema(counts.schema).parquet(_place(path, "counts", batch_id - 1))
            numbered = (
                numbered.join(before, SITE, "left").withColumn("_rn", F.col("_rn") + F.coalesce("n_rows", F.lit(0))).drop("n_rows")
            )
            counts = before.unionByName(counts).groupBy(SITE).agg(F.sum("n_rows").alias("n_rows"))
        # Ranges keep the rows of a window together.
        files = max(FILES, -(-n_rows // FILE_ROWS))
        numbered.repartitionByRange(files, SITE, "_rn").write.mode("overwrite").parquet(f"{path}/numbered/batch={batch_id}")
        counts.write.mode("overwrite").parquet(_place(path, "counts", batch_id))

    return each


def _numbered_stream(stream: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], files: int | None) -> DataFrame:
    """Number all that is available; the numbered rows as a stream whose files go once they are read."""
    spark = stream.sparkSession
    run_available(stream, f"{path}/checkpoint/numbers", number_batches(path, columns, order))
    kinds = {f.name: f.dataType for f in stream.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in dict.fromkeys([SITE, *order, *columns])), "_rn long"])
    reader = spark.readStream.schema(schema).option("cleanSource", "delete")
    if files:
        reader = reader.option("maxFilesPerTrigger", files * FILES)
    return reader.parquet(f"{path}/numbered/batch=*")


class _Windows(StatefulProcessor):
    """State of a stretch: the rows of windows that are not full yet."""

    def __init__(self, features: list[str], rows: int, max_null_share: float, mask: float | None) -> None:
        self.features, self.rows, self.share, self.mask = features, rows, max_null_share, mask

    def init(self, handle) -> None:
        self.open = handle.getListState("open", f"{WINDOW} long, " + ", ".join(f"f{i} double" for i in range(len(self.features))))

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        new = pd.concat([p[[WINDOW, *self.features]] for p in parts], ignore_index=True).astype({f: float for f in self.features})
        held = pd.DataFrame(list(self.open.get()), columns=[WINDOW, *self.features])
        held = held.astype({WINDOW: "int64", **{f: float for f in self.features}})
        table = pd.concat([held, new], ignore_index=True) if len(held) else new
        grouped = table.groupby(WINDOW)
        size = grouped.size()
        full = size.index[size >= self.rows]
        rest = table[~table[WINDOW].isin(full)]
        left = [(int(w), *(None if np.isnan(x) else float(x) for x in line)) for w, *line in rest.itertuples(index=False)]
        if left:
            self.open.put(left)
        elif len(held):
            self.open.clear()
        done = grouped.mean().loc[full]
        missing = self.rows - grouped.count().loc[full]
        empty = np.nan if self.mask is None else self.mask
        done = done.where(missing <= self.rows * self.share, empty).reset_index()
        done.insert(0, SITE, key[0])
        yield done

    def close(self) -> None:
        pass


def stream_tumble_rows(
    stream: DataFrame,
    features: Sequence[str],
    path: str,
    rows: int = BLOCK_ROWS,
    max_null_share: float = MAX_NULL_SHARE,
    mask: float | None = 0.0,
    order: Sequence[str] = ORDER,
    files: int | None = None,
) -> DataFrame:
    """``tumble_rows`` over a stream; rows short of a full window wait in the state store.

    Everything that is available is processed; a later call with the same ``path`` goes on
    from there. Returns all windows so far, which lie in ``path``/windows. ``files`` bounds the
    numbered files that a batch takes, in batches of ``FILES``. Rows without a site belong to no window.
    """
    features = list(features)
    with _state_store(stream.sparkSession):
        numbered = _numbered_stream(stream, path, features, order, files)
        placed = numbered.select(SITE, F.floor(F.col("_rn") / rows).alias(WINDOW), *features)
        schema = f"{SITE} string, {WINDOW} long, " + ", ".join(f"`{f}` double" for f in features)
        built = (
            placed.withColumn("_stretch", F.floor(F.col(WINDOW) / STRETCH)).groupBy(SITE, "_stretch")
            .transformWithStateInPandas(_Windows(features, rows, max_null_share, mask), schema, "Append", "None")
        )
        # A file for each partition of the state would be a batch for each of them in a stream that reads a few files at a time.
        few = built.repartition(FILES, SITE, F.floor(F.col(WINDOW) / STRETCH))
        append_available(few, f"{path}/windows", f"{path}/checkpoint/windows")
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/windows")


class _Sequences(StatefulProcessor):
    """State of a stretch: the next sequence's last window, and the windows that it and later ones need."""

    def __init__(self, features: list[str], length: int, reach: int, stretch: int) -> None:
        self.features, self.length, self.reach, self.stretch = features, length, reach, stretch

    def init(self, handle) -> None:
        self.next = handle.getValueState("next", "window_no long")
        self.held = handle.getListState("held", f"{WINDOW} long, " + ", ".join(f"f{i} double" for i in range(len(self.features))))

    def handleInputRows(self, key, rows, timerValues):
        parts = list(rows)
        first = int(key[1]) * self.stretch
        end = int(self.next.get()[0]) if self.next.exists() else max(first, self.length - 1)
        held = list(self.held.get())
        number = np.concatenate([np.array([h[0] for h in held], np.int64), *[p[WINDOW].to_numpy(np.int64) for p in parts]])
        values = np.concatenate([np.array([h[1:] for h in held], float).reshape(-1, len(self.features)), *[p[self.features].to_numpy(float) for p in parts]])
        order = np.argsort(number, kind="stable")
        number, values = number[order], values[order]
        # Windows from the start of the next sequence on that follow each other without a gap.
        at = int(np.searchsorted(number, end - self.length + 1))
        run = int((number[at:] == end - self.length + 1 + np.arange(len(number) - at)).cumprod().sum())
        ends = max(0, min(end - self.length + run - self.reach, first + self.stretch - 1) - end + 1)
        if ends:
            block = values[at : at + ends + self.length - 1 + self.reach]
            flat = np.lib.stride_tricks.sliding_window_view(block[: ends + self.length - 1], self.length, axis=0).transpose(0, 2, 1).reshape(ends, -1)
            ahead = block[self.length : self.length + ends] if self.reach else np.full((ends, len(self.features)), np.nan)
            yield pd.DataFrame({SITE: key[0], WINDOW: np.arange(end, end + ends), "flat": list(flat), "ahead": list(ahead)})
            end += ends
            self.next.update((end,))
        keep = number >= end - self.length + 1 if end < first + self.stretch else np.zeros(len(number), bool)
        if keep.any():
            self.held.put([(int(w), *(None if np.isnan(x) else float(x) for x in line)) for w, line in zip(number[keep], values[keep], strict=True)])
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def stream_sequences(
    windows: DataFrame,
    features: Sequence[str],
    path: str,
    length: int = SEQUENCE_ROWS,
    prediction: int = PREDICTION_ROWS,
    with_labels: Sequence[str] = (),
) -> DataFrame:
    """``sequence_build`` over a stream of window rows (site, window_no, features).

    A window goes to each stretch that has a sequence which needs it; at most
    (length + prediction) / stretch of the windows go to two. Windows may arrive in any order: a
    sequence waits until it is complete. Returns all sequences so far (site, window_no, seq and
    ``label_t``), which lie in ``path``/sequences; a later call goes on from there.
    """
    features, own = list(features), list(dict.fromkeys([*features, *with_labels]))
    reach = max(prediction, 1 if with_labels else 0)
    stretch = max(STRETCH, 8 * (length + reach))
    low = F.floor(F.greatest(F.col(WINDOW) - reach, F.lit(0)) / stretch)
    high = F.floor((F.col(WINDOW) + length - 1) / stretch)
    rows = windows.where(F.col(SITE).isNotNull()).select(SITE, F.col(WINDOW).cast("long").alias(WINDOW), *[F.col(f).cast("double").alias(f) for f in own])
    spread = rows.withColumn("_stretch", F.explode(F.sequence(low, high)))
    schema = f"{SITE} string, {WINDOW} long, flat array<double>, ahead array<double>"
    with _state_store(windows.sparkSession):
        built = spread.groupBy(SITE, "_stretch").transformWithStateInPandas(_Sequences(own, length, reach, stretch), schema, "Append", "None")
        append_available(built, f"{path}/sequences", f"{path}/checkpoint/sequences")
    found = windows.sparkSession.read.schema(schema).parquet(f"{path}/sequences")
    real = lambda x: F.nanvl(x, F.lit(None).cast("double"))
    step = lambda i: F.struct(*[real(F.get("flat", (i * len(own) + own.index(f)).cast("int"))).alias(f) for f in features])
    return found.select(
        SITE, WINDOW, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), step).alias("seq"),
        *[real(F.get("ahead", F.lit(own.index(t)))).alias(f"label_{t}") for t in with_labels],
    )


# --- Spark's own state ------------------------------------------------------

def stream_running_minmax(stream: DataFrame, features: Sequence[str], path: str) -> DataFrame:
    """Running bounds per site; each batch merges the sites it changed into the table of the batch before."""
    bounds = stream.groupBy(SITE).agg(
        *[F.min(f).alias(f"{f}_min") for f in features], *[F.max(f).alias(f"{f}_max") for f in features]
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id > 0:
            before = spark.read.schema(batch.schema).parquet(_place(path, "bounds", batch_id - 1))
            kept = before.withColumnRenamed(SITE, "_site").join(batch.select(SITE), F.col("_site").eqNullSafe(F.col(SITE)), "left_anti")
            batch = kept.withColumnRenamed("_site", SITE).unionByName(batch)
        batch.write.mode("overwrite").parquet(_place(path, "bounds", batch_id))
        _mark(spark, path, batch_id)

    run_available(bounds, f"{path}/checkpoint", each, mode="update")
    spark = stream.sparkSession
    return spark.read.schema(bounds.schema).parquet(_place(path, "bounds", last_batch(spark, path)))


def hourly_stream(stream: DataFrame, measures: Sequence[str], delay: str = "2 hours") -> DataFrame:
    """Event-time hourly mean per site; rows later than ``delay`` are dropped by the watermark."""
    timed = stream.withColumn("_ts", F.timestamp_seconds(EPOCH)).withWatermark("_ts", delay)
    return (
        timed.groupBy(SITE, F.window("_ts", "1 hour").alias("_w"))
        .agg(*[F.avg(m).alias(m) for m in measures])
        .select(SITE, F.unix_timestamp(F.col("_w.start")).alias("hour_epoch"), *measures)
    )


def live_folders(batch_id: int) -> list[str]:
    """Folders that hold the closed hours once ``batch_id`` is written: up to nine of each tier."""
    out, written, tier = [], batch_id + 1, 0
    while written:
        out += [f"tier={tier}/slot={s}" for s in range(written % TIER)]
        written //= TIER
        tier += 1
    return out


def _put_closed(path: str, rows: DataFrame, batch_id: int) -> None:
    """Write the hours that a batch closed; every tenth folder of a tier goes to the next tier with the nine before.

    A folder is overwritten only after the batch that merged it was committed, so a replay
    finds what it needs.
    """
    spark, written, tier = rows.sparkSession, batch_id, 0
    schema = rows.schema
    while written % TIER == TIER - 1:
        before = [f"{path}/closed/tier={tier}/slot={s}" for s in range(TIER - 1)]
        rows = rows.unionByName(spark.read.schema(schema).parquet(*before))
        written //= TIER
        tier += 1
    rows.write.mode("overwrite").parquet(f"{path}/closed/tier={tier}/slot={written % TIER}")


def stream_hourly_mean(stream: DataFrame, measures: Sequence[str], path: str, delay: str = "2 hours") -> DataFrame:
    """Every hour's mean so far, open hours included.

    An hour is closed when its end lies ``delay`` before the latest hour that an earlier batch had, which is
    not after the watermark: no row can change it any more. It is written once, as closed, and merged
    with others from time to time; what is open is carried from batch to batch and holds
    hours of about ``delay`` alone. Rows that are later than the watermark are dropped.
    """
    hours = hourly_stream(stream, measures, delay)
    wait = F.expr(f"(unix_timestamp(timestamp'1970-01-01 00:00:00' + interval {delay}) - unix_timestamp(timestamp'1970-01-01 00:00:00'))")
    schema = hours.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now, newest = batch, None
        if batch_id > 0:
            carried = spark.read.schema(schema).parquet(_place(path, "open", batch_id - 1))
            newest = spark.read.schema("newest long").parquet(_place(path, "newest", batch_id - 1)).first()[0]
            same = F.col("_site").eqNullSafe(F.col(SITE)) & (F.col("_hour") == F.col("hour_epoch"))
            old = carried.withColumnsRenamed({SITE: "_site", "hour_epoch": "_hour"}).join(batch.select(SITE, "hour_epoch"), same, "left_anti")
            now = old.withColumnsRenamed({"_site": SITE, "_hour": "hour_epoch"}).unionByName(batch)
        now = _kept(now, _place(path, "now", batch_id))
        final = F.lit(False) if newest is None else F.col("hour_epoch") + 3600 <= F.lit(newest) - wait
        _put_closed(path, now.where(final), batch_id)
        now.where(~final).write.mode("overwrite").parquet(_place(path, "open", batch_id))
        latest = now.agg(F.greatest(F.max("hour_epoch"), F.lit(newest).cast("long")).alias("newest"))
        latest.coalesce(1).write.mode("overwrite").parquet(_place(path, "newest", batch_id))
        _mark(spark, path, batch_id)

    run_available(hours, f"{path}/checkpoint", each, mode="update")
    spark = stream.sparkSession
    last = last_batch(spark, path)
    closed = [f"{path}/closed/{folder}" for folder in live_folders(last)]
    return spark.read.schema(schema).parquet(*closed, _place(path, "open", last))
