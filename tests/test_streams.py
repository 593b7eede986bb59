"""A stream cut into several batches gives the rows of the batch operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import rowwindows as rw
from sensorloom.plans.ordered import number_rows
from sensorloom.streaming import streams

FIELDS = "aqs_code string, epoch long, event_id long, o3 double, temp double"


@pytest.fixture(scope="module")
def readings(spark):
    """Three sites; one appears in the middle of the stream and one stops."""
    rows = []
    for i in range(400):
        site = "hot" if i % 2 else ("early" if i < 200 else "late")
        rows.append((site, 300 * i, i, None if i % 5 == 0 else float(i % 17), float(i % 9)))
    return spark.createDataFrame(rows, FIELDS)


@pytest.fixture
def arriving(spark, readings, tmp_path):
    """The readings as a stream of five files, one per batch."""
    folder = str(tmp_path / "in")
    for part in range(5):
        piece = readings.filter(F.col("event_id").between(part * 80, part * 80 + 79))
        piece.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", 1).parquet(folder)


def same(a, b):
    columns = sorted(a.columns)
    return a.count() == b.count() and a.select(columns).exceptAll(b.select(columns)).isEmpty()


def test_blocks_over_batches(readings, arriving, tmp_path):
    got = streams.stream_tumble_rows(arriving, ["o3", "temp"], str(tmp_path / "out"))
    assert same(got, rw.tumble_rows(readings, ["o3", "temp"]))


def test_sequences_over_batches(spark, readings, arriving, tmp_path):
    blocks = rw.tumble_rows(readings, ["o3", "temp"], rows=4)
    folder = str(tmp_path / "blocks")
    for part in range(5):
        piece = blocks.filter(F.col("window_no").between(part * 10, part * 10 + 9))
        piece.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = streams.stream_sequences(stream, ["o3", "temp"], str(tmp_path / "out"), length=5, prediction=2, with_labels=["o3"])
    want = rw.sequence_build(blocks, ["o3", "temp"], 5, 2, with_labels=["o3"])
    assert same(rw.sequence_unnest(got, "label_o3"), rw.sequence_unnest(want, "label_o3"))


def test_windows_in_any_order(spark, readings, tmp_path):
    """Sequences wait for windows that arrive late; small stretches share their edges."""
    blocks = rw.tumble_rows(readings, ["o3", "temp"], rows=4)
    folder = str(tmp_path / "blocks")
    for part in (3, 0, 4, 1, 2):
        blocks.filter(F.col("window_no") % 5 == part).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(blocks.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = streams.stream_sequences(stream, ["temp"], str(tmp_path / "out"), length=3, prediction=1, with_labels=["o3"])
    want = rw.sequence_build(blocks, ["temp"], 3, 1, with_labels=["o3"])
    assert same(rw.sequence_unnest(got, "label_o3"), rw.sequence_unnest(want, "label_o3"))


def test_small_stretches(spark, readings, arriving, tmp_path, monkeypatch):
    """Many keys for one site, windows and sequences over their edges."""
    monkeypatch.setattr(streams, "STRETCH", 3)
    got = streams.stream_tumble_rows(arriving, ["o3", "temp"], str(tmp_path / "out"), rows=4, mask=None, files=1)
    assert same(got, rw.tumble_rows(readings, ["o3", "temp"], rows=4, mask=None))
    stream = spark.readStream.schema(got.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "out" / "windows"))
    built = streams.stream_sequences(stream, ["o3"], str(tmp_path / "more"), length=2, prediction=0)
    want = rw.sequence_build(rw.tumble_rows(readings, ["o3"], rows=4, mask=None), ["o3"], 2, 0)
    assert same(rw.sequence_unnest(built), rw.sequence_unnest(want))


def test_a_replayed_batch_changes_nothing(spark, readings, tmp_path):
    path = str(tmp_path / "out")
    each = streams.number_batches(path, ["o3", "temp"])
    first, second = readings.filter("event_id < 150"), readings.filter("event_id >= 150")
    each(first, 0)
    each(second, 1)
    each(second, 1)
    got = spark.read.parquet(f"{path}/numbered").drop("batch")
    assert same(got, number_rows(readings, ["aqs_code"], rw.ORDER))


def test_a_restarted_stream_goes_on_where_it_stopped(spark, readings, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    got = None
    for first, last in ((0, 129), (130, 269), (270, 399)):
        readings.filter(F.col("event_id").between(first, last)).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(FIELDS).parquet(folder)
        got = streams.stream_tumble_rows(stream, ["o3", "temp"], path)
    assert same(got, rw.tumble_rows(readings, ["o3", "temp"]))


def test_running_bounds(readings, arriving, tmp_path):
    got = streams.stream_running_minmax(arriving, ["o3"], str(tmp_path / "out"))
    want = readings.groupBy("aqs_code").agg(F.min("o3").alias("o3_min"), F.max("o3").alias("o3_max"))
    assert same(got, want)


def test_hourly_means_include_open_hours(readings, arriving, tmp_path):
    got = streams.stream_hourly_mean(arriving, ["temp"], str(tmp_path / "out"), delay="1 hour")
    want = readings.groupBy("aqs_code", (F.floor(F.col("epoch") / 3600) * 3600).alias("hour_epoch")).agg(F.avg("temp").alias("temp"))
    assert same(got, want)


def test_stateless_steps(spark, readings, arriving, tmp_path):
    step = lambda df: df.filter("temp > 3")
    streams.stream_transform(arriving, [step], str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
    assert same(spark.read.schema(FIELDS).parquet(str(tmp_path / "rows")), step(readings))


def test_closed_hours_are_merged(spark, readings, tmp_path, monkeypatch):
    """Twenty-three batches, those that merge written twice: a bounded number of folders, and every hour once."""
    path = str(tmp_path / "out")
    taken = []
    monkeypatch.setattr(streams, "run_available", lambda hours, checkpoint, each, mode: [taken.append(each)])
    monkeypatch.setattr(streams, "last_batch", lambda spark, path: 0)
    with pytest.raises(Exception, match="(?i)path|exist|schema"):
        streams.stream_hourly_mean(spark.readStream.schema(FIELDS).parquet(str(tmp_path)), ["temp"], path, delay="1 hour").count()
    hours = lambda upto, since: readings.filter(F.col("epoch") < upto).groupBy(
        "aqs_code", (F.floor(F.col("epoch") / 3600) * 3600).alias("hour_epoch")
    ).agg(F.avg("temp").alias("temp"), F.max("epoch").alias("_m")).filter(F.col("_m") >= since).drop("_m")
    width = 5400
    for b in range(23):
        for _ in range(2 if b in (9, 19) else 1):
            taken[0](hours((b + 1) * width, b * width), b)
    folders = [p for p in (tmp_path / "out" / "closed").glob("tier=*/slot=*")]
    assert len(folders) <= 14
    live = streams.live_folders(22)
    assert live == ["tier=0/slot=0", "tier=0/slot=1", "tier=0/slot=2", "tier=1/slot=0", "tier=1/slot=1"]
    assert len(streams.live_folders(10**6)) <= 9 * 7
    closed = spark.read.parquet(*[f"{path}/closed/{f}" for f in live])
    now = spark.read.parquet(f"{path}/open/place={22 % 3}")
    assert now.count() <= 10
    want = readings.groupBy("aqs_code", (F.floor(F.col("epoch") / 3600) * 3600).alias("hour_epoch")).agg(F.avg("temp").alias("temp"))
    assert same(closed.select("aqs_code", "hour_epoch", "temp").unionByName(now.select("aqs_code", "hour_epoch", "temp")), want)


def test_late_rows_are_dropped_and_open_hours_go_on(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")
    got = None
    for batch in ([("a", 0, 1.0), ("a", 3600, 2.0)], [("a", 4000, 4.0), ("b", 20_000, 1.0)], [("a", 10, 99.0), ("b", 20_100, 3.0)], [("b", 90_000, 5.0)]):
        spark.createDataFrame(batch, "aqs_code string, epoch long, temp double").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("aqs_code string, epoch long, temp double").parquet(folder)
        got = streams.stream_hourly_mean(stream, ["temp"], path, delay="1 hour")
    assert {tuple(r) for r in got.collect()} == {("a", 0, 1.0), ("a", 3600, 3.0), ("b", 18_000, 2.0), ("b", 90_000, 5.0)}


def test_files_do_not_grow_with_shuffle_partitions(spark, readings, tmp_path):
    """A stream that reads a few files at a time has as many batches as before, whatever the shuffle partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    many = readings.crossJoin(spark.range(20)).withColumn("event_id", F.col("event_id") * 20 + F.col("id")).drop("id")
    many = many.withColumn("aqs_code", F.concat("aqs_code", (F.col("event_id") % 16).cast("string")))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        streams.number_batches(str(tmp_path), ["o3"])(many, 0)
        folder = str(tmp_path / "in")
        many.coalesce(1).write.parquet(folder)
        stream = spark.readStream.schema(FIELDS).parquet(folder)
        got = streams.stream_tumble_rows(stream, ["o3", "temp"], str(tmp_path / "out"), files=1)
        assert same(got, rw.tumble_rows(many, ["o3", "temp"]))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(list((tmp_path / "numbered" / "batch=0").glob("*.parquet"))) <= streams.FILES
    assert len(list((tmp_path / "out" / "windows").glob("*.parquet"))) <= streams.FILES
    assert len(list((tmp_path / "out" / "checkpoint" / "windows" / "commits").glob("[0-9]*"))) == 1
