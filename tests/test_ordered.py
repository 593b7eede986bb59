"""Ordered work on blocks and chunks against plain windows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorloom.plans.ordered import nearest_values, number_rows, over_chunks, running_total

def key():
    return W.partitionBy("site")



@pytest.fixture(scope="module")
def rows(spark):
    """A hot site with most rows, repeated epochs, nulls, a site with one row."""
    rng = random.Random(7)
    data = []
    for i in range(1500):
        site = "hot" if i % 3 else f"s{i % 5}"
        value = None if rng.random() < 0.4 else float(rng.randrange(100))
        data.append((site, rng.randrange(40) * 40_000 if i % 4 else 80_000, i, value))
    data.append(("single", 5, 99_999, None))
    return spark.createDataFrame(data, "site string, epoch long, id long, v double").cache()


# Blocks by day, and blocks too big for the limit, which are range-partitioned.
@pytest.mark.parametrize("max_rows", [10**6, 40])
def test_row_numbers(rows, max_rows):
    got = number_rows(rows, ["site"], ["epoch", "id"], count="n", max_rows=max_rows)
    order = key().orderBy("epoch", "id")
    want = rows.withColumns({"_rn": (F.row_number().over(order) - 1).cast("long"), "n": F.count("*").over(key())})
    assert got.count() == rows.count()
    assert got.exceptAll(want).isEmpty()


@pytest.mark.parametrize("max_rows", [10**6, 40])
def test_row_numbers_without_key(rows, max_rows):
    got = number_rows(rows, [], ["epoch", "id"], max_rows=max_rows)
    want = rows.withColumn("_rn", (F.row_number().over(W.orderBy("epoch", "id")) - 1).cast("long"))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


@pytest.mark.parametrize("width,max_rows", [(86_400, 10**6), (86_400, 40), (None, 10**6), (None, 40)])
def test_running_total(rows, width, max_rows):
    got = running_total(
        rows, ["site"], ["epoch", "id"], F.col("id") % 7, "upto", total="all", width=width, max_rows=max_rows
    )
    grow = key().orderBy("epoch", "id").rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumns({"upto": F.sum(F.col("id") % 7).over(grow), "all": F.sum(F.col("id") % 7).over(key())})
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


@pytest.mark.parametrize("max_rows", [10**6, 40])
def test_nearest_values(rows, max_rows):
    got = nearest_values(rows, ["site"], ["epoch", "id"], ["v"], max_rows=max_rows)
    order = key().orderBy("epoch", "id")
    want = rows.withColumns(
        {
            "_prev_v": F.last("v", True).over(order.rowsBetween(W.unboundedPreceding, 0)),
            "_next_v": F.first("v", True).over(order.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


# Chunks smaller and larger than the frame.
@pytest.mark.parametrize("before,after,chunk", [(3, 0, 16), (0, 5, 16), (7, 9, 4), (20, 20, 8), (2, 2, None)])
def test_frames_over_chunks(rows, before, after, chunk):
    numbered = number_rows(rows, ["site"], ["epoch", "id"])
    frame = (-before, after)
    columns = {
        "s": lambda w: F.sum("id").over(w.rowsBetween(*frame)),
        "c": lambda w: F.count("v").over(w.rowsBetween(*frame)),
    }
    got = over_chunks(numbered, ["site"], "_rn", columns, before, after, chunk_rows=chunk)
    plain = key().orderBy("_rn").rowsBetween(*frame)
    want = numbered.withColumns({"s": F.sum("id").over(plain), "c": F.count("v").over(plain)})
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_empty_input(rows):
    assert number_rows(rows.filter("false"), ["site"], ["epoch", "id"]).count() == 0


@pytest.mark.parametrize("length", [1, 2, 7, 24])
def test_trailing_moments(spark, length):
    """Count, mean and squared deviations of every frame, over chunk edges, with nulls and large levels."""
    rng = random.Random(length)
    values = [None if rng.random() < 0.3 else 1e9 + rng.gauss(0, 1) for _ in range(150)] + [5.25] * 60 + [None] * 40
    df = spark.createDataFrame([(s, i, v) for s in ("a", "b") for i, v in enumerate(values)], "site string, rn long, x double")
    pick = {"n": lambda w: F.col(f"_n{length}_x"), "mean": lambda w: F.col(f"_mean{length}_x"), "m2": lambda w: F.col(f"_m2{length}_x")}
    got = over_chunks(df, ["site"], "rn", pick, before=length - 1, chunk_rows=31, moments={length: ["x"]})
    for r in got.filter(F.col("rn") >= length - 1).collect():
        own = [v for v in values[r.rn - length + 1 : r.rn + 1] if v is not None]
        assert r.n == len(own)
        if own:
            mean = math.fsum(own) / len(own)
            assert r.mean == pytest.approx(mean, rel=1e-14)
            assert r.m2 == pytest.approx(sum((v - mean) ** 2 for v in own), rel=1e-5, abs=1e-7 if own[0] > 1e8 else 0.0)
        else:
            assert r.mean is None and r.m2 == 0.0
