"""Selection by brackets against the table of all values, densities and correlations against plain sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import profile as pf
from sensorloom.operators import selection

SHARES = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.fixture(scope="module")
def rows(spark):
    """Continuous values over many powers of ten, ties, nulls, a flat column, small groups and a null group."""
    rng = random.Random(1)
    out = []
    for i in range(3000):
        g = rng.choice(["hot"] * 20 + ["b", None]) if i else "single"
        out.append((g, None if rng.random() < 0.1 else math.exp(rng.gauss(0, 9)) * rng.choice([-1, 1]), float(rng.randrange(4)), 7.5))
    return spark.createDataFrame(out, "site string, wide double, tied double, flat double")


@pytest.mark.parametrize("pick", [40, 10_000])
def test_equal_to_the_table_of_all_values(rows, monkeypatch, pick):
    monkeypatch.setattr(selection, "PICK", pick)
    monkeypatch.setattr(selection, "BINS", 16 if pick == 40 else 512)
    columns = ["wide", "tied", "flat"]
    for groups in ([], ["site"]):
        values = selection.values_of(rows, groups, columns)
        got = selection.quantiles(values, selection.moments(values), SHARES)
        want = pf.quantiles(pf.value_table(rows, groups, columns), groups, SHARES)
        assert got.count() == want.count() == (12 if groups else 3)
        assert got.select(want.columns).exceptAll(want).isEmpty()


def test_subsets_share_brackets(spark, rows, monkeypatch):
    monkeypatch.setattr(selection, "PICK", 30)
    number = F.abs(F.col("wide")).cast("long")
    tagged = rows.withColumn("tags", F.when(number % 3 == 0, F.array(F.lit("all"), F.lit("third"))).when(number.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.lit("all"))))
    values = selection.values_of(tagged, ["site"], ["wide", "tied"], tags="tags")
    got = selection.summary(values, pf.QUARTILES)
    flat = tagged.withColumn("subset", F.explode("tags"))
    plain = selection.values_of(flat, ["site", "subset"], ["wide", "tied"])
    want = pf.quantiles(pf.value_table(flat, ["site", "subset"], ["wide", "tied"]), ["site", "subset"], pf.QUARTILES)
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count()
    a = {(r.site, r.subset, r.column): r for r in got.collect()}
    for r in selection.moments(plain).collect():
        mine = a[r.site, r.subset, r.column]
        assert (mine["count"], mine["min"], mine["max"]) == (r["count"], r["min"], r["max"])
        assert mine["mean"] == pytest.approx(r["mean"], rel=1e-9) and (mine["std"] is None) == (r["std"] is None)


def test_odd_values(frame, monkeypatch):
    monkeypatch.setattr(selection, "PICK", 2)
    numbers = [float("-inf"), -1.7e308, -1.0, 0.0, 0.0, 5e-324, 1.0, 1.7e308, float("inf"), float("inf")]
    df = frame([(v,) for v in numbers] + [(None,)], "x double")
    values = selection.values_of(df, [], ["x"])
    ranks = {f"r{i}": i / (len(numbers) - 1) for i in range(len(numbers))}
    got = selection.quantiles(values, selection.moments(values), ranks).first()
    finite = [i for i, v in enumerate(numbers) if math.isfinite(v) and not (i + 1 < len(numbers) and math.isinf(numbers[i + 1]))]
    assert [got[f"r{i}"] for i in finite] == [numbers[i] for i in finite]
    empty = selection.values_of(df.where("x = 3.5"), [], ["x"])
    assert selection.summary(empty, pf.QUARTILES).count() == 0


def test_moments_of_a_large_level(frame):
    values = selection.values_of(frame([("a", 1e9 + i % 3) for i in range(300)] + [("b", 5.0)], "g string, x double"), ["g"], ["x"])
    got = {r.g: r for r in selection.moments(values).collect()}
    assert got["a"]["std"] == pytest.approx(np.std([i % 3 for i in range(300)], ddof=1), rel=1e-7)
    assert got["b"]["std"] is None and got["b"]["count"] == 1


def test_binned_density_keeps_its_bound(frame):
    rng = random.Random(2)
    df = frame([(rng.gauss(40, 12),) for _ in range(1500)] + [(9e9,), (-9e9,), (None,)], "x double")
    exact = {r.point: r for r in pf.kernel_density(df, ["x"], points=60, cells=None).collect()}
    h = selection.summary(selection.values_of(df, [], ["x"]), pf.QUARTILES).select(F.col("std") * F.pow(F.col("count"), -0.2)).first()[0]
    for cells in (4, 64):
        got = pf.kernel_density(df, ["x"], points=60, cells=cells)
        worst = max(abs(r.density - exact[r.point].density) for r in got.collect())
        assert worst <= 1 / (8 * cells**2) / (h * math.sqrt(2 * math.pi))
    assert "Generate" not in pf.kernel_density(df, ["x"])._jdf.queryExecution().optimizedPlan().toString()


def test_correlation_of_incomplete_rows(frame):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((1e9 + x, None if i % 3 == 0 else x + y, None if i % 4 == 0 else -y, 2.0, 1.0 if i == 5 else None))
    df = frame(rows, "a double, b double, c double, flat double, one double")
    got = {(r.a, r.b): r.r for r in pf.correlation_matrix(df, df.columns).collect()}
    want = df.withColumn("a", F.col("a") - 1e9).toPandas().corr()
    assert len(got) == 25
    for (a, b), r in got.items():
        if "flat" in (a, b) or "one" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)
    none = pf.correlation_matrix(df.limit(0), ["a", "b"]).collect()
    assert len(none) == 4 and all(r.r is None for r in none)
