from __future__ import annotations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from sensorloom.llm import infill


@pytest.mark.parametrize("n", [0, 1, 2, 9, 100, 3000])
@pytest.mark.parametrize("even", [True, False])
def test_every_rank(n, even):
    points = None if even else np.random.default_rng(n).integers(1, 9, n)
    place = np.arange(n + 1) if even else np.concatenate([[0], np.cumsum(points)])
    units = infill.SkipList(n, points)
    assert [units.place(r) for r in range(n + 1)] == place.tolist()


def test_lanes_get_thin_and_links_add_up():
    units = infill.SkipList(200_000)
    sizes = [len(wide) for wide, _, _ in units.lanes]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) > 3
    assert all(int(wide.sum()) == 200_000 == int(long.sum()) for wide, long, _ in units.lanes)


def test_units_of_a_pattern():
    assert infill.units_of("ab  c", regex.compile(r"\w+")).tolist() == [2, 1, 1, 1]
    assert infill.units_of("", regex.compile("x")).tolist() == []


TEXTS = [None, "", "a", "café \U0001f600 z", "has <S> mark", "<", "plain text of some words " * 40, "x" * 300_000, "same", (1, "same"), (1, "same"), (None, "no id")]


def cuts(docs, **how):
    found = infill.fill_in_middle(docs([(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(TEXTS * 3)], extra="yes"), **how)
    return found.withColumn("back", infill.restored(F.col("output"), F.col("form"))).toPandas()


@pytest.mark.parametrize("unit", [None, r"\S+\s*"])
def test_texts_come_back(docs, unit):
    got = cuts(docs, unit=unit, rate=100)
    want = [(t[1] if isinstance(t, tuple) else t) or "" for t in TEXTS * 3]
    assert got["back"].tolist() == want
    assert set(got["form"]) == {"plain", "psm", "spm"}
    for form, text, n, a, b, out in zip(got["form"], want, got["n"], got["prefix_chars"], got["middle_chars"], got["output"], strict=True):
        assert n == len(text if unit is None else infill.units_of(text, regex.compile(unit)))
        if form == "plain":
            assert out == text and np.isnan(a) and np.isnan(b)
            assert not text or "<S>" in text
        else:
            a, b = int(a), int(b)
            p, m, s = text[:a], text[a : a + b], text[a + b :]
            assert out == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_rates(docs):
    assert set(cuts(docs, rate=0)["form"]) == {"plain"}
    assert "psm" not in set(cuts(docs, spm=100)["form"])


def test_empty_table(docs):
    assert infill.digest(infill.fill_in_middle(docs([(1, "x")]).limit(0))).count() == 0
