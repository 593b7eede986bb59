from __future__ import annotations

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorloom.llm import QUERIES, runs


def brute(w, shortest=12):
    """All runs by comparing every two words a period apart."""
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - s
            smaller = any(all(w[k] == w[k + d] for k in range(s, s + length - d)) for d in range(1, q))
            if length >= max(shortest, 2 * q) and not smaller:
                out.add((s, length, q))
    return sorted(out)


def found(w, shortest=12):
    return sorted(runs.squares_to_runs(w, shortest))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 13))
def test_all_runs_of_small_alphabets(w, shortest):
    assert found(w, shortest) == brute(w, shortest)


def test_runs_in_runs_and_in_stretches():
    rng = random.Random(3)
    for _ in range(150):
        n, k = rng.randint(1, 90), rng.choice([2, 4, 30])
        w = [rng.randrange(k) for _ in range(n)]
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = brute(w)
        assert found(w) == want
        cut = runs.stretches(np.zeros(n, np.int64), np.array(w, np.int64))
        assert sorted((s + lo, m, q) for lo, hi in cut for s, m, q in found(w[lo:hi])) == want


def test_a_run_does_not_cross_documents():
    w = np.array([1, 2, 3] * 8, np.int64)
    assert runs.stretches(np.repeat([0, 1], 12), w) == [(0, 12), (12, 24)]
    assert runs.stretches(np.repeat([0, 1, 2, 3], 6), w) == []


def test_every_run_is_reported_once_in_a_long_text():
    block = random.Random(1).sample(range(10_000), 700)
    assert found(block * 30 + [block[0]]) == [(0, 21_001, 700)]


def test_rows(spark, docs):
    verse = "a b c d " * 3
    texts = [None, "", " \n\t", "one two", verse, verse, (None, verse), "x\x1cy " * 12, "A a " * 6 + "tail", "w " * 11]
    got = runs.periodic_runs(docs(texts, extra="yes")).toPandas()
    assert len(got) == len(texts)
    assert got["n_words"].tolist() == [0, 0, 0, 2, 12, 12, 12, 12, 13, 11]
    assert [[tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in x] for x in got["runs"]] == [
        [], [], [], [], [(0, 12, 4)], [(0, 12, 4)], [(0, 12, 4)], [(0, 12, 1)], [(0, 12, 2)], [],
    ]
    assert got["collapsed"].tolist() == ["", "", "", "one two", *["a b c d"] * 3, "x\x1cy", "A a tail", " ".join("w" * 11)]
    assert runs.digest(runs.periodic_runs(docs([(1, "x")]).limit(0))).count() == 0


def test_ties_of_the_longest_run(docs):
    text = "a b " * 6 + "z " + "c d " * 6 + "y " + "e " * 12
    row = runs.digest(runs.periodic_runs(docs([text]))).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (3, 0, 12, 2, 6000)
    assert row["runs_sha256"] == hashlib.sha256(b"0,12,2\n13,12,2\n26,12,1\n").hexdigest()


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_the_query_against_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        w = rows[r["doc_id"]].encode().split()
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 700:  # brute force is quadratic; longer texts are tested above
            continue
        want = brute(w)
        gone = {i for s, m, q in want for i in range(s + q, s + m)}
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        top = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *top)
