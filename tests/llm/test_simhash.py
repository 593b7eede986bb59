from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from sensorloom.llm import QUERIES, simhash


def fingerprint(text, k=3):
    import xxhash

    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(prints, radius=3):
    """Component of each fingerprint by comparing all pairs."""
    label = {p: p for p in prints}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    own = sorted(label)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= radius and top(a) != top(b):
                label[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in own}


def clustered(rng, centres, each, most):
    out = set()
    for c in rng.integers(0, 2**62, centres).tolist():
        for _ in range(each):
            for b in rng.integers(0, 64, rng.integers(0, most)).tolist():
                c ^= 1 << b
            out.add(c)
    return sorted(out)


TEXTS = [None, "", " \t", "One", "one TWO", "a b c", "A B C", "a\x1cb c d É é", "w " * 9000, "a b c d e f " * 50]


def test_fingerprints():
    arr = pa.array([*TEXTS, *(" ".join(str(i * j % 7) for j in range(i)) for i in range(60))])
    for step in (7, 1 << 18):
        assert simhash.simhash(*simhash.shingle_hashes(arr, 3), step=step).tolist() == [fingerprint(t) for t in arr.to_pylist()]
    part = arr.slice(4, 20)
    assert simhash.simhash(*simhash.shingle_hashes(part, 3)).tolist() == [fingerprint(t) for t in part.to_pylist()]


@pytest.mark.parametrize("radius", [0, 1, 3, 9])
def test_a_search_finds_all_within_the_radius(radius):
    prints = np.array(clustered(np.random.default_rng(1), 12, 40, 4), np.uint64)
    route = (np.arange(len(prints)) % 3).astype(np.int64) * 7
    found = set()
    for who, node in simhash.Forest(route, prints).search(route, prints, radius):
        found |= set(zip(who.tolist(), node.tolist(), strict=True))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    i, j = np.nonzero(near & (route[:, None] == route[None, :]))
    assert found == set(zip(i.tolist(), j.tolist(), strict=True))
    none = simhash.Forest(route, prints).search(np.full(3, 99, np.int64), prints[:3], 3)
    assert list(none) == []


@pytest.mark.parametrize("shard", [3, 40, 4096])
def test_components_of_any_shard_size(spark, monkeypatch, shard):
    """Small shards: routes are split again, and trees of a route meet blocks of others."""
    rng = np.random.default_rng(shard)
    prints = [*clustered(rng, 6, 30, 5), *clustered(rng, 1, 120, 2), 0, 1, 2**63, 2**64 - 1, 2**64 - 9]
    rows = [(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)]
    made = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, k: docs)
    monkeypatch.setattr(simhash, "BROADCAST_NODES", 100 if shard == 3 else 500_000)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(made, shard=shard).collect()}
    label = closure(prints)
    least = {}
    for i, p in enumerate(prints):
        least[label[p]] = min(i, least.get(label[p], i))
    assert got == {i: (f"{p:016x}", least[label[p]]) for i, p in enumerate(prints)}


def test_rows(docs):
    got = simhash.simhash_components(docs([*TEXTS, (None, "a b c"), (None, "quite another text"), (3, "One")], extra="yes")).toPandas()
    assert len(got) == len(TEXTS) + 3
    zero = got[got["fingerprint"] == "0" * 16]
    assert set(zero["component_id"]) == {0} and {0, 1, 2} <= set(zero["doc_id"].dropna())
    abc = got[got["fingerprint"] == f"{fingerprint('a b c'):016x}"]
    assert len(abc) == 3 and set(abc["component_id"]) == {5}
    alone = got[got["fingerprint"] == f"{fingerprint('quite another text'):016x}"]
    assert alone["component_id"].isna().all()
    assert simhash.simhash_components(docs([(1, "x")]).limit(0)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_the_query_against_all_pairs(spark):
    rows = {r["doc_id"]: fingerprint(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    label = closure(list(rows.values()))
    least = {}
    for i, p in rows.items():
        least[label[p]] = min(i, least.get(label[p], i))
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op13_simhash_bk_trees"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {(i, f"{p:016x}", least[label[p]]) for i, p in rows.items()}
