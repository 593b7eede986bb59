from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest

from sensorloom.llm import sharding


def smallest(sizes, shards):
    def need(room):
        n, x = 1, 0
        for s in sizes:
            if s > room:
                return shards + 1
            if x + s > room:
                n, x = n + 1, 0
            x += s
        return n

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if need(mid) <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize(("seed", "points"), [(s, p) for s in range(3) for p in (3, 20, 20_000)])
def test_capacity_is_the_smallest(spark, seed, points):
    rng = random.Random(seed)
    sizes = [rng.choice([8, 9, 50, 400, 3000]) + rng.randrange(5) for _ in range(150)]
    if seed == 2:
        sizes[70] = 40_000
    before = [sum(sizes[:i]) for i in range(len(sizes))]
    groups = spark.createDataFrame(list(zip(before, sizes, strict=True)), "before long, bytes long")
    capacity, cuts = sharding.minimax_cuts(groups, 7, points)
    assert capacity == smallest(sizes, 7)
    assert cuts == sorted(cuts)
    assert set(cuts) <= {*before, sum(sizes)}
    edges = [0, *cuts, sum(sizes)]
    assert max(b - a for a, b in zip(edges, edges[1:], strict=False)) == capacity


def test_documents(docs):
    texts = ["a" * (i % 13) + str(i % 17) for i in range(80)] + [None, "", None, "é" * 500, (3, "again"), (None, "no id"), (None, "no id")]
    rows = sharding.contiguous_shards(docs(texts, "extra"), 5).collect()
    assert len(rows) == len(texts)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        shard_of[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    sizes = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows}
    assert sizes[83] == (1008, zlib.crc32(("é" * 500).encode()))
    assert sizes[80] == (8, 0)


def test_few_groups_and_no_rows(docs):
    assert {r["slot"] for r in sharding.contiguous_shards(docs(["same"] * 9), 4).collect()} == set(range(9))
    assert sharding.contiguous_shards(docs([]), 4).count() == 0
