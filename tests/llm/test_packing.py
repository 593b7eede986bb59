from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from sensorloom.llm import packing

P = pytest.importorskip("public_tokenizers")


def filled(runs, capacity):
    """Sequences from the runs: place and length of every piece."""
    out = defaultdict(list)
    for n, lo, hi, per, first, at in runs:
        for k in range(hi - lo):
            out[first + k // per].append((at + (k % per) * n, n))
    for pieces in out.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= capacity
    return out


def plain(lengths, capacity):
    """Item by item: large ones matched greedily, small ones to the least room that holds them."""
    bins, large = [], sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    while large:
        n = large.pop(0)
        fits = [p for p in large if p <= capacity - n]
        if fits:
            large.remove(max(fits))
        bins.append(capacity - n - (max(fits) if fits else 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [r for r in bins if r >= n]
        if fits:
            bins.remove(min(fits))
        bins.append((min(fits) if fits else capacity) - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(40))
def test_plan_packs_as_item_by_item(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 12, 30, 100])
    lengths = [rng.randint(1, capacity if rng.random() < 0.5 else max(1, capacity // 3)) for _ in range(rng.randrange(120))]
    out = filled(packing.plan(Counter(lengths), capacity), capacity)
    assert Counter(n for p in out.values() for _, n in p) == Counter(lengths)
    assert len(out) == plain(lengths, capacity)
    assert all(sum(3 * n > capacity for _, n in p) <= 2 for p in out.values())


def test_plan_limits():
    assert packing.plan({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_cut():
    assert packing.cut(0, 4) == []
    assert packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_documents(docs):
    from tokenizers import Tokenizer

    texts = ["a b c", None, "", "word " * 3000, "same text", "same text", (4, "same text"), (None, "no id")]
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs(texts, "extra"), path, 2, capacity=64).collect()
    coder = Tokenizer.from_file(path)
    want = Counter()
    for i, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (i, t)
        want[i] += len(coder.encode(t or "").ids) + 1
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        assert [a for a, _ in sorted(p)] == [sum(n for b, n in p if b < a) for a, _ in sorted(p)]
        assert sum(n for _, n in p) <= 64


def test_hash_blocks_and_no_rows(docs, spark):
    pieces = spark.range(500).selectExpr("id AS doc_id", "0 AS piece", "id % 3 + 1 AS length")
    rows = packing.pack(pieces, 10, block_rows=7).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 500
    assert packing.pack_documents(docs([]), P.path("byte_bpe_50k.json"), 2).count() == 0
