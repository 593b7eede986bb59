from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from sensorloom.llm import setjoin
from sensorloom.llm.graph import components
from sensorloom.llm.setjoin import Rules


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def plain(texts, k, percent):
    sets, root = shingle_sets(texts, k), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(seed, groups=6, many=14):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{g}_{rng.randrange(400)}" for _ in range(rng.choice([4, 9, 25, 60, 150, 420]))]
        for _ in range(many):
            copy = base[:]
            for _ in range(rng.randrange(1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(["x", "y", "z", f"n{rng.randrange(9)}"])
            out.append(" ".join(copy if rng.random() < 0.9 else base).replace("w", rng.choice("wW")))
    out += ["", None, " \n ", "one", "One", "one two", "one two", "é É", "É é"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "k", "percent"), [(0, 3, 90), (1, 3, 90), (2, 5, 80), (3, 1, 80), (4, 3, 60)])
def test_components(docs, seed, k, percent):
    texts = near_copies(seed)
    rows = setjoin.jaccard_components(docs(texts, "extra"), Rules(k, percent)).collect()
    assert sorted(tuple(r) for r in rows) == plain(texts, k, percent)


def test_blocks_of_a_hot_group(docs, monkeypatch):
    """Chains of near copies, more than a block of them, under one lead."""
    monkeypatch.setattr(setjoin, "BLOCK_SETS", 5)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        copy = base[:]
        for p in rng.sample(range(100), rng.randrange(6)):
            copy[p] = f"v{rng.randrange(3)}"
        texts.append(" ".join(copy))
    rows = setjoin.jaccard_components(docs(texts), Rules(3, 90)).collect()
    assert sorted(tuple(r) for r in rows) == plain(texts, 3, 90)


@pytest.mark.parametrize(("deletions", "more"), [(0, 0), (1, 0), (100, 0), (0, 1), (0, 3), (1, 2), (100, 4), (0, None), (2, None)])
def test_no_linked_pair_is_missed_by_the_index(deletions, more):
    rules = Rules(3, 80)
    texts = [t for t in near_copies(5) if t and t.strip()]
    doc, prints = setjoin.shingled(pa.array(texts), 3)
    size, cid = setjoin._classes(doc, prints, len(texts))
    edges = rules.edges(int(size.max()))
    gaps = rules.gaps(edges)
    deleting = np.minimum(deletions, (gaps + 1) // 2)
    slack = setjoin.spare(edges, gaps) if more is None else np.full_like(gaps, more)
    keys = [set() for _ in texts]
    for _, owner, key in setjoin._keys(doc, prints, size, edges, gaps + 1 + slack - deleting, deleting, slack):
        for o, x in zip(owner.tolist(), key.tolist(), strict=True):
            keys[o].add(x)
    sets = shingle_sets(texts, 3)
    for i in range(len(texts)):
        assert size[i] == len(sets[i])
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                assert keys[i] & keys[j]
            assert (cid[i] == cid[j]) == (sets[i] == sets[j])


def test_parity_maps_rule_out_no_link():
    texts = [t for t in near_copies(7) if t and t.strip()]
    doc, prints = setjoin.shingled(pa.array(texts), 3)
    size, _ = setjoin._classes(doc, prints, len(texts))
    maps, sets, ruled_out = setjoin.parity_maps(doc, prints, size), shingle_sets(texts, 3), 0
    for percent in (60, 90):
        for i in range(len(texts)):
            for j in range(i):
                passed = setjoin.may_link(maps[i], maps[j], int(size[i]), int(size[j]), percent)
                ruled_out += not passed
                assert passed or 100 * len(sets[i] & sets[j]) < percent * len(sets[i] | sets[j])
    assert ruled_out > len(texts) ** 2 // 2


def test_slices_of_a_batch():
    texts = pa.array([t for t in near_copies(6)])
    for lo in (0, 1, 17):
        got, want = setjoin.shingled(texts.slice(lo, 40), 3), setjoin.shingled(pa.array(texts.slice(lo, 40).to_pylist()), 3)
        assert got[0].tolist() == want[0].tolist()
        assert got[1].tolist() == want[1].tolist()
        assert np.bincount(got[0], minlength=40).tolist() == [len(s) for s in shingle_sets(texts.slice(lo, 40).to_pylist(), 3)]


def test_ids_that_are_null_or_repeat(docs):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = setjoin.jaccard_components(docs([(5, a), (3, a + " x"), (5, b), (None, b), (2, b), (9, None)]), Rules(3, 90)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in rows) == [(False, 2, 2), (False, 3, 3), (False, 5, 2), (False, 5, 3), (False, 9, 9), (True, 0, 2)]
    assert setjoin.jaccard_components(docs([])).count() == 0
    assert setjoin.jaccard_components(docs([None, "", " "])).count() == 3


def test_one_of_each_group(docs):
    a = " ".join(f"a{i}" for i in range(60))
    df = docs([a, a + " more", "something else here now", a, None, ""], "extra")
    kept = setjoin.one_of_each_group(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 4, 5]


def test_one_of_each_group_goes_by_text_where_ids_are_null_or_repeat(docs):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [
        (1, a), (None, a + " more"), (None, b), (None, c), (None, c + " more"), (None, c),  # a null id beside a copy of a text with one, alone, and copies without any
        (2, a), (2, d),  # one text of an id is linked to a smaller one, the other is not
        (3, e), (3, e), (3, e + " more"), (None, None), (None, ""), (3, ""), (3, ""),
    ]
    kept = setjoin.one_of_each_group(docs(rows, "extra"))
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()), key=str)
    of_c, of_e = [t for i, t in got if t.startswith("c0 ")], [t for i, t in got if t.startswith("e0 ")]
    assert len(of_c) == len(of_e) == 1
    assert got == sorted([(1, a), (0, b), (0, of_c[0]), (2, d), (3, of_e[0]), (0, ""), (0, ""), (3, ""), (3, "")], key=str)


def test_components_of_a_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
