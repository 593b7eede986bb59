from __future__ import annotations

import random

import pytest

from sensorloom.llm import decontam

ITEM = "which of the seven old rivers flows north past the grey castle before it meets the cold inland sea"


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS score", "'x' AS gram")


def plain(item, passage):
    best = 0
    row = [0] * (len(passage) + 1)
    for w in item:
        new = [0]
        for j, v in enumerate(passage, 1):
            step = decontam.MATCH if v == w else decontam.MISMATCH
            new.append(max(0, row[j - 1] + step, row[j] + decontam.GAP, new[-1] + decontam.GAP))
        row = new
        best = max(best, *row)
    return best


def test_alignment_is_smith_waterman():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(1, 15))]
        assert decontam.align(a, b)[0] == plain(a, b)
    assert decontam.align([], ["a"]) == (0, 0)


def found(df):
    return {(r["doc_id"], r["item_id"]): r["percent"] for r in df.collect()}


def test_copies_edits_and_clean_documents(docs, bench):
    rng = random.Random(2)
    filler = lambda: " ".join(rng.choice(["the", "of", "and", "river", "road", "stone", "green", "walks"]) for _ in range(60))
    w = ITEM.split()
    edited = " ".join(x for i, x in enumerate(w) if i != 5).replace("grey", "gray").replace("cold inland", "cold and inland")
    texts = [f"{filler()} {ITEM.upper()}. {filler()}", f"{filler()} {edited} {filler()}", filler(), " ".join(w[:4]) + " " + filler(), None, "", f"{filler()} {ITEM}", (6, "other text of that id")]
    got = found(decontam.leaks(docs(texts, "extra"), bench([(1, ITEM), (2, None), (3, ""), (4, "of the"), (None, ITEM)])))
    assert got[0, 1] == 100
    assert got[6, 1] == 100
    assert got[1, 1] >= 60
    assert {k for k in got if k[1] == 1} == {(0, 1), (1, 1), (6, 1)}
    one = decontam.leaks(docs(["a b c " + ITEM + " d"]), bench([(1, ITEM)])).collect()[0]
    assert (one["first_word"], one["last_word"], one["score"]) == (3, 3 + len(w), 2 * len(w))


def test_excerpts_and_parts_that_stand_apart(docs, bench):
    item = [f"w{i}" for i in range(60)]
    short = [f"s{i}" for i in range(20)]
    far = " ".join(f"f{i}" for i in range(400))
    part = lambda a, b, w=item: " ".join(w[a:b])
    loose = " ".join(x for w in item[13:26] for x in ("y", "y", w))
    texts = [
        f"{far} {part(0, 29)} {far}", f"a {part(31, 60)} b", f"a {part(20, 33)} b", f"a {part(20, 32)} b",  # halves, an excerpt of 13 words, one of 12
        f"{part(0, 8, short)} {far} {part(8, 16, short)}", f"{part(0, 8, short)} q r s t u v w x y z {part(8, 16, short)}", f"{part(0, 8, short)} {far} {part(0, 8, short)}",
        f"a {part(0, 13)} {loose} b", f"{part(0, 10)} x {part(11, 20)} {far}",
    ]
    got = found(decontam.leaks(docs(texts), bench([(1, " ".join(item)), (2, " ".join(short))])))
    assert set(got) == {(0, 1), (1, 1), (2, 1), (4, 2), (5, 2), (7, 1), (8, 1)}
    assert got[4, 2] == got[5, 2] == 80


def test_an_excerpt_of_frequent_words_has_a_seed(docs, bench):
    """The half of an item that many documents have is found in each of them."""
    item = [f"w{i}" for i in range(60)]
    assert len(found(decontam.leaks(docs([f"start {i} {' '.join(item[:25])} end {i}" for i in range(40)]), bench([(1, " ".join(item))])))) == 40


def test_an_item_in_most_documents_is_found(docs, bench):
    texts = [f"start {i} {ITEM} end {i}" for i in range(40)]
    assert len(found(decontam.leaks(docs(texts), bench([(1, ITEM)])))) == 40


def test_blocks_of_the_benchmark(docs, bench, monkeypatch):
    items = [(i, " ".join(f"q{i}x{j}" for j in range(15))) for i in range(12)]
    monkeypatch.setattr(decontam, "BLOCK_NGRAMS", 30)
    assert set(found(decontam.leaks(docs([t for _, t in items]), bench(items)))) == {(i, i) for i in range(12)}


def test_stage(docs, bench):
    df = docs([ITEM, "clean", None, (0, "clean too")], "extra")
    out = decontam.decontaminated(df, bench([(1, ITEM)]))
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["text"]) == [(0, "clean too"), (1, "clean")]
    assert out.count() == 3
    assert decontam.decontaminated(df, bench([])).count() == 4
    assert decontam.decontaminated(docs([]), bench([(1, ITEM)])).count() == 0


def every_leak(texts, items):
    """All pairs, whole documents."""
    out = set()
    for d, text in enumerate(texts):
        words = decontam.normal(text)
        out |= {(d, i) for i, item in items if decontam.passage_leak(decontam.normal(item), words, [(0, len(words))], decontam.PERCENT)}
    return out


@pytest.mark.parametrize("copies", [1, 30, 1000])
def test_edited_copies_however_many(docs, bench, copies):
    """Copies with every fourth word changed, beside verbatim ones that make other n-grams rarer."""
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    filler = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    item = [f"w{i}" for i in range(64)]
    edited = " ".join(f"x{i}" if i % 4 == 3 else w for i, w in enumerate(item))
    texts = [f"{filler(20)} {edited} {filler(20)}" for _ in range(copies)] + [filler(60) for _ in range(1000)] + [f"{filler(9)} {' '.join(item)}"]
    got = found(decontam.leaks(docs(texts), bench([(1, " ".join(item))])))
    assert set(got) == {(i, 1) for i in [*range(copies), copies + 1000]}


def test_all_rates_of_edits_against_aligning_all_pairs(docs, bench):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(150)]
    filler = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(i, " ".join(filler(rng.randrange(14, 60)))) for i in range(8)]

    def edited(words, rate):
        out = []
        for w in words:
            kind = rng.choice("cdi") if rng.random() < rate else "k"
            out += [] if kind == "d" else [rng.choice(pool)] if kind == "c" else [w, rng.choice(pool)] if kind == "i" else [w]
        return out

    texts = [" ".join(filler(30) + edited(items[j % 8][1].split(), (j % 10) / 20) + filler(30)) for j in range(400)]
    want, got = every_leak(texts, items), set(found(decontam.leaks(docs(texts), bench(items))))
    assert got <= want
    assert len(want) > 200
    assert len(got) >= 0.99 * len(want)


def test_items_without_id(docs, bench):
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs([ITEM, "clean"]), bench([(None, ITEM), (None, "")])).collect()} == {(0, None)}
