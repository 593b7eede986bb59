from __future__ import annotations

import random

from sensorloom.llm import linedup

LONG = "this is a line of more than twelve words that two documents have in common"
OTHER = "and here is a second line of quite some words that stands behind the first"


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_patience_gives_common_blocks():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(20))]
        b = [rng.randrange(12) for _ in range(rng.randrange(20))]
        end, end2, total = 0, 0, 0
        for i, j, n in linedup.patience(a, b):
            assert i >= end
            assert j >= end2
            assert n > 0
            assert a[i : i + n] == b[j : j + n]
            end, end2, total = i + n, j + n, total + n
        assert total <= common(a, b)
    assert linedup.patience([1, 2, 3, 9, 4], [1, 2, 7, 3, 4]) == [(0, 0, 2), (2, 3, 1), (4, 4, 1)]
    assert linedup.patience([], [1]) == []


def texts(df):
    return {r["doc_id"]: r["text"] for r in linedup.without_repeated_lines(df).collect()}


def test_blocks_go_from_the_later_document(docs):
    got = texts(docs([f"own one\n{LONG}\n{OTHER}\nown two", f"first\n{LONG}\n{OTHER}\nlast", f"x\n{OTHER}", "short\nlines", "short\nlines", None, ""], "extra"))
    assert got[0] == f"own one\n{LONG}\n{OTHER}\nown two"
    assert got[1] == "first\nlast"
    assert got[2] == "x"
    assert got[4] == "short\nlines"  # two words are no evidence
    assert got[5] is None
    assert got[6] == ""


def test_a_line_of_many_documents(docs):
    """Long lines go from all but the first; short ones of many documents stay."""
    many = linedup.RARE_DOCS + 15
    got = texts(docs([f"own {i}\n{LONG}\nfour words of no\nend {i}" for i in range(many)]))
    assert got[0].count(LONG) == 1
    assert all(got[i] == f"own {i}\nfour words of no\nend {i}" or got[i] == f"own {i}\nend {i}" for i in range(1, many))


def plain(texts, least=linedup.BLOCK_WORDS):
    """Lines of each text in a block of ``least`` words that an earlier one has, by comparing all pairs."""
    lines = [[" ".join(x.split()) for x in t.split("\n")] for t in texts]
    out = []
    for k, a in enumerate(lines):
        gone = set()
        for b in lines[:k]:
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in a[i : i + n]) >= least:
                        gone.update(range(i, i + n))
        out.append(sorted(gone))
    return out


def test_a_passage_of_short_lines_in_many_documents(docs):
    """Neither the length of its lines nor the number of documents keeps a passage."""
    verse = "\n".join(f"line {i} of a verse has eight words" for i in range(8))
    couplet = "\n".join(f"two {i} words" for i in range(5))
    got = texts(docs([f"own {i}\n{verse}\nmid {i}\n{couplet}\nend {i}" for i in range(linedup.RARE_DOCS + 15)]))
    assert got.pop(0).count("\n") == 15
    assert all(t == f"own {i}\nmid {i}\nend {i}" for i, t in got.items())


def test_blocks_beyond_pairs_and_one_order(docs):
    """Lines first seen in different documents, a passage held twice, lines that repeat, another order."""
    x, y, z = (f"one line of six {w} words" for w in "xyz")
    got = texts(docs([f"{x}\na", f"{y}\nb", f"c\n{x}\n{y}\nd", f"e\n{x}\n{y}\nf", f"g\n{x}\n{y}\nh\n{x}\n{y}\ni", f"{z}\n{z}\n{LONG}\n{OTHER}", f"j\n{z}\n{z}\n{z}\nk", f"l\n{OTHER}\nm\n{LONG}\nn"]))
    assert got[2] == f"c\n{x}\n{y}\nd"
    assert got[3] == "e\nf"
    assert got[4] == "g\nh\ni"
    assert got[6] == "j\nk"
    assert got[7] == "l\nm\nn"


def test_gone_lines_are_those_of_a_brute_force(docs):
    rng = random.Random(4)
    lines = ["", " ", "one", "two words", "a line of five words", "here is a line of seven words", LONG]
    all_texts = list({"\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14))): 0 for _ in range(60)})
    want = plain(all_texts)
    assert sum(map(bool, want)) > 20
    got = {r["doc_id"]: r["gone"] for r in linedup.repeated_lines(docs(all_texts)).collect()}
    assert [got.get(i, []) for i in range(len(all_texts))] == want


def test_lines_go_by_alignment(docs, monkeypatch):
    """Pairs are aligned: what the diff leaves (another order, held twice) goes by the longest common block, nothing by runs alone."""
    import numpy as np

    a, b = np.array([1, 2, 3, 4, 5, 6]), np.array([4, 5, 6, 9, 1, 2, 3, 8, 5, 6])
    words = np.full(10, 6)
    runs = [(0, 2), (1, 2), (4, 2), (5, 2), (8, 2)]
    assert linedup.aligned_lines(a, b, words, runs, 12).tolist() == [0, 1, 2, 4, 5, 6, 8, 9]
    assert linedup.aligned_lines(a, b, words, [], 12).tolist() == [x for _, s, n in linedup.patience(a.tolist(), b.tolist()) for x in range(s, s + n) if n > 1]
    assert linedup.aligned_lines(a[:1], b, words, [(0, 2)], 12).tolist() == []  # a run whose key is another's goes nowhere
    assert linedup.longest_block(np.array([7, 7, 1, 7, 7, 7]), np.array([7, 7, 7, 7]), 1, 1) == (1, 3)
    pairs = []
    monkeypatch.setattr(linedup, "_aligned", lambda found, least, by=linedup._aligned: by(pairs.append(found) or found, least))
    text = "\n".join(f"line {i} of a text that three documents have" for i in range(6))
    got = linedup.repeated_lines(docs([text, f"own\n{text}", f"{text}\nown too", "own"])).collect()
    assert sorted((r["doc_id"], r["gone"]) for r in got) == [(1, [1, 2, 3, 4, 5, 6]), (2, [0, 1, 2, 3, 4, 5])]
    assert sorted((r["_row"], r["first"]) for r in pairs[0].collect()) == [(1, 0), (2, 0)]


def test_white_space_order_and_repeated_rows(docs):
    spaced = LONG.replace(" ", "  ")
    got = linedup.without_repeated_lines(docs([(2, LONG), (1, f"a\n {spaced} "), (2, LONG), (None, "n\n" + OTHER), (0, OTHER)])).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in got) == sorted(
        [(True, 2, ""), (True, 2, ""), (True, 1, f"a\n {spaced} "), (False, 0, "n\n" + OTHER), (True, 0, "")]
    )


def test_stage(docs):
    df = docs([LONG, LONG, f"{LONG}\nkept", "", None], "extra")
    out = linedup.line_dedup(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect() if r["text"] is not None) == [(0, LONG, len(LONG)), (2, "kept", 4), (3, "", 0)]
    assert linedup.line_dedup(docs([])).count() == 0
