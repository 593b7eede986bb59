from __future__ import annotations

import random
import re
from collections import Counter

from sensorloom.llm import quality

W = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    w = re.findall(W, text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(grams)
    covered = {j for i, g in enumerate(grams) if twice[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(W, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice(["a", "b", "c", "dd", "é", "$", "|"]) + rng.choice([" ", " ", "\n", "\t", "\x0b", "\xa0", ""]) for _ in range(rng.randrange(200))) for _ in range(60)]
    return [*made, None, "", " \n ", "x", "a b", "a b c a b c", "w " * 5000, "word " * 49, "line one\nline one\nline two\n\n\n", "a a a a"]


def test_measures(docs):
    given = texts()
    rows = quality.measured(docs(given, "extra"), NAMES).collect()
    assert len(rows) == len(given)
    for r in rows:
        assert tuple(r[f"_q_{n}"] for n in NAMES) == plain(r["text"]), repr(r["text"])


def test_cascade_keeps_the_same_in_any_order(docs):
    df = docs(texts(), "extra")
    forth = {(r["doc_id"], r["kept"]) for r in quality.cascade(df, list(quality.RULES)).collect()}
    back = quality.cascade(df, list(reversed(quality.RULES)))
    assert back.columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "_row", "length", "cid", "kept", "rejected_by"]
    assert forth == {(r["doc_id"], r["kept"]) for r in back.collect()}
    assert all((r["rejected_by"] is None) == r["kept"] for r in back.collect())


def test_order_by_rejections_per_cost(docs):
    got = quality.estimate(docs([f"short {i}" for i in range(30)]))
    assert got[0].rejected == 30
    assert sum(e.rejected for e in got) == 30
    assert {e.rule.name for e in got} == {r.name for r in quality.RULES}


def test_kept_rows(docs):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    df = docs([good, "short", good + " $$$" * 20, None, (0, good)])
    assert sorted(r["doc_id"] for r in quality.quality_kept(df).collect()) == [0, 0]
    assert quality.quality_kept(df).columns == df.columns
    assert quality.quality_kept(docs([])).count() == 0
