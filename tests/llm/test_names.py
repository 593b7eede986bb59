"""Columns of documents that are called what the stages call their own."""

from __future__ import annotations

import pytest

from sensorloom.llm import decontam, linedup, quality, setjoin
from sensorloom.llm.base import unused

ITEM = "which of the seven old rivers flows north past the grey castle before it meets the cold inland sea"
PROSE = " ".join(f"{a}{b}" for a in ("stone", "river", "walk", "green", "house", "light", "paper") for b in ("s", "er", "ed", "ing", "ful", "ly", "ness", "less", "like"))
LINE = "twelve words that stand in two of the documents given to this stage here"
NAMES = ["_id", "_v", "_gone", "_lines_gone", "kept", "_q_words", "_q_row", "_q_text", "_first", "n", "_version", "rejected_by", "gone", "grams", "__ID", "a.b"]
STAGES = {
    "quality": lambda df, bench: quality.quality_kept(df),
    "lines": lambda df, bench: linedup.line_dedup(df),
    "jaccard": lambda df, bench: setjoin.one_of_each_group(df),
    "benchmark": decontam.decontaminated,
}
KEPT = {"quality": {0, 1, 2, 3}, "lines": {0, 1, 4, 5, 6, 2}, "jaccard": {0, 1, 2, 4, 5, 6}, "benchmark": {0, 1, 3, 4, 5, 6}}


@pytest.mark.parametrize("stage", STAGES)
def test_clashing_names(spark, docs, stage):
    other = " ".join(w[::-1] for w in PROSE.split())
    texts = [f"{PROSE}\n{LINE}", f"{other}\n{LINE}", f"{ITEM} {PROSE[::-1]}", f"{PROSE}\n{LINE}", "short", None, ""]
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    plain = docs(texts)
    df = plain.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in NAMES])
    out = STAGES[stage](df, bench)
    assert out.schema.names == df.schema.names
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == KEPT[stage]
    assert all(r[n] == f"{n}{i}" for i, r in rows.items() for n in NAMES)
    assert {i: r["text"] for i, r in rows.items()} == {r["doc_id"]: r["text"] for r in STAGES[stage](plain, bench).collect()}


def test_counted_lines_replace_a_column(docs):
    df = docs([f"a\n{LINE}", f"b\n{LINE}"]).selectExpr("*", "'x' AS _lines_gone")
    assert {r["doc_id"]: r["_lines_gone"] for r in linedup.without_repeated_lines(df).collect()} == {0: 0, 1: 1}


def test_unused(docs):
    assert unused(docs(["a"]).selectExpr("1 AS _V", "1 AS __v"), "_v", "_v", "w") == ["___v", "____v", "w"]
