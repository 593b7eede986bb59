"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule names the measures it needs. On a bounded sample every rule is timed and
its rejections are noted; rules are then ordered by rejections (among what the
rules before it keep) per second. The cascade computes a rule's measures only for
documents that no earlier rule rejected. A document is kept if no rule rejects it,
so the order never changes the verdict, only the time and ``rejected_by``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import SPACE, WORD, columns, query, table, whole, words

#: Rows of the sample that rules are timed on.
SAMPLE_ROWS = 2_000

SYMBOLS = "#*$%&|<>"

_P = "_q_"


def _m(name: str) -> Column:
    return F.col(_P + name)


def _positions() -> Column:
    """Start positions of 3-word windows found twice or more, ascending; empty without any."""
    w, size = _m("words"), F.size(_m("windows"))
    every = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("p")))
    # Equal hashes may be of different windows, different hashes never of equal ones.
    return F.when(size > F.size(F.array_distinct(_m("windows"))), F.sort_array(every)).otherwise(F.array().cast("array<struct<t:string,p:int>>"))


def _found_twice() -> Column:
    s = _m("sorted")
    twice = F.filter(s, lambda x, i: (x["t"] == F.get(s, i - 1)["t"]) | (x["t"] == F.get(s, i + 1)["t"]))
    return F.sort_array(F.transform(twice, lambda x: x["p"]))


def _covered() -> Column:
    p = _m("twice")
    steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


#: name -> (measures it is made of, expression). Each is a column of its own, so nothing is computed twice.
MEASURES: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "words": (["text"], lambda: words(_m("text"))),
    "n_words": (["words"], lambda: F.size(_m("words")).cast("long")),
    "word_chars": (["text"], lambda: (F.length(_m("text")) - F.length(F.regexp_replace(_m("text"), WORD, ""))).cast("long")),
    "n_symbols": (["text"], lambda: F.length(F.regexp_replace(_m("text"), r"[^#*$%&|<>]+", "")).cast("long")),
    "n_letters": (["text"], lambda: F.length(F.regexp_replace(_m("text"), r"\P{L}+", "")).cast("long")),
    "lines": (["text"], lambda: F.filter(F.split(_m("text"), "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)),
    "n_lines": (["lines"], lambda: F.size(_m("lines")).cast("long")),
    "n_dup_lines": (["lines"], lambda: (F.size(_m("lines")) - F.size(F.array_distinct(_m("lines")))).cast("long")),
    "windows": (
        ["words"],
        lambda: F.slice(F.transform(_m("words"), lambda x, i: F.xxhash64(x, F.get(_m("words"), i + 1), F.get(_m("words"), i + 2))), F.lit(1), F.greatest(F.size(_m("words")) - 2, F.lit(0))),
    ),
    "sorted": (["words", "windows"], _positions),
    "twice": (["sorted"], _found_twice),
    "n_repeat_words": (["twice"], _covered),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column]


#: Whole-number thresholds, so that no rounding decides.
RULES = (
    Rule("few_words", ("n_words",), lambda: _m("n_words") < 50),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda: 100 * _m("n_repeat_words") > 50 * _m("n_words")),
    Rule("symbols", ("n_words", "n_symbols"), lambda: 10 * _m("n_symbols") > _m("n_words")),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda: 2 * _m("n_dup_lines") > _m("n_lines")),
    Rule("word_length", ("n_words", "word_chars"), lambda: (10 * _m("word_chars") < 25 * _m("n_words")) | (_m("word_chars") > 12 * _m("n_words"))),
    Rule("few_letters", ("word_chars", "n_letters"), lambda: 2 * _m("n_letters") < _m("word_chars")),
)


def _with(df: DataFrame, names: tuple[str, ...], open_only: bool) -> DataFrame:
    """Adds measures and what they are made of; with ``open_only`` they stay null where a rule has rejected."""
    for name in names:
        if _P + name in df.columns:
            continue
        needs, build = MEASURES[name]
        df = _with(df, tuple(n for n in needs if n != "text"), open_only)
        df = df.withColumn(_P + name, F.when(F.col(_P + "out").isNull(), build()) if open_only else build())
    return df


def measured(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``docs`` with measures of the whole text (null: empty) as columns ``_q_<name>``."""
    return _with(docs.withColumn(_P + "text", whole()), names, False)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: int


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The rules in the order of the cascade, with their time on the sample and what each rejects of what is left.

    The sample holds about ``sample_rows`` rows, chosen by a hash of the text, whatever the size of ``docs``.
    """
    rows = docs.count()
    share = 1_000_000 if rows <= sample_rows else max(1, sample_rows * 1_000_000 // rows)
    chosen = docs.select(whole().alias("text")).where(F.pmod(F.xxhash64("text", F.lit(8)), F.lit(1_000_000)) < share)
    # Copies of one text share a hash; the limit bounds the sample where one text is a third of all rows.
    sample = chosen.limit(2 * sample_rows).repartition(4).persist()

    def timed(rule: Rule | None) -> float:
        df = sample.withColumn(_P + "text", F.col("text"))
        if rule:
            df = _with(df, rule.needs, False)
        began = time.perf_counter()
        df.agg(F.count_if(rule.rejects() if rule else F.col("text").isNull())).collect()
        return time.perf_counter() - began

    try:
        every = sample.withColumn(_P + "text", F.col("text"))
        for rule in rules:
            every = _with(every, rule.needs, False)
        every = every.select(F.array(*[F.coalesce(r.rejects(), F.lit(False)) for r in rules]).alias("_bits"))
        patterns = [(tuple(r[0]), r[1]) for r in every.groupBy("_bits").count().collect()]  # at most 2 ** rules rows
        idle = timed(None)
        cost = {r.name: max(timed(r) - idle, 1e-3) for r in rules}
    finally:
        sample.unpersist()
    out, left, open_rules = [], patterns, list(range(len(rules)))
    while open_rules:
        hits = {k: sum(n for bits, n in left if bits[k]) for k in open_rules}
        best = max(open_rules, key=lambda k: (hits[k] / cost[rules[k].name], -cost[rules[k].name], -k))
        out.append(Estimate(rules[best], cost[rules[best].name], hits[best]))
        left = [(bits, n) for bits, n in left if not bits[best]]
        open_rules.remove(best)
    return out


def cascade(docs: DataFrame, order: list[Rule]) -> DataFrame:
    """``docs`` (all columns and rows) with ``kept`` and ``rejected_by`` (the first rule in ``order`` that rejects, else null).

    Measures that ``docs`` already has (from :func:`measured`) are used. A null
    text counts as an empty one. Columns called ``kept`` or ``rejected_by`` are replaced.
    """
    names = [c for c in docs.columns if c not in ("kept", "rejected_by")]
    df = docs.withColumn(_P + "out", F.lit(None).cast("string"))
    if _P + "text" not in df.columns:
        df = df.withColumn(_P + "text", whole())
    for rule in order:
        df = _with(df, rule.needs, True)
        df = df.withColumn(_P + "out", F.coalesce(_P + "out", F.when(rule.rejects(), F.lit(rule.name))))
    return df.select(*names, F.col(_P + "out").isNull().alias("kept"), F.col(_P + "out").alias("rejected_by"))


def quality_kept(docs: DataFrame) -> DataFrame:
    """The rows that every rule keeps, with the columns of ``docs`` as they are, whatever their names.

    Null, empty and blank texts have no words and go. Rows that repeat are judged
    alike. An empty table stays empty.
    """
    order = [e.rule for e in estimate(docs)]
    # The row is carried as one value, so no column of it meets those of the cascade.
    rows = docs.select(F.struct(*columns(docs)).alias(_P + "row"), F.col("text").alias("text"))
    # A filter on `kept` alone would be pushed below the measures and compute them anew for each use.
    held = cascade(rows, order).withColumn(_P + "held", F.monotonically_increasing_id())
    return held.where(F.col("kept") & (F.col(_P + "held") >= 0)).select(_P + "row.*")


_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    length(regexp_replace(text, '\\P{L}', '', 'g')) AS n_letters,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
t AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM t) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
a AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, n_letters, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM m LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * word_chars < 25 * n_words
    OR word_chars > 12 * n_words OR 2 * n_letters < word_chars) AS kept
FROM b"""


@query("op8_quality_cascade", _SQL)
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [e.rule for e in estimate(docs)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = cascade(measured(docs, names), order)
    # What the cascade passes on beside its own columns: the measures every document is asked for.
    base = [_m(n).alias(n) for n in names]
    failed = (_m("n_words") < 50) | (100 * _m("n_repeat_words") > 50 * _m("n_words"))
    return out.select("doc_id", *base, failed.alias("base_failed"), "kept")
