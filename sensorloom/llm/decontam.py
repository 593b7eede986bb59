"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

Every n-gram of a test item that a document has is a seed hit. Of the n-grams of an
item that documents have, a seed is rare if it is among the rarer half, if it is the
rarest of some LEAST_WORDS words of the item, whatever the others there, or if few
documents have it. A copy may share only n-grams that many documents have, such as an edited
copy that leaked often: so a passage is also tried, however frequent its n-grams,
if it shares as many different ones as any copy with that many changed words must
(``shared_least``). Around the seeds of such passages a document's words are aligned with the item
(local alignment: matches count, mismatches and gaps cost), so copies with
inserted, dropped or changed words still score. A passage counts as a leak if its
score reaches ``percent`` of the item's own, or if it is an excerpt: EXCERPT words and
more, whatever their share of the item, verbatim or with few changes. Passages that
stand apart count together by the words of the item that they cover.

Test items are scanned for in blocks of at most ``block_ngrams`` n-grams; a block
is what each task holds, so a large benchmark means more passes, never a larger
broadcast. Texts are read whole; they are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, sized, table, thin, unused, whole
from sensorloom.plans.staging import staged

#: Words of a seed, and n-grams of test items that are looked for in one pass.
SEED_WORDS, BLOCK_NGRAMS = 3, 200_000
#: A seed in at most one of so many documents is rare.
RARE_ONE_IN = 1_000
#: Share of an item's own score that makes a leak.
PERCENT = 60
#: Matching words that a leak has at least (all words of a shorter item).
LEAST_WORDS = 6
#: Words of an excerpt that is a leak by itself, and the percentage of its length that its score reaches.
EXCERPT, DENSE = 13, 80
MATCH, MISMATCH, GAP = 2, -1, -1


def normal(text: str | None) -> list[str]:
    """Lower-cased words without marks at their ends."""
    out = []
    for w in (text or "").lower().split():
        w = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—")
        if w:
            out.append(w)
    return out


def align(item: list[str], passage: list[str]) -> tuple[int, int]:
    """Best local alignment: (score, end in the passage, exclusive)."""
    if not item or not passage:
        return 0, 0
    number: dict[str, int] = {}
    b = np.array([number.setdefault(w, len(number)) for w in passage])
    ramp = -GAP * np.arange(len(b))
    row, best, end = np.zeros(len(b), np.int64), 0, 0
    for w in item:
        step = np.where(b == number.get(w, -1), MATCH, MISMATCH)
        up = np.empty_like(row)
        up[0], up[1:] = 0, row[:-1]
        cell = np.maximum(np.maximum(up + step, row + GAP), 0)
        # Gaps in the item: the running maximum of scores that lose GAP with each word.
        row = np.maximum.accumulate(cell + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k + 1
    return best, end


def longest_run(item: list[str], passage: list[str]) -> tuple[int, int]:
    """Longest run of words that stand in both: (words, end in the passage, exclusive)."""
    if not item or not passage:
        return 0, 0
    number: dict[str, int] = {}
    b = np.array([number.setdefault(w, len(number)) for w in passage])
    row, best, end = np.zeros(len(b), np.int64), 0, 0
    for w in item:
        row = np.where(b == number.get(w, -1), np.concatenate([[0], row[:-1]]) + 1, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k + 1
    return best, end


def passage_leak(item: list[str], words: list[str], windows: list[tuple[int, int]], percent: int) -> tuple[int, int, int] | None:
    """(score, first word, last word exclusive) of the leak of ``item`` in windows of a document, or None.

    The best passage if it is a leak by itself; else an excerpt; else all dense
    passages of LEAST_WORDS words and more, if the words of the item they cover make
    a leak. Then the score is that of the covered words.
    """
    need, least = MATCH * len(item), MATCH * min(len(item), LEAST_WORDS)
    pieces, todo = [], list(windows)
    while todo:
        lo, hi = todo.pop()
        score, end = align(item, words[lo:hi])
        if score < least:
            continue
        back, length = align(item[::-1], words[lo : lo + end][::-1])
        first, last = lo + end - (length if back == score else end), lo + end
        pieces.append((score, first, last))
        # A passage that is a leak needs no others from its window.
        if 100 * score < percent * need:
            todo += [(a, b) for a, b in ((lo, first), (last, hi)) if MATCH * (b - a) >= least]
    if not pieces:
        return None
    best = max(pieces, key=lambda x: x[0])
    if 100 * best[0] >= percent * need:
        return best
    dense = [x for x in pieces if 100 * x[0] >= DENSE * MATCH * (x[2] - x[1])]
    loose = [x[1:] for x in pieces if x not in dense]
    while loose:  # a longer and looser alignment may hold verbatim parts
        lo, hi = loose.pop()
        n, end = longest_run(item, words[lo:hi])
        if MATCH * n >= least:
            dense.append((MATCH * n, lo + end - n, lo + end))
            loose += [(lo, lo + end - n), (lo + end, hi)]
    longest = max(dense, key=lambda x: x[0], default=(0, 0, 0))
    if longest[0] >= MATCH * EXCERPT:
        return longest
    if len(dense) > 1:
        covered = set()
        for score, first, last in dense:
            there, end = align(words[first:last], item)
            back, length = align(words[first:last][::-1], item[:end][::-1])
            covered.update(range(end - (length if back == there else end), end))
        if 100 * len(covered) >= percent * len(item):
            return MATCH * len(covered), min(x[1] for x in dense), max(x[2] for x in dense)
    return None


def _items(benchmark: DataFrame, n: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items in blocks of about BLOCK_NGRAMS n-grams; the driver holds one block at a time."""
    held, size = [], 0
    for r in thin(benchmark, item_id="item_id", text=whole()).orderBy("item_id", "text").toLocalIterator():
        words = normal(r["text"])
        if words:
            held.append((r["item_id"], words))
            size += max(1, len(words) - n + 1)
        if size >= BLOCK_NGRAMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _grams(words: list[str], n: int) -> list[tuple[str, ...]]:
    return list(zip(*(words[j:] for j in range(n)), strict=False)) if len(words) >= n else [tuple(words)]


def shared_least(words: int, n: int = SEED_WORDS, percent: int = PERCENT) -> int:
    """n-grams that an item of so many words shares with any copy that scores ``percent`` by changed words alone, two at least.

    k changed words cost MATCH - MISMATCH each and leave at most k + 1 runs, each of which
    has n - 1 n-grams fewer than words.
    """
    changed = (100 - percent) * MATCH * words // (100 * (MATCH - MISMATCH))
    return max(2, words - changed - (n - 1) * (changed + 1))


class _Block:
    """Test items of one pass: their n-grams as numbers, and the items of each n-gram."""

    def __init__(self, items: list[tuple[int | None, list[str]]], n: int, percent: int):
        self.items, self.n = items, n
        rows = [_grams(words, n) for _, words in items]
        self.number = {g: k for k, g in enumerate(sorted({g for row in rows for g in row}))}
        self.sizes = sorted({len(g) for g in self.number})
        #: Numbers of an item's n-grams in the order of its words.
        self.rows = [[self.number[g] for g in row] for row in rows]
        self.least = [shared_least(len(words), n, percent) for _, words in items]
        self.items_of: dict[int, list[int]] = {}
        for k, row in enumerate(self.rows):
            for g in set(row):
                self.items_of.setdefault(g, []).append(k)

    def places(self, words: list[str]) -> dict[int, list[int]]:
        """Where each n-gram of the items stands in a document."""
        out: dict[int, list[int]] = {}
        for size in self.sizes:
            for at, g in enumerate(zip(*(words[j:] for j in range(size)), strict=False)):
                k = self.number.get(g)
                if k is not None:
                    out.setdefault(k, []).append(at)
        return out

    def windows(self, k: int, at: dict[int, list[int]], seeds: set[int]) -> list[tuple[int, int]]:
        """Stretches of a document (from, to; to may lie behind its end) around n-grams of item ``k`` that hold a seed or enough different n-grams."""
        reach = 2 * len(self.items[k][1]) + self.n
        out, lo, hi, held = [], 0, -1, set()
        for place, g in sorted((p, g) for g in set(self.rows[k]) & at.keys() for p in at[g]):
            if held and place - reach > hi:
                out.append((lo, hi, held))
                held = set()
            if not held:
                lo = max(0, place - reach)
            hi = place + reach
            held.add(g)
        if held:
            out.append((lo, hi, held))
        return [(lo, hi) for lo, hi, held in out if len(held) >= self.least[k] or not held.isdisjoint(seeds)]


#: Stands for "shares enough n-grams with an item" among the numbers of n-grams.
_ENOUGH = -1


def _hits(docs: DataFrame, block: _Block) -> DataFrame:
    """(doc_id, version, gram): which n-grams of the items each document has, as numbers, and _ENOUGH."""
    held = docs.sparkSession.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]):
        block = held.value
        of = block.number
        for batch in batches:
            doc, version, gram = [], [], []
            ids, versions = batch.column("doc_id").to_pylist(), batch.column("version").to_pylist()
            for i in range(batch.num_rows):
                words = normal(batch.column("text")[i].as_py())
                found = {of[g] for size in block.sizes for g in zip(*(words[j:] for j in range(size)), strict=False) if g in of}
                shared = Counter(k for g in found for k in block.items_of[g]) if len(found) > 1 else {}
                if any(c >= block.least[k] for k, c in shared.items()):
                    found.add(_ENOUGH)
                doc += [ids[i]] * len(found)
                version += [versions[i]] * len(found)
                gram += found
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(version, pa.int64()), pa.array(gram, pa.int64())], names=["doc_id", "version", "gram"])

    return docs.mapInArrow(find, "doc_id long, version long, gram long")


def rare_seeds(rows: list[list[int]], counts: dict[int, int], total: int, n: int = SEED_WORDS) -> set[int]:
    """The n-grams that are seeds by themselves, of items given by the numbers of their n-grams.

    ``counts`` holds the documents of each n-gram that any document has; others are
    no seeds and take no place among them.
    """
    out: set[int] = set()
    part = max(1, LEAST_WORDS - n + 1)
    for row in rows:
        own = sorted({g for g in row if g in counts}, key=lambda g: (counts[g], g))
        out.update(own[: (len(own) + 1) // 2], (g for g in own if counts[g] * RARE_ONE_IN <= total))
        for i in range(max(1, len(row) - part + 1)):
            there = [g for g in row[i : i + part] if g in counts]
            if there:
                out.add(min(there, key=lambda g: (counts[g], g)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, version (hash of the text), item_id, score, percent of the item's own score, first and last word (exclusive) of the passage or passages.

    Null and empty texts have no leak. Items without a word are skipped, items
    shorter than ``n`` words are one seed, items of one id, or without one, are
    separate texts of it. Repeated documents give one row for each (doc_id, text).
    """
    spark = docs.sparkSession
    docs = thin(docs, doc_id=F.col("doc_id").cast("long"), version=F.xxhash64(whole(), F.lit(4)), text=whole())
    total = docs.count()
    out = spark.createDataFrame([], _LEAK)
    for items in _items(thin(benchmark, item_id=F.col("item_id").cast("long"), text="text"), n):
        out = out.unionByName(_block_leaks(docs, _Block(items, n, percent), total, percent))
    # An item whose text repeats, or a row that does, is one leak: the best.
    best = out.groupBy("doc_id", "version", "item_id").agg(F.max(F.struct("score", "percent", "first_word", "last_word")).alias("b"))
    return best.select("doc_id", "version", "item_id", "b.*")


_LEAK = "doc_id long, version long, item_id long, score long, percent long, first_word long, last_word long"


def _block_leaks(docs: DataFrame, block: _Block, total: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    hits = staged(_hits(docs, block), "seed-hits")
    counts = dict(hits.where(F.col("gram") != _ENOUGH).groupBy("gram").count().collect())  # at most one row for each n-gram of the block
    seeds = rare_seeds(block.rows, counts, total, block.n)
    wanted = spark.createDataFrame([(g,) for g in [_ENOUGH, *sorted(seeds)]], "gram long")
    # Thin rows; the seeds are bounded by the block.
    seeded = hits.join(F.broadcast(wanted), "gram").select(F.col("doc_id").alias("_id"), F.col("version").alias("_v")).distinct()
    found = docs.join(sized(staged(seeded, "seeded")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_v"))).select("doc_id", "version", "text")
    held = spark.sparkContext.broadcast((block, seeds))

    def scored(batches: Iterator[pa.RecordBatch]):
        block, seeds = held.value
        for batch in batches:
            rows = []
            ids, versions = batch.column("doc_id").to_pylist(), batch.column("version").to_pylist()
            for i in range(batch.num_rows):
                words = normal(batch.column("text")[i].as_py())
                at = block.places(words)
                shared = Counter(k for g in at for k in block.items_of[g])
                likely = {k for k, c in shared.items() if c >= block.least[k]} | {k for g in seeds & at.keys() for k in block.items_of[g]}
                for k in likely:
                    item, item_words = block.items[k]
                    windows = [(lo, min(len(words), hi)) for lo, hi in block.windows(k, at, seeds)]
                    leak = passage_leak(item_words, words, windows, percent)
                    if leak:
                        rows.append((ids[i], versions[i], item, leak[0], 100 * leak[0] // (MATCH * len(item_words)), leak[1], leak[2]))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(7)], names=[f.split()[0] for f in _LEAK.split(", ")])

    return found.mapInArrow(scored, _LEAK)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak, with all columns, whatever their names.

    A row is judged by its doc_id and text: other texts of the same id, or without
    one, stay. Rows that repeat go together. Null and empty texts stay.
    """
    one, two = unused(docs, "_id", "_v")
    found = staged(leaks(docs, benchmark).select(F.col("doc_id").alias(one), F.col("version").alias(two)).distinct(), "leaks")
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.xxhash64(whole(), F.lit(4)) == F.col(two))
    return docs.join(sized(found), here, "left_anti")


@query("op4_decontaminate")
def op4(spark, sf_dir):
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "score", "percent", "first_word", "last_word")
