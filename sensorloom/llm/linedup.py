"""Line dedup by alignment of overlapping documents.

A block of consecutive lines that an earlier document has too, of at least
``block_words`` words, goes from the later document. Documents are paired by the
shortest parts of such blocks: the shortest run of lines from each line on, and up
to each line, that reaches ``block_words`` words. Each run pairs a document with
the first document that has it, however many have it. A pair is aligned by a
patience diff of its lines, and aligned blocks of ``block_words`` words go. A run
that the diff leaves (held twice, in another order, without a line that is unique in
both) is aligned by the longest common block around it, until no run is left.

Every line of a common block is in such a run within the block, so the aligned
blocks are exactly the lines of all common blocks: in any number of documents, in
any order, repeated or not, and whichever documents have them first. A pair without
a shared run has no common block, so a shared line alone, rare or not, pairs nobody.

Proof: let less than ``block_words`` words stand from a line to the end of its
block, and from the block's start to it (else a run from or up to the line does).
Of the lines before it, the last one from which the words reach ``block_words`` by
the end of the block has its shortest run end at the line or behind it.

Runs and lines are hashes; texts are read again only where lines go.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import SPACE, columns, numbered, query, sized, table, unused, whole, words
from sensorloom.llm.setjoin import _mix
from sensorloom.plans.staging import staged

#: No limit of the operator: tests take groups larger than this.
RARE_DOCS = 20
#: Words of a common block that is deleted.
BLOCK_WORDS = 12
#: Rows of a batch of runs.
OUT_ROWS = 50_000


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (ascending in the first) that ascends in the second too."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, lines) in ascending order, by a patience diff of two texts."""
    matched: dict[int, int] = {}
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            matched[lo] = low
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            matched[hi] = high
        if lo >= hi or low >= high:
            continue
        one, two = Counter(a[lo:hi]), Counter(b[low:high])
        where = {x: j for j, x in enumerate(b[low:high], low) if two[x] == 1}
        anchors = _ascending([(i, where[x]) for i, x in enumerate(a[lo:hi], lo) if one[x] == 1 and x in where])
        if not anchors:
            continue
        last, last2 = lo, low
        for i, j in anchors:
            todo.append((last, i, last2, j))
            matched[i] = j
            last, last2 = i + 1, j + 1
        todo.append((last, hi, last2, high))
    blocks: list[list[int]] = []
    for i, j in sorted(matched.items()):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def longest_block(a: np.ndarray, b: np.ndarray, start: int, lines: int) -> tuple[int, int]:
    """(start in b, lines) of a longest common block around ``b[start : start + lines]``: farthest on, then farthest back. Without one: no lines."""
    at = np.arange(len(a) - lines + 1)
    for k in range(lines):
        at = at[a[at + k] == b[start + k]]
    if not len(at):
        return start, 0
    end = start + lines
    while end < len(b):
        on = at[at + end - start < len(a)]
        on = on[a[on + end - start] == b[end]]
        if not len(on):
            break
        at, end = on, end + 1
    low = start
    while low:
        back = at[at > start - low]
        back = back[a[back - start + low - 1] == b[low - 1]]
        if not len(back):
            break
        at, low = back, low - 1
    return low, end - low


def aligned_lines(a: np.ndarray, b: np.ndarray, counts: np.ndarray, runs: list[tuple[int, int]], block_words: int) -> np.ndarray:
    """Lines of ``b`` (``counts``: their words) in aligned blocks of ``block_words`` words; ``runs`` (start, lines) of ``b`` are those that ``a`` has."""
    gone = np.zeros(len(b), bool)
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    for _, start, lines in patience(a.tolist(), b.tolist()):
        if before[start + lines] - before[start] >= block_words:
            gone[start : start + lines] = True
    for start, lines in sorted(runs):
        if not gone[start : start + lines].all():
            low, size = longest_block(a, b, start, lines)
            gone[low : low + size] = True
    return np.flatnonzero(gone)


def _lines(docs: DataFrame) -> DataFrame:
    """Thin rows, one for each different (doc_id, text): line hashes, words of each line, and a key that orders documents."""
    text = whole()
    lines = F.split(text, "\n")
    counted = F.transform(lines, lambda x: F.size(words(x)))
    hashes = F.transform(lines, lambda x: F.xxhash64(F.trim(F.regexp_replace(x, SPACE, " "))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.lit(3)).alias("version"), hashes.alias("hashes"), counted.alias("words"))
    return rows.groupBy("doc_id", "version").agg(F.first("hashes").alias("hashes"), F.first("words").alias("words"))


def run_keys(hashes: np.ndarray, counts: np.ndarray, ends: np.ndarray, block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, first line, lines, key) of the shortest runs of ``block_words`` words from each line on and up to each line.

    ``hashes`` and ``counts``: line hashes and words of all documents one behind the other; ``ends``: where each document ends.
    """
    n = len(hashes)
    after = np.cumsum(counts, dtype=np.int64)
    before = after - counts
    line = np.arange(n)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    doc = np.repeat(np.arange(len(ends)), ends - starts)
    last = np.searchsorted(after, before + block_words, "left")
    down = last < ends[doc]
    first = np.searchsorted(before, after - block_words, "right") - 1
    up = first >= starts[doc]
    low, high = np.concatenate([line[down], first[up]]), np.concatenate([last[down], line[up]])
    # Most runs are found both ways.
    low, high = np.divmod(np.unique(low * n + high), n) if n else (low, high)
    acc, size = _mix(hashes[low].view(np.uint64), 0), high - low + 1
    todo = np.flatnonzero(size > 1)
    step = 1
    with np.errstate(over="ignore"):
        while len(todo):
            acc[todo] = _mix(acc[todo] * np.uint64(0x100000001B3) + hashes[low[todo] + step].view(np.uint64), 1)
            step += 1
            todo = todo[size[todo] > step]
    return doc[low], low - starts[doc[low]], size, acc.view(np.int64)


def _runs(rows: DataFrame, block_words: int) -> DataFrame:
    """_row, start, lines, key: the runs of each document."""

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in _slices(batch):
                lists = part.column("hashes")
                ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
                doc, start, size, key = run_keys(lists.flatten().to_numpy(), part.column("words").flatten().to_numpy(), ends, block_words)
                row = part.column("_row").to_numpy()[doc]
                for lo in range(0, len(doc), OUT_ROWS):
                    hi = lo + OUT_ROWS
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[lo:hi], pa.int64()), pa.array(start[lo:hi], pa.int32()), pa.array(size[lo:hi], pa.int32()), pa.array(key[lo:hi], pa.int64())], names=["_row", "start", "lines", "key"]
                    )

    return rows.select("_row", "hashes", "words").mapInArrow(cut, "_row long, start int, lines int, key long")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, 500):
        yield batch.slice(lo, 500)


def _aligned(pairs: DataFrame, block_words: int) -> DataFrame:
    """_row, gone: the lines that the alignment of each pair takes from its later document."""

    def align(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            own, words_of, first, start, size = (_lists(batch.column(c)) for c in ("hashes", "words", "first_hashes", "starts", "sizes"))
            gone = [
                aligned_lines(a, b, counts, list(zip(s.tolist(), n.tolist(), strict=True)), block_words)
                for a, b, counts, s, n in zip(first, own, words_of, start, size, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(gone, pa.list_(pa.int32()))], names=["_row", "gone"])

    return pairs.select("_row", "hashes", "words", "first_hashes", "starts", "sizes").mapInArrow(align, "_row long, gone array<int>")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column, none of them null."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))[:-1])


def repeated_lines(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, version, gone): positions of the lines to delete, for each document that loses any. Written."""
    # Numbers stand for the order of documents: a number is a far smaller key than an id and a version.
    rows = staged(numbered(_lines(docs), ["doc_id", "version"], {}, "documents"), "lines")
    runs = _runs(rows, block_words)
    # Counted map-side first: a very common run costs a row for each task.
    known = runs.groupBy("key").agg(F.min("_row").alias("first"), F.max("_row").alias("_last"))
    shared = staged(known.where("first < _last").select("key", "first"), "shared-runs")
    found = runs.join(sized(shared), "key").where("_row > first").select("_row", "first", F.struct("start", "lines").alias("run"))
    pairs = found.groupBy("_row", "first").agg(F.collect_list("run").alias("runs")).select("_row", "first", F.col("runs.start").alias("starts"), F.col("runs.lines").alias("sizes"))
    # The first documents come last: their lines go from the join to the alignment, not through another shuffle.
    later = pairs.join(rows.select("_row", "hashes", "words"), "_row")
    firsts = rows.select(F.col("_row").alias("first"), F.col("hashes").alias("first_hashes"))
    aligned = _aligned(later.join(firsts, "first"), block_words)
    gone = aligned.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")).where(F.size("gone") > 0)
    return staged(rows.select("_row", "doc_id", "version").join(gone, "_row").select("doc_id", "version", "gone"), "gone-lines")


def without_repeated_lines(docs: DataFrame, counted: str = "_lines_gone", **params: int) -> DataFrame:
    """``docs`` with ``text`` less the lines that an earlier document has in a common block, and their number as ``counted``.

    Earlier means a smaller doc_id (null first), for equal ids a smaller text hash;
    rows that repeat are one document. Line ends of kept lines stay. Null texts
    stay null. All rows and columns stay, but a column called ``counted`` is
    replaced; a document may become empty.
    """
    docs = docs.drop(counted)
    one, two, lost = unused(docs, "_id", "_v", "_gone")
    gone = repeated_lines(docs, **params).select(F.col("doc_id").alias(one), F.col("version").alias(two), F.col("gone").alias(lost))
    version = F.xxhash64(whole(), F.lit(3))
    joined = docs.join(sized(gone), F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (version == F.col(two)), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(lost, i)), "\n")
    return joined.select(
        *[F.when(F.col(lost).isNull(), F.col("text")).otherwise(left).alias(n) if n == "text" else c for n, c in zip(docs.columns, columns(docs), strict=True)],
        F.coalesce(F.size(lost), F.lit(0)).alias(counted),
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with shortened texts and their ``n_chars``; documents that lost every word go.

    Null and empty texts stay as they are. Rows that repeat are one document, so
    they lose the same lines. Columns may have any name.
    """
    (lost,) = unused(docs, "_lines_gone")
    out = without_repeated_lines(docs, lost)
    kept = out.where((F.col(lost) == 0) | (F.length(F.regexp_replace(whole(), SPACE, "")) > 0))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*columns(docs))


@query("op10_line_alignment")
def op10(spark, sf_dir):
    """Per document: lines deleted, and the length and hash of what is left of its text."""
    out = without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_lines_gone").cast("long").alias("lines_deleted"), F.length(whole()).cast("long").alias("chars_left"), F.md5(whole()).alias("text_md5"))
