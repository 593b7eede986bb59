"""Best-fit packing of token pieces into sequences by matching large items.

Pieces above a third of the capacity fit at most two to a sequence. They are
matched greedily: from the longest down, each takes the longest partner that
still fits. Smaller pieces, from the longest down, go where the least room is
left that holds them, and open a sequence only where none does.

Lengths are whole numbers up to the capacity, so equal pieces are exchangeable
and the plan needs only their counts: at most ``capacity`` numbers, whatever the
corpus. The driver makes the plan from those counts in runs of equal sequences;
the pieces are numbered within their length and find their run by a join.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table, thin, whole
from sensorloom.llm.tokens import encoded
from sensorloom.plans.staging import staged

CAPACITY = 1024

PIECES = "doc_id long, piece int, start long, length long, ids binary"
PLAN = "_length long, _from long, _to long, _per long, _first long, _at long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] * (n > 0) + [(at, capacity) for at in range(head, n, capacity)]


def token_pieces(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, **sizes: int) -> DataFrame:
    """Encode whole texts (null: empty) and cut those longer than ``capacity``.

    Every document has the end id at least, so none is lost. ``ids`` holds
    little-endian unsigned 32-bit integers. Other columns are not carried. ``sizes``
    are those of ``tokens.encoded``; they change memory and time, not the pieces.
    """

    def pieces(batches: Iterator[pa.RecordBatch]):
        for part, coded in encoded(batches, path, end, **sizes):
            rows = [(i, k, s, n, ids[s : s + n]) for i, ids in enumerate(coded) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())).cast(pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4].astype("<u4").tobytes() for r in rows], pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return thin(docs, doc_id="doc_id", text="text").mapInArrow(pieces, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from, to, per, first, at): pieces ``from`` to ``to`` of that length, ``per`` to a sequence from ``first`` on, placed from ``at``."""
    left = {n: c for n, c in counts.items() if c > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths must be between 1 and the capacity")
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)
    opened = 0

    def place(n: int, per: int, first: int, many: int, at: int) -> None:
        runs.append((n, taken[n], taken[n] + per * many, per, first, at))
        taken[n] += per * many
        left[n] -= per * many

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            fits = [p for p in large if p <= min(n, capacity - n) and left[p] > (p == n)]
            if not fits:
                many = left[n]
                place(n, 1, opened, many, 0)
                rooms[capacity - n].append((opened, many))
            else:
                p = fits[-1]
                many = left[n] // 2 if p == n else min(left[n], left[p])
                place(n, 1, opened, many, 0)
                place(p, 1, opened, many, n)
                rooms[capacity - n - p].append((opened, many))
            opened += many
    free = sorted(rooms)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(free, n)
            if i == len(free):
                per = min(capacity // n, left[n])
                many = left[n] // per
                first, at = opened, 0
                opened += many
            else:
                room = free[i]
                first, had = rooms[room].pop()
                at = capacity - room
                per = min(room // n, left[n])
                many = min(had, left[n] // per)
                if many < had:
                    rooms[room].append((first + many, had - many))
                if not rooms[room]:
                    free.pop(i)
            place(n, per, first, many, at)
            rest = capacity - at - per * n
            if not rooms[rest]:
                insort(free, rest)
            rooms[rest].append((first, many))
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_rows: int = 100_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length and anything else) with ``sequence_id`` and ``offset``.

    ``pieces`` should be a written table. Pieces of one length are numbered in
    hash blocks of about ``block_rows`` rows each, so one length may hold most rows.
    Rows that repeat are packed as often as they come; ties go by doc_id and piece.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = plan(counts, capacity)
    blocks = max(1, sum(counts.values()) // block_rows)
    rest = [F.col(c) for c, t in pieces.dtypes if c not in ("doc_id", "piece", "length") and t in ("bigint", "int")]
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col("length").alias("_l"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank0"))
    )
    within = Window.partitionBy("length", "_block").orderBy("doc_id", "piece", *rest)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, (F.col("length") == F.col("_l")) & (F.col("_block") == F.col("_b"))).withColumn(
        "_rank", F.col("_rank") + F.col("_rank0")
    )
    runs_table = spark.createDataFrame(runs, PLAN)
    # The plan's size depends on the capacity alone: a few runs for each length and room.
    joined = ranked.join(
        F.broadcast(runs_table),
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")),
    )
    nth = F.col("_rank") - F.col("_from")
    return joined.select(
        *pieces.columns,
        (F.col("_first") + F.floor(nth / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(nth, F.col("_per")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY, **sizes: int) -> DataFrame:
    """Pieces of all documents with their checksum and place; the ids themselves are not kept in the written table.

    Null and empty texts give a piece of the end id alone. A doc_id that is null
    or repeats is packed like any other. An empty table gives no rows.
    """
    pieces = token_pieces(docs, path, end, capacity, **sizes).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(staged(pieces, "pieces"), capacity)


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents").withColumn("text", whole()), public_tokenizers.path("byte_bpe_50k.json"), end=2)
