"""Shards of nearly equal bytes by a minimax contiguous partition.

Documents with equal texts form one group that is never split. Groups stand in
the order of their smallest doc_id. The smallest capacity for which a greedy
check fits all groups into the shards is found by binary search, and the order is
cut there.

The search runs on the driver over a bounded number of known group boundaries.
Each capacity is checked twice: strictly, cutting at known boundaries only, and
leniently, cutting anywhere between two boundaries that have unknown groups
between them. The true answer lies between the two smallest feasible capacities;
boundaries are refined (one aggregation over the written group table) only
where a cut can still fall, until both agree.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import numbered, query, table, thin, whole
from sensorloom.plans.staging import staged

#: Boundaries the driver asks for in a round.
POINTS = 20_000


class Edges:
    """Known boundaries in ascending order, from 0 to the total; ``whole[i]``: one group fills the gap after boundary i."""

    def __init__(self, at: np.ndarray, whole_gap: np.ndarray, total: int):
        self.at, self.whole, self.total = at, whole_gap, total

    def strict(self, x: int, room: int) -> int:
        return int(self.at[np.searchsorted(self.at, x + room, "right") - 1])

    def lenient(self, x: int, room: int) -> int:
        y = x + room
        if y >= self.total:
            return self.total
        i = int(np.searchsorted(self.at, y, "right")) - 1
        return int(self.at[i]) if self.whole[i] else y

    def reaches(self, reach, room: int, shards: int) -> list[int]:
        x, out = 0, []
        for _ in range(shards):
            x = max(x, reach(x, room))
            out.append(x)
        return out

    def smallest(self, reach, least: int, shards: int) -> int:
        lo, hi = least, max(least, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.reaches(reach, mid, shards)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo


def _points(groups: DataFrame, spans: list[tuple[int, int]], points: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries within the spans, about ``points`` of them, and whether a single group follows each."""
    width = sum(b - a for a, b in spans)
    step = max(1, -(-width // points))
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | ((F.col("before") >= a) & (F.col("before") < b))
    rows = (
        groups.where(inside).groupBy(F.floor(F.col("before") / step).alias("_slot"))
        .agg(F.min("before").alias("at"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    )
    return np.array([r["at"] for r in rows], np.int64), np.array([r["n"] == 1 for r in rows], bool)


def minimax_cuts(groups: DataFrame, shards: int, points: int = POINTS) -> tuple[int, list[int]]:
    """(capacity, ``shards`` - 1 cut positions) for a written table of groups with ``before`` (bytes before the group) and ``bytes``.

    Among the partitions of the smallest capacity, each cut is taken next to its equal share of the total.
    """
    top = groups.agg(F.max("bytes").alias("most"), F.max(F.col("before") + F.col("bytes")).alias("total")).first()
    if top["total"] is None:
        return 0, []
    total, least = int(top["total"]), max(int(top["most"]), -(-int(top["total"]) // shards))
    at, single = _points(groups, [(0, total)], points)
    while True:
        edges = Edges(np.append(at, total), np.append(single, True), total)
        low, high = edges.smallest(edges.lenient, least, shards), edges.smallest(edges.strict, least, shards)
        if low == high:
            break
        reach = [0, *edges.reaches(edges.lenient, high, shards)]
        windows = [(max(0, total - (shards - k) * high), reach[k]) for k in range(1, shards)]
        spans: list[list[int]] = []
        for i in np.flatnonzero(~single):  # gaps with unknown boundaries that a cut can fall into
            a, b = int(edges.at[i]), int(edges.at[i + 1])
            if any(a <= hi and lo < b for lo, hi in windows):
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        if len(spans) > 4 * shards:  # join neighbours: the filter stays short
            spans = [[spans[0][0], spans[-1][1]]]
        points *= 2
        new, new_single = _points(groups, [(a, b) for a, b in spans], points)
        keep = np.ones(len(at), bool)
        for a, b in spans:
            keep &= (at < a) | (at >= b)
        at, single = np.concatenate([at[keep], new]), np.concatenate([single[keep], new_single])
        order = np.argsort(at, kind="stable")
        at, single = at[order], single[order]
    known = edges.at
    # From the right: the earliest boundary before which a cut must not fall.
    floor = [0] * (shards + 1)
    floor[shards] = total
    for k in range(shards - 1, 0, -1):
        floor[k] = int(known[np.searchsorted(known, max(0, floor[k + 1] - high), "left")])
    cuts, x = [], 0
    for k in range(1, shards):
        far = edges.strict(x, high)
        want = total * k // shards
        i = int(np.searchsorted(known, want, "left"))
        near = min((int(known[j]) for j in (i - 1, i) if 0 <= j < len(known)), key=lambda p: abs(p - want))
        x = max(x, floor[k], min(far, near))
        cuts.append(x)
    return high, cuts


def contiguous_shards(docs: DataFrame, shards: int = 24, points: int = POINTS) -> DataFrame:
    """doc_id, size (bytes of the text and 8; null: 8), text_crc32, shard, slot (gapless from 0 in each shard).

    A null text counts as an empty one. Repeated rows get slots of their own;
    rows without doc_id come first. With fewer groups than shards some stay empty.
    """
    rows = staged(
        thin(
            docs, doc_id=F.col("doc_id").cast("long"), size=(F.octet_length(whole()) + 8).cast("long"),
            text_crc32=F.crc32(F.encode(whole(), "UTF-8")), _key=F.unhex(F.sha2(F.encode(whole(), "UTF-8"), 256)),
        ), "sizes",
    )
    groups = rows.groupBy(F.col("_key").alias("_k")).agg(F.min("doc_id").alias("_first"), F.sum("size").alias("bytes"))
    groups = staged(numbered(groups, ["_first", "_k"], {"before": "bytes"}, "groups").drop("_row"), "placed")
    _, cuts = minimax_cuts(groups, shards, points)
    shard = sum((F.when(F.col("before") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = groups.select("_k", "_first", shard.cast("int").alias("shard"))
    # A hot group is one key here: adaptive execution splits it, and the order below by doc_id too.
    joined = rows.join(placed, F.col("_key") == F.col("_k")).drop("_k")
    ordered = staged(numbered(joined, ["shard", "_first", "_key", "doc_id"], {}, "rows"), "rows")
    first = ordered.groupBy(F.col("shard").alias("_s")).agg(F.min("_row").alias("_row0"))  # one row a shard
    out = ordered.join(F.broadcast(first), F.col("shard") == F.col("_s"))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_row0")).alias("slot"))


def _law(name: str) -> Column:
    return F.lit(name).alias("law")


@query("op6_minimax_shards")
def op6(spark, sf_dir):
    out = contiguous_shards(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", _law("bytes"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
