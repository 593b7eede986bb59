"""Periodic runs of words: a suffix automaton whose link tree is read with link-cut access.

A run is a stretch with a period q, at least twice as long as q, that no neighbouring
word extends. Words are appended to a suffix automaton one by one. The suffixes of the
text so far are the path from the newest state to the root of the suffix-link tree, and
every state is coloured by the last place at which its strings ended. A link-cut access
walks that path in segments of one colour and recolours it. A segment whose strings last
ended at j and are up to L words long says that the last L words ended p = i - j words
earlier too: if p <= L, that is a square with smallest period p, which reaches L words
back from j and no further. If the next word breaks the period, the run ends here, so
each run is reported once, with both of its ends.

Before that, words that no run can hold are set aside: a run of 12 words or more is covered
by blocks of six words that it holds twice. What is left are stretches, each of which
has an automaton of its own; neighbours outside a stretch belong to no run.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table, text_slices, thin, whole, words

#: Fewest words of a run.
SHORTEST = 12

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class LinkTree:
    """The suffix-link tree, cut into paths of one colour; each path is a splay tree ordered by depth.

    A path's colour is kept at the root of its splay tree. Node 0 is none.
    """

    def __init__(self) -> None:
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [0, 0]

    def add(self, parent: int, colour: int) -> int:
        """A new node below ``parent``, a path of its own."""
        self.left.append(0)
        self.right.append(0)
        self.up.append(parent)
        self.colour.append(colour)
        return len(self.up) - 1

    def splay(self, x: int) -> None:
        """Make ``x`` the root of its path's splay tree."""
        left, right, up = self.left, self.right, self.up
        p = up[x]
        if left[p] != x and right[p] != x or not p:
            return
        while True:
            g = up[p]
            inner = bool(g) and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._rotate(p)
            elif inner:
                self._rotate(x)
                p = up[x]
            last = self._rotate(x)
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                self.colour[x] = self.colour[last if not inner else g]
                return

    def _rotate(self, x: int) -> int:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p] = x
        up[x] = g
        return p

    def insert_above(self, q: int, parent: int) -> int:
        """A new node between ``q`` and its ``parent``, with the colour of ``q``."""
        self.splay(q)
        above, colour = self.left[q], self.colour[q]
        if above:
            self.up[above] = self.up[q]
            self.colour[above] = colour
            self.left[q] = 0
        node = self.add(parent, colour)
        self.up[q] = node
        return node

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """(former colour, deepest node) of the segments from ``x`` to the root, which become one path of ``colour``.

        Neighbouring paths of one colour, as ``insert_above`` leaves them, are one segment.
        """
        left, right, up, shade = self.left, self.right, self.up, self.colour
        out, below = [], 0
        while x:
            p = up[x]
            if p and (left[p] == x or right[p] == x):
                self.splay(x)
            if not out or out[-1][0] != shade[x]:
                out.append((shade[x], x))
            cut = right[x]
            if cut:
                shade[cut] = shade[x]
            right[x] = below
            below = x
            x = up[x]
        shade[below] = colour
        return out


def squares_to_runs(codes: Sequence[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(shortest, 2 * period) words, by ends."""
    n = len(codes)
    # State 1 is the empty string. Ends are counted from 1, so colour 0 is never seen before.
    tree = LinkTree()
    goes: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last, out = 1, []
    for i, c in enumerate(codes, 1):
        size = length[last] + 1
        p, q = last, 0
        while p:
            q = goes[p].get(c, 0)
            if q:
                break
            p = link[p]
        if not p:
            parent = 1
        elif length[q] == length[p] + 1:
            parent = q
        else:
            parent = tree.insert_above(q, link[q])
            goes.append(goes[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = parent
            r = p
            while r and goes[r].get(c) == q:
                goes[r][c] = parent
                r = link[r]
        state = tree.add(parent, 0)
        goes.append({})
        link.append(parent)
        length.append(size)
        r = last
        while r != p:
            goes[r][c] = state
            r = link[r]
        last = state
        follow = codes[i] if i < n else None
        for j, node in tree.access(state, i):
            period, reach = i - j, length[node]
            # The run ends here unless the next word goes on with the period.
            if j and period <= reach and reach + period >= shortest and (follow is None or codes[i - period] != follow):
                out.append((i - reach - period, reach + period, period))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def stretches(doc: np.ndarray, codes: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Intervals of words that may hold runs; all other words are in none.

    A run of length n >= max(shortest, 2q) and period q holds its first n - q words twice,
    so blocks of shortest / 2 words that stand in a stretch twice cover it. Words outside
    such blocks end a stretch, until no word goes any more. Equal hashes only let more pass.
    """
    k = max(1, shortest // 2)
    at = np.arange(len(codes))
    part = doc.astype(np.int64)
    while len(at) >= k:
        h = np.full(len(at) - k + 1, 7, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                h = _mixed(h * np.uint64(0x100000001B3) + codes[at[j : len(at) - k + 1 + j]].astype(np.uint64))
            h = _mixed(h + _mixed(part[: len(h)].astype(np.uint64) + np.uint64(1)))
        # Blocks within one stretch.
        inside = part[: len(h)] == part[k - 1 :]
        h, first = h[inside], np.flatnonzero(inside)
        ordered = np.sort(h)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            return []
        place = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
        hits = first[twice[place] == h]
        marks = np.zeros(len(at) + 1, np.int64)
        np.add.at(marks, hits, 1)
        np.add.at(marks, hits + k, -1)
        kept = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        new_at, old = at[kept], part[kept]
        breaks = np.ones(len(kept), bool)
        breaks[1:] = (np.diff(new_at) > 1) | (old[1:] != old[:-1])
        new_part = np.cumsum(breaks)
        long = np.bincount(new_part)[new_part] >= shortest
        new_at, new_part = new_at[long], new_part[long]
        if len(new_at) == len(at):
            break
        at, part = new_at, new_part
    else:
        return []
    edges = np.flatnonzero(np.diff(part)) + 1
    lows, highs = [0, *edges.tolist()], [*edges.tolist(), len(at)]
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(lows, highs, strict=True)]


def worded(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(bounds of each text's words, words) of whole texts, A-Z lower-cased on request; null has none."""
    # Taken anew: Arrow splits slices that do not start at their buffer's first text wrongly.
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0)).astype(bool)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(real)])
    return before[offsets - offsets[0]], flat.filter(pa.array(real, pa.bool_()))


def _dropped(found: Sequence[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words lie in a run behind its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        marks[start + period] += 1
        marks[start + length] -= 1
    return np.cumsum(marks[:-1]) > 0


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed.

    Words are runs of characters other than ASCII white space, numbered from 0. ``runs`` are
    all runs of at least max(shortest, 2 * period) words. ``collapsed`` is the text with
    the first period of every run alone, its words joined by one space. Null, empty and blank
    texts have no words, no runs and an empty ``collapsed``. Each row is judged alone, so
    repeated rows give equal rows, and a null doc_id stays null; other columns are ignored.
    The memory of a task grows with its longest text.
    """

    def found(batches):
        for part in text_slices(batches):
            bounds, flat = worded(part.column("text"))
            coded = flat.dictionary_encode()
            codes = np.asarray(coded.indices).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
            size = np.diff(bounds)
            doc = np.repeat(np.arange(part.num_rows), size)
            runs: list[list] = [[] for _ in range(part.num_rows)]
            for lo, hi in stretches(doc, codes, shortest):
                own = int(doc[lo])
                shift = lo - int(bounds[own])
                runs[own] += [(s + shift, n, q) for s, n, q in squares_to_runs(codes[lo:hi].tolist(), shortest)]
            keep = np.ones(len(flat), bool)
            for own, many in enumerate(runs):
                if many:
                    many.sort(key=lambda r: (r[0], r[2]))
                    keep[bounds[own] : bounds[own + 1]] = ~_dropped(many, int(size[own]))
            kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
            lists = pa.ListArray.from_arrays(pa.array(kept, pa.int32()), flat.filter(pa.array(keep, pa.bool_())).cast(pa.string()))
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in many] for many in runs]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(rows, kind), pc.binary_join(lists, " ")],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = thin(docs, doc_id=F.col("doc_id").cast("long"), text="text")
    return rows.mapInArrow(found, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


# --- the registered query ---------------------------------------------------

def _repeating(docs: DataFrame) -> DataFrame:
    """The contract's documents: from word a on, one in ten repeats the p words behind a."""
    own = words(whole())
    n = F.size(own)
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    block = F.slice(own, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice(own, F.lit(1), a.cast("int")), tail), " ")
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The longest run, counts and hashes of what ``periodic_runs`` returns."""
    longest = F.when(F.size("runs") > 0, F.array_sort("runs", _longer)[0])
    listed = F.array_join(
        F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), ""
    )
    return found.withColumn("_top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_top.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _top.length div _top.period").cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _longer(a: Column, b: Column) -> Column:
    """Order by length downwards, then start, then period."""
    order = F.lit(0)
    for c, sign in (("period", 1), ("start", 1), ("length", -1)):
        order = F.when(a[c] == b[c], order).when(a[c] < b[c], F.lit(-sign)).otherwise(F.lit(sign))
    return order


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    return digest(periodic_runs(_repeating(table(spark, sf_dir, "documents"))))
