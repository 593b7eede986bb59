"""Fill-in-middle texts: cuts at ranks of units, reached through an indexable skip list.

The base lane has a node before each unit of a text (a code point, or what a pattern
matches). An express lane links every few nodes of the lane below it; each link carries its
width in units and its width in code points. To reach a rank, a descent follows links
while their unit widths fit into what is left, goes down a lane and goes on; the code
points added up on the way are the place of the cut. Which nodes rise to which lane
depends on their rank alone, so the coins are tossed once for all texts, and a rerun
builds the same lists.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.base import query, table, text_slices, thin, whole

#: One node in so many rises to the next lane.
RISE = 8


@cache
def _risen(size: int) -> tuple[np.ndarray, ...]:
    """Ranks of the nodes of each express lane, for lists of up to ``size`` units. Node 0 is in every lane."""
    step = 1 << 20
    at = np.concatenate([_winners(np.arange(lo, min(lo + step, size + 1)), 1) for lo in range(0, size + 1, step)])
    lanes = [at]
    while len(at) > RISE:
        at = _winners(at, len(lanes) + 1)
        lanes.append(at)
    return tuple(lanes)


def _winners(ranks: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (ranks.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return ranks[(x % np.uint64(RISE) == 0) | (ranks == 0)]


class SkipList:
    """Units in order; ``points`` are their widths in code points, or None if each has one."""

    def __init__(self, units: int, points: np.ndarray | None = None) -> None:
        self.units = units
        self.points = points
        place = None if points is None else np.concatenate([[0], np.cumsum(points, dtype=np.int64)])
        # From the lowest express lane up: ranks, widths in units and in code points, and where the node is one lane down.
        self.lanes = []
        size = 1 << max(10, units.bit_length())
        below = None
        for risen in _risen(size):
            ranks = risen[: np.searchsorted(risen, units, "right")]
            if len(ranks) < 2:
                break
            wide = np.diff(ranks, append=units)
            long = wide if place is None else np.diff(place[ranks], append=place[-1])
            self.lanes.append((wide, long, ranks if below is None else np.searchsorted(below, ranks)))
            below = ranks

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank (0 to ``units``)."""
        node = points = 0
        left = rank
        for wide, long, down in reversed(self.lanes):
            while node < len(wide) and wide[node] <= left:
                if not left:
                    break
                left -= int(wide[node])
                points += int(long[node])
                node += 1
            if node == len(wide):  # past the last link: only the end has this rank
                return points
            node = int(down[node])
        if self.points is None:
            return points + left
        return points + int(self.points[node : node + left].sum())


def units_of(text: str, pattern) -> np.ndarray | None:
    """Widths of the units: what ``pattern`` matches from left to right, and each code point that it skips."""
    if pattern is None:
        return None
    out, at = [], 0
    for m in pattern.finditer(text):
        a, b = m.span()
        if a == b:
            continue
        out += [1] * (a - at)
        out.append(b - a)
        at = b
    return np.array(out + [1] * (len(text) - at), np.int64)


def draws(salt: str | int, doc_id: Column, many: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the hex digits of sha256 of ``salt:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(many)]


def fill_in_middle(
    docs: DataFrame, rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), unit: str | None = None, salt: str | int = 1,
) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output.

    A text of ``n`` units is cut behind two ranks, each drawn from 0 to ``n``. ``form`` is
    ``psm`` (prefix, suffix, middle behind their marks), ``spm`` (suffix, prefix, middle; ``spm``
    percent of the transformed ones) or ``plain``: the text as it is, for 100 - ``rate`` percent of
    the texts, empty texts and texts that hold a mark. ``unit`` is a regular expression of
    units; without it each code point is one. Null texts are empty. The draws depend on
    ``salt`` and doc_id alone, so repeated rows give equal rows and rows without doc_id share
    their draws. Other columns are ignored. Whole texts are cut, one after the other.
    """
    first, second, third, fourth = draws(salt, F.col("doc_id").cast("long"))
    plain = third % 100 >= rate
    for mark in marks:
        plain = plain | F.col("text").contains(mark)
    rows = thin(docs, doc_id=F.col("doc_id").cast("long"), text=whole())
    rows = rows.select("doc_id", "text", first.alias("a"), second.alias("b"), plain.alias("plain"), (fourth % 100 < spm).alias("spm"))
    p, s, m = marks

    def cut(batches):
        import regex

        pattern = None if unit is None else regex.compile(unit)
        for part in text_slices(batches):
            out: list[tuple] = []
            columns = [part.column(c).to_pylist() for c in ("text", "a", "b", "plain", "spm")]
            for text, a, b, is_plain, is_spm in zip(*columns, strict=True):
                points = units_of(text, pattern)
                n = len(text) if points is None else len(points)
                if is_plain or not text:
                    out.append((n, "plain", None, None, text))
                    continue
                units = SkipList(n, points)
                x, y = sorted(map(units.place, (a % (n + 1), b % (n + 1))))
                prefix, middle, suffix = text[:x], text[x:y], text[y:]
                made = f"{s}{suffix}{p}{prefix}{m}{middle}" if is_spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
                out.append((n, "spm" if is_spm else "psm", x, y - x, made))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *[pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return rows.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text from an output and its form. A transformed text holds no mark, so each stands once."""
    p, s, m = map(F.lit, marks)
    front, middle = F.split_part(output, m, F.lit(1)), F.split_part(output, m, F.lit(2))
    one, two = F.lit(1), F.lit(2)
    psm = F.concat(F.split_part(F.split_part(front, s, one), p, two), middle, F.split_part(front, s, two))
    spm = F.concat(F.split_part(front, p, two), middle, F.split_part(F.split_part(front, p, one), s, two))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(cuts: DataFrame) -> DataFrame:
    return cuts.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def _draw(k: int) -> str:
    """SQL of the k-th draw: eight hex digits."""
    digits = [f"(strpos('0123456789abcdef', substr(d, {8 * k + i + 1}, 1)) - 1) * {16 ** (7 - i)}" for i in range(8)]
    return "(" + " + ".join(digits) + ")"


_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
h AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, {", ".join(f"CAST({_draw(k)} AS BIGINT) AS h{k + 1}" for k in range(4))} FROM t),
c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, x) AS pre, substr(text, x + 1, y - x) AS mid, substr(text, y + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


@query("op12_fill_in_middle", _SQL)
def op12(spark, sf_dir):
    return digest(fill_in_middle(table(spark, sf_dir, "documents")))
