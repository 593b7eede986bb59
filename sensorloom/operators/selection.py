"""Moments and exact quantiles of many groups by narrowing brackets.

A quantile is a value of known rank. Its bracket is first the range of its group. While a bracket holds
many rows, one pass counts the rows of ``BINS`` equal bins inside every open bracket, which Spark combines
map-side, and the bin with the rank becomes the bracket, from its smallest to its largest value. What is
left in brackets of at most ``PICK`` rows is counted value by value, and the rank is picked
there. So continuous values are not shuffled one by one, and the picks are values of the data.
Bins need not be exact: they only have to keep the order of values, and rounding does.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.plans.ordered import join_null_safe
from sensorloom.plans.staging import staged

BINS = 512
#: Most rows of a bracket whose values are counted one by one.
PICK = 10_000

_LARGEST = 1.7976931348623157e308


@dataclass
class Values:
    """Numeric ``columns`` of staged ``rows`` in ``groups``. With ``tags``, an array, a row is in a group (``subset``) for each tag."""

    rows: DataFrame
    groups: list[str]
    columns: list[str]
    tags: str | None = None

    @property
    def base(self) -> list[str]:
        return [*self.groups, "column"]

    @property
    def keys(self) -> list[str]:
        return [*self.groups, *(["subset"] if self.tags else []), "column"]

    @property
    def counted(self) -> list[str]:
        """What rows are counted by: tags stay arrays until the counts are small."""
        return [*self.groups, *([self.tags] if self.tags else []), "column"]

    def long(self) -> DataFrame:
        """(groups, tags, column, value), nulls left out."""
        ids = [*self.groups, *([self.tags] if self.tags else [])]
        return self.rows.unpivot(ids, self.columns, "column", "value").filter(F.col("value").isNotNull())

    def by_subset(self, counts: DataFrame) -> DataFrame:
        return counts.withColumn("subset", F.explode(self.tags)).drop(self.tags) if self.tags else counts


def values_of(df: DataFrame, groups: Sequence[str], columns: Sequence[str], tags: str | None = None) -> Values:
    """The columns as doubles, written once for the passes to come."""
    ids = [*groups, *([tags] if tags else [])]
    narrow = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return Values(staged(narrow, "values"), list(groups), list(columns), tags)


def moments(values: Values) -> DataFrame:
    """count, mean, std (n - 1), min and max per (groups, subset, column), in one pass.

    Parts are merged by their own means, so large values of small spread stay exact.
    """
    parts = values.long().groupBy(*values.counted).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    if not values.tags:
        spread = F.when(F.col("_n") > 1, F.sqrt(F.col("_var") * F.col("_n") / (F.col("_n") - 1)))
        return parts.select(*values.keys, F.col("_n").alias("count"), F.col("_mean").alias("mean"), spread.alias("std"), "min", "max")
    parts = staged(values.by_subset(parts), "moments")
    total = parts.groupBy(*values.keys).agg(
        F.sum("_n").alias("count"), (F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max")
    )
    apart = F.col("_n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("mean"), F.lit(2.0)))
    squares = join_null_safe(parts.select(*values.keys, "_n", "_mean", "_var"), total.select(*values.keys, "mean"), values.keys).groupBy(*values.keys).agg(F.sum(apart).alias("_m2"))
    spread = F.when(F.col("count") > 1, F.sqrt(F.col("_m2") / (F.col("count") - 1)))
    return join_null_safe(total, squares, values.keys).select(*values.keys, "count", "mean", spread.alias("std"), "min", "max")


def _inside(values: Values, brackets: DataFrame) -> DataFrame:
    """Rows with the bracket (lo, hi) of their group that they lie in."""
    renamed = brackets.withColumnsRenamed({k: f"_{k}" for k in values.base})
    # Without groups there are a few brackets for each column of the call.
    renamed = renamed if values.groups else F.broadcast(renamed)
    same = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    for k in values.base:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return values.long().join(renamed, same).drop(*[f"_{k}" for k in values.base])


def _bin() -> Column:
    """Number of the value's bin; does not fall when the value grows. Infinite values count as the largest numbers, NaN lies above."""
    finite = lambda c: F.least(F.greatest(F.col(c), F.lit(-_LARGEST)), F.lit(_LARGEST)) / 2
    low, width = finite("lo"), finite("hi") - finite("lo")
    inner = F.least(F.floor((finite("value") - low) / width * BINS), F.lit(BINS - 2))
    # The ends have bins of their own, so that every pass tells them apart.
    return F.when(F.col("value") == F.col("lo"), -1).when(F.col("value") == F.col("hi"), BINS).when(width > 0, F.greatest(inner, F.lit(0))).otherwise(0).cast("int")


def quantiles(values: Values, totals: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per (groups, subset, column). ``totals`` come from ``moments``."""
    keys, base = values.keys, values.base
    ranks = []
    for name, share in shares.items():
        at = (F.col("count") - 1) * F.lit(float(share))
        ranks += [F.struct(F.lit(f"{name}_{side}").alias("name"), rank.cast("long").alias("rank")) for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at)))]
    ends = totals.groupBy(*base).agg(F.min("min").alias("lo"), F.max("max").alias("hi"), F.max("count").alias("_n"))
    wanted = join_null_safe(totals.select(*keys, F.explode(F.array(*ranks)).alias("_r")), ends, base)
    # below: rows of the group under the bracket; held: rows inside, of the group's largest subset.
    targets = staged(wanted.select(*keys, "_r.name", "_r.rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("_n").alias("held")), "targets")
    done = []
    while True:
        wide = (F.col("held") > PICK) & (F.col("lo") != F.col("hi"))
        done.append(targets.where(~wide))
        targets = targets.where(wide)
        if targets.isEmpty():
            break
        counts = _inside(values, targets.select(*base, "lo", "hi").distinct()).groupBy(*values.counted, "lo", "hi", _bin().alias("_bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("_lo"), F.max("value").alias("_hi")
        )
        counts = staged(counts, "bins")
        cut = [*base, "lo", "hi", "_bin"]
        edges = counts.groupBy(*cut).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        own = values.by_subset(counts.drop("_lo", "_hi")).groupBy(*keys, "lo", "hi", "_bin").agg(F.sum("n").alias("n"))
        # At most BINS + 2 rows in a window.
        upto = F.sum("n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        own = join_null_safe(own.withColumn("_upto", upto), edges, cut)
        found = join_null_safe(targets, own, [*keys, "lo", "hi"])
        found = found.where((F.col("rank") < F.col("below") + F.col("_upto")) & (F.col("rank") >= F.col("below") + F.col("_upto") - F.col("n")))
        targets = staged(found.select(
            *keys, "name", "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("below") + F.col("_upto") - F.col("n")).alias("below"), F.col("n").alias("held")
        ), "targets")
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    flat = settled.where(F.col("lo") == F.col("hi")).select(*keys, "name", F.col("lo").alias("value"))
    small = settled.where(F.col("lo") != F.col("hi"))
    counts = _inside(values, small.select(*base, "lo", "hi").distinct()).groupBy(*values.counted, "lo", "hi", "value").agg(F.count(F.lit(1)).alias("n"))
    own = values.by_subset(counts).groupBy(*keys, "lo", "hi", "value").agg(F.sum("n").alias("n"))
    # At most PICK rows of a subset in a window.
    upto = F.sum("n").over(Window.partitionBy(*keys, "lo", "hi").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    picked = join_null_safe(small, own.withColumn("_upto", upto), [*keys, "lo", "hi"])
    picked = picked.where((F.col("rank") < F.col("below") + F.col("_upto")) & (F.col("rank") >= F.col("below") + F.col("_upto") - F.col("n"))).select(*keys, "name", "value")
    names = [f"{name}_{side}" for name in shares for side in ("lo", "hi")]
    wide = flat.unionByName(picked).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"_{n}") for n in names])
    wide = join_null_safe(wide, totals.select(*keys, "count"), keys)
    out = []
    for name, share in shares.items():
        at, lo, hi = (F.col("count") - 1) * F.lit(float(share)), F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return wide.select(*keys, *out)


def summary(values: Values, shares: dict[str, float]) -> DataFrame:
    """count, mean, std, min, the quantiles and max per (groups, subset, column)."""
    totals = staged(moments(values), "totals")
    return join_null_safe(totals, quantiles(values, totals, shares), values.keys).select(*values.keys, "count", "mean", "std", "min", *shares, "max")
