"""Set operations, ordering, limits and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_years(*frames: DataFrame) -> DataFrame:
    """Stack yearly frames by column name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dedup_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def except_valid_rows(df: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the valid set."""
    return df.join(valid.select(key), key, "left_anti")


def intersect_columns_union(*frames: DataFrame) -> DataFrame:
    """Stack frames on the columns they share, in the order of the first."""
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    return reduce(DataFrame.unionByName, [f.select(*shared) for f in frames])


def sort_rows(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*by)


def head_n(df: DataFrame, n: int, by: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows in an explicit order (288 rows are one day)."""
    return df.orderBy(*by).limit(n)


def sample_seeded(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Sample by Spark's own random numbers; the rows depend on how the input is partitioned."""
    return df.sample(fraction=fraction, seed=seed)


def hash_bucket(key: Column, buckets: int = 1000) -> Column:
    """A reproducible bucket of an integer key, equal on every run and engine."""
    # The key is reduced first, so that no long overflows.
    return F.pmod(F.pmod(key, F.lit(buckets)) * F.lit(7919) + F.lit(104729), F.lit(buckets))


def sample_rows(df: DataFrame, fraction: float, key: str) -> DataFrame:
    """Reproducible sample: the same keys are kept on every run."""
    return df.filter(hash_bucket(F.col(key)) < round(fraction * 1000))


def top_importances(importances: DataFrame, n: int | None = None) -> DataFrame:
    ordered = importances.orderBy(F.desc("importance"), "feature")
    return ordered.limit(n) if n else ordered
