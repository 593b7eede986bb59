"""What the corpus operators share: reading, words, keys of rows, numbering in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.plans.staging import staged
from sensorloom.session import tune_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast on request only when it was counted and has at most so many thin rows.
BROADCAST_ROWS = 400_000


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune_session(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str | Column = "text") -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def thin(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the columns an operator works on, under its own names."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as make it a new column of ``df`` (names differ by more than case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever stands in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; else left to Spark. ``df`` should be a written table."""
    return F.broadcast(df) if len(df.limit(rows + 1).select(F.lit(1)).head(rows + 1)) <= rows else df


def numbered(df: DataFrame, order: list[str], sums: dict[str, str], name: str = "ordered") -> DataFrame:
    """Number rows in the order of ``order`` from 0 (``_row``), with running sums before each row.

    Rows are dealt into ranges of the order and written once, so the ranges are
    fixed; numbers within a range and the totals of the ranges before it add up
    to the global ones. No task holds more than a range. ``sums`` maps new
    columns to the columns that they add up.
    """
    ranges = staged(
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).withColumn("_range", F.spark_partition_id()), name
    )
    totals = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_row0"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_0_{k}") for k in sums],
    )
    within = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    prior = within.rowsBetween(Window.unboundedPreceding, -1)
    own = ranges.select(
        "*", (F.row_number().over(within) - 1).cast("long").alias("_row"),
        *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(k) for k, c in sums.items()],
    )
    # One row for each range: bounded by the number of partitions.
    out = own.join(F.broadcast(offsets), F.col("_range") == F.col("_r"))
    for k in ["_row", *sums]:
        out = out.withColumn(k, (F.col(k) + F.col("_row0" if k == "_row" else f"_0_{k}")).cast("long"))
    return out.drop("_range", "_r", "_row0", *[f"_0_{k}" for k in sums])


def text_slices(batches, column: str = "text", most: int = 4_000_000):
    """The rows of Arrow batches in slices of about ``most`` bytes of ``column``, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                yield batch.slice(lo, hi - lo)
