"""Ordered work per site without one task per site.

Row numbers, running totals and gap filling need every row of a site in order.
A plain window partitioned by site puts a site with a third of all rows into one
task. Here a site is first cut into *blocks* that follow its order and have a
checked size; the window runs inside a block and a small table of per-block
totals carries the result from block to block. Row frames (moving averages,
lags, sequences) run on *chunks* of row numbers with the neighbouring rows
copied in, so a frame never needs more than one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorloom.plans.staging import staged

BLOCK = "_blk"
MAX_BLOCK_ROWS = 1_000_000
DAY = 86_400


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where a null key equals a null key; the columns of ``left`` come first."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__right_{k}`"))
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def with_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: Sequence[Column] = (),
    width: int | None = DAY,
    max_rows: int = MAX_BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_blk``, blocks that follow ``order`` inside ``keys``, and a table per block.

    The blocks are intervals of the first order column, ``width`` long (a day by
    default), or with ``width=None`` the whole key. One pass over the needed columns
    writes the block table: the row count ``__n`` and the aggregates ``totals``. If
    the largest block is too big, the rows are range-partitioned on ``keys + order``
    instead, so any unique order splits evenly, and staged so that the partition
    numbers stay fixed; ``max_rows=0`` always does so. Both ways give the same rows.
    """
    if width is None:
        block = F.lit(0).cast("long")
    else:
        block = F.coalesce(F.floor(F.col(order[0]) / width), F.lit(-(2**62)))

    def table(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("__n"), *totals)

    blocked = df.withColumn(BLOCK, block)
    blocks = staged(table(blocked), "block-totals")
    largest, rows = blocks.agg(F.max("__n"), F.sum("__n")).first()
    if (largest or 0) <= max_rows:
        return blocked, blocks
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // max_rows))
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn(BLOCK, F.spark_partition_id().cast("long"))
    ranged = staged(ranged, "blocks")
    return ranged, table(ranged)


def _carried(blocks: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """Per block: the total of all earlier blocks of the key, and the key's total.

    The block table is small (days or partitions per key), so its window is too.
    """
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        *keys, BLOCK,
        F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias("__before"),
        F.sum(total).over(per_key).alias("__all"),
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "_rn",
    count: str | None = None,
    width: int | None = DAY,
    max_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """Exact zero-based row number per key, and optionally the key's row count. Rows without a key belong to no series and are left out."""
    blocked, blocks = with_blocks(df, keys, order, (), width, max_rows)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    joined = blocked.withColumn("__in", F.row_number().over(inside)).join(
        _carried(blocks, keys, "__n"), [*keys, BLOCK]
    )
    joined = joined.withColumn(out, (F.col("__before") + F.col("__in") - 1).cast("long"))
    if count:
        joined = joined.withColumn(count, F.col("__all").cast("long"))
    return joined.drop(BLOCK, "__in", "__before", "__all")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    total: str | None = None,
    width: int | None = DAY,
    max_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """Running sum of ``value`` per key up to and including the row; a null key is a key."""
    valued = df.withColumn("__v", value)
    blocked, blocks = with_blocks(valued, keys, order, [F.sum("__v").alias("__t")], width, max_rows)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumn("__in", F.sum("__v").over(inside))
    joined = join_null_safe(summed, _carried(blocks, keys, "__t"), [*keys, BLOCK])
    joined = joined.withColumn(out, F.col("__before") + F.col("__in"))
    if total:
        joined = joined.withColumn(total, F.col("__all"))
    return joined.drop(BLOCK, "__v", "__in", "__before", "__all")


def nearest_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    width: int | None = DAY,
    max_rows: int = MAX_BLOCK_ROWS,
) -> DataFrame:
    """Add ``_prev_c`` and ``_next_c``: the last value at or before and the first at or after a row.

    Rows without a key belong to no series: they stay, and have their own value only.
    """
    alone = F.lit(False)
    for k in keys:
        alone = alone | F.col(k).isNull()
    single = df.where(alone).select("*", *[F.col(c).alias(f"_{side}_{c}") for side in ("prev", "next") for c in columns])
    names, df = df.columns, df.where(~alone)
    place = F.struct(*order)
    edges = [
        pick(c, F.when(F.col(c).isNotNull(), place)).alias(f"_{name}_{c}")
        for c in columns for name, pick in (("first", F.min_by), ("last", F.max_by))
    ]
    blocked, blocks = with_blocks(df, keys, order, edges, width, max_rows)
    grow = (Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(*grow)
    # Looking ahead is a growing frame over the reversed order: linear, unlike a shrinking frame.
    back = Window.partitionBy(*keys, BLOCK).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(*grow)
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        *keys, BLOCK,
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_before_{c}") for c in columns],
        *[F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_after_{c}") for c in columns],
    )
    found = blocked.select(
        "*",
        *[F.last(c, ignorenulls=True).over(ahead).alias(f"_in_prev_{c}") for c in columns],
        *[F.last(c, ignorenulls=True).over(back).alias(f"_in_next_{c}") for c in columns],
    ).join(carried, [*keys, BLOCK])
    return found.select(
        *names,
        *[F.coalesce(f"_in_prev_{c}", f"_before_{c}").alias(f"_prev_{c}") for c in columns],
        *[F.coalesce(f"_in_next_{c}", f"_after_{c}").alias(f"_next_{c}") for c in columns],
    ).unionByName(single)


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    row: str,
    columns: dict[str, object],
    before: int = 0,
    after: int = 0,
    descending: bool = False,
    chunk_rows: int | None = None,
    moments: dict[int, Sequence[str]] | None = None,
) -> DataFrame:
    """Add window columns whose frames reach ``before`` rows back and ``after`` ahead.

    ``row`` is a dense row number per key. Each entry of ``columns`` is a function
    ``WindowSpec -> Column``; the window is ordered by ``row`` and covers one chunk
    plus the copied neighbours. Copies add (before + after) / chunk to the data,
    at most an eighth. ``moments`` names columns for each length of a trailing frame (within
    ``before``); the makers may use what ``trailing_moments`` adds for them.
    """
    size = chunk_rows or max(4096, 8 * (before + after))
    number = F.col(row)
    chunk = F.floor(number / size)
    first = F.greatest(F.lit(0), F.floor((number - after) / size))
    copies = df.withColumn("_own", chunk).withColumn(
        "_chunk", F.explode(F.sequence(first, F.floor((number + before) / size)))
    )
    spec: WindowSpec = Window.partitionBy(*keys, "_chunk").orderBy(
        F.col(row).desc() if descending else F.col(row)
    )
    for length, of in (moments or {}).items():
        copies = trailing_moments(copies, [*keys, "_chunk"], row, of, length)
    return (
        copies.withColumns({name: make(spec) for name, make in columns.items()})
        .filter(F.col("_chunk") == F.col("_own"))
        .drop("_own", "_chunk")
    )


def trailing_moments(df: DataFrame, keys: Sequence[str], row: str, columns: Sequence[str], length: int) -> DataFrame:
    """Add ``_n{length}_c``, ``_mean{length}_c`` and ``_m2{length}_c`` of the last ``length`` rows, at a cost that does not depend on ``length``.

    Rows are cut into blocks of ``length`` rows. A frame is the end of one block and the beginning of the next,
    so its moments are those of a growing frame from the front of its block and of one from the
    back of the block before, merged. Both are centred: nothing is subtracted from a larger
    sum, and a flat frame has deviation 0. Nulls are skipped; without values the mean is null.
    """
    number = F.col(row)
    df = df.withColumn("_block", F.floor(number / length))
    inside, grow = Window.partitionBy(*keys, "_block"), (Window.unboundedPreceding, 0)
    front, back = (inside.orderBy(o).rowsBetween(*grow) for o in (number, number.desc()))
    part = lambda c, w: F.struct(F.count(c).over(w).alias("n"), F.avg(c).over(w).alias("mean"), (F.var_pop(c).over(w) * F.count(c).over(w)).alias("m2"))
    df = df.withColumns({f"_front_{c}": part(c, front) for c in columns}).withColumns({f"_back_{c}": part(c, back) for c in columns})
    ordered = Window.partitionBy(*keys).orderBy("_block", number)
    df = df.withColumns({f"_back_{c}": F.lag(f"_back_{c}", length - 1).over(ordered) for c in columns})
    out: dict[str, Column] = {}
    for c in columns:
        a, b = F.col(f"_front_{c}"), F.when(F.pmod(number, F.lit(length)) != length - 1, F.col(f"_back_{c}"))
        an, bn = a["n"], F.coalesce(b["n"], F.lit(0))
        n = an + bn
        apart = F.when((an > 0) & (bn > 0), b["mean"] - a["mean"]).otherwise(F.lit(0.0))
        out[f"_n{length}_{c}"] = n
        out[f"_mean{length}_{c}"] = F.when(an == 0, b["mean"]).otherwise(a["mean"] + apart * F.try_divide(bn, n))
        out[f"_m2{length}_{c}"] = F.coalesce(a["m2"], F.lit(0.0)) + F.coalesce(b["m2"], F.lit(0.0)) + apart * apart * F.coalesce(F.try_divide(an * bn, n), F.lit(0.0))
    return df.withColumns(out).drop("_block", *[f"_{side}_{c}" for side in ("front", "back") for c in columns])
