"""Long, wide and regular-grid layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.schema import EPOCH, READING_SECONDS, ROW_ID, SITE


def pivot_wide(
    df: DataFrame,
    columns: Sequence[str],
    sites: Sequence[str],
    keys: Sequence[str] = (EPOCH, "hour", "day_of_year"),
    tiebreak: str = ROW_ID,
) -> DataFrame:
    """One row per epoch with ``{site}_{column}`` columns.

    The site list is explicit, so no job has to find the pivot values. Of several
    readings at one instant the one with the highest ``tiebreak`` is kept.
    """
    cells = [F.max_by(c, tiebreak).alias(c) for c in columns]
    wide = df.groupBy(*keys).pivot(SITE, list(sites)).agg(*cells)
    return _site_prefixed(wide, columns, sites)


def pivot_hourly_wide(
    df: DataFrame, columns: Sequence[str], sites: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Hourly means per site, one row per hour; averaged before they are pivoted."""
    hourly = df.groupBy(*keys, SITE).agg(*[F.avg(c).alias(c) for c in columns])
    wide = hourly.groupBy(*keys).pivot(SITE, list(sites)).agg(*[F.first(c).alias(c) for c in columns])
    return _site_prefixed(wide, columns, sites)


def _site_prefixed(wide: DataFrame, columns: Sequence[str], sites: Sequence[str]) -> DataFrame:
    # With a single aggregate Spark names the columns by the pivot value alone.
    if len(columns) == 1:
        return wide.withColumnsRenamed({s: f"{s}_{columns[0]}" for s in sites})
    return wide


def time_grid(df: DataFrame, step: int = READING_SECONDS) -> DataFrame:
    """Every ``step`` seconds from a site's first to its last epoch, both included.

    Site spans are cut into days and spread over the cluster before they are
    expanded, so no task and no array holds a whole site.
    """
    span = df.groupBy(SITE).agg(F.min(EPOCH).alias("_lo"), F.max(EPOCH).alias("_hi"))
    per_slice = max(1, 86_400 // step)
    # An explicit number: the few bytes of the slices must not be merged into one task.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.floor((F.col("_hi") - F.col("_lo")) / step)
    slices = span.select(
        SITE, "_lo", last.alias("_last"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / per_slice))).alias("_slice"),
    ).repartition(parts, SITE, "_slice")
    first = F.col("_slice") * per_slice
    steps = F.sequence(first, F.least(first + per_slice - 1, F.col("_last")))
    return slices.select(SITE, "_lo", F.explode(steps).alias("_i")).select(
        SITE, (F.col("_lo") + F.col("_i") * step).alias(EPOCH)
    )


def unpivot_columns(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Column layout to (ids, column, value) rows."""
    return df.unpivot(list(ids), list(columns), "column", "value")
