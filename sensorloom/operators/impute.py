"""Filling gaps: from neighbours, from the values around a gap, from means. Completion is in ``completion``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.scalar import softmax_weights
from sensorloom.operators.filters import any_null
from sensorloom.plans.ordered import nearest_values
from sensorloom.schema import EPOCH, ROW_ID, SITE


def neighbor_weights(neighbors: DataFrame) -> DataFrame:
    """Weight of each neighbour: softmax of 1 - distance / sum of the site's distances."""
    total = F.sum("distance").over(Window.partitionBy(SITE))
    share = F.coalesce(F.try_divide(F.col("distance"), F.col("_total")), F.lit(0.0))
    return softmax_weights(neighbors.withColumn("_total", total), [SITE], 1 - share).drop("_total")


def impute_neighbors(
    df: DataFrame,
    weights: DataFrame,
    measures: Sequence[str],
    at: str = EPOCH,
    insufficient: int = 3,
    renormalize: bool = False,
) -> DataFrame:
    """Fill null measures from the weighted neighbours at the same ``at``.

    A value with ``insufficient`` or more missing neighbours stays null. With fewer
    missing, ``renormalize`` rescales the remaining weights; otherwise it stays null
    as well. ``{measure}_status`` says present, filled or insufficient.
    """
    values = df.groupBy(F.col(SITE).alias("neighbor"), at).agg(*[F.avg(m).alias(f"_v_{m}") for m in measures])
    gaps = df.filter(any_null(measures)).select(SITE, at).distinct()
    near = gaps.join(weights.select(SITE, "neighbor", "weight"), SITE).join(values, ["neighbor", at], "left")
    parts: list[Column] = []
    for m in measures:
        v = F.col(f"_v_{m}")
        parts += [
            F.sum(F.col("weight") * v).alias(f"_sum_{m}"),
            F.sum(F.when(v.isNotNull(), F.col("weight"))).alias(f"_w_{m}"),
            F.count_if(v.isNull()).alias(f"_miss_{m}"),
        ]
    estimates = near.groupBy(SITE, at).agg(*parts)
    out: dict[str, Column] = {}
    for m in measures:
        total, missing = F.col(f"_sum_{m}"), F.col(f"_miss_{m}")
        if renormalize:
            guess = F.when(missing < insufficient, F.try_divide(total, F.col(f"_w_{m}")))
        else:
            guess = F.when(missing == 0, total)
        out[f"{m}_status"] = (
            F.when(F.col(m).isNotNull(), F.lit("present"))
            .when(guess.isNotNull(), F.lit("filled"))
            .otherwise(F.lit("insufficient"))
        )
        out[m] = F.coalesce(F.col(m), guess)
    return df.join(estimates, [SITE, at], "left").withColumns(out).select(
        *df.columns, *[f"{m}_status" for m in measures]
    )


def impute_bracket_mean(
    df: DataFrame, columns: Sequence[str], order: Sequence[str] = (EPOCH, ROW_ID)
) -> DataFrame:
    """Each null run gets the mean of the value before and the value after it; runs at an edge stay null."""
    around = nearest_values(df, [SITE], order, columns)
    return around.select(
        *[c for c in df.columns if c not in columns],
        *[F.coalesce(F.col(c), (F.col(f"_prev_{c}") + F.col(f"_next_{c}")) / 2).alias(c) for c in columns],
    )


def impute_column_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null becomes the column mean; columns without any value are dropped."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    known = {c: m for c, m in means.items() if m is not None}
    return df.drop(*[c for c in columns if c not in known]).fillna(known)
