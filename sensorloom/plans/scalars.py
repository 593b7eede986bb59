"""One-row aggregates used as values in another frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_value(one_row: DataFrame) -> Column:
    """The single row of an aggregate as a struct value (a scalar subquery, no join)."""
    return one_row.select(F.struct("*").alias("v")).scalar()
