"""Sums over one scan of rows that hold number arrays."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of an Arrow batch (32 MB), and most numbers that a scan returns to the driver (256 MB).
BATCH_VALUES, RESULT_VALUES = 2**22, 2**25

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, width: int):
    """Python tasks started inside get batches of rows that hold about ``BATCH_VALUES`` numbers, ``width`` in a row."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(max(1, min(int(before), BATCH_VALUES // max(1, width)))))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, width)


def scan_sums(df: DataFrame, column: str, width: int, shape: tuple[int, int], kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``kernel(rows)``, an array of ``shape``, over all batches of rows of the array column.

    A task adds up its own batches; Spark adds up the tasks' sums, number by number.
    """
    rows, columns = shape
    if rows * columns > RESULT_VALUES:
        raise ValueError(f"{rows} x {columns} sums exceed the {RESULT_VALUES} numbers of a scan")

    def partial(batches):
        total = np.zeros(shape)
        for batch in batches:
            total += kernel(matrix(batch, column, width))
        at, value = np.flatnonzero(total), total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(value[at])], names=["i", "v"])

    out = np.zeros(rows * columns)
    with small_batches(df.sparkSession, width):
        found = df.select(column).mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out[found["i"].to_numpy().astype(np.int64)] = found["v"].to_numpy()
    return out.reshape(shape)
