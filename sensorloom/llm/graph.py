"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.plans.staging import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours go to the smallest one. Small: the node and its smaller neighbours do."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    # A star's centre is a hot key; adaptive execution splits its rows.
    found = pairs.join(least, F.col("u") == F.col("_u"))
    if large:
        out = found.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = found.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("_u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: long); the label is the smallest node of the component.

    Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the largest component.
    """
    edges = edges.where("a != b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    seen = None
    while True:
        edges = staged(_star(_star(edges, large=True), large=False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label")).distinct()
