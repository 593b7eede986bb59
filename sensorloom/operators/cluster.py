"""k-means for many numbers of clusters in shared scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.plans.scans import matrix, scan_sums, small_batches
from sensorloom.plans.staging import staged

#: Rows for each cluster among which starting centres are chosen.
START_ROWS = 20


@dataclass
class Fit:
    """Centres after ``rounds`` scans, rows and summed squared distances of each cluster (of the last scan)."""

    k: int
    seed: int
    centres: np.ndarray
    sizes: np.ndarray
    inertia: float
    rounds: int
    converged: bool


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)
    label = far.argmin(1)
    return label, np.maximum(far[np.arange(len(x)), label], 0.0)


def _starts(df: DataFrame, column: str, k: int, seed: int) -> np.ndarray:
    """k-means++ among the ``START_ROWS`` x k rows with the smallest seeded hash."""
    few = df.orderBy(F.xxhash64(column, F.lit(seed))).limit(START_ROWS * k).toPandas()[column]
    x = np.stack([np.asarray(v, float) for v in few]) if len(few) else np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    chosen = [0] if len(x) else []
    while len(chosen) < min(k, len(x)):
        far = _nearest(x, x[chosen])[1]
        if not far.any():
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
    return x[chosen]


def kmeans_fits(
    df: DataFrame, ks: Sequence[int], column: str = "features", seeds: int = 2, tolerance: float = 1e-4, max_rounds: int = 300
) -> list[Fit]:
    """The best of ``seeds`` restarts for every k. ``column`` is an array of numbers, of one length and without nulls.

    Each round is one scan for all centre sets that still move: a batch of rows meets them all, and only
    sums by set and cluster come back. A set is done when no centre moves by more than ``tolerance``. A
    cluster that loses its rows keeps its centre. With fewer distinct rows than k, there are fewer centres.
    """
    rows = df.select(column).where(F.col(column).isNotNull())
    width = rows.select(F.max(F.size(column))).first()[0]
    if not width:
        return []
    sets = [Fit(k, seed, _starts(rows, column, k, seed), np.zeros(0), np.inf, 0, False) for k in ks for seed in range(seeds)]
    while moving := [s for s in sets if not s.converged and s.rounds < max_rounds]:
        centres = [s.centres for s in moving]
        edges = np.cumsum([0, *map(len, centres)])

        def kernel(x: np.ndarray, centres=centres, edges=edges) -> np.ndarray:
            out = np.zeros((edges[-1], width + 2))
            for lo, c in zip(edges, centres, strict=False):
                label, far = _nearest(x, c)
                own = np.zeros((len(c), len(x)))
                own[label, np.arange(len(x))] = 1.0
                out[lo : lo + len(c)] += np.concatenate([own @ x, own.sum(1)[:, None], (own @ far)[:, None]], 1)
            return out

        sums = scan_sums(rows, column, width, (int(edges[-1]), width + 2), kernel)
        for s, lo in zip(moving, edges, strict=False):
            part = sums[lo : lo + len(s.centres)]
            many = part[:, -2]
            new = np.where(many[:, None] > 0, part[:, :-2] / np.maximum(many, 1)[:, None], s.centres)
            s.converged = bool(np.sqrt(((new - s.centres) ** 2).sum(1)).max() <= tolerance)
            s.sizes, s.inertia, s.rounds = many, float(part[:, -1].sum()), s.rounds + 1
            if not s.converged:
                s.centres = new
    return [min((s for s in sets if s.k == k), key=lambda s: (s.inertia, s.seed)) for k in ks]


def kmeans_sweep(df: DataFrame, ks: Sequence[int] = range(4, 20, 2), **options) -> DataFrame:
    """k, inertia, iterations, converged, n_rows and seed of the best fit for each k."""
    fits = kmeans_fits(df, ks, **options)
    rows = [(f.k, f.inertia, f.rounds, f.converged, int(f.sizes.sum()), f.seed) for f in fits]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, iterations int, converged boolean, n_rows long, seed int")


def cluster_centres(df: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """k, cluster, n_rows and centre, a row for each cluster of every fit."""
    rows = [(f.k, i, int(n), [float(v) for v in c]) for f in fits for i, (n, c) in enumerate(zip(f.sizes, f.centres, strict=True))]
    return df.sparkSession.createDataFrame(rows, "k int, cluster int, n_rows long, centre array<double>")


def cluster_labels(df: DataFrame, fits: Sequence[Fit], keys: Sequence[str], column: str = "features") -> DataFrame:
    """``keys``, k and cluster: each row's nearest centre in every fit."""
    if not fits:
        return df.select(*keys, F.lit(0).alias("k"), F.lit(0).alias("cluster")).limit(0)
    centres = [(f.k, f.centres) for f in fits]
    width = centres[0][1].shape[1]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def label(batches):
        for batch in batches:
            x = matrix(batch, column, width)
            for k, c in centres:
                found = _nearest(x, c)[0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keys], pa.array(np.full(len(x), k, np.int32)), pa.array(found)], names=[*keys, "k", "cluster"])

    own = df.where(F.col(column).isNotNull()).select(*keys, column)
    with small_batches(df.sparkSession, width):
        return staged(own.mapInArrow(label, ", ".join(f"`{n}` {kinds[n]}" for n in keys) + ", k int, cluster int"), "labels")


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Rows of each cluster of every k."""
    return labelled.groupBy("k", "cluster").agg(F.count(F.lit(1)).alias("n_rows"))
