"""Principal components of wide rows without a matrix of columns by columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.plans.scans import scan_sums

#: Directions beyond those asked for.
OVERSAMPLE = 10


def _outside(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` has outside ``basis``."""
    size = np.linalg.norm(block, 2) if block.size else 0.0
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        # What is left of a block inside the basis is rounding, small beside the block itself.
        block, size = u[:, s > 1e-8 * size], 1.0
    return block[:, : basis.shape[0] - basis.shape[1]]


def principal_components(df: DataFrame, count: int, column: str = "scaled", tolerance: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest ``count`` variances along orthonormal directions, the directions, and the total variance (n - 1).

    A randomised range finder: a block of random directions is sent through the covariance again and again,
    one scan each, and all blocks together span the space searched (block Krylov). The driver holds
    columns x blocks, never columns x columns, until the variances found change by less than ``tolerance`` of the
    largest or the blocks span everything. Rows are shifted by their means first, so large levels do
    no harm. Null arrays are left out; without two rows all variances are 0.
    """
    rows = df.select(column).where(F.col(column).isNotNull())
    width, many = rows.agg(F.max(F.size(column)), F.count(F.lit(1))).first()
    if not width or many < 2:
        return np.zeros(count), np.zeros((width or 0, count)), 0.0
    count = min(count, width)
    mean = scan_sums(rows, column, width, (1, width), lambda x: x.sum(0, keepdims=True))[0] / many
    total = float(scan_sums(rows, column, width, (1, 1), lambda x: np.array([[((x - mean) ** 2).sum()]]))[0, 0]) / (many - 1)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, count + OVERSAMPLE))))[0]
    basis, images, before = np.zeros((width, 0)), np.zeros((width, 0)), None
    while True:
        image = scan_sums(rows, column, width, block.shape, lambda x, b=block: (x - mean).T @ ((x - mean) @ b)) / (many - 1)
        basis, images = np.concatenate([basis, block], 1), np.concatenate([images, image], 1)
        inner = basis.T @ images
        found, turn = np.linalg.eigh((inner + inner.T) / 2)
        found, turn = np.maximum(found[::-1][:count], 0.0), turn[:, ::-1][:, :count]
        block = _outside(image, basis)
        settled = before is not None and np.abs(found - before).max() <= tolerance * max(found[0], 1e-300)
        if settled or not block.shape[1]:
            return found, basis @ turn, total
        before = found


def pca_variance(df: DataFrame, components: Sequence[int] = range(4, 40, 4), column: str = "scaled") -> DataFrame:
    """Explained variance of the first n components of an array column, as a share and as it is."""
    largest = max(components)
    variances, directions, total = principal_components(df, largest, column)
    kept = [n for n in components if n <= directions.shape[1]]
    rows = [(n, float(variances[:n].sum() / total) if total else 0.0, float(variances[:n].sum())) for n in kept]
    return df.sparkSession.createDataFrame(rows, "n_components int, ratio double, variance double")
