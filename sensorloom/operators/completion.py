"""Completion of matrices given as (row, col, value) cells: biscaling and soft-thresholded singular values.

Cells are packed once, one record for each row of the matrix. A step of either solver is one
pass over the packed rows: what belongs to a row (offset, scale, left factor) follows from the
state of the columns, so it is worked out where the row is and never stored, and only sums for
each column come back. The state of the columns is sent with the pass. Its size is
checked (``STATE_VALUES``); a matrix with more columns than that should be turned round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.plans.ordered import join_null_safe
from sensorloom.plans.staging import staged
from sensorloom.schema import EPOCH, SITE

#: Most numbers in the state of all columns (256 MB), which the driver holds and every pass takes along.
STATE_VALUES = 2**25
#: Fewest cells of a row or column that has a scale of its own.
CORE_CELLS = 3
#: Steps that an extrapolation looks back, and steps within which the unevenness has to halve.
MEMORY, PATIENCE = 15, 15
#: Unevenness from which on steps are extrapolated.
NEAR = 0.1


def matrix_cells(df: DataFrame, measures: Sequence[str], bucket_seconds: int = 3600) -> DataFrame:
    """(row, col, value): mean per time bucket and site measure; unobserved cells are null."""
    row = F.floor(F.col(EPOCH) / bucket_seconds).cast("int").alias("row")
    means = df.groupBy(SITE, row).agg(*[F.avg(m).alias(m) for m in measures])
    return means.unpivot([SITE, "row"], list(measures), "measure", "value").select(
        "row", F.concat_ws("|", SITE, "measure").alias("col"), "value"
    )


# --- packed matrices --------------------------------------------------------

@dataclass
class Packed:
    """``rows``: row, ids, values (arrays); ``names``: id, col; ``ids``: all ids in order."""

    rows: DataFrame
    names: DataFrame
    ids: np.ndarray

    def sums(self, kernel: Callable, width: int, spare: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """One pass: ``kernel(block)`` gives column numbers, ``width`` numbers for each, and ``spare`` rows of as many that belong to no column.

        All are added up, the first by column.
        """
        ids, names = self.ids, [f"s{i}" for i in range(width)]
        every = np.append(ids, np.arange(-spare, 0))

        def partial(batches):
            total = np.zeros((len(every), width))
            for batch in batches:
                number, values, others = kernel(Block.of(batch, ids))
                for i in range(width):
                    total[: len(ids), i] += np.bincount(number, values[:, i], len(ids))
                total[len(ids) :] += others
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(every[at]), *[pa.array(total[at, i]) for i in range(width)]], names=["id", *names])

        found = self.rows.mapInArrow(partial, "id long, " + ", ".join(f"{n} double" for n in names))
        total = found.groupBy("id").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        out = np.zeros((len(every), width))
        key = total["id"].to_numpy()
        out[np.where(key < 0, len(every) + key, np.searchsorted(ids, key))] = total[names].to_numpy()
        return out[: len(ids)], out[len(ids) :]

    def cells(self, kernel: Callable, fields: Sequence[str]) -> DataFrame:
        """row, col, value and the ``fields`` that ``kernel(block)`` gives for every cell."""
        ids = self.ids

        def each(batches):
            for batch in batches:
                block = Block.of(batch, ids, observed=False)
                spread = pa.array(np.repeat(np.arange(batch.num_rows), block.size))
                value = pa.array(block.x, mask=np.isnan(block.x))
                made = [pa.array(np.broadcast_to(v, len(block.x)).copy(), pa.float64(), mask=np.isnan(np.broadcast_to(v, len(block.x)))) for v in kernel(block)]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(spread), pa.array(ids[block.col]), value, *made], names=["row", "id", "value", *fields])

        kind = self.rows.schema["row"].dataType.simpleString()
        found = self.rows.mapInArrow(each, f"row {kind}, id long, value double, " + ", ".join(f"{f} double" for f in fields))
        return found.join(self.names, "id").select("row", "col", "value", *fields)


@dataclass
class Block:
    """Cells of some rows: ``size`` of each row, and row number, column number and value of each cell."""

    size: np.ndarray
    row: np.ndarray
    col: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, ids: np.ndarray, observed: bool = True) -> Block:
        size = np.asarray(batch.column("ids").value_lengths()).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), size)
        col = np.searchsorted(ids, np.asarray(batch.column("ids").flatten()))
        x = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(float)
        if observed:
            known = ~np.isnan(x)
            return Block(np.bincount(row[known], minlength=len(size)), row[known], col[known], x[known])
        return Block(size, row, col, x)

    def by_row(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, len(self.size))


def packed(cells: DataFrame, width: int = 2) -> Packed:
    """``cells`` by rows. NaN counts as null; ``width`` numbers of state are foreseen for each column."""
    names = staged(cells.select("col").distinct().withColumn("id", F.monotonically_increasing_id()), "matrix-columns")
    many = names.count()
    if many * width > STATE_VALUES:
        raise ValueError(f"{many} columns x {width} exceed the {STATE_VALUES} numbers a pass takes along; turn the matrix round")
    keyed = join_null_safe(cells.select("row", "col", F.nanvl(F.col("value").cast("double"), F.lit(None)).alias("value")), names, ["col"])
    # A null value would be left out of a list of its own.
    lists = keyed.groupBy("row").agg(F.collect_list(F.struct("id", "value")).alias("c"))
    rows = staged(lists.select("row", F.col("c.id").alias("ids"), F.col("c.value").alias("values")), "matrix-rows")
    return Packed(rows, names, np.sort(names.select("id").toPandas()["id"].to_numpy().astype(np.int64)))


# --- biscaling --------------------------------------------------------------

class _Extrapolated:
    """Anderson's mixing of a fixed-point map: the next state from the last steps and how far each fell short."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, self.states, self.moves = weight, [], []

    def next(self, state: np.ndarray, image: np.ndarray) -> np.ndarray:
        move = image - state
        self.states, self.moves = [*self.states[-MEMORY:], state], [*self.moves[-MEMORY:], move]
        if len(self.moves) < 2:
            return image
        dm = np.diff(np.stack(self.moves, 1), axis=1)
        ds = np.diff(np.stack(self.states, 1), axis=1)
        share = np.linalg.lstsq(dm * self.weight[:, None], move * self.weight, rcond=1e-10)[0]
        return image - (ds + dm) @ share


def _row_scales(block: Block, offset: np.ndarray, weight: np.ndarray, core: np.ndarray, floor: float):
    """From the columns' offsets, weights (1 / scale) and core: each row's offset and scale, the cells' residuals, and which count."""
    q = weight[block.col]
    total = block.by_row(q)
    row_offset = np.divide(block.by_row(q * (block.x - offset[block.col])), total, out=np.zeros(len(total)), where=total > 0)
    residual = block.x - row_offset[block.row] - offset[block.col]
    counts = core[block.col]
    many = block.by_row(counts.astype(float))
    squares = block.by_row(np.where(counts, (residual * q) ** 2, 0.0))
    spread = np.sqrt(np.divide(squares, many, out=np.zeros(len(many)), where=many > 0))
    plain = np.sqrt(np.divide(block.by_row(np.where(counts, residual**2, 0.0)), many, out=np.zeros(len(many)), where=many > 0))
    own = (many >= CORE_CELLS) & (plain > floor)
    return row_offset, np.where(own, spread, 1.0), residual, own[block.row] & counts


def biscale(cells: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Centre and scale rows and columns: row, col, value, scaled, shift, scale, core.

    ``scaled`` = (value - ``shift``) / ``scale``, where a cell's shift is the sum of an offset of its
    row and one of its column, and its scale the product of theirs. Every row and column of
    ``scaled`` has mean 0, and every row and column of the core has deviation 1 over its core
    cells. The core (``core`` = 1) is what is left when rows and columns with fewer than three
    cells, or without spread, are taken away until none is left; rows and columns outside are
    centred and take the typical scale (the geometric mean) of those inside. Unobserved cells have a null ``scaled``; a row or column without any
    observed cell takes the mean offset and the typical scale. Repeated cells count as often as they stand there.
    An empty frame gives an empty one.

    Offsets are least-squares steps under the weights 1 / scale, scales are multiplied by the
    deviations left; once near the end, steps are extrapolated (``MEMORY``), until all means and
    deviations are within ``tolerance``. The end is certain: when the unevenness has not halved in
    ``PATIENCE`` steps, the smallest spread that a scale is given for is raised a hundredfold,
    so that rows and columns which collapse leave the core, and offsets alone are a
    convex problem.
    """
    m = packed(cells)
    state = _even_columns(m, tolerance)

    def apply(block: Block):
        known = ~np.isnan(block.x)
        inner = Block(np.bincount(block.row[known], minlength=len(block.size)), block.row[known], block.col[known], block.x[known])
        row_offset, row_scale, _, counts = _row_scales(inner, *state)
        shift = row_offset[block.row] + state[0][block.col]
        scale = row_scale[block.row] / state[1][block.col]
        core = np.zeros(len(block.x))
        core[np.flatnonzero(known)[counts]] = 1.0
        return (block.x - shift) / scale, shift, scale, core

    return m.cells(apply, ["scaled", "shift", "scale", "core"]).withColumn("core", F.col("core").cast("int"))


def _even_columns(m: Packed, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Offsets, weights and core of the columns, and the smallest spread with a scale."""
    n = len(m.ids)
    offset, log_scale = np.zeros(n), np.zeros(n)
    core = np.ones(n, bool)
    first, _ = m.sums(lambda b: (b.col, np.stack([np.ones(len(b.x)), b.x, b.x**2], 1), np.zeros((0, 3))), 3)
    many = np.maximum(first[:, 0], 1.0)
    offset = first[:, 1] / many
    overall = np.sqrt(max(0.0, (first[:, 2] - first[:, 1] * offset).sum() / max(1.0, first[:, 0].sum())))
    floor = 1e-9 * max(overall, np.abs(offset).max(initial=0.0), 1e-290)
    mix = _Extrapolated(np.concatenate([np.full(n, 1.0 / max(overall, 1e-300)), np.ones(n)]))
    best, stalled = np.inf, 0
    while True:
        weight = np.exp(-log_scale)

        def kernel(block: Block, offset=offset, weight=weight, core=core, floor=floor):
            row_offset, scale, residual, counts = _row_scales(block, offset, weight, core, floor)
            p = 1.0 / scale[block.row]
            r, c = residual * p, counts.astype(float)
            own = np.unique(block.row[counts])
            some = block.size > 0
            rows = [np.log(scale[own]).sum(), len(own), row_offset[some].sum(), some.sum(), 0.0, 0.0]
            return block.col, np.stack([p, r, c, c * r**2, c * r * p, c * p**2], 1), np.array([rows])

        found, rows = m.sums(kernel, 6, 1)
        p, r, count, rr, rp, pp = found.T
        typical = rows[0, 0] / max(1.0, rows[0, 1])
        # Columns that have lost their cells or their spread are centred only from here on.
        lost = core & ((count < CORE_CELLS) | (np.sqrt(rr / np.maximum(count, 1.0)) * np.sqrt(count / np.maximum(pp, 1e-300)) <= floor))
        if lost.any():
            core = core & ~lost
            log_scale = _with_typical(log_scale, core)
            mix = _Extrapolated(mix.weight)
            continue
        deviation = np.sqrt(rr / np.maximum(count, 1.0)) * weight
        uneven = max(np.abs(r * weight / many).max(initial=0.0), np.abs(deviation[core] - 1.0).max(initial=0.0))
        if uneven <= tolerance:
            return offset, weight, core, floor
        if uneven < best / 2:
            best, stalled = uneven, 0
        else:
            stalled += 1
        if stalled >= PATIENCE:
            floor, best, stalled, mix = floor * 100, np.inf, 0, _Extrapolated(mix.weight)
        step = np.divide(r, p, out=np.zeros(n), where=p > 0)
        left = np.maximum(rr - 2 * step * rp + step**2 * pp, 0.0) / np.maximum(count, 1.0)
        moved = np.where(core & (left > 0), 0.5 * np.log(np.maximum(left, 1e-300)), log_scale)
        # Offsets and scales count up to a constant: the typical row has offset 0 and scale 1.
        level = offset + step + rows[0, 2] / max(1.0, rows[0, 3])
        image = np.concatenate([_with_typical(level, first[:, 0] > 0), _with_typical(moved + typical, core)])
        # There may be several fixed points where cells are few: far from one, the plain step decides which.
        state = mix.next(np.concatenate([offset, log_scale]), image) if uneven < NEAR else image
        offset, log_scale = state[:n], state[n:]


def _with_typical(values: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Columns that have no value of their own get the mean of those inside."""
    return np.where(inside, values, values[inside].mean() if inside.any() else 0.0)


# --- completion -------------------------------------------------------------

@dataclass
class LowRank:
    """A completion by soft-thresholded singular values: row parts follow from ``right``."""

    matrix: Packed
    right: np.ndarray
    penalty: float
    #: Singular values of the completed matrix, and the largest one of the residual outside their directions.
    values: np.ndarray
    rest: float
    passes: int


def _left(block: Block, right: np.ndarray, penalty: float) -> np.ndarray:
    """Each row's ridge solution: the left factor that goes with ``right``."""
    k = right.shape[1]
    b = right[block.col]
    gram = np.empty((len(block.size), k, k))
    for f in range(k):
        for g in range(f + 1):
            gram[:, f, g] = gram[:, g, f] = block.by_row(b[:, f] * b[:, g])
    known = np.stack([block.by_row(block.x * b[:, f]) for f in range(k)], 1) if k else np.zeros((len(block.size), 0))
    return np.linalg.solve(gram + penalty * np.eye(k), known[:, :, None])[:, :, 0]


def _orthonormal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of ``v`` outside those of ``against`` (orthonormal)."""
    for _ in range(2):
        v = v - against @ (against.T @ v)
        v = np.linalg.qr(v)[0]
    return v


def soft_impute(cells: DataFrame, share: float = 0.02, steps: int = 5, tolerance: float = 1e-4, probes: int = 3, max_rank: int | None = None) -> LowRank:
    """The matrix M that minimises 1/2 |observed cells - M|^2 + penalty x (sum of the singular values of M).

    The penalty goes down in ``steps`` from the largest singular value of the cells (unobserved ones
    as 0) to ``share`` of it, each solution being the start of the next. M is kept as a
    product of a left factor, which each row works out by itself, and a right factor over the
    columns. A pass takes the right factor one power step further, on the matrix whose unobserved
    cells are those of M, and shrinks its singular values; the residual is probed by a block
    power iteration on the side, and a direction whose singular value exceeds the penalty
    joins the factors. So the rank finds itself, and in the end the residual has no singular value
    above the penalty, which marks the optimum. ``max_rank`` bounds it on request. It ends
    when singular values move by less than ``tolerance`` of the largest. The starts of the probes
    are fixed, so a rerun gives the same result up to the order of sums.
    """
    m = packed(cells, 2 * probes)
    n = len(m.ids)
    limit = min(n, max_rank or n)
    right, values = np.zeros((n, 0)), np.zeros(0)
    basis = np.zeros((n, 0))
    probe = np.linalg.qr(np.random.default_rng(0).standard_normal((n, max(1, min(probes, n)))))[0] if n else np.zeros((0, 0))
    penalty, path, passes, rest = np.inf, [], 0, 0.0
    while n:
        k, p = right.shape[1], probe.shape[1]
        if n * (k + p) > STATE_VALUES:
            raise ValueError(f"{n} columns of rank {k} exceed the {STATE_VALUES} numbers a pass takes along; raise share or set max_rank")

        def kernel(block: Block, right=right, probe=probe, penalty=penalty, k=k, p=p):
            left = _left(block, right, penalty) if k else np.zeros((len(block.size), 0))
            a = left[block.row]
            s = block.x - np.einsum("ij,ij->i", a, right[block.col])
            seen = np.stack([block.by_row(s * probe[block.col, f]) for f in range(p)], 1)
            parts = np.concatenate([s[:, None] * a, s[:, None] * seen[block.row]], 1)
            return block.col, parts, np.concatenate([left.T @ left, np.zeros((k, p))], 1)

        moved, gram = m.sums(kernel, k + p, k)
        gram = gram[:, :k]
        passes += 1
        # Singular values of the residual along the probes.
        seen = probe.T @ moved[:, k:]
        before, rest = rest, float(np.sqrt(max(0.0, np.linalg.eigvalsh((seen + seen.T) / 2)[-1])))
        if not path:
            # First the largest singular value of the cells themselves.
            probe = _orthonormal(moved[:, k:], basis)
            if rest == 0.0:
                break
            if passes > 2 and rest - before <= 0.02 * rest:
                path = [rest * share ** (i / steps) for i in range(1, steps + 1)]
                penalty = path[0]
            continue
        change = 0.0
        if k:
            ridge = gram + penalty * np.eye(k)
            right = np.linalg.solve(ridge, (moved[:, :k] + right @ gram).T).T
            right, basis, new = _balanced(right, gram)
            change = np.abs(_padded(new, k) - _padded(values, k)).max() / max(new.max(initial=0.0), 1e-300)
            values = new
        ritz, turn = np.linalg.eigh((seen + seen.T) / 2)
        found = np.sqrt(np.maximum(ritz, 0.0))
        join = np.flatnonzero(found > penalty * (1 + 10 * tolerance))[::-1][: max(0, limit - right.shape[1])]
        if len(join):
            fresh = _orthonormal((probe @ turn)[:, join], basis)
            right = np.concatenate([right, fresh * np.sqrt(found[join] - penalty)], 1)
            basis = np.concatenate([basis, fresh], 1)
            values = _padded(values, right.shape[1])
        width = max(1, min(p, n - basis.shape[1])) if basis.shape[1] < n else 0
        probe = _orthonormal(moved[:, k : k + width], basis) if width else np.zeros((n, 1))
        last = len(path) == 1
        settled = abs(rest - before) <= (0.02 if last else 0.2) * max(rest, penalty)
        if not len(join) and settled and change <= (tolerance if last else 100 * tolerance):
            if last:
                break
            path = path[1:]
            penalty = path[0]
    return LowRank(m, right, penalty if path else 0.0, values, rest, passes)


def _padded(values: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([values, np.zeros(max(0, size - len(values)))])


def _balanced(right: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From a right factor and the products of the left one: right factor, right singular vectors and singular values of their product."""
    size, turn = np.linalg.eigh(gram)
    half = turn * np.sqrt(np.maximum(size, 0.0))
    vectors, values, _ = np.linalg.svd(right @ half, full_matrices=False)
    real = values > 1e-7 * values.max(initial=0.0)
    vectors, values = vectors[:, real], values[real]
    return vectors * np.sqrt(values), vectors, values


def impute_low_rank(cells: DataFrame, share: float = 0.02, tolerance: float = 1e-4, max_rank: int | None = None) -> DataFrame:
    """Fill the null cells of a (row, col, value) frame: row, col, value, imputed.

    Cells are biscaled, completed by ``soft_impute`` and scaled back. Observed cells keep their
    value. A row or column without any observed cell gets the level of its column or row;
    without observed cells at all, everything is 0.
    """
    ready = staged(biscale(cells), "biscaled")
    found = soft_impute(ready.select("row", "col", F.col("scaled").alias("value")), share, tolerance=tolerance, max_rank=max_rank)
    right, penalty = found.right, found.penalty

    def fill(block: Block):
        known = ~np.isnan(block.x)
        inner = Block(np.bincount(block.row[known], minlength=len(block.size)), block.row[known], block.col[known], block.x[known])
        left = _left(inner, right, penalty) if right.shape[1] else np.zeros((len(block.size), 0))
        return (np.einsum("ij,ij->i", left[block.row], right[block.col]),)

    levels = ready.select("row", "col", F.col("value").alias("_value"), "shift", "scale")
    fitted = found.matrix.cells(fill, ["fitted"]).select("row", "col", "fitted").distinct()
    filled = F.coalesce("_value", F.col("fitted") * F.col("scale") + F.col("shift"))
    return join_null_safe(levels, fitted, ["row", "col"]).select("row", "col", filled.alias("value"), F.col("_value").isNull().alias("imputed"))


def impute_als(cells: DataFrame, rank: int = 4, iterations: int = 30, regularization: float = 0.1, seed: int = 0) -> DataFrame:
    """``impute_low_rank`` by Spark's alternating least squares of a given rank. Rows are integers."""
    ready = staged(biscale(cells), "biscaled")
    indexed = StringIndexer(inputCol="col", outputCol="_col").fit(ready).transform(ready)
    indexed = indexed.withColumn("_col", F.col("_col").cast("int"))
    model = ALS(
        userCol="row", itemCol="_col", ratingCol="scaled", rank=rank, maxIter=iterations,
        regParam=regularization, seed=seed, coldStartStrategy="nan",
    ).fit(indexed.filter(F.col("scaled").isNotNull()))
    level = F.nanvl(F.col("prediction").cast("double"), F.lit(0.0)) * F.col("scale") + F.col("shift")
    return model.transform(indexed).select("row", "col", F.coalesce("value", level).alias("value"), F.col("value").isNull().alias("imputed"))
