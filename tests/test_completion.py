"""Biscaling and completion against dense versions and hand-worked cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sensorloom.operators import completion as co

CELLS = "row int, col string, value double"


def dense(df, value):
    rows = df.select("row", "col", value).toPandas().drop_duplicates(["row", "col"])
    return rows.pivot(index="row", columns="col", values=value)


def cells_of(frame, matrix):
    return frame([(r, f"c{c:02d}", None if math.isnan(v) else float(v)) for r, line in enumerate(matrix) for c, v in enumerate(line)], CELLS)


def holey(rng, rows, cols, rank, share):
    whole = rng.standard_normal((rows, rank)) @ rng.standard_normal((rank, cols))
    return whole, np.where(rng.random((rows, cols)) < share, np.nan, whole)


def soft_impute_dense(x, penalty):
    """The textbook iteration: fill, decompose, shrink."""
    known, m = ~np.isnan(x), np.zeros_like(x)
    for _ in range(20_000):
        u, s, v = np.linalg.svd(np.where(known, x, m), full_matrices=False)
        new = (u * np.maximum(s - penalty, 0)) @ v
        if np.abs(new - m).max() < 1e-10:
            break
        m = new
    return m


def test_rows_and_columns_come_out_even(frame):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((60, 7)) < 0.2, np.nan, 5 + rng.standard_normal((60, 7)) * rng.uniform(0.1, 50, (60, 1)) * rng.uniform(0.1, 9, 7))
    out = co.biscale(cells_of(frame, x)).toPandas()
    assert len(out) == 420
    known = out[out["value"].notna()]
    assert (known["scaled"] * known["scale"] + known["shift"] - known["value"]).abs().max() < 1e-9
    for axis in ("row", "col"):
        assert known.groupby(axis)["scaled"].mean().abs().max() < 1e-6
        core = known[known["core"] == 1]
        assert ((core["scaled"] ** 2).groupby(core[axis]).mean() - 1).abs().max() < 1e-6
    assert out[out["value"].isna()]["scaled"].isna().all() and (out["scale"] > 0).all()


def test_thin_and_flat_rows_are_centred_only(frame):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 6))
    x[0, 1:] = np.nan  # one cell
    x[1, 2:] = np.nan  # two cells
    x[2] = np.nan  # none
    x[:, 5] = np.nan
    x[3:5, 5] = [7.0, 9.0]  # a column of two cells
    out = co.biscale(cells_of(frame, x))
    scaled = dense(out, "scaled")
    assert abs(scaled.iloc[0, 0]) < 1e-6 and abs(scaled.iloc[1, :2].sum()) < 1e-6
    assert scaled.iloc[2].isna().all()
    core = dense(out, "core")
    assert core.iloc[0].sum() == core.iloc[1].sum() == core["c05"].sum() == 0 and core.iloc[6].sum() == 5
    # The row without cells lies at the level of the columns.
    level = dense(out, "shift")
    assert np.allclose(level.iloc[2], level.drop(index=2).mean(), atol=1e-6)


def test_an_additive_matrix_has_no_core(frame):
    x = np.arange(8.0)[:, None] + 10 * np.arange(5.0)
    out = co.biscale(cells_of(frame, x)).toPandas()
    assert out["scaled"].abs().max() < 1e-6 and (out["core"] == 0).all()
    assert (out["shift"] - out["value"]).abs().max() < 1e-6


def test_odd_cells(frame):
    rows = [(1, "a", 1.0), (1, "a", 3.0), (None, "a", 2.0), (1, None, 4.0), (2, "b", float("nan")), (2, "b", None)]
    df = frame(rows, CELLS).selectExpr("*", "7 AS id", "'x' AS scale")
    out = co.biscale(df).toPandas()
    assert len(out) == 6 and out["scaled"].notna().sum() == 4
    filled = co.impute_low_rank(df).toPandas()
    assert len(filled) == 6 and filled["value"].notna().all() and filled["imputed"].sum() == 2
    empty = frame([], CELLS)
    assert co.biscale(empty).count() == 0 and co.impute_low_rank(empty).count() == 0
    assert co.impute_low_rank(frame([(1, "a", None)], CELLS).selectExpr("*")).first()["value"] == 0.0


@pytest.mark.parametrize("share", [0.3, 0.03])
def test_the_optimum_of_the_dense_iteration(frame, share):
    rng = np.random.default_rng(3)
    _, x = holey(rng, 40, 9, 3, 0.3)
    x += 0.1 * rng.standard_normal(x.shape)
    found = co.soft_impute(cells_of(frame, x), share=share, tolerance=1e-6)
    names = found.matrix.names.toPandas().set_index("col")["id"].sort_index()
    right = found.right[np.searchsorted(found.matrix.ids, names.to_numpy())]
    known = ~np.isnan(x)
    left = np.stack([np.linalg.solve(right[o].T @ right[o] + found.penalty * np.eye(right.shape[1]), right[o].T @ line[o]) for line, o in zip(x, known, strict=True)])
    m = left @ right.T
    top = np.linalg.svd(np.where(known, x, 0.0), compute_uv=False)[0]
    assert found.penalty == pytest.approx(share * top, rel=0.05)
    assert np.abs(m - soft_impute_dense(x, found.penalty)).max() < 1e-3 * np.abs(m).max()
    # The fixed point: no singular value of the residual is above the penalty.
    residual = np.where(known, x - m, 0.0)
    assert np.linalg.svd(residual, compute_uv=False)[0] <= found.penalty * (1 + 1e-3)
    assert found.rest <= found.penalty * (1 + 1e-3)
    assert found.values == pytest.approx(np.linalg.svd(m, compute_uv=False)[: len(found.values)], rel=1e-3, abs=1e-3)


def test_held_out_cells_of_a_low_rank_matrix(frame):
    whole, x = holey(np.random.default_rng(4), 150, 24, 3, 0.25)
    filled = dense(co.impute_low_rank(cells_of(frame, x), share=0.001), "value").to_numpy()
    out = np.isnan(x)
    assert np.linalg.norm((filled - whole)[out]) < 0.05 * np.linalg.norm(whole[out])
    assert np.allclose(filled[~out], x[~out])


def test_rank_bound_and_alternating_squares(frame):
    whole, x = holey(np.random.default_rng(5), 60, 8, 2, 0.2)
    assert len(co.soft_impute(cells_of(frame, x), share=0.01, max_rank=1).values) == 1
    filled = dense(co.impute_als(cells_of(frame, x), rank=3, iterations=15, regularization=0.01), "value").to_numpy()
    out = np.isnan(x)
    assert np.linalg.norm((filled - whole)[out]) < 0.4 * np.linalg.norm(whole[out])


def test_too_many_columns_are_refused(frame, monkeypatch):
    monkeypatch.setattr(co, "STATE_VALUES", 4)
    with pytest.raises(ValueError, match="turn the matrix round"):
        co.biscale(cells_of(frame, np.ones((2, 3))))
