"""Clusters, components and forests against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sensorloom.operators import cluster, forest, spectral


def arrays(spark, x, name="features"):
    return spark.createDataFrame([(i, [float(v) for v in line]) for i, line in enumerate(x)], f"id long, {name} array<double>")


def test_centres_are_means_and_sizes_add_up(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (0, 5, 9, 14)])
    df = arrays(spark, x).union(spark.createDataFrame([(999, None)], "id long, features array<double>"))
    fits = cluster.kmeans_fits(df, [2, 4, 7])
    assert all(f.converged and f.sizes.sum() == 240 for f in fits)
    labels = cluster.cluster_labels(df, fits, ["id"]).toPandas()
    assert len(labels) == 3 * 240
    for f in fits:
        own = labels[labels["k"] == f.k].set_index("id")["cluster"].sort_index().to_numpy()
        nearest = ((x[:, None] - f.centres[None]) ** 2).sum(2)
        assert (own == nearest.argmin(1)).all()
        assert f.inertia == pytest.approx(nearest.min(1).sum(), rel=1e-3)
        for i, (c, n) in enumerate(zip(f.centres, f.sizes, strict=True)):
            assert n == (own == i).sum() and c == pytest.approx(x[own == i].mean(0), abs=1e-3)
    assert sorted(round(float(c.mean())) for c in fits[1].centres) == [0, 5, 9, 14]
    sizes = cluster.cluster_sizes(cluster.cluster_labels(df, fits, ["id"])).toPandas()
    assert sizes.groupby("k")["n_rows"].sum().tolist() == [240] * 3
    assert cluster.cluster_centres(df, fits).count() == 13


def test_few_distinct_rows_and_none(spark):
    same = arrays(spark, [[1.0, 2.0]] * 5)
    fit = cluster.kmeans_fits(same, [3])[0]
    assert len(fit.centres) == 1 and fit.inertia == 0 and fit.sizes.tolist() == [5]
    assert cluster.kmeans_fits(same.limit(0), [3]) == []


def test_shares_of_spark(spark):
    rng = np.random.default_rng(2)
    x = 1e5 + rng.standard_normal((300, 40)) * np.linspace(3, 0.5, 40)
    df = arrays(spark, x, "scaled")
    got = spectral.pca_variance(df, [1, 4, 9]).toPandas()
    model = PCA(k=9, inputCol="v", outputCol="o").fit(df.select(array_to_vector("scaled").alias("v")))
    shares = np.cumsum(model.explainedVariance.toArray())
    assert got["ratio"].tolist() == pytest.approx([shares[0], shares[3], shares[8]], abs=1e-6)
    variances, directions, total = spectral.principal_components(df, 9)
    assert total == pytest.approx(x.var(0, ddof=1).sum())
    assert np.abs(directions.T @ directions - np.eye(9)).max() < 1e-9


def test_wide_rows_and_low_rank(spark):
    """168 steps of 16 features: the blocks stay far below the width."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 5)) @ rng.standard_normal((5, 168 * 16))
    variances, directions, total = spectral.principal_components(arrays(spark, x, "scaled"), 8)
    want = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2 / 119
    assert variances == pytest.approx(want[:8], abs=1e-6 * want[0])
    assert variances[:5].sum() == pytest.approx(total)
    assert spectral.principal_components(arrays(spark, x[:1], "scaled"), 2)[2] == 0.0


def plain_tree(x, y, cuts, depth, leaf_rows):
    """Predictions of one tree that tries every cut of every feature."""
    if depth and len(x) > 1:
        best, score = None, ((y - y.mean(0)) ** 2).sum() - 1e-9 * len(y)
        for f, points in enumerate(cuts):
            for c in points:
                left = x[:, f] <= c
                if leaf_rows <= left.sum() <= len(x) - leaf_rows:
                    s = ((y[left] - y[left].mean(0)) ** 2).sum() + ((y[~left] - y[~left].mean(0)) ** 2).sum()
                    if s < score - 1e-9:
                        best, score = left, s
        if best is not None:
            out = np.empty_like(y)
            out[best] = plain_tree(x[best], y[best], cuts, depth - 1, leaf_rows)
            out[~best] = plain_tree(x[~best], y[~best], cuts, depth - 1, leaf_rows)
            return out
    return np.tile(y.mean(0), (len(y), 1))


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 10, (400, 3))
    y = np.stack([np.sin(x[:, 0]) * 5 + x[:, 1], 100 * (x[:, 1] > 4) + x[:, 2]], 1) + rng.normal(0, 0.1, (400, 2))
    rows = [(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, p double, q double")


def test_a_single_tree_is_the_plain_one(examples, monkeypatch):
    x, y, df = examples
    made = forest.fit_forest(df, ["a", "b", "c"], ["p", "q"], trees=1, depth=4, bins=8, share=1.0, leaf_rows=5, bootstrap=False)
    cuts = [np.unique([r for r in df.select(F.percentile_approx(c, [i / 8 for i in range(1, 8)], 100_000)).first()[0]]) for c in ("a", "b", "c")]
    scale = y.std(0)
    want = plain_tree(x, y / scale, cuts, 4, 5) * scale
    got = made.predict(df).orderBy("id").toPandas()[["pred_p", "pred_q"]].to_numpy()
    assert np.abs(got - want).max() < 1e-6
    # Levels in several passes give the same tree.
    monkeypatch.setattr(forest, "PASS_SUMS", 150)
    again = forest.fit_forest(df, ["a", "b", "c"], ["p", "q"], trees=1, depth=4, bins=8, share=1.0, leaf_rows=5, bootstrap=False)
    assert again.trees[0].feature == made.trees[0].feature and again.trees[0].threshold == made.trees[0].threshold


def test_a_forest_fits_all_targets(examples, frame):
    x, y, df = examples
    made, scored = forest.rf_regress_multi(df.where("id % 4 > 0"), df.where("id % 4 = 0").withColumn("a", F.when(F.col("id") != 8, F.col("a"))), ["a", "b", "c"], ["p", "q"], trees=6, depth=7, share=0.7)
    got = scored.toPandas()
    assert len(made.trees) == 6 and len(got) == 100
    assert got[got["id"] == 8][["pred_p", "pred_q"]].isna().all(axis=None)
    got = got[got["id"] != 8]
    for c in ("p", "q"):
        assert 1 - ((got[c] - got[f"pred_{c}"]) ** 2).sum() / ((got[c] - got[c].mean()) ** 2).sum() > 0.85
    assert forest.fit_forest(df.limit(0), ["a"], ["p"]).trees == []
