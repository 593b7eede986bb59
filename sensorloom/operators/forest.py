"""Regression forests with several targets: one split for all of them.

Trees grow level by level. A pass over the rows sums weight, targets and squares by (node, feature, bin) of every node
of the level, of all trees at once; Spark adds the sums up and picks each node's best split among them: the one
that lowers the variance of all targets, each scaled by its deviation, most. The driver holds
the trees alone. A pass takes as many nodes as ``PASS_SUMS`` allows; wide levels take several passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.plans.scans import matrix, small_batches
from sensorloom.plans.staging import staged

#: Most sums that a task holds in a pass (128 MB).
PASS_SUMS = 2**24


@dataclass
class Tree:
    """Nodes by number: feature (-1: leaf), threshold (left if at most), left child (right is the next), mean of each target."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[np.ndarray] = field(default_factory=list)

    def split(self, node: int, feature: int, threshold: float, values: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
        first = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, first
        for v in values:
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(0)
            self.value.append(v)
        return first, first + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return at
            f = np.maximum(feature[at], 0)
            at = np.where(inner, left[at] + (x[rows, f] > threshold[at]), at)


@dataclass
class Forest:
    """Fitted trees; predictions are means over the trees."""

    trees: list[Tree]
    features: list[str]
    labels: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``pred_{label}`` for each target; null where a feature is null."""
        trees, width, many = self.trees, len(self.features), len(self.labels)
        x = F.array(*[F.col(f).cast("double") for f in self.features])

        def score(batches):
            for batch in batches:
                rows = matrix(batch, "_x", width)
                total = sum(np.array(t.value)[t.place(rows)] for t in trees) / len(trees)
                total[np.isnan(rows).any(axis=1)] = np.nan
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * many, pa.int32()), pa.array(total.ravel(), mask=np.isnan(total.ravel())))
                names = [n for n in batch.schema.names if n != "_x"]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists], names=[*names, "_p"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        scored = df.withColumn("_x", x).mapInArrow(score, f"{kinds}, _p array<double>")
        return scored.select(*df.columns, *[F.get("_p", F.lit(i)).alias(f"pred_{label}") for i, label in enumerate(self.labels)])


def _uniform(number: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (number.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).astype(float) / 2.0**64


#: Cumulative probabilities of 0, 1, 2, ... draws of a row: Poisson with mean 1.
_DRAWS = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(12)])


def fit_forest(
    df: DataFrame, features: Sequence[str], labels: Sequence[str], trees: int = 10, depth: int = 10, bins: int = 32, share: float = 1 / 3,
    leaf_rows: int = 1, seed: int = 0, bootstrap: bool = True,
) -> Forest:
    """Fit on the rows that have all features and all labels.

    Thresholds are the ``bins`` quantiles of each feature. Each tree draws every row as often as a Poisson number
    says (``bootstrap``) and each node looks at ``share`` of the features, one at least; both follow from ``seed`` and the
    row's own number, so a lost task draws the same. A node is split while a split lowers the variance and
    leaves ``leaf_rows`` drawn rows on both sides, down to ``depth``. Without rows there are no trees.
    """
    features, labels = list(features), list(labels)
    n_f, n_t = len(features), len(labels)
    full = df.dropna(subset=[*features, *labels])
    x, y = F.array(*[F.col(f).cast("double") for f in features]), [F.col(c).cast("double") for c in labels]
    rows = staged(full.select(F.monotonically_increasing_id().alias("id"), F.concat(x, F.array(*y)).alias("row")), "forest")
    shares = [i / bins for i in range(1, bins)]
    cuts = rows.select(*[F.percentile_approx(F.get("row", F.lit(i)), shares, 100_000).alias(str(i)) for i in range(n_f)]).first()
    scale = rows.select(*[F.struct(F.avg(F.get("row", F.lit(n_f + t))).alias("m"), F.stddev_pop(F.get("row", F.lit(n_f + t))).alias("s")).alias(str(t)) for t in range(n_t)]).first()
    if cuts["0"] is None:
        return Forest([], features, labels)
    thresholds = [np.unique(np.array(cuts[str(i)], float)) for i in range(n_f)]
    mean = np.array([scale[str(t)]["m"] for t in range(n_t)])
    spread = np.array([scale[str(t)]["s"] or 1.0 for t in range(n_t)])
    forest = [Tree(value=[mean]) for _ in range(trees)]
    open_nodes = [(t, 0) for t in range(trees)]
    per_node = sum(len(c) + 1 for c in thresholds) * (n_t + 2)
    wanted = max(1, int(n_f * share + 0.5))
    for _ in range(depth):
        following = []
        for lo in range(0, len(open_nodes), max(1, PASS_SUMS // per_node)):
            group = open_nodes[lo : lo + max(1, PASS_SUMS // per_node)]
            for slot, r in _best_splits(rows, forest, group, thresholds, mean, spread, wanted, leaf_rows, seed, bootstrap):
                t, node = group[slot]
                if node == 0 and bootstrap:
                    forest[t].value[0] = mean + spread * np.array(r["total"]) / r["weight"]
                left = np.array(r["left"]) / r["left_weight"]
                right = (np.array(r["total"]) - np.array(r["left"])) / (r["weight"] - r["left_weight"])
                following += [(t, child) for child in forest[t].split(node, r["feature"], float(thresholds[r["feature"]][r["bin"]]), (mean + spread * left, mean + spread * right))]
        open_nodes = following
        if not open_nodes:
            break
    return Forest(forest, features, labels)


def _best_splits(rows: DataFrame, forest: list[Tree], group: list, thresholds: list, mean, spread, wanted: int, leaf_rows: int, seed: int, bootstrap: bool):
    """(place in ``group``, best split) of the nodes that have one."""
    n_f, n_t = len(thresholds), len(mean)
    width = [len(c) + 1 for c in thresholds]
    base = np.cumsum([0, *width])
    slots = {t: np.full(len(tree.feature), -1) for t, tree in enumerate(forest)}
    for slot, (t, node) in enumerate(group):
        slots[t][node] = slot
    active = sorted({t for t, _ in group})
    sums = ["w", *[f"s{i}" for i in range(n_t)]]

    def count(batches):
        total = np.zeros((n_t + 1, len(group) * base[-1]))
        for batch in batches:
            values = matrix(batch, "row", n_f + n_t)
            x, y = values[:, :n_f], (values[:, n_f:] - mean) / spread
            number = np.asarray(batch.column("id"))
            bin_ = [base[f] + np.searchsorted(thresholds[f], x[:, f], "left") for f in range(n_f)]
            for t in active:
                slot = slots[t][forest[t].place(x)]
                weight = np.searchsorted(_DRAWS, _uniform(number, 1_000_003 * seed + t), "right").astype(float) if bootstrap else np.ones(len(x))
                used = np.flatnonzero((slot >= 0) & (weight > 0))
                w = weight[used]
                for f in range(n_f):
                    at = slot[used] * base[-1] + bin_[f][used]
                    total[0] += np.bincount(at, w, total.shape[1])
                    for i in range(n_t):
                        total[i + 1] += np.bincount(at, w * y[used, i], total.shape[1])
        some = np.flatnonzero(total[0])
        slot, rest = np.divmod(some, base[-1])
        feature = np.searchsorted(base, rest, "right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot.astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array((rest - base[feature]).astype(np.int32)), *[pa.array(total[i][some]) for i in range(n_t + 1)]],
            names=["slot", "feature", "bin", *sums],
        )

    with small_batches(rows.sparkSession, n_f + n_t):
        parts = rows.mapInArrow(count, "slot int, feature int, bin int, " + ", ".join(f"{s} double" for s in sums))
        added = parts.groupBy("slot", "feature", "bin").agg(*[F.sum(s).alias(s) for s in sums])
        # A node's features, by a hash of its place; at most ``bins`` rows in a window of (node, feature).
        places = rows.sparkSession.createDataFrame([(i, t, node) for i, (t, node) in enumerate(group)], "slot int, tree int, node int")
        each = places.select("slot", F.explode(F.slice(F.array_sort(F.array(*[F.struct(F.xxhash64("tree", "node", F.lit(seed), F.lit(f)).alias("h"), F.lit(f).alias("feature")) for f in range(n_f)])), 1, wanted)).alias("c"))
        added = added.join(each.select("slot", F.col("c.feature").alias("feature")), ["slot", "feature"])
        one = Window.partitionBy("slot", "feature")
        upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        run = added.select(
            "slot", "feature", "bin", F.sum("w").over(upto).alias("left_weight"), F.sum("w").over(one).alias("weight"),
            F.array(*[F.sum(s).over(upto) for s in sums[1:]]).alias("left"), F.array(*[F.sum(s).over(one) for s in sums[1:]]).alias("total"),
        )
        right = F.col("weight") - F.col("left_weight")
        gain = F.lit(0.0)
        for i in range(n_t):
            l, s = F.col("left")[i], F.col("total")[i]
            gain = gain + l * l / F.col("left_weight") + (s - l) * (s - l) / right - s * s / F.col("weight")
        good = run.where((F.col("left_weight") >= leaf_rows) & (right >= leaf_rows) & (right > 0)).withColumn("gain", gain).where(F.col("gain") > 1e-9 * F.col("weight"))
        best = good.groupBy("slot").agg(F.max_by(F.struct("feature", "bin", "left_weight", "weight", "left", "total"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("b"))
        # One row for each node of the level: a part of the model.
        found = best.select("slot", "b.*").orderBy("slot").collect()
    return [(r["slot"], r) for r in found]


def rf_regress_multi(train: DataFrame, test: DataFrame, features: Sequence[str], labels: Sequence[str], **options) -> tuple[Forest, DataFrame]:
    """One forest for all targets; predictions become ``pred_{target}``."""
    forest = fit_forest(train, features, labels, **options)
    return forest, forest.predict(test)
