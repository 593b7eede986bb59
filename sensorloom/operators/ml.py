"""Data work around Spark ML: scaling, splits, regression, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler, MinMaxScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.sets import hash_bucket
from sensorloom.plans.ordered import number_rows
from sensorloom.plans.staging import staged


# --- features and scaling ---------------------------------------------------

def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one vector; rows with a null feature go."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(df)


def vectors(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    """An array column as a vector."""
    return df.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))


def fit_minmax_scaler(df: DataFrame, path: str | None = None, column: str = "features") -> MinMaxScalerModel:
    """Fit 0-1 scaling on training rows and, with ``path``, save it."""
    model = MinMaxScaler(inputCol=column, outputCol="scaled").fit(df)
    if path:
        model.write().overwrite().save(path)
    return model


def load_minmax_scaler(path: str) -> MinMaxScalerModel:
    return MinMaxScalerModel.load(path)


# --- splits -----------------------------------------------------------------

def split_seeded(df: DataFrame, train: float = 0.75, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two frames by Spark's own random numbers; the rows depend on how the input is partitioned."""
    first, second = df.randomSplit([train, 1 - train], seed)
    return first, second


def split_random(df: DataFrame, key: str, train: float = 0.75) -> DataFrame:
    """Add ``part`` by a hash of the key: the same rows on every run, no shuffle."""
    inside = hash_bucket(F.col(key)) < round(train * 1000)
    return df.withColumn("part", F.when(inside, F.lit("train")).otherwise(F.lit("test")))


def split_chronological(
    df: DataFrame, order: Sequence[str], train: float = 0.66, names: tuple[str, str] = ("train", "validate")
) -> DataFrame:
    """Add ``part``: the first share of the rows in time, and the rest."""
    numbered = number_rows(df, [], order, out="_rn", count="_n")
    first = F.col("_rn") < F.floor(F.col("_n") * train)
    return numbered.withColumn("part", F.when(first, F.lit(names[0])).otherwise(F.lit(names[1]))).drop("_rn", "_n")


def split_tail_validation(df: DataFrame, order: Sequence[str], validation: float = 0.2) -> DataFrame:
    """Add ``part``: the last share of the rows is for validation."""
    return split_chronological(df, order, 1 - validation)


# --- metrics ----------------------------------------------------------------

def metric_r2(df: DataFrame, label: str, prediction: str, epsilon: float = 1e-7) -> DataFrame:
    """1 - SSres / (SStot + epsilon), in one pass."""
    y, p = F.col(label), F.col(prediction)
    both = df.filter(y.isNotNull() & p.isNotNull())
    total = F.var_pop(label) * F.count(label)
    return both.agg((1 - F.sum((y - p) * (y - p)) / (total + epsilon)).alias("r2"))


def metric_mae(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(prediction) - F.col(label))).alias("mae"))


def metric_mse(df: DataFrame, label: str, prediction: str) -> DataFrame:
    error = F.col(prediction) - F.col(label)
    return df.agg(F.avg(error * error).alias("mse"))


# --- regression -------------------------------------------------------------

def random_forest(
    trees: int = 10, depth: int = 10, seed: int = 0, label: str = "label", features: str = "features"
) -> RandomForestRegressor:
    return RandomForestRegressor(
        numTrees=trees, maxDepth=depth, seed=seed, labelCol=label, featuresCol=features, predictionCol="prediction"
    )


def rf_regress(train: DataFrame, test: DataFrame, label: str, **options: int) -> tuple[Model, DataFrame]:
    """Random forest for one target: the model and the scored test rows."""
    model = random_forest(label=label, **options).fit(train)
    return model, model.transform(test)


def rf_best_of_seeds(
    train: DataFrame, validate: DataFrame, label: str, seeds: int, **options: int
) -> tuple[Model, int, float]:
    """Refit with seeds 0 .. seeds - 1 and keep the best validation R2."""
    scorer = RegressionEvaluator(labelCol=label, metricName="r2")
    runs = []
    for seed in range(seeds):
        model = random_forest(label=label, seed=seed, **options).fit(train)
        runs.append((model, seed, scorer.evaluate(model.transform(validate))))
    return max(runs, key=lambda run: run[2])


def gbt_regress(train: DataFrame, test: DataFrame, label: str, rounds: int = 10, seed: int = 0) -> tuple[Model, DataFrame]:
    model = GBTRegressor(labelCol=label, maxIter=rounds, seed=seed).fit(train)
    return model, model.transform(test)


def linear_regress(train: DataFrame, test: DataFrame, label: str) -> tuple[Model, DataFrame]:
    model = LinearRegression(labelCol=label).fit(train)
    return model, model.transform(test)


def feature_importance(model: Model, features: Sequence[str], like: DataFrame) -> DataFrame:
    """(feature, importance) rows of a fitted forest."""
    shares = [(f, float(model.featureImportances[i])) for i, f in enumerate(features)]
    return like.sparkSession.createDataFrame(shares, "feature string, importance double")


def cross_validate(df: DataFrame, estimator: Estimator, label: str, folds: int = 4, seed: int = 0) -> DataFrame:
    """Mean absolute error (negated) of each fold's held-out rows."""
    scorer = RegressionEvaluator(labelCol=label, metricName="mae")
    marked = staged(df.withColumn("_fold", F.floor(F.rand(seed) * folds)), "folds")
    scores = []
    for fold in range(folds):
        model = estimator.fit(marked.filter(F.col("_fold") != fold))
        held_out = marked.filter(F.col("_fold") == fold)
        scores.append((fold, -scorer.evaluate(model.transform(held_out))))
    return df.sparkSession.createDataFrame(scores, "fold int, neg_mae double")


def grid_search(
    df: DataFrame,
    label: str,
    trees: Sequence[int],
    subsets: Sequence[str],
    leaf_rows: Sequence[int],
    folds: int = 4,
    seed: int = 0,
) -> DataFrame:
    """Trees x feature subsets x rows per leaf; mean MAE over the folds per combination."""
    forest = RandomForestRegressor(labelCol=label, seed=seed)
    grid = (
        ParamGridBuilder()
        .addGrid(forest.numTrees, list(trees))
        .addGrid(forest.featureSubsetStrategy, list(subsets))
        .addGrid(forest.minInstancesPerNode, list(leaf_rows))
        .build()
    )
    scorer = RegressionEvaluator(labelCol=label, metricName="mae")
    fitted = CrossValidator(
        estimator=forest, estimatorParamMaps=grid, evaluator=scorer, numFolds=folds, seed=seed, parallelism=2
    ).fit(staged(df, "grid"))
    rows = [
        (
            int(params[forest.numTrees]),
            params[forest.featureSubsetStrategy],
            int(params[forest.minInstancesPerNode]),
            float(mae),
        )
        for params, mae in zip(grid, fitted.avgMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "trees int, subset string, leaf_rows int, mae double")


def impute_by_model(df: DataFrame, estimator: Estimator, features: Sequence[str], label: str, train) -> DataFrame:
    """Fit ``label`` on the rows that pass ``train`` and have it; predict it where it is null.

    Rows with a null feature keep their null; ``{label}_imputed`` marks predictions.
    """
    known = assemble(df.filter(train & F.col(label).isNotNull()).select(*features, label), features)
    stage = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    model = estimator.fit(staged(known.select("features", label), "train"))
    scored = model.transform(stage.transform(df))
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull()
    guess = F.when(complete, F.col("prediction"))
    missing = F.col(label).isNull() & complete
    return scored.withColumns({f"{label}_imputed": missing, label: F.coalesce(F.col(label), guess)}).drop(
        "features", "prediction"
    )
