"""Shared steps of the model operators: splits, scores, vectors.

Rows go to folds by a hash of their key, so a recomputed partition gives the same
split. The table a model learns from is stored once: the many passes of a fit then read
rows and not the plan behind them. Only scores and importances, a few numbers each, come back to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator, Evaluator, RegressionEvaluator,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import fixed


class Fitted(NamedTuple):
    """Predicted rows, score rows, importance rows, and the fitted model."""

    predictions: DataFrame
    metrics: DataFrame
    importances: DataFrame | None
    model: object


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def with_fold(df: DataFrame, key: Sequence[str], folds: int, seed: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(folds)).cast("int"))


def regression(metric: str, label: str, prediction: str = "prediction") -> Evaluator:
    return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName=metric)


def area_under_roc(label: str) -> Evaluator:
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")


#: Fits that run at once. A fit is a long row of short jobs; the others fill the cores each leaves idle.
FITS_AT_ONCE = 3


def at_once(spark, task: Callable, items: Iterable) -> list:
    """`task` of every item, in their order, a few at a time; the first failure is raised."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(spark)(task), x) for x in items]]


def cross_validate(
    df: DataFrame, fit: Callable, evaluator: Evaluator, fold: str, folds: int
) -> tuple[float, float]:
    """Mean and population deviation of the score over the folds, which are fitted a few at a time."""

    def score(k: int) -> float:
        model = fit(df.filter(F.col(fold) != k))
        return evaluator.evaluate(model.transform(df.filter(F.col(fold) == k)))

    scores = at_once(df.sparkSession, score, range(folds))
    mean = sum(scores) / folds
    return mean, (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5


def metric_rows(spark, rows: Sequence[tuple]) -> DataFrame:
    """(model, metric, value) rows."""
    return spark.createDataFrame(
        [(m, n, None if v is None else float(v)) for m, n, v in rows],
        "model string, metric string, value double",
    )


def importances(spark, model, features: Sequence[str]) -> DataFrame:
    """Feature importances, largest first."""
    weights = model.featureImportances.toArray()
    return spark.createDataFrame(
        [(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")


def best_model(metrics: DataFrame, metric: str = "rmse") -> DataFrame:
    """The model with the lowest score."""
    return metrics.filter(F.col("metric") == metric).agg(
        F.min_by("model", F.struct("value", "model")).alias("best_model"),
        F.min("value").alias(f"best_{metric}"),
    )


SEED = fixed.SEED
