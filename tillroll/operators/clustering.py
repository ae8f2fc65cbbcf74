"""k-means customer segments, choice of k, and cluster profiles."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import fill_zero, mean_of, ratio
from tillroll.operators.aggregates import TOTAL
from tillroll.operators.learning import at_once
from tillroll.operators.ordering import durable
from tillroll.operators.selection import column_quantiles
from tillroll.operators.rfm import fill_median


class Segments(NamedTuple):
    segmented: DataFrame
    centers: DataFrame
    model: object


def _scaler(features: Sequence[str], centred: bool) -> Pipeline:
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features"),
            StandardScaler(
                inputCol="features", outputCol="scaled", withMean=centred, withStd=True
            ),
        ]
    )


def kmeans_segments(
    rfm: DataFrame,
    features: Sequence[str] = fixed.SEGMENT_FEATURES,
    k: int = 6,
    seed: int = fixed.SEED,
) -> Segments:
    """Segments on features of unit deviation; the scaler is part of the model."""
    clean = durable(fill_zero(rfm, features))
    stages = _scaler(features, centred=False).getStages()
    kmeans = KMeans(featuresCol="scaled", predictionCol="Segment", k=k, seed=seed)
    model = Pipeline(stages=[*stages, kmeans]).fit(clean)
    centers = rfm.sparkSession.createDataFrame(
        [
            (i, name, float(x))
            for i, c in enumerate(model.stages[-1].clusterCenters())
            for name, x in zip(features, c)
        ],
        "Segment int, feature string, center double",
    )
    return Segments(model.transform(clean).drop("features", "scaled"), centers, model)


def segment_stats(segmented: DataFrame) -> DataFrame:
    return (
        segmented.groupBy("Segment")
        .agg(
            F.count(F.lit(1)).alias("Customer_Count"),
            mean_of(F.col("Recency")).alias("Avg_Recency"),
            mean_of(F.col("Frequency")).alias("Avg_Frequency"),
            mean_of(F.col("Monetary")).alias("Avg_Monetary"),
            F.sum("Monetary").cast(TOTAL).alias("Total_Revenue"),
        )
        .orderBy(F.desc("Total_Revenue"), "Segment")
    )


def _silhouette() -> ClusteringEvaluator:
    return ClusteringEvaluator(
        featuresCol="scaled", predictionCol="cluster", distanceMeasure="squaredEuclidean"
    )


def tune_kmeans(
    rfm: DataFrame,
    features: Sequence[str] = ("Recency", "Frequency", "Monetary"),
    ks: Sequence[int] = (4, 5, 6, 7, 8),
    seeds: Sequence[int] = (42, 123, 456),
) -> DataFrame:
    """Silhouette of every (k, seed), best first."""
    clean = fill_zero(rfm, features)
    scaled = durable(_scaler(features, centred=False).fit(clean).transform(clean).select("scaled"))

    def scored(setting: tuple[int, int]) -> tuple:
        k, seed = setting
        model = KMeans(featuresCol="scaled", predictionCol="cluster", k=k, seed=seed).fit(scaled)
        return k, seed, float(_silhouette().evaluate(model.transform(scaled)))

    rows = at_once(rfm.sparkSession, scored, [(k, seed) for k in ks for seed in seeds])
    return rfm.sparkSession.createDataFrame(rows, "k int, seed int, silhouette double").orderBy(
        F.desc("silhouette"), "k", "seed"
    )


def _spread_to_own_center(predicted: DataFrame, centers: np.ndarray) -> dict[int, float]:
    """Mean distance of a cluster's rows to its center: one row per cluster."""
    own = F.element_at(
        F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers]), F.col("cluster") + 1
    )
    gaps = F.zip_with(vector_to_array("scaled"), own, lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x))
    grouped = predicted.select("cluster", distance.alias("d")).groupBy("cluster")
    return {r["cluster"]: r["m"] for r in grouped.agg(F.avg("d").alias("m")).collect()}


def _davies_bouldin(centers: np.ndarray, spread: dict[int, float]) -> float | None:
    used = sorted(spread)
    if len(used) < 2:
        return None
    worst = [
        max(
            (spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j]) for j in used if j != i
        )
        for i in used
    ]
    return float(np.mean(worst))


def cluster_sweep(
    rfm: DataFrame,
    features: Sequence[str] = fixed.CLUSTER_FEATURES,
    ks: Sequence[int] = tuple(range(2, 11)),
    seed: int = fixed.SEED,
) -> Segments:
    """Scores of each k, and the rows labelled by the k of best silhouette.

    `centers` holds the score table. Calinski-Harabasz and Davies-Bouldin come from
    per-cluster moments, not from pairs of rows.
    """
    filled = fill_median(rfm, features)
    prepared = durable(_scaler(features, centred=True).fit(filled).transform(filled))
    whole = prepared.agg(
        Summarizer.metrics("count", "variance").summary(F.col("scaled")).alias("s")
    ).select("s.count", "s.variance").first()
    n, total = whole[0], float(np.sum(whole[1].toArray())) * (whole[0] - 1)

    def scored(k: int) -> tuple:
        model = KMeans(featuresCol="scaled", predictionCol="cluster", k=k, seed=seed).fit(prepared)
        predicted = model.transform(prepared)
        centers = np.array(model.clusterCenters())
        within = model.summary.trainingCost
        silhouette = float(_silhouette().evaluate(predicted))
        between = (total - within) / (k - 1)
        row = (
            k, silhouette, float(between / (within / (n - k))) if within else None,
            _davies_bouldin(centers, _spread_to_own_center(predicted, centers)), float(within),
        )
        return row, model

    fits = at_once(rfm.sparkSession, scored, ks)
    rows, models = [row for row, _ in fits], dict(zip(ks, (model for _, model in fits)))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    scores = rfm.sparkSession.createDataFrame(
        [(*r, r[0] == best) for r in rows],
        "n_clusters int, silhouette_score double, calinski_harabasz_score double, "
        "davies_bouldin_score double, inertia double, best boolean",
    )
    labelled = models[best].transform(prepared).withColumnRenamed("cluster", "ML_Cluster")
    return Segments(labelled.drop("features", "scaled"), scores, models[best])


def cluster_profiles(
    df: DataFrame, features: Sequence[str] = fixed.CLUSTER_FEATURES, cluster: str = "ML_Cluster"
) -> DataFrame:
    """Size, share, mean, exact median and deviation per cluster and feature."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    long = df.select(
        cluster,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"))
                    for f in features
                ]
            )
        ),
    )
    stats = long.groupBy(cluster, "feature").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
    )
    medians = column_quantiles(df, features, (0.5,), [cluster]).select(
        cluster, F.col("column").alias("feature"), F.col("value").alias("median")
    )
    return stats.join(medians, [cluster, "feature"]).withColumn(
        "percentage", ratio(F.col("size"), rows) * 100
    )
