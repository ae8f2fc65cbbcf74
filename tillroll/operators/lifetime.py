"""Customer lifetime value and churn models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import ratio
from tillroll.operators.learning import (
    Fitted, area_under_roc, assemble, cross_validate, importances, metric_rows, regression,
    with_fold,
)
from tillroll.operators.ordering import durable, rank_in_groups
from tillroll.operators.rfm import fill_median, with_risk_band

# One row in five is a test row.
_PARTS = 5


def _stratified(df: DataFrame, key: Sequence[str], folds: int, seed: int) -> DataFrame:
    """Adds test part and fold by the row's place among those of its label, in order of a key hash.

    Every part and every fold then holds each label in its share of the table, to within a row.
    """
    placed = rank_in_groups(df.withColumn("_h", F.xxhash64(*key, F.lit(seed))), ["label"], ["_h", *key], "_place")
    place = F.col("_place") - 1
    return placed.withColumns(
        {"part": (place % _PARTS).cast("int"), "fold": (F.floor(place / _PARTS) % folds).cast("int")}
    ).drop("_h", "_place")


def _prepared(
    df: DataFrame, features: Sequence[str], label: str, folds: int, seed: int, classes: bool = False
) -> DataFrame:
    """Median-filled vectors with a test part and a cross-validation fold, by class if the label is one."""
    slim = df.select("Customer_ID", F.col(label).cast("double").alias("label"), *features)
    filled = fill_median(slim, features)
    if classes:
        split = _stratified(filled, ["Customer_ID"], folds, seed)
    else:
        split = with_fold(with_fold(filled, ["Customer_ID"], _PARTS, seed, "part"), ["Customer_ID"], folds, seed + 1, "fold")
    return durable(assemble(split, features).select("Customer_ID", "label", "features", "part", "fold"))


def clv_model(
    df: DataFrame,
    features: Sequence[str] = fixed.CLV_FEATURES,
    trees: int = 100,
    folds: int = 5,
    seed: int = fixed.SEED,
) -> Fitted:
    """Random forest on spend. Spend equals order value times frequency, two of the
    features, so the scores show fit and not foresight."""
    spark = df.sparkSession
    data = _prepared(df, features, "Monetary", folds, seed)
    forest = RandomForestRegressor(labelCol="label", numTrees=trees, seed=seed)
    model = forest.fit(data.filter("part > 0"))
    tested = model.transform(data.filter("part = 0"))
    mean, dev = cross_validate(data, forest.fit, regression("r2", "label"), "fold", folds)
    metrics = metric_rows(
        spark,
        [
            ("random_forest", "rmse", regression("rmse", "label").evaluate(tested)),
            ("random_forest", "r2_score", regression("r2", "label").evaluate(tested)),
            ("random_forest", "cv_mean_r2", mean),
            ("random_forest", "cv_std_r2", dev),
        ],
    )
    predicted = model.transform(data).select("Customer_ID", F.col("prediction").alias("Predicted_CLV"))
    return Fitted(df.join(predicted, "Customer_ID"), metrics, importances(spark, model, features), model)


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from the confusion counts."""
    counts = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = counts.select(
        "n",
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.lit("actual").alias("side")),
                F.struct(F.col("prediction").alias("class"), F.lit("predicted").alias("side")),
            )
        ),
        (F.col("label") == F.col("prediction")).alias("hit"),
    )

    def total(side: str, hit: bool = False):
        test = (F.col("side") == side) & (F.col("hit") if hit else F.lit(True))
        return F.sum(F.when(test, F.col("n")).otherwise(0))

    grouped = sides.groupBy("class").agg(
        total("actual").alias("support"),
        total("predicted").alias("predicted"),
        total("actual", True).alias("hits"),
    )
    precision = F.coalesce(ratio(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("hits"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return grouped.select(
        F.col("class").cast("int").alias("class"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score"), "support",
    )


def churn_model(
    df: DataFrame,
    features: Sequence[str] = fixed.CHURN_FEATURES,
    iters: int = 100,
    folds: int = 5,
    seed: int = fixed.SEED,
) -> Fitted:
    """Boosted trees on `Is_Churned`; adds probability and risk band.

    Test part and folds are dealt out per class, so both classes are in each.
    """
    spark = df.sparkSession
    data = _prepared(df, features, "Is_Churned", folds, seed, classes=True)
    if data.select("label").distinct().limit(2).count() < 2:
        raise ValueError("churn labels have one class only")
    boosted = GBTClassifier(labelCol="label", maxIter=iters, maxDepth=3, stepSize=0.1, seed=seed)
    model = boosted.fit(data.filter("part > 0"))
    tested = model.transform(data.filter("part = 0"))
    mean, dev = cross_validate(data, boosted.fit, area_under_roc("label"), "fold", folds)
    report = class_report(tested)
    metrics = metric_rows(
        spark,
        [
            ("boosted_trees", "auc_score", area_under_roc("label").evaluate(tested)),
            ("boosted_trees", "cv_mean_auc", mean),
            ("boosted_trees", "cv_std_auc", dev),
        ],
    ).unionByName(
        report.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit("boosted_trees").alias("model"),
                            F.concat(F.lit("class_"), "class", F.lit(f"_{c}")).alias("metric"),
                            F.col(c).cast("double").alias("value"),
                        )
                        for c in ("precision", "recall", "f1_score", "support")
                    ]
                )
            )
        )
    )
    probability = vector_to_array("probability")[1]
    scored = model.transform(data).select("Customer_ID", probability.alias("Churn_Probability"))
    joined = with_risk_band(df.join(scored, "Customer_ID"))
    return Fitted(joined, metrics, importances(spark, model, features), model)


def churn_mlp(
    df: DataFrame,
    features: Sequence[str] = fixed.MLP_FEATURES,
    hidden: Sequence[int] = (128, 64, 32),
    iters: int = 500,
    seed: int = fixed.SEED,
) -> Fitted:
    """Multilayer perceptron on customer rows with `Is_Churned`."""
    spark = df.sparkSession
    slim = df.select(
        "Customer_ID", "Country", F.col("Is_Churned").cast("double").alias("label"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
    )
    data = durable(_stratified(slim, ["Customer_ID", "Country"], 1, seed))
    net = MultilayerPerceptronClassifier(
        featuresCol="scaled", labelCol="label", layers=[len(features), *hidden, 2], maxIter=iters, seed=seed
    )
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="features"),
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
            net,
        ]
    ).fit(data.filter("part > 0"))
    tested = model.transform(data.filter("part = 0"))
    churned = class_report(tested).filter(F.col("class") == 1).first()
    accuracy = tested.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    names = ("precision", "recall", "f1_score")
    metrics = metric_rows(
        spark,
        [("perceptron", "accuracy", accuracy)]
        + [("perceptron", m, churned[m] if churned else 0.0) for m in names],
    )
    predicted = model.transform(data).select(
        "Customer_ID", "Country", "label", "prediction",
        vector_to_array("probability")[1].alias("Churn_Probability"),
    )
    return Fitted(predicted, metrics, None, model)
