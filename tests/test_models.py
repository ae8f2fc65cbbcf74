import datetime as dt

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.operators import clustering as CL
from tillroll.operators import factors as FA
from tillroll.operators import forecasting as FO
from tillroll.operators import lifetime as LT
from tillroll.operators import rfm as R
from tillroll.operators.learning import best_model, metric_rows


def value(metrics, model, metric):
    return metrics.filter((F.col("model") == model) & (F.col("metric") == metric)).first()["value"]


def blobs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c, middle in enumerate(((0, 0), (10, 0), (0, 10))):
        rows += [(c * 100 + i, *map(float, rng.normal(middle, 0.5))) for i in range(40)]
    return spark.createDataFrame(rows, "Customer_ID long, a double, b double")


def test_sweep_finds_three_blobs_and_scores_match_numpy(spark):
    found = CL.cluster_sweep(blobs(spark), ["a", "b"], (2, 3, 4))
    best = found.centers.filter("best").first()
    assert best["n_clusters"] == 3 and best["silhouette_score"] > 0.9
    pdf = found.segmented.toPandas()
    x = pdf[["a", "b"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    label = pdf["ML_Cluster"].to_numpy()
    centers = np.array([x[label == k].mean(0) for k in range(3)])
    within = sum(((x[label == k] - centers[k]) ** 2).sum() for k in range(3))
    between = ((x - x.mean(0)) ** 2).sum() - within
    assert best["inertia"] == pytest.approx(within, rel=1e-6)
    assert best["calinski_harabasz_score"] == pytest.approx(between / 2 / (within / (len(x) - 3)), rel=1e-6)
    spread = [np.linalg.norm(x[label == k] - centers[k], axis=1).mean() for k in range(3)]
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(centers[i] - centers[j]) for j in range(3) if j != i) for i in range(3)]
    assert best["davies_bouldin_score"] == pytest.approx(np.mean(worst), rel=1e-6)
    profiles = CL.cluster_profiles(found.segmented, ["a", "b"]).collect()
    assert len(profiles) == 6 and all(r["size"] == 40 for r in profiles)
    for r in profiles:
        part = pdf[pdf["ML_Cluster"] == r["ML_Cluster"]][r["feature"]]
        assert r["median"] == pytest.approx(part.median()) and r["std"] == pytest.approx(part.std())


def test_tuning_prefers_the_true_k(spark):
    best = CL.tune_kmeans(blobs(spark), ["a", "b"], (2, 3, 5), (42, 7)).first()
    assert best["k"] == 3


def buyers(spark, n=300):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        f, aov, tenure = int(rng.integers(1, 9)), float(rng.uniform(5, 200)), int(rng.integers(0, 90))
        recency = int(rng.integers(0, 60))
        rows.append((i, recency, f, round(f * aov, 2), aov, f / (tenure + 1) * 30, f * 2, tenure, f * 3))
    return spark.createDataFrame(
        rows,
        "Customer_ID long, Recency int, Frequency int, Monetary double, Avg_Order_Value double, "
        "Purchase_Frequency double, Product_Variety int, Tenure_Days int, Transaction_Count int",
    ).withColumn("Monetary", F.col("Monetary").cast("decimal(28,2)"))


def test_value_and_churn_models(spark):
    df = buyers(spark)
    clv = LT.clv_model(df, trees=20, folds=2)
    assert value(clv.metrics, "random_forest", "r2_score") > 0.6
    assert clv.predictions.count() == 300
    assert clv.importances.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    labelled = R.churn_labels(df).withColumn("Is_Churned", (F.col("Monetary") < 200).cast("int"))
    churn = LT.churn_model(labelled, iters=5, folds=2)
    assert value(churn.metrics, "boosted_trees", "auc_score") > 0.9
    support = churn.metrics.filter("metric like '%support'").agg(F.sum("value")).first()[0]
    assert 30 < support < 100
    with pytest.raises(ValueError):
        LT.churn_model(df.withColumn("Is_Churned", F.lit(1)), iters=1, folds=2)


def test_class_report(spark):
    rows = [(1.0, 1.0)] * 6 + [(1.0, 0.0)] * 2 + [(0.0, 1.0)] * 3 + [(0.0, 0.0)] * 9
    got = {r["class"]: r for r in LT.class_report(spark.createDataFrame(rows, "label double, prediction double")).collect()}
    assert got[1]["precision"] == pytest.approx(6 / 9) and got[1]["recall"] == pytest.approx(6 / 8)
    assert got[1]["f1_score"] == pytest.approx(2 * (6 / 9) * 0.75 / (6 / 9 + 0.75)) and got[0]["support"] == 12


def history(spark, n=200):
    rng = np.random.default_rng(6)
    t = np.arange(n)
    x = 500 + 2 * t + 60 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 4, n)
    start = dt.date(2020, 1, 1)
    return x, spark.createDataFrame(
        [("s", start + dt.timedelta(days=int(i)), float(v)) for i, v in zip(t, x)],
        "series string, Date date, Daily_Revenue double",
    )


def test_holt_winters_follows_trend_and_season(spark):
    x, df = history(spark)
    row = FO.holt_winters(df).first()
    assert row["train_rows"] == 160 and row["rmse"] < 15
    assert len(row["forecast"]) == 30 and row["forecast"][0] == pytest.approx(500 + 2 * 200 + 60 * np.sin(2 * np.pi * 200 / 7), abs=25)


def test_arima_order_and_error(spark):
    rng = np.random.default_rng(8)
    z = np.zeros(400)
    for i in range(2, 400):
        z[i] = 1.2 * z[i - 1] - 0.6 * z[i - 2] + rng.normal()
    start = dt.date(2020, 1, 1)
    df = spark.createDataFrame(
        [("s", start + dt.timedelta(days=i), float(v) + 50) for i, v in enumerate(z)],
        "series string, Date date, Daily_Revenue double",
    )
    row = FO.ar_grid(df).first()
    assert row["p"] == 2 and row["d"] == 0
    assert row["rmse"] < z.std() * 1.2 and len(row["forecast"]) == 80
    short = FO.ar_grid(df.limit(5)).first()
    assert short["p"] is None and short["forecast"] is None and short["train_rows"] == 4


def test_series_models_and_future(spark):
    _, df = history(spark)
    series = df.drop("series")
    fitted = FO.ts_ml_models(series, trees=5, iters=3, recent=14)
    assert value(fitted.metrics, FO.LINEAR, "rmse") < 200
    best = best_model(fitted.metrics).first()
    assert best["best_model"] in (FO.FOREST, FO.BOOSTED, FO.LINEAR)
    future = FO.forecast_future(series, fitted, days=10)
    assert future.count() == 40 and future.agg(F.min("Date")).first()[0] == dt.date(2020, 7, 19)
    wide = future.groupBy("Date").pivot("model").agg(F.first("forecast")).orderBy("Date").first()
    assert wide["ensemble"] == pytest.approx((wide[FO.FOREST] + wide[FO.BOOSTED] + wide[FO.LINEAR]) / 3)


def test_comparison_wording(spark):
    week = spark.createDataFrame([(100.0, 120.0, 110.0)] * 7, f"{FO.FOREST} double, {FO.LINEAR} double, ensemble double")
    summary = spark.createDataFrame([(90.0, 104.0)], "avg_revenue double, last_revenue double")
    row = FO.forecast_comparison(week, summary).first()
    assert row["revenue_trend"] == "Increasing" and row["confidence_level"] == "Medium"
    assert row["model_agreement"] == "Medium" and row["recommended_model"] == "Random Forest"
    assert row["total_forecast_revenue"] == pytest.approx(770)


def test_best_model(spark):
    m = metric_rows(spark, [("a", "rmse", 3.0), ("b", "rmse", 2.0), ("b", "r2", -9.0)])
    assert tuple(best_model(m).first()) == ("b", 2.0)


def test_factors_put_like_customers_together(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        for p in range(20):
            if rng.random() < 0.7:
                like = (c % 2) == (p % 2)
                rows.append((c, f"P{p:02d}", f"{'x' * 60}{p}", float(rng.normal(50 if like else 5, 1))))
    tx = spark.createDataFrame(rows, "Customer_ID long, StockCode string, Description string, Revenue double")
    f = FA.customer_product_factors(tx, rank=4, iters=5)
    assert value(f.metrics, "als", "test_rmse") < 0.6
    near = FA.similar_customers(f.customers, tx, 3, 4).collect()
    assert len(near) == 12
    assert all(r["customer_id"] % 2 == r["similar_customer"] % 2 and r["customer_id"] != r["similar_customer"] for r in near)
    names = tx.groupBy("StockCode").agg(F.min("Description").alias("Description"))
    goods = FA.similar_products(f.products, tx, names, 2, 3).collect()
    assert len(goods) == 6 and all(r["description"] == "x" * 50 + "..." for r in goods)


def _ratings(spark, customers=60, products=30):
    rng = np.random.default_rng(5)
    rows = [(c, f"P{p:02d}", float(rng.normal(20, 5))) for c in range(customers) for p in range(products) if rng.random() < 0.6]
    return spark.createDataFrame(rows, "Customer_ID long, StockCode string, Revenue double")


def test_factor_rounds_leave_few_files(spark):
    """The vectors that rounds send each other are deleted while the fit goes on."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in disk.getAllFiles().mkString(",").split(",") if f.endswith(".data")}

    before = files()
    FA.customer_product_factors(_ratings(spark), rank=4, iters=10)
    assert len(files() - before) < 140  # twenty half rounds of ten files each, without deletion


def test_predictions_are_products_of_both_vectors(spark, monkeypatch):
    monkeypatch.setattr(FA, "CELL_KEYS", 7)
    rng = np.random.default_rng(6)
    u, v = rng.normal(size=(20, 3)).astype("float32"), rng.normal(size=(15, 3)).astype("float32")

    def vectors(x, n):
        return spark.createDataFrame([(i, list(map(float, x[i]))) for i in range(n)], "id int, features array<float>")

    rated = [(a, b, int(a % 5), float(a * 100 + b)) for a in range(20) for b in range(15)] * 2
    got = FA.predicted_ratings(spark.createDataFrame(rated, "user int, item int, part long, rating float"), vectors(u, 18), vectors(v, 14))
    rows = sorted(tuple(r) for r in got.collect())
    want = sorted((a % 5, float(a * 100 + b), float(u[a] @ v[b])) for a in range(18) for b in range(14) for _ in range(2))
    assert len(rows) == len(want)
    assert all(r[:2] == w[:2] and abs(r[2] - w[2]) < 1e-5 for r, w in zip(rows, want))


def test_blocks_of_the_fit_grow_with_the_ratings(spark, monkeypatch):
    """A task is sent a vector for each rating of its block at most, so blocks may not grow with the table."""
    monkeypatch.setattr(FA, "BLOCK_RATINGS", 50, raising=False)
    f = FA.customer_product_factors(_ratings(spark), rank=4, iters=2)
    train = 60 * 30 * 0.6 * 0.8
    for vectors in (f.model.userFactors, f.model.itemFactors):
        assert train / 50 * 0.8 < vectors.rdd.getNumPartitions() < train / 50 * 1.2


def test_predictions_hold_one_batch_of_products(spark):
    """Two cells, one customer each, products in batches of their own: predictions come before later batches are read."""
    read = []

    def batches():
        names = ["place", "user", "part", "rating", "features"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float32(), pa.list_(pa.float32())]
        for cell in (3, 8):
            def row(item, rated, user, rating, features, at=cell << 33):
                return at + (item + 1) * 2 + rated, user, 1, rating, features

            some = [[row(-1, 0, 5, 0.0, [1.0, 2.0])], [row(-1, 0, 4, 0.0, [cell, 0.0])]]
            for i in range(20):  # the vector, two ratings, a rating of an unknown customer; a product without a vector
                some += [[row(2 * i, 0, -1, 0.0, [i, 1.0]), row(2 * i, 1, 5, i, None)], [row(2 * i, 1, 4, -i, None), row(2 * i, 1, 6, 0.0, None)], [row(2 * i + 1, 1, 5, 0.0, None)]]
            for rows in some:
                read.append(cell)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    out = FA._predict_cells(batches())
    first = next(out)
    assert first.to_pylist() == [{"part": 1, "rating": 0.0, "prediction": 2.0}] and len(read) == 3
    rest = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert sorted([(1, 0.0, 2.0), *rest]) == sorted(x for cell in (3, 8) for i in range(20) for x in ((1, i, i + 2.0), (1, -i, cell * i)))


def test_neighbours_read_stored_vectors(spark):
    """The vectors and the wanted keys are worked out once, however often the search reads them."""
    seen, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(counter):
        def run(x):
            counter.add(1)
            return x

        return F.udf(run, "long").asNondeterministic()

    factors = spark.range(60).select(counted(seen)("id").alias("k"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    ids = spark.range(3).select(counted(asked)("id").alias("k"))
    near = FA.similar(factors, "k", ids, 2).collect()
    assert len(near) == 6 and {r["query_id"] for r in near} == {0, 1, 2}
    assert (seen.value, asked.value) == (60, 3)


def test_rare_class_is_in_every_part(spark):
    from tillroll.operators import lifetime

    rows = [(i, 1.0 if i % 400 == 0 else 0.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "Customer_ID int, label double")
    got = lifetime._stratified(df, ["Customer_ID"], 5, 7).groupBy("part", "label").count().collect()
    assert {(r["part"], r["label"]): r["count"] for r in got} == {**{(p, 0.0): 399 for p in range(5)}, **{(p, 1.0): 1 for p in range(5)}}


def test_folds_are_fitted_side_by_side_and_scored_in_order(spark):
    import threading

    from tillroll.operators import learning

    meet = threading.Barrier(3, timeout=60)

    class Model:
        def transform(self, df):
            return df

    class Rows:
        def evaluate(self, df):
            return float(df.count())

    def fit(df):
        meet.wait()
        return Model()

    df = spark.range(60).selectExpr("CAST(id % 3 AS INT) AS fold")
    assert learning.cross_validate(df, fit, Rows(), "fold", 3) == (20.0, 0.0)
