import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.operators import ordering as O


def skewed(spark, n=3000, parts=7):
    """One group and one value hold more than a third of all rows."""
    rng = np.random.default_rng(3)
    g = np.where(rng.random(n) < 0.4, "hot", rng.integers(0, 30, n).astype(str))
    v = np.where(rng.random(n) < 0.4, 1.0, rng.normal(0, 5, n).round(1))
    pdf = pd.DataFrame({"id": rng.permutation(n), "g": g, "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(parts)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_global_rank_equals_a_sort(spark, parts):
    pdf, df = skewed(spark, parts=parts)
    got = {r["id"]: r["rank"] for r in O.global_rank(df, ["v", "id"]).collect()}
    want = pdf.sort_values(["v", "id"]).reset_index(drop=True)
    assert got == {i: k + 1 for k, i in enumerate(want["id"])}


def test_rank_spreads_a_hot_value_over_partitions(spark):
    wide = spark.range(200_000).select("id", F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = O._placed(wide, ["v", "id"]).groupBy("_part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 4 and max(r["count"] for r in parts) < 100_000


def test_rank_in_groups(spark):
    pdf, df = skewed(spark)
    got = {r["id"]: r["r"] for r in O.rank_in_groups(df, ["g"], ["v", "id"], "r").collect()}
    pdf = pdf.sort_values(["g", "v", "id"])
    assert got == dict(zip(pdf["id"], pdf.groupby("g").cumcount() + 1))


def test_a_few_large_groups_stay_spread(spark):
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.autoBroadcastJoinThreshold": "20000"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(80_000).withColumn("g", (F.col("id") % 10 < 3).cast("int"))
        ranked = O.rank_in_groups(df, ["g"], ["id"], "r").withColumn("task", F.spark_partition_id())
        rows = ranked.toPandas()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = rows.sort_values(["g", "id"])
    assert list(rows["r"]) == list(rows.groupby("g").cumcount() + 1) and len(rows) == 80_000
    assert rows.groupby("task").size().max() < 20_000


def test_running_totals(spark):
    pdf, df = skewed(spark)
    got = {r["id"]: r["run_id"] for r in O.running_totals(df, ["v", "id"], ["id"]).collect()}
    pdf = pdf.sort_values(["v", "id"])
    assert got == dict(zip(pdf["id"], pdf["id"].cumsum()))


@pytest.mark.parametrize("n", [1, 2, 5, 3000])
def test_quantiles_equal_numpy(spark, n):
    pdf, df = skewed(spark, n)
    probs = (0.0, 0.2, 0.25, 0.5, 0.75, 0.8, 1.0)
    got = {r["prob"]: r["value"] for r in O.quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(pdf["v"], p), abs=1e-12)


def test_group_quantiles_skip_nulls(spark):
    pdf, df = skewed(spark)
    df = df.withColumn("v", F.when(F.col("id") % 5 != 0, F.col("v")))
    pdf = pdf[pdf["id"] % 5 != 0]
    got = {(r["g"], r["prob"]): r["value"] for r in O.quantiles(df, "v", (0.3, 0.5), ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g, 0.3] == pytest.approx(part["v"].quantile(0.3), abs=1e-12)
        assert got[g, 0.5] == pytest.approx(part["v"].median(), abs=1e-12)


def test_row_chunks_and_top_in_group(spark):
    pdf, df = skewed(spark, 230)
    sizes = O.row_chunks(df, ["id"], 50).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in sizes] == [50, 50, 50, 50, 30]
    top = O.top_in_group(df.withColumn("one", F.lit(1)), ["one"], "g", 3).orderBy("place").collect()
    want = pdf.groupby("g").size().reset_index(name="n").sort_values(["n", "g"], ascending=[False, True])
    assert [(r["g"], r["n"]) for r in top] == list(want.head(3).itertuples(index=False, name=None))


def test_ranges_follow_the_data(spark, monkeypatch):
    from tillroll.operators import ordering

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    monkeypatch.setattr(ordering, "RANGE_ROWS", 1000)
    try:
        for n, least in ((500, 1), (20_000, 12)):
            placed = ordering._placed(spark.range(n), ["id"])
            assert placed.select("_part").distinct().count() >= least
            ranked = ordering.global_rank(spark.range(n), ["id"])
            assert ranked.filter("rank <> id + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_session_tables_can_be_dropped(spark):
    import os

    from tillroll.operators import ordering
    from tillroll.plans import queries_models

    queries_models.forget()
    folder = ordering.session_folder(spark).removeprefix("file:")
    kept = ordering.durable(spark.range(5))
    assert kept.count() == 5 and os.listdir(folder)
    ordering.drop_session_tables(spark)
    assert not os.path.exists(folder)
