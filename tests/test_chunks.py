import datetime as dt
import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import chunks as CH
from tillroll.operators import similarity
from tillroll.sources import versions
from tillroll.sources.sinks import save_chunks, stored_chunks
from tillroll.sources.tables import scan_chunks

DAY = dt.date(2009, 12, 1)


def fact(spark, n):
    rows = [
        (i, Decimal("1000.50"), Decimal("2.25"), i % 3 if i % 4 else None, f"P{i % 5}", "UK" if i % 3 else "FR",
         DAY + dt.timedelta(days=i % 2))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "i int, Revenue decimal(18,2), Total_Amount decimal(18,2), Customer_ID long, StockCode string, "
        "Country string, Date date").repartition(4)


def test_transaction_chunk_text(spark):
    out = CH.transaction_chunks(fact(spark, 7), ["i"], 4).orderBy("chunk").collect()
    assert [r["rows"] for r in out] == [4, 3]
    pad = "\n" + " " * 16
    assert out[0]["content"] == pad.join([
        "Transaction Segment 1:", "- Date Range: 2009-12-01 to 2009-12-02", "- Total Revenue: £4,002.00",
        "- Unique Customers: 3", "- Unique Products: 4", "- Top Countries: {'FR': 2, 'UK': 2}",
        "- Transaction Count: 4", "- Average Order Value: £2.25",
    ])
    assert out[1]["chunk_id"] == "transactions_2"
    meta = json.loads(out[1]["metadata"])
    assert (meta["start_idx"], meta["end_idx"], meta["customers"], meta["products"]) == (4, 7, 2, 3)


def test_customer_and_product_chunks(spark):
    customers = spark.createDataFrame(
        [(i, "UK" if i else "FR", Decimal(100 - i)) for i in range(5)],
        "Customer_ID long, Country string, Total_Spent decimal(28,2)")
    first = CH.customer_chunks(customers, [F.desc("Total_Spent"), "Customer_ID"], 3).orderBy("chunk").first()
    assert "- Countries: {'UK': 2, 'FR': 1}" in first["content"]
    assert first["content"].endswith("- Spending Range: £98.00 - £100.00")
    products = spark.createDataFrame(
        [(f"P{i}", "d", "BAGS" if i % 2 else "SETS", Decimal(5000 - i)) for i in range(4)],
        "StockCode string, Description string, Product_Category string, Total_Revenue decimal(28,2)")
    first = CH.product_chunks(products, [F.desc("Total_Revenue"), "StockCode"], 3).orderBy("chunk").first()
    assert "- Top Product: P0 (£5,000.00)" in first["content"]
    assert "- Categories: {'SETS': 2, 'BAGS': 1}" in first["content"]


def vectors(spark, n=300, dims=8):
    m = np.random.default_rng(1).normal(size=(n, dims))
    m[7] = m[3]
    m[9] = 0.0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    return m.astype(np.float32).astype(float), df.repartition(5)


@pytest.mark.parametrize("per_pass", [2, 512])
@pytest.mark.parametrize("skip", [False, True])
def test_cosine_topk_by_brute_force(spark, monkeypatch, per_pass, skip):
    monkeypatch.setattr(similarity, "BLOCK_QUERIES", per_pass)
    m, df = vectors(spark)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    got = similarity.cosine_topk(df.filter("vec_id < 5"), df, 4, skip_self=skip)
    got = {(r["query_id"], r["place"]): (r["vector_id"], r["similarity"]) for r in got.collect()}
    assert len(got) == 20
    for q in range(5):
        s = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(len(s)), -s.round(12))) if not (skip and i == q)][:4]
        assert [got[q, k + 1][0] for k in range(4)] == order
        assert got[q, 1][1] == pytest.approx(s[order[0]])


def test_topk_of_no_query_is_empty(spark):
    _, df = vectors(spark, 20)
    assert similarity.cosine_topk(df.filter("vec_id < 0"), df).count() == 0


def test_stored_chunks_can_be_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "chunks")
    cols = "chunk_type string, chunk_id string, content string"
    assert stored_chunks(spark, path) == (0, None)
    save_chunks(spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], cols), path)
    new = spark.createDataFrame([("a", "1", "z"), ("a", "2", "w")], cols)
    number, old = stored_chunks(spark, path)
    assert save_chunks(CH.upsert_chunks(old.select("chunk_type", "chunk_id", "content"), new), path, number) == 2
    rows = lambda df: {(r["chunk_type"], r["chunk_id"]): r["content"] for r in df.collect()}
    assert rows(stored_chunks(spark, path)[1]) == {("a", "1"): "z", ("a", "2"): "w", ("b", "1"): "y"}
    # A reader that opened the store before sees what it opened, whole.
    assert rows(old) == {("a", "1"): "x", ("b", "1"): "y"}
    # Another writer that started from the first state changes nothing.
    with pytest.raises(versions.StoreChanged):
        save_chunks(new, path, number)
    assert stored_chunks(spark, path)[1].count() == 3
    plan = scan_chunks(stored_chunks(spark, path)[1], ["a"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(chunk_type" in plan


def test_build_embed_search_and_upsert(spark):
    customers = spark.createDataFrame(
        [(i, "NORWAY" if i < 3 else "UK", Decimal(100 - i)) for i in range(9)],
        "Customer_ID long, Country string, Total_Spent decimal(28,2)")
    chunks = CH.build_chunks(
        {"customer_analysis": customers, "retail_transactions_processed": fact(spark, 9)}, ["i"], 3
    )
    stats = {r["chunk_type"]: r["chunks"] for r in CH.chunk_stats(chunks).collect()}
    assert stats == {"customer_analysis": 3, "transactions": 3, "total": 6}
    model = CH.embedder(256).fit(chunks)
    embedded = CH.apply_embedder(model, chunks)
    size = embedded.select(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("s"))
    assert size.agg(F.max(F.abs(F.col("s") - 1))).first()[0] < 1e-5
    hits = CH.search_chunks(model, embedded, "countries {'norway':", 2, ["customer_analysis"]).orderBy("place").collect()
    assert hits[0]["chunk_id"] == "customers_1" and hits[0]["relevance_pct"] > 0
    assert {h["chunk_type"] for h in hits} == {"customer_analysis"}
    newer = chunks.filter("chunk_id = 'customers_1'").withColumn("content", F.lit("new"))
    newer = newer.unionByName(chunks.limit(0))
    merged = CH.upsert_chunks(chunks, newer)
    assert merged.count() == 6
    assert merged.filter("content = 'new'").select("chunk_id").first()[0] == "customers_1"
    with pytest.raises(ValueError):
        CH.build_chunks({}, ["i"])


def test_chunk_and_warehouse_tables_come_from_one_stored_fact(spark, monkeypatch):
    """The star is joined once however many tables are made from its lines."""
    from tillroll.plans import queries_experiments as Q
    from tillroll.plans import queries_sources, star_tables
    from tillroll.sources import star

    joined = []
    whole = star.raw_lines
    monkeypatch.setattr(star, "raw_lines", lambda *a: joined.append(1) or whole(*a))
    t = star_tables.StarTables(spark, "/root/testdata/sf0.001")
    for df in Q._catalog(t).values():
        assert "lineitem.parquet" not in "".join(df.inputFiles()) and df.count() > 0
    assert "lineitem.parquet" not in "".join(t.stored_daily.inputFiles()) and len(joined) == 1
    seen = {}
    monkeypatch.setattr(queries_sources.warehouse, "load_warehouse", lambda s, d, *a: seen.update(d))
    queries_sources._warehouse_load(t)
    assert seen and all("lineitem.parquet" not in "".join(df.inputFiles()) for df in seen.values())
