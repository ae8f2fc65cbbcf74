import datetime as dt
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators import aggregates as A
from tillroll.operators import alerts as AL
from tillroll.operators.clustering import kmeans_segments
from tillroll.plans import marts
from tillroll.schemas import RAW_LINES, WAREHOUSE
from tillroll.sources import sinks, tables, warehouse


def raw(spark):
    day = dt.datetime(2009, 12, 1, 9)
    rows = [
        (f"I{i // 3}", f"P{i % 4}", "gift bag" if i % 2 else "light", 1 + i % 5, day + dt.timedelta(days=i % 40),
         Decimal(f"{1 + i % 60}.25"), None if i % 7 == 0 else i % 9, "uk" if i % 3 else "fr")
        for i in range(120)
    ]
    return spark.createDataFrame(rows, RAW_LINES)


def test_pipeline_catalog_and_warehouse(spark, tmp_path):
    folder = str(tmp_path / "marts")
    stored = marts.run_pipeline(raw(spark), folder)
    assert stored["daily_sales"].agg(F.sum("Total_Revenue")).first()[0] == stored[marts.FACT].agg(F.sum("Revenue")).first()[0]
    catalog = tables.load_catalog(spark, folder)
    assert set(catalog) == {
        marts.FACT, "daily_sales", "product_performance", "customer_analysis", "country_performance", "monthly_trends"
    }
    n = tables.sql(spark, "SELECT count(*) AS n FROM customer_analysis WHERE Country = 'UK'").first()["n"]
    assert n == catalog["customer_analysis"].filter("Country = 'UK'").count() > 0
    warehouse.create_namespaces(spark)
    warehouse.create_tables(spark)
    loaded = warehouse.load_warehouse(spark, catalog)
    assert set(loaded) == set(WAREHOUSE)
    warehouse.load_warehouse(spark, catalog)
    counts = {r["table_name"]: r["n"] for r in warehouse.warehouse_counts(spark).collect()}
    assert counts["analytics.retail_transactions"] == 120
    assert counts["analytics.country_performance"] == 2
    row = spark.table("analytics.customer_analysis").first()
    assert row["customer_segment"] is None and row["created_at"] is not None
    assert row["First_Purchase_Date"] <= row["Last_Purchase_Date"]
    assert "country" in [r[0].lower() for r in tables.sql(spark, "DESCRIBE analytics.daily_sales").collect()]
    report = marts.business_report(catalog)
    sinks.save_report(report, str(tmp_path / "report"))
    back = spark.read.schema("section string, metric string, key string, value double").json(str(tmp_path / "report"))
    assert back.count() == report.count() > 15
    assert AL.alerts(
        catalog[marts.FACT], catalog["customer_analysis"], catalog["product_performance"],
        ["InvoiceDate", "Invoice", "StockCode"], concentration_pct=1,
    ).count() >= 1


def test_partitioned_fact(spark, tmp_path):
    stored = marts.run_pipeline(raw(spark), str(tmp_path), partition_by=("Year", "Month"))
    plan = stored[marts.FACT].filter("Year = 2010 AND Month = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(Year" in plan
    assert stored[marts.FACT].filter("Year = 2010").count() > 0


def test_csv_round_trip_skips_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 2.345), (2, None, None)], "id long, s string, x double")
    names = sinks.save_tables({"t": df, "none": df.limit(0)}, str(tmp_path), "csv", digits=2)
    assert names == ["t"]
    back = tables.read_table(spark, str(tmp_path / "t"), "csv", df.schema)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a,b", 2.34), (2, None, None)]
    assert set(tables.load_catalog(spark, str(tmp_path), "csv", ["daily_sales"])) == set()
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t"), "csv")
    sinks.export_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_results_are_appended(spark, tmp_path):
    df = spark.createDataFrame([("e1", 0.01)], "experiment string, p_value double")
    for _ in range(2):
        sinks.append_results(df, str(tmp_path / "r"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "r")).count() == 2


def test_validate_and_profile(spark):
    df = raw(spark)
    rows = {r["required"]: r for r in tables.validate_table(df, ["Invoice", "customer", "Tax"]).collect()}
    assert rows["Invoice"]["found"] and rows["Invoice"]["rows"] == 120 and rows["Invoice"]["non_empty"]
    assert rows["customer"]["matched_column"] == "Customer ID" and rows["customer"]["nulls"] == 18
    assert not rows["Tax"]["found"] and rows["Tax"]["nulls"] is None
    p = {r["column"]: r for r in tables.profile(df).collect()}
    assert p["Quantity"]["p50"] == 3.0 and p["Customer ID"]["nulls"] == 18
    assert p["Country"]["mean"] is None and p["Country"]["min_text"] == "fr"
    assert p["Price"]["null_pct"] == 0.0


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = tables.sample_n(df.repartition(3), 50, ["id"])
    assert a.count() == 50 and a.exceptAll(tables.sample_n(df.repartition(11), 50, ["id"])).count() == 0


def test_missing_tables_count_zero(spark):
    got = tables.table_counts(spark, ["no_such_table"]).collect()
    assert [(r[0], r[1]) for r in got] == [("no_such_table", 0)]


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 AS chunk_type", "id AS other").write.parquet(str(tmp_path / "c"))
    df = tables.scan_chunks(tables.read_table(spark, str(tmp_path / "c")), [1]).select("id", "chunk_type")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(chunk_type), EqualTo(chunk_type,1)]" in plan
    assert "ReadSchema: struct<id:bigint,chunk_type:bigint>" in plan


def test_model_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    df = spark.range(60).selectExpr("id AS Customer_ID", "id % 3 AS a", "id % 5 AS b")
    fitted = kmeans_segments(df, ["a", "b"], 3)
    sinks.save_model(fitted.model, str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(df)
    assert again.select("Customer_ID", "Segment").exceptAll(fitted.segmented.select("Customer_ID", "Segment")).count() == 0


def test_batch_job_from_csv(spark, tmp_path):
    from tillroll.plans import job

    sinks.export_csv(raw(spark), str(tmp_path / "raw"))
    args = job.parser().parse_args(["--raw", str(tmp_path / "raw"), "--out", str(tmp_path / "out"), "--partition-by", "Year"])
    job.run(spark, args)
    assert spark.read.parquet(str(tmp_path / "out" / marts.FACT)).count() == 120
    assert spark.read.parquet(str(tmp_path / "out" / "processing_summary")).first()["total_records"] == 120


def test_raw_csv_as_other_tools_write_it(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"
        '1,A,"SAID ""HI"", TWICE",2,2009-12-01 07:45:00,6.95,13085.0,United Kingdom\n'
        "1,B,,3,2009-12-01 07:45:00,1.5,,United Kingdom\n"
        "2,C,x,4,never,1.5,7,France\n"
    )
    df = tables.read_table(spark, str(path), "csv", RAW_LINES)
    first, second, third = df.collect()
    assert first["Customer ID"] == 13085 and first["Description"] == 'SAID "HI", TWICE'
    assert first["InvoiceDate"] == dt.datetime(2009, 12, 1, 7, 45) and first["Price"] == Decimal("6.95")
    assert second["Customer ID"] is None and second["Description"] is None
    assert third["InvoiceDate"] is None
    from tillroll.operators.etl import clean

    assert clean(df).count() == 2


def test_fractions_are_no_whole_numbers(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.csv").write_text("q,c\n12.7,13085.0\n13085.9,oops\n-3,7.00\n")
    schema = T.StructType().add("q", T.IntegerType()).add("c", T.LongType())
    got = [tuple(r) for r in tables.read_table(spark, str(tmp_path / "x.csv"), "csv", schema).collect()]
    assert got == [(None, 13085), (None, None), (-3, 7)]


def test_an_empty_table_replaces_the_last_run(spark, tmp_path):
    df = spark.range(3)
    assert sinks.save_tables({"t": df}, str(tmp_path)) == ["t"]
    assert sinks.save_tables({"t": df.limit(0)}, str(tmp_path)) == []
    assert spark.read.schema("id long").parquet(str(tmp_path / "t")).count() == 0


def test_every_record_is_kept_or_listed(spark, tmp_path):
    lines = [
        "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country",
        "I1,P1,bag,3,2009-12-01 09:00:00,2.50,7.0,UK",
        "I2,P1,bag,,2009-12-01 09:00:00, ,,UK",  # absent and blank cells are nulls
        "I3,P1,bag,three,2009-12-01 09:00:00,2.50,7,UK",
        "I4,P1,bag,3,2009-13-01 09:00:00,2.505,7.5,UK",
        "I5,P1,bag",
        "I6,P1,bag,3,2009-12-01 09:00:00,2.50,7,UK,extra",
        'I7,P1,"a ""large"" bag",99999999999,2009-12-01 09:00:00,2.50,7,UK',
    ]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    checked = tables.read_checked(spark, str(tmp_path / "a.csv"), "csv", RAW_LINES)
    assert checked.kept.schema.simpleString() == RAW_LINES.simpleString()
    kept = {r["Invoice"]: (r["Quantity"], r["Price"], r["Customer ID"]) for r in checked.kept.collect()}
    assert kept == {"I1": (3, Decimal("2.50"), 7), "I2": (None, None, None)}
    listed = {r["record"][:2] if r["columns"] is None else r["record"][12:14]: r for r in checked.rejected.collect()}
    assert {k: r["columns"] for k, r in listed.items()} == {
        "I3": "Quantity", "I4": "InvoiceDate,Price,Customer ID", "I5": None, "I6": None, "I7": "Quantity"
    }
    assert listed["I6"]["record"] == lines[6] and listed["I3"]["file"].endswith("a.csv") and '"Quantity":"three"' in listed["I3"]["record"]
    counts = {r["columns"]: r["records"] for r in tables.rejected_counts(checked).collect()}
    assert counts == {"kept": 2, "line": 2, "Quantity": 2, "InvoiceDate,Price,Customer ID": 1}


def test_json_records_are_kept_or_listed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": "x"}\n{"a": 1.5, "b": "y"}\n{"a": 2\n{"b": "z"}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    checked = tables.read_checked(spark, str(tmp_path / "a.json"), "json", schema)
    assert sorted(map(tuple, checked.kept.collect()), key=str) == [(1, "x"), (None, "z")]
    assert sorted((r["columns"] or "line", r["record"]) for r in checked.rejected.collect()) == [("a", '{"a":"1.5","b":"y"}'), ("line", '{"a": 2')]
    with pytest.raises(ValueError):
        tables.read_checked(spark, str(tmp_path), "parquet", schema)


def test_tables_are_written_side_by_side(spark, tmp_path):
    """Two of the jobs wait for each other, so one after the other they would not end; results keep their order."""
    meet = threading.Barrier(2, timeout=20)
    assert len(set(sinks.at_once(spark, [meet.wait, meet.wait], 2))) == 2
    with pytest.raises(ZeroDivisionError):
        sinks.at_once(spark, [lambda: 1, lambda: 1 / 0], 2)
    frames = {f"t{i}": spark.range(i % 3) for i in range(7)}
    assert sinks.save_tables(frames, str(tmp_path)) == [f"t{i}" for i in range(7) if i % 3]
    assert sinks.save_tables({}, str(tmp_path)) == []


def test_summary_counts_keys_in_the_aggregates(spark, tmp_path):
    stored = marts.run_pipeline(raw(spark), str(tmp_path))
    want = A.processing_summary(stored[marts.FACT]).first().asDict()
    got = stored["processing_summary"].drop("processing_date").first().asDict()
    assert got == want
    # Given tables are read instead of the lines.
    none = {n: stored[n].limit(0) for n in ("product_performance", "customer_analysis", "country_performance")}
    row = A.processing_summary(stored[marts.FACT], *none.values()).first()
    assert (row["unique_products"], row["unique_customers"], row["countries"]) == (0, 0, 0)
