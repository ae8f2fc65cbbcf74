import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.functions import columns as C
from tillroll.operators import aggregates as A
from tillroll.operators import etl
from tillroll.schemas import RAW_LINES, TRANSACTIONS

DAY = dt.datetime(2009, 12, 5, 8, 30)


def line(invoice="1", code="a", text="x", quantity=1, when=DAY, price="1.00", customer=7, country="fr"):
    return (invoice, code, text, quantity, when, None if price is None else Decimal(price), customer, country)


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW_LINES)


def test_clean_text_strips_all_white_space_and_fills_nulls(spark):
    df = raw(spark, line(text=" \t gift bag \n", country=None, code=None))
    row = etl.clean(df).first()
    assert row["Description"] == "GIFT BAG"
    assert row["Country"] == "UNKNOWN" and row["StockCode"] == "UNKNOWN"
    assert "Customer_ID" in row.asDict()


def test_clean_drops_invalid_rows_and_keeps_returns(spark):
    df = raw(
        spark, line(), line(quantity=-3, price="2.50"), line(quantity=0), line(price="-1"),
        line(price=None), line(when=None), line(invoice=None), line(quantity=None), line(price="0"),
    )
    rows = etl.clean(df).orderBy("Total_Amount").collect()
    assert [r["Total_Amount"] for r in rows] == [Decimal("0.00"), Decimal("1.00"), Decimal("7.50")]
    assert [r["Is_Return"] for r in rows] == [False, False, True]
    kept = etl.retention(df).first()
    assert (kept["rows_in"], kept["rows_kept"]) == (9, 3)
    assert kept["retained_pct"] == pytest.approx(100 / 3)


def test_unparsable_time_text_is_dropped(spark):
    df = raw(spark, line(), line()).withColumn(
        "InvoiceDate", F.when(F.rand(1) < 2, F.lit("2009-12-05 08:30:00"))
    )
    bad = df.withColumn("InvoiceDate", F.lit("soon"))
    assert etl.clean(df.unionByName(bad)).count() == 2


def test_features(spark):
    tx = etl.add_features(etl.clean(raw(
        spark,
        line(text="christmas gift bag set light", price="5.00", quantity=-2),
        line(text="christmas gift", price="5.01"),
        line(text="tea", price="0", customer=None),
        line(text="tea set", price="50.01"),
        line(text="paper bag", price="50"),
    )))
    assert {f.name: f.dataType for f in tx.schema.fields} == {
        f.name: f.dataType for f in TRANSACTIONS.fields
    }
    by = {r["Description"]: r for r in tx.collect()}
    first = by["CHRISTMAS GIFT BAG SET LIGHT"]
    assert first["Product_Category"] == "LIGHTING" and first["Price_Range"] == "LOW"
    assert first["Revenue"] == Decimal("-10.00")
    assert (first["Year"], first["Month"], first["Day"], first["Hour"]) == (2009, 12, 5, 8)
    assert first["DayOfWeek"] == 5 and first["Date"] == dt.date(2009, 12, 5)
    assert by["CHRISTMAS GIFT"]["Product_Category"] == "GIFTS"
    assert by["CHRISTMAS GIFT"]["Price_Range"] == "MEDIUM"
    assert by["TEA"]["Price_Range"] is None and by["TEA"]["Customer_Type"] == "GUEST"
    assert by["TEA"]["Product_Category"] == "OTHER"
    assert by["TEA SET"]["Product_Category"] == "SETS" and by["TEA SET"]["Price_Range"] == "PREMIUM"
    assert by["PAPER BAG"]["Product_Category"] == "BAGS" and by["PAPER BAG"]["Price_Range"] == "HIGH"


def test_aggregates_count_lines_and_ignore_guests_where_they_should(spark):
    other = DAY + dt.timedelta(days=40)
    tx = etl.add_features(etl.clean(raw(
        spark,
        line(price="2.00", quantity=3), line(price="4.00", quantity=-1),
        line(customer=None, price="1.00"), line(customer=7, country="de", when=other, price="10.00"),
        line(customer=8, country="fr ", price="1.50"),
    )))
    daily = {(r["Country"], str(r["Date"])): r for r in A.daily_sales(tx).collect()}
    fr = daily["FR", "2009-12-05"]
    assert fr["Total_Revenue"] == Decimal("4.50") and fr["Total_Quantity"] == 6
    assert fr["Total_Transactions"] == 4 and fr["Unique_Customers"] == 2
    assert fr["Avg_Unit_Price"] == pytest.approx(8.5 / 4)
    customers = A.customer_analysis(tx).collect()
    assert [(r["Customer_ID"], r["Country"]) for r in customers] == [(7, "DE"), (7, "FR"), (8, "FR")]
    months = A.monthly_trends(tx).orderBy("Year", "Month").collect()
    assert [(r["Year"], r["Month"], r["Total_Transactions"]) for r in months] == [(2009, 12, 4), (2010, 1, 1)]
    total = A.processing_summary(tx).first()
    assert total["date_range"] == "2009-12-05 to 2010-01-14"
    assert total["total_revenue"] == sum(r["Total_Revenue"] for r in A.country_performance(tx).collect())


def test_country_totals_add_up_from_days(spark):
    # A shipped day table: France sold 1024.29 on one day and took back 28.95 on the next.
    days = spark.createDataFrame(
        [("FRANCE", Decimal("1024.29")), ("FRANCE", Decimal("-28.95")), ("EIRE", Decimal("1800.43"))],
        "Country string, Total_Revenue decimal(28,2)",
    )
    got = {r["Country"]: r["s"] for r in days.groupBy("Country").agg(F.sum("Total_Revenue").alias("s")).collect()}
    assert got["FRANCE"] == Decimal("995.34")


def test_cut_is_right_closed_and_open_below(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (100.01,), (1000.0,), (1e9,), (-1.0,), (None,)], "x double")
    got = [r[0] for r in df.select(C.cut(F.col("x"), (0, 100, 500, 1000, None), "BSGP")).collect()]
    assert got == [None, "B", "S", "G", "P", None, None]


def test_strip_equals_python(spark):
    texts = ["", " ", "a", " a b ", "\u2003x\xa0", "é ", " é", "é", "\x85a\x1c", "a\u200b", "\t\n", "日本 ", "~", "a\u3000"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(C.strip(F.col("s"))).collect()] == [t.strip() for t in texts]


def test_ellipsize_and_rounding(spark):
    df = spark.createDataFrame([("a" * 50, 0.125, Decimal("2.345")), ("b" * 51, 0.375, Decimal("2.355"))],
                               "s string, x double, d decimal(10,3)")
    short = [r[0] for r in df.select(C.ellipsize(F.col("s"))).collect()]
    assert short == ["a" * 50, "b" * 50 + "..."]
    rows = C.rounded(df).collect()
    assert [r["x"] for r in rows] == [0.12, 0.38]
    assert [r["d"] for r in rows] == [Decimal("2.34"), Decimal("2.36")]


def test_filters(spark):
    df = spark.createDataFrame(
        [("France", dt.date(2020, 1, 1)), ("FRANCE", dt.date(2020, 1, 3)), ("Spain", dt.date(2020, 1, 2))],
        "c string, d date",
    )
    assert df.filter(C.eq_ci(F.col("c"), "france")).count() == 2
    assert df.filter(C.between_dates(F.col("d"), "2020-01-01", "2020-01-02")).count() == 2
    assert df.filter(C.between_dates(F.col("d"))).count() == 3
