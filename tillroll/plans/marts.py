"""The batch pipeline: raw lines to stored fact, aggregates and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.operators import aggregates as A
from tillroll.operators import reports as R
from tillroll.operators.etl import add_features, clean
from tillroll.sources.sinks import save_tables
from tillroll.sources.tables import read_table

FACT = "retail_transactions_processed"
#: The tables of the summary's product codes, customers and countries.
_KEY_TABLES = ("product_performance", "customer_analysis", "country_performance")


def aggregate_tables(tx: DataFrame, ordered: bool = True) -> dict[str, DataFrame]:
    return {
        "daily_sales": A.daily_sales(tx),
        "product_performance": A.product_performance(tx, ordered),
        "customer_analysis": A.customer_analysis(tx, ordered),
        "country_performance": A.country_performance(tx, ordered),
        "monthly_trends": A.monthly_trends(tx),
    }


def run_pipeline(
    raw: DataFrame,
    folder: str,
    rules=fixed.CATEGORY_RULES,
    price_edges=fixed.PRICE_EDGES,
    price_labels=fixed.PRICE_LABELS,
    partition_by: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Clean, enrich and store the fact once; build every aggregate from the stored fact.

    The stored fact is columnar, so each aggregate reads only its own columns, and no
    aggregate repeats the cleaning. Aggregates are written side by side. Stored tables are returned.
    """
    spark = raw.sparkSession
    fact = add_features(clean(raw), rules, price_edges, price_labels)
    save_tables({FACT: fact}, folder, partition_by={FACT: partition_by} if partition_by else None)
    tx = read_table(spark, f"{folder}/{FACT}", schema=None).select(*fact.columns)
    aggregates = aggregate_tables(tx)
    written = save_tables(aggregates, folder)
    # The aggregates hold every code, customer and country that the summary counts.
    keys = [spark.read.schema(aggregates[n].schema).parquet(f"{folder}/{n}") for n in _KEY_TABLES]
    summary = A.processing_summary(tx, *keys).withColumn("processing_date", F.localtimestamp())
    written += save_tables({"processing_summary": summary}, folder)
    return {FACT: tx} | {n: read_table(spark, f"{folder}/{n}") for n in written}


def business_report(tables: dict[str, DataFrame], tier_edges=fixed.TIER_EDGES) -> DataFrame:
    """The report's numbers as rows: section, metric, key, value."""
    tx, customers = tables[FACT], tables["customer_analysis"]
    products, countries = tables["product_performance"], tables["country_performance"]
    parts = [
        _metrics("business_summary", R.overview(tx).drop("top_country", "start_date", "end_date")),
        _keyed("business_summary", "top_countries", R.business_summary_countries(tx), "Country", "transactions"),
        _keyed("business_summary", "revenue_by_category", R.revenue_by_category(tx), "Product_Category", "revenue"),
        _metrics("customers", R.tier_totals(customers)),
        *[
            _keyed("customers", c, R.tier_analysis(customers, tier_edges), "Segment", c)
            for c in ("customers", "avg_spent", "avg_orders")
        ],
        _metrics("products", R.product_analysis(products)),
        _keyed("products", "category_performance", R.category_performance(products), "Product_Category", "revenue"),
        _metrics("markets", R.market_analysis(countries)),
        _keyed("markets", "top_markets", R.top_markets(countries), "Country", "Total_Revenue"),
        _keyed("markets", "emerging_markets", R.emerging_markets(countries), "Country", "Total_Revenue"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _metrics(section: str, df: DataFrame) -> DataFrame:
    rows = [
        F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).cast("double").alias("value"))
        for c in df.columns
    ]
    return df.select(F.lit(section).alias("section"), F.inline(F.array(*rows)))


def _keyed(section: str, metric: str, df: DataFrame, key: str, value: str) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        F.lit(metric).alias("metric"),
        F.col(key).cast("string").alias("key"),
        F.col(value).cast("double").alias("value"),
    )
