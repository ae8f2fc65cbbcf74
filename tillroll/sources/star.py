"""Raw invoice lines out of a star of order, line, part, customer and nation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.operators.etl import add_features, clean

# The star's prices are about a thousand times those of a shop; its words differ too.
PRICE_EDGES = (0, 5000, 20000, 50000, None)
TIER_EDGES = (0, 100_000, 500_000, 1_000_000, None)
CATEGORY_RULES = (
    ("RING", "RINGS"),
    ("GEAR", "GEARS"),
    ("PLATE", "PLATES"),
    ("BLUE", "BLUE RANGE"),
    ("OLD", "CLEARANCE"),
)
# A total order of the lines, up to rows that are equal in every column.
LINE_ORDER = ("InvoiceDate", "Invoice", "StockCode", "Quantity", "Price")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner joins only; Spark chooses each join's strategy from table sizes."""
    line = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "n_name"
    )
    heads = order.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "n_name"
    )
    returned = F.col("l_returnflag") == "R"
    return (
        line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.concat(F.lit("INV"), F.col("l_orderkey")).alias("Invoice"),
            F.concat(F.lit("PROD"), F.col("l_partkey")).alias("StockCode"),
            F.col("p_name").alias("Description"),
            F.when(returned, -F.col("l_quantity"))
            .otherwise(F.col("l_quantity"))
            .cast("int")
            .alias("Quantity"),
            F.col("o_orderdate").alias("InvoiceDate"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("Price"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("Customer ID"),
            F.col("n_name").alias("Country"),
        )
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_features(
        clean(raw_lines(spark, sf_dir)), CATEGORY_RULES, PRICE_EDGES, fixed.PRICE_LABELS
    )
