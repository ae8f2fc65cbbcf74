"""Namespaces and typed warehouse tables in the session catalog, and a star stored for joins without a shuffle."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.operators.ordering import session_folder
from tillroll.schemas import WAREHOUSE, WAREHOUSE_SOURCE
from tillroll.sources.tables import table_counts

ANALYTICS = "analytics"


def create_namespaces(spark: SparkSession) -> None:
    for name in fixed.NAMESPACES:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def create_tables(spark: SparkSession, namespace: str = ANALYTICS) -> None:
    """The five tables: a dataset's columns plus `created_at`.

    Each names its folder in the namespace, so a session without a catalog of earlier ones finds the table
    where they left it.
    """
    home = spark.catalog.getDatabase(namespace).locationUri.rstrip("/")
    for name, schema in WAREHOUSE.items():
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {namespace}.{name} ({columns}, created_at timestamp) USING parquet LOCATION '{home}/{name}'"
        )


def load_warehouse(
    spark: SparkSession, datasets: Mapping[str, DataFrame], namespace: str = ANALYTICS
) -> list[str]:
    """Replace the rows of each table whose dataset is given.

    Columns are taken by name and cast to the table's types; a column the dataset lacks
    stays null. Rows are written by the executors.
    """
    loaded = []
    for name, schema in WAREHOUSE.items():
        df = datasets.get(WAREHOUSE_SOURCE.get(name, name))
        if df is None:
            continue
        columns = [
            (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
        out = df.select(*columns, F.current_timestamp().alias("created_at"))
        out.write.insertInto(f"{namespace}.{name}", overwrite=True)
        loaded.append(name)
    return loaded


def warehouse_counts(spark: SparkSession, namespace: str = ANALYTICS) -> DataFrame:
    return table_counts(spark, [f"{namespace}.{name}" for name in WAREHOUSE])


#: Rows of a bucket of the larger stored star table, about.
BUCKET_ROWS = 1_000_000
LINES, INVOICES = "star_lines", "star_invoices"


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Replace a catalog table with the rows in `buckets` files by hash of the key, sorted by it in each.

    Tables that are stored by the same key into the same number of buckets join, and a table groups by that key, where
    the rows lie. Rows of one hot key share a file, as they would share a task in a shuffle. Every call writes a
    folder of its own among the session's tables: files that another session or an earlier call left are not met,
    and frames that read the table replaced stay whole.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{table.rpartition('.')[2]}-{uuid.uuid4()}"
    laid = df.repartition(buckets, key)
    laid.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def store_star(
    line: DataFrame, order: DataFrame, part: DataFrame, customer: DataFrame, nation: DataFrame, namespace: str = ANALYTICS
) -> int:
    """Store the star as two tables that are laid out alike, by invoice number; returns their buckets.

    What a line needs of its product goes to the lines, and what an invoice needs of its customer to the invoices, so
    these joins are paid once, when the star is loaded. The number of buckets follows from the rows.
    """
    spark = line.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {namespace}")
    buyers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("Country"))
    invoices = order.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("Customer ID"),
        "Country",
    )
    quantity = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("int")
    lines = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("order_key"),
        F.concat(F.lit("PROD"), F.col("l_partkey")).alias("StockCode"),
        F.col("p_name").alias("Description"),
        quantity.alias("Quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("Price"),
    )
    buckets = max(1, math.ceil(line.count() / BUCKET_ROWS))
    buckets = 1 << (buckets - 1).bit_length()
    save_bucketed(lines, f"{namespace}.{LINES}", "order_key", buckets)
    save_bucketed(invoices, f"{namespace}.{INVOICES}", "order_key", buckets)
    return buckets


def stored_lines(spark: SparkSession, namespace: str = ANALYTICS) -> DataFrame:
    """Raw invoice lines from the stored star, merged bucket by bucket: no row moves. `order_key` stays, to group by."""
    lines, invoices = spark.table(f"{namespace}.{LINES}"), spark.table(f"{namespace}.{INVOICES}")
    return lines.join(invoices.hint("merge"), "order_key").select(
        "order_key", F.concat(F.lit("INV"), F.col("order_key")).alias("Invoice"), "StockCode", "Description", "Quantity",
        "InvoiceDate", "Price", "Customer ID", "Country",
    )


def invoice_totals(lines: DataFrame) -> DataFrame:
    """Lines, items and amount of every invoice, where its lines lie."""
    amount = (F.abs("Quantity") * F.col("Price")).cast("decimal(18,2)")
    return lines.groupBy("order_key").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.abs("Quantity")).alias("items"), F.sum(amount).cast("decimal(28,2)").alias("amount")
    )
