"""The five aggregate tables, the run summary, and small generic aggregates.

Money is summed as decimal, which is exact in any order, and means are taken from
those sums. Distinct counts are exact: Spark first groups by (key, value), so one
hot key is spread over the values it holds before it is counted. Where several columns are
counted, each is counted by itself, from a scan of its own column; one aggregate over all of them
would copy every row once per column. So give these operators a stored table, in which a
column can be read alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import mean_of
from tillroll.operators.etl import registered

TOTAL = "decimal(28,2)"


def _total(name: str):
    return F.sum(name).cast(TOTAL)


def distinct_count(df: DataFrame, column: str) -> Column:
    """How many values a column holds, as a scalar column."""
    return df.select(column).distinct().agg(F.count(column)).scalar()


def distinct_per(df: DataFrame, group: str, columns: Mapping[str, str]) -> DataFrame:
    """The group and, for each (name, column), how many values the column holds in it; 0 for none."""
    out = None
    for name, column in columns.items():
        seen = df.select(group, column).distinct().groupBy(group).agg(F.count(column).alias(name))
        out = seen if out is None else out.join(seen, group)
    return out


def daily_sales(tx: DataFrame) -> DataFrame:
    return tx.groupBy("Date", "Country").agg(
        _total("Revenue").alias("Total_Revenue"),
        F.sum("Absolute_Quantity").alias("Total_Quantity"),
        F.count("Invoice").alias("Total_Transactions"),
        F.countDistinct("Customer_ID").alias("Unique_Customers"),
        mean_of(F.col("Price")).alias("Avg_Unit_Price"),
    )


def product_performance(tx: DataFrame, ordered: bool = True) -> DataFrame:
    out = tx.groupBy("StockCode", "Description", "Product_Category").agg(
        _total("Revenue").alias("Total_Revenue"),
        F.sum("Absolute_Quantity").alias("Total_Quantity_Sold"),
        F.count("Invoice").alias("Total_Orders"),
        mean_of(F.col("Price")).alias("Avg_Price"),
        F.countDistinct("Customer_ID").alias("Unique_Customers"),
    )
    return out.orderBy(F.desc("Total_Revenue"), "StockCode", "Description") if ordered else out


def customer_analysis(tx: DataFrame, ordered: bool = True) -> DataFrame:
    """One row per registered customer and country."""
    out = (
        registered(tx)
        .groupBy("Customer_ID", "Country")
        .agg(
            _total("Revenue").alias("Total_Spent"),
            F.count("Invoice").alias("Total_Orders"),
            F.sum("Absolute_Quantity").alias("Total_Items"),
            mean_of(F.col("Total_Amount")).alias("Avg_Order_Value"),
            F.max("InvoiceDate").alias("Last_Purchase_Date"),
            F.min("InvoiceDate").alias("First_Purchase_Date"),
        )
    )
    return out.orderBy(F.desc("Total_Spent"), "Customer_ID", "Country") if ordered else out


def country_performance(tx: DataFrame, ordered: bool = True) -> DataFrame:
    out = tx.groupBy("Country").agg(
        _total("Revenue").alias("Total_Revenue"),
        F.count("Invoice").alias("Total_Transactions"),
        F.countDistinct("Customer_ID").alias("Unique_Customers"),
        mean_of(F.col("Total_Amount")).alias("Avg_Transaction_Value"),
    )
    return out.orderBy(F.desc("Total_Revenue"), "Country") if ordered else out


def monthly_trends(tx: DataFrame) -> DataFrame:
    return tx.groupBy("Year", "Month").agg(
        _total("Revenue").alias("Total_Revenue"),
        F.sum("Absolute_Quantity").alias("Total_Quantity"),
        F.count("Invoice").alias("Total_Transactions"),
        F.countDistinct("Customer_ID").alias("Unique_Customers"),
    )


def processing_summary(
    tx: DataFrame, products: DataFrame | None = None, customers: DataFrame | None = None, countries: DataFrame | None = None
) -> DataFrame:
    """The run summary. Codes, customers and countries are counted in the lines, or in smaller tables made from them that hold each."""
    return tx.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.concat(
            F.min("Date").cast("string"), F.lit(" to "), F.max("Date").cast("string")
        ).alias("date_range"),
        _total("Revenue").alias("total_revenue"),
    ).select(
        "*",
        distinct_count(tx if products is None else products, "StockCode").alias("unique_products"),
        distinct_count(tx if customers is None else customers, "Customer_ID").alias("unique_customers"),
        distinct_count(tx if countries is None else countries, "Country").alias("countries"),
    )


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    if approx:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
    return df.sparkSession.range(1).select(*[distinct_count(df, c).alias(c) for c in cols])


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Rows per value, most frequent first, nulls left out."""
    counts = (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), col)
    )
    return counts if n is None else counts.limit(n)


def top_n(df: DataFrame, by: str, n: int, ties: Sequence[str], ascending: bool = False) -> DataFrame:
    first = F.asc(by) if ascending else F.desc(by)
    return df.orderBy(first, *ties).limit(n)


def product_dim(tx: DataFrame, time: str = "InvoiceDate") -> DataFrame:
    """The description of each code's earliest line, ties by text.

    Lines are reduced to one row per (code, description) first, with fixed-width state.
    """
    return (
        tx.groupBy("StockCode", "Description")
        .agg(F.min(time).alias("_t"))
        .groupBy("StockCode")
        .agg(F.min_by("Description", F.struct("_t", "Description")).alias("Description"))
    )


def busiest(tx: DataFrame, key: str, n: int = 5) -> DataFrame:
    return value_counts(tx, key, n).withColumnRenamed("n", "Transactions")


def filter_values(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct values, for a filter list."""
    return df.select(col).distinct().orderBy(col)


def date_range(df: DataFrame, col: str = "Date") -> DataFrame:
    """First and last day, for a date filter."""
    return df.agg(F.min(col).alias("first_date"), F.max(col).alias("last_date"))
