"""Mergeable state of the aggregate tables: by day, merged by month, and the tables made from it.

The lines of a day are reduced to four small tables. Sums, counts, first and last times of two of them
add up to those of both; who and what was seen is kept as rows, so that a distinct count is
a count of merged rows and nothing is expanded for it. Money stays decimal, so any
order of merging gives the same tables as one pass over all lines.

Sales and customers are few and hold one row per key. Products and pairs may be nearly as many as the lines, so they are
compacted: rows that meet in a task become one and no row moves. A key may then have a row of each task that met
it. Only the tables over all time gather those, in one shuffle.

| state | one row per | holds |
| --- | --- | --- |
| sales | day, country | sums of revenue, quantity, price and amount, lines |
| products | day, code, description, category | sums of revenue, quantity and price, lines |
| customers | day, customer, country | sums of revenue, quantity and amount, lines, first and last time |
| pairs | day, code, description, category, customer | nothing else |
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.columns import ratio
from tillroll.operators.aggregates import TOTAL
from tillroll.operators.etl import registered

_SUM = "decimal(38,2)"
PRODUCT = ("StockCode", "Description", "Product_Category")

#: State: its keys besides the period, and how each of its measures merges.
STATES: dict[str, tuple[tuple[str, ...], dict[str, str]]] = {
    "sales": (("Country",), {"revenue": "sum", "quantity": "sum", "price": "sum", "amount": "sum", "lines": "sum", "first_day": "min", "last_day": "max"}),
    "products": (PRODUCT, {"revenue": "sum", "quantity": "sum", "price": "sum", "lines": "sum"}),
    "customers": (
        ("Customer_ID", "Country"),
        {"revenue": "sum", "quantity": "sum", "amount": "sum", "lines": "sum", "first_time": "min", "last_time": "max"},
    ),
    "pairs": ((*PRODUCT, "Customer_ID"), {}),
}

#: States whose rows are merged inside tasks by day and month, and across tasks only over all time.
COMPACTED = ("products", "pairs")

_TYPES = {
    "revenue": _SUM, "price": _SUM, "amount": _SUM, "quantity": "bigint", "lines": "bigint", "Customer_ID": "bigint",
    "first_day": "date", "last_day": "date", "first_time": "timestamp_ntz", "last_time": "timestamp_ntz",
}


def state_schema(name: str, *period: str) -> T.StructType:
    """The columns of a stored state after those of its period, such as `Date date`."""
    keys, merges = STATES[name]
    return T.StructType.fromDDL(", ".join([*period, *(f"{c} {_TYPES.get(c, 'string')}" for c in (*keys, *merges))]))


def day_states(tx: DataFrame) -> dict[str, DataFrame]:
    """The four states of featured lines, with the day in `Date`."""
    measures = {
        "revenue": F.sum("Revenue").cast(_SUM),
        "quantity": F.sum("Absolute_Quantity"),
        "price": F.sum("Price").cast(_SUM),
        "amount": F.sum("Total_Amount").cast(_SUM),
        "lines": F.count("Invoice"),
        "first_day": F.min("Date"),
        "last_day": F.max("Date"),
        "first_time": F.min("InvoiceDate"),
        "last_time": F.max("InvoiceDate"),
    }
    single = {
        "revenue": F.col("Revenue"),
        "quantity": F.col("Absolute_Quantity"),
        "price": F.col("Price"),
        "lines": F.col("Invoice").isNotNull().cast("long"),
    }
    out = {}
    for name, (keys, merges) in STATES.items():
        source = registered(tx) if "Customer_ID" in keys else tx
        if name in COMPACTED:
            rows = source.select("Date", *keys, *[single[m].cast(_TYPES[m]).alias(m) for m in merges])
            out[name] = compacted(rows, name, ("Date",))
        else:
            out[name] = source.groupBy("Date", *keys).agg(*[measures[m].alias(m) for m in merges])
    return out


def compacted(state: DataFrame, name: str, period: tuple[str, ...]) -> DataFrame:
    """Rows of a state that agree in period and keys, as one wherever they meet in a task; no row moves."""
    keys, merges = STATES[name]
    by = [*period, *keys]
    slim = state.select(*by, *merges)

    def run(batches):
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            rows = whole.group_by(by, use_threads=False).aggregate([(m, how) for m, how in merges.items()])
            named = rows.select([*by, *(f"{m}_{how}" for m, how in merges.items())]).rename_columns([*by, *merges])
            yield from named.cast(whole.schema).to_batches()

    return slim.sortWithinPartitions(*by).mapInArrow(run, slim.schema)


def merged(state: DataFrame, name: str, period: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a state that agree in the period columns and the state's keys, as one."""
    keys, merges = STATES[name]
    if not merges:
        return state.select(*period, *keys).distinct()
    types = {f.name: f.dataType for f in state.schema.fields}
    rows = [getattr(F, how)(m).cast(types[m]).alias(m) for m, how in merges.items()]
    return state.groupBy(*period, *keys).agg(*rows)


def daily_sales(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """The daily table, from the day states of whole days."""
    seen = customers.select("Date", *STATES["customers"][0]).distinct().groupBy("Date", "Country").agg(F.count(F.lit(1)).alias("n"))
    return (
        merged(sales, "sales", ("Date",))
        .join(seen, ["Date", "Country"], "left")
        .select(
            "Date", "Country", F.col("revenue").cast(TOTAL).alias("Total_Revenue"), F.col("quantity").alias("Total_Quantity"),
            F.col("lines").alias("Total_Transactions"), F.coalesce("n", F.lit(0)).cast("long").alias("Unique_Customers"),
            ratio(F.col("price"), F.col("lines")).alias("Avg_Unit_Price"),
        )
    )


def monthly_trends(sales: DataFrame, customers: DataFrame, month: str) -> DataFrame:
    """The monthly table, from month states; `month` (a column of both, as 2001-12) stays."""
    seen = customers.select(month, "Customer_ID").distinct().groupBy(month).agg(F.count(F.lit(1)).alias("n"))
    total = sales.groupBy(month).agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.sum("lines").alias("lines"))
    return total.join(seen, month, "left").select(
        month, F.substring(month, 1, 4).cast("int").alias("Year"), F.substring(month, 6, 2).cast("int").alias("Month"),
        F.col("revenue").cast(TOTAL).alias("Total_Revenue"), F.col("quantity").alias("Total_Quantity"),
        F.col("lines").alias("Total_Transactions"), F.coalesce("n", F.lit(0)).cast("long").alias("Unique_Customers"),
    )


def product_performance(products: DataFrame, pairs: DataFrame) -> DataFrame:
    buyers = merged(pairs, "pairs").groupBy(*PRODUCT).agg(F.count(F.lit(1)).alias("n"))
    return (
        merged(products, "products")
        .join(buyers, list(PRODUCT), "left")
        .select(
            *PRODUCT, F.col("revenue").cast(TOTAL).alias("Total_Revenue"), F.col("quantity").alias("Total_Quantity_Sold"),
            F.col("lines").alias("Total_Orders"), ratio(F.col("price"), F.col("lines")).alias("Avg_Price"),
            F.coalesce("n", F.lit(0)).cast("long").alias("Unique_Customers"),
        )
    )


def customer_analysis(customers: DataFrame) -> DataFrame:
    return merged(customers, "customers").select(
        "Customer_ID", "Country", F.col("revenue").cast(TOTAL).alias("Total_Spent"), F.col("lines").alias("Total_Orders"),
        F.col("quantity").alias("Total_Items"), ratio(F.col("amount"), F.col("lines")).alias("Avg_Order_Value"),
        F.col("last_time").alias("Last_Purchase_Date"), F.col("first_time").alias("First_Purchase_Date"),
    )


def country_performance(sales: DataFrame, customers: DataFrame) -> DataFrame:
    seen = customers.select("Customer_ID", "Country").distinct().groupBy("Country").agg(F.count(F.lit(1)).alias("n"))
    return (
        merged(sales, "sales")
        .join(seen, "Country", "left")
        .select(
            "Country", F.col("revenue").cast(TOTAL).alias("Total_Revenue"), F.col("lines").alias("Total_Transactions"),
            F.coalesce("n", F.lit(0)).cast("long").alias("Unique_Customers"), ratio(F.col("amount"), F.col("lines")).alias("Avg_Transaction_Value"),
        )
    )


def _rows(df: DataFrame, column: str):
    return df.select(column).distinct().agg(F.count(column)).scalar()


def processing_summary(sales: DataFrame, products: DataFrame, customers: DataFrame) -> DataFrame:
    """The run summary; its three distinct counts are counts of rows of three small tables, which may be states or the tables made of them."""
    return sales.agg(
        F.sum("lines").alias("total_records"),
        F.concat(F.min("first_day").cast("string"), F.lit(" to "), F.max("last_day").cast("string")).alias("date_range"),
        F.sum("revenue").cast(TOTAL).alias("total_revenue"),
    ).select(
        F.coalesce("total_records", F.lit(0)).cast("long").alias("total_records"), "date_range", "total_revenue",
        _rows(products, "StockCode").alias("unique_products"), _rows(customers, "Customer_ID").alias("unique_customers"),
        _rows(sales, "Country").alias("countries"),
    )


def whole_tables(months: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables over all time besides the summary, from the states of all months."""
    sales, products, customers, pairs = (months[n] for n in STATES)
    return {
        "product_performance": product_performance(products, pairs),
        "customer_analysis": customer_analysis(customers),
        "country_performance": country_performance(sales, customers),
    }
