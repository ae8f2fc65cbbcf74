"""Report metrics over the fact and the aggregate tables.

Scalars that a report needs from the whole table are scalar subqueries, so no
table is joined with a one-row table and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import between_dates, cut, eq_ci, mean_of, ratio
from tillroll.operators.aggregates import TOTAL, distinct_count, top_n, value_counts
from tillroll.operators.selection import quantiles


def overview(tx: DataFrame) -> DataFrame:
    top = value_counts(tx, "Country", 1).select("Country").scalar()
    return tx.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("Revenue").cast(TOTAL).alias("total_revenue"),
        F.min("Date").alias("start_date"),
        F.max("Date").alias("end_date"),
        mean_of(F.col("Total_Amount")).alias("avg_order_value"),
    ).select(
        "total_transactions",
        "total_revenue",
        distinct_count(tx, "Customer_ID").alias("unique_customers"),
        distinct_count(tx, "StockCode").alias("unique_products"),
        distinct_count(tx, "Country").alias("countries"),
        "start_date",
        "end_date",
        "avg_order_value",
        top.alias("top_country"),
    )


def kpi(tx: DataFrame, monthly: DataFrame) -> DataFrame:
    """Headline numbers, with the growth of the last month over the one before."""
    total = tx.agg(
        F.sum("Revenue").cast(TOTAL).alias("revenue"),
        F.count(F.lit(1)).alias("transactions"),
        mean_of(F.col("Total_Amount")).alias("avg_order_value"),
        F.countDistinct("Customer_ID").alias("customers"),
    )
    # One row per calendar month, so the unpartitioned window is over a short table.
    w = Window.orderBy("Year", "Month")
    growth = {
        f"{out}_growth_pct": (ratio(F.col(src), F.lag(src).over(w)) - 1) * 100
        for out, src in (
            ("revenue", "Total_Revenue"),
            ("transactions", "Total_Transactions"),
            ("customers", "Unique_Customers"),
        )
    }
    last = (
        monthly.withColumns(growth)
        .agg(F.max_by(F.struct(*growth), F.struct("Year", "Month")).alias("g"))
        .scalar()
    )
    return total.withColumn("g", last).select(
        *total.columns, *[F.col(f"g.{name}").alias(name) for name in growth]
    )


def business_summary_countries(tx: DataFrame, n: int = 5) -> DataFrame:
    return value_counts(tx, "Country", n).withColumnRenamed("n", "transactions")


def revenue_by_category(tx: DataFrame) -> DataFrame:
    return (
        tx.groupBy("Product_Category")
        .agg(F.sum("Revenue").cast(TOTAL).alias("revenue"))
        .orderBy(F.desc("revenue"), "Product_Category")
    )


def with_tier(customers: DataFrame, edges=fixed.TIER_EDGES, labels=fixed.TIER_LABELS) -> DataFrame:
    return customers.withColumn("Segment", cut(F.col("Total_Spent"), edges, labels))


def tier_analysis(
    customers: DataFrame, edges=fixed.TIER_EDGES, labels=fixed.TIER_LABELS
) -> DataFrame:
    """Customers, mean spend and mean orders per spend tier; no tier is left out."""
    return (
        with_tier(customers, edges, labels)
        .filter(F.col("Segment").isNotNull())
        .groupBy("Segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            mean_of(F.col("Total_Spent")).alias("avg_spent"),
            mean_of(F.col("Total_Orders")).alias("avg_orders"),
        )
    )


def tier_totals(customers: DataFrame, high_value: float = fixed.HIGH_VALUE_SPEND) -> DataFrame:
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("Total_Spent") > high_value).alias("high_value_customers"),
        F.count_if(F.col("Total_Orders") > 1).alias("repeat_customers"),
    )


def product_analysis(products: DataFrame) -> DataFrame:
    """Totals plus how many products lie below the first and above the third quartile."""
    q = (
        quantiles(products, "Total_Revenue", (0.25, 0.75))
        .agg(F.map_from_entries(F.collect_list(F.struct("prob", "value"))).alias("q"))
        .scalar()
    )
    revenue = F.col("Total_Revenue").cast("double")
    return products.agg(
        F.count(F.lit(1)).alias("total_products"),
        mean_of(F.col("Total_Revenue")).alias("avg_revenue_per_product"),
        F.count_if(revenue < F.element_at(q, F.lit(0.25))).alias("low_performing_products"),
        F.count_if(revenue > F.element_at(q, F.lit(0.75))).alias("high_performing_products"),
    )


def category_performance(products: DataFrame) -> DataFrame:
    return (
        products.groupBy("Product_Category")
        .agg(F.sum("Total_Revenue").cast(TOTAL).alias("revenue"))
        .orderBy(F.desc("revenue"), "Product_Category")
    )


def market_shares(countries: DataFrame) -> DataFrame:
    total = countries.agg(F.sum("Total_Revenue")).scalar()
    return countries.withColumn("Revenue_Share", ratio(F.col("Total_Revenue"), total) * 100)


def top_markets(countries: DataFrame, n: int = 5) -> DataFrame:
    return top_n(market_shares(countries), "Total_Revenue", n, ["Country"])


def emerging_markets(countries: DataFrame, n: int = 5) -> DataFrame:
    return top_n(countries, "Total_Revenue", n, ["Country"], ascending=True)


def market_analysis(countries: DataFrame, concentration: int = 3) -> DataFrame:
    lead = top_n(countries, "Total_Revenue", concentration, ["Country"])
    top_sum = lead.agg(F.sum("Total_Revenue")).scalar()
    return countries.agg(
        F.count(F.lit(1)).alias("total_markets"),
        F.sum("Total_Revenue").alias("total_revenue"),
    ).select(
        "total_markets",
        "total_revenue",
        (ratio(top_sum, F.col("total_revenue")) * 100).alias("market_concentration_pct"),
    )


def _daily_filtered(daily: DataFrame, country=None, start=None, end=None) -> DataFrame:
    if country is not None:
        daily = daily.filter(eq_ci(F.col("Country"), country))
    return daily.filter(between_dates(F.col("Date"), start, end))


def daily_trend(daily: DataFrame, measure: str, country=None, start=None, end=None) -> DataFrame:
    return (
        _daily_filtered(daily, country, start, end)
        .groupBy("Date")
        .agg(F.sum(measure).alias(measure))
    )


def sales_page_metrics(daily: DataFrame, country=None, start=None, end=None) -> DataFrame:
    per_day = (
        _daily_filtered(daily, country, start, end)
        .groupBy("Date")
        .agg(F.sum("Total_Revenue").alias("rev"), F.sum("Total_Transactions").alias("n"))
    )
    return per_day.agg(
        F.sum("rev").cast(TOTAL).alias("total_revenue"),
        F.sum("n").alias("total_transactions"),
        mean_of(F.col("rev")).alias("avg_daily_revenue"),
    )


def _of_category(products: DataFrame, category=None) -> DataFrame:
    if category is None:
        return products
    return products.filter(eq_ci(F.col("Product_Category"), category))


def product_page_metrics(products: DataFrame, category=None) -> DataFrame:
    return _of_category(products, category).agg(
        F.count(F.lit(1)).alias("total_products"),
        F.sum("Total_Revenue").cast(TOTAL).alias("total_revenue"),
        mean_of(F.col("Total_Revenue")).alias("avg_revenue"),
    )


def customer_page_metrics(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        mean_of(F.col("Total_Spent")).alias("avg_spent"),
        mean_of(F.col("Total_Orders")).alias("avg_orders"),
        mean_of(F.col("Total_Items")).alias("avg_items"),
    )


def spend_histogram(customers: DataFrame, bins: int = 50) -> DataFrame:
    """Customers per equal-width spend bin; the last bin holds its upper end."""
    spent = F.col("Total_Spent").cast("double")
    ends = customers.agg(F.struct(F.min(spent).alias("lo"), F.max(spent).alias("hi")).alias("s"))
    s = ends.scalar()
    width = (s["hi"] - s["lo"]) / bins
    at = F.coalesce(F.floor(F.try_divide(spent - s["lo"], width)), F.lit(0)).cast("int")
    return (
        customers.select(F.least(at, F.lit(bins - 1)).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("customers"))
        .withColumn("bin_start", s["lo"] + F.col("bin") * width)
    )


def geo_page_metrics(countries: DataFrame) -> DataFrame:
    return countries.agg(
        F.count(F.lit(1)).alias("total_countries"),
        F.max_by("Country", F.struct("Total_Revenue", "Country")).alias("top_country"),
        F.sum("Total_Revenue").alias("total_revenue"),
    )


def transaction_context(tx: DataFrame, n: int = 3) -> DataFrame:
    top = (
        value_counts(tx, "Country", n)
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "Country"))),
                    lambda e: e["Country"],
                ),
                ", ",
            ).alias("t")
        )
        .scalar()
    )
    return tx.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("Revenue").alias("min_revenue"),
        F.max("Revenue").alias("max_revenue"),
        F.min("Date").alias("start_date"),
        F.max("Date").alias("end_date"),
    ).withColumn("top_countries", top)


def daily_sales_filtered(daily, country=None, start=None, end=None, limit: int = 100) -> DataFrame:
    """Newest days first."""
    out = _daily_filtered(daily, country, start, end)
    return out.orderBy(F.desc("Date"), "Country").limit(limit)


def products_filtered(products: DataFrame, category=None, limit: int = 20) -> DataFrame:
    return top_n(
        _of_category(products, category), "Total_Revenue", limit, ["StockCode", "Description"]
    )


def customers_filtered(customers: DataFrame, country=None, min_spent=None, limit: int = 50):
    """Best customers first; a minimum of 0 or None means no minimum."""
    if country is not None:
        customers = customers.filter(eq_ci(F.col("Country"), country))
    if min_spent:
        customers = customers.filter(F.col("Total_Spent") >= min_spent)
    return top_n(customers, "Total_Spent", limit, ["Customer_ID", "Country"])


def product_table(products: DataFrame) -> DataFrame:
    """The columns a product listing shows."""
    return products.select(
        "Description", "Product_Category", "Total_Revenue",
        "Total_Quantity_Sold", "Total_Orders", "Avg_Price",
    )


def customer_table(customers: DataFrame, edges=fixed.TIER_EDGES) -> DataFrame:
    """The columns a customer listing shows."""
    return with_tier(customers, edges).select(
        "Customer_ID", "Country", "Total_Spent", "Total_Orders",
        "Total_Items", "Avg_Order_Value", "Segment",
    )
