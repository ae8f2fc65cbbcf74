"""The tables that registered queries start from, derived lazily from the star."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import aggregates
from tillroll.operators.etl import registered, sales_only
from tillroll.operators.ordering import durable
from tillroll.sources import star


class StarTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return star.table(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return star.raw_lines(self.spark, self.sf_dir)

    @cached_property
    def tx(self) -> DataFrame:
        return star.transactions(self.spark, self.sf_dir)

    @cached_property
    def buyers_sales(self) -> DataFrame:
        return sales_only(registered(self.tx))

    @cached_property
    def daily(self) -> DataFrame:
        return aggregates.daily_sales(self.tx)

    @cached_property
    def products(self) -> DataFrame:
        return aggregates.product_performance(self.tx, ordered=False)

    @cached_property
    def customers(self) -> DataFrame:
        return aggregates.customer_analysis(self.tx, ordered=False)

    @cached_property
    def countries(self) -> DataFrame:
        return aggregates.country_performance(self.tx, ordered=False)

    @cached_property
    def monthly(self) -> DataFrame:
        return aggregates.monthly_trends(self.tx)

    # For queries that read a table more than once: built once, then stored.
    @cached_property
    def stored_tx(self) -> DataFrame:
        """The columns of the fact that reports and series read; the star is joined for them once."""
        return durable(
            self.tx.select(
                "Invoice", "StockCode", "Description", "Product_Category", "Customer_ID", "Country", "InvoiceDate", "Date",
                "Year", "Month", "Quantity", "Absolute_Quantity", "Price", "Total_Amount", "Revenue",
            )
        )

    @cached_property
    def stored_daily(self) -> DataFrame:
        """The daily table of the stored fact."""
        return durable(aggregates.daily_sales(self.stored_tx))

    @cached_property
    def stored_products(self) -> DataFrame:
        return durable(self.products)

    @cached_property
    def stored_customers(self) -> DataFrame:
        return durable(self.customers)

    @cached_property
    def stored_countries(self) -> DataFrame:
        return durable(self.countries)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def experiment(self) -> DataFrame:
        """Events as an experiment: two groups by user, the value as metric."""
        return self.events.select(
            F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("group"),
            "user_id", "event_id", "ts", F.col("value").alias("metric"),
            (F.col("event_type") == "purchase").alias("converted"),
        )
