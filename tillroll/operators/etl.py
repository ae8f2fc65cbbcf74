"""From raw invoice lines to the featured fact table, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import fixed
from tillroll.functions.columns import categorize, clean_text, cut, ratio

MONEY = "decimal(18,2)"


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim column names and use `Customer_ID` for the customer key."""
    names = [c.strip() for c in df.columns]
    return df.toDF(*["Customer_ID" if n == "Customer ID" else n for n in names])


def _invoice_time(df: DataFrame) -> Column:
    if isinstance(df.schema["InvoiceDate"].dataType, T.StringType):
        return F.col("InvoiceDate").try_cast("timestamp_ntz")
    return F.col("InvoiceDate").cast("timestamp_ntz")


def _prepared(df: DataFrame) -> DataFrame:
    df = normalize_columns(df)
    quantity = F.col("Quantity")
    return df.withColumns(
        {
            "InvoiceDate": _invoice_time(df),
            "Description": clean_text(F.col("Description")),
            "Country": clean_text(F.col("Country")),
            "StockCode": clean_text(F.col("StockCode")),
            "Is_Return": quantity < 0,
            "Absolute_Quantity": F.abs(quantity),
            "Total_Amount": (F.abs(quantity) * F.col("Price")).cast(MONEY),
        }
    )


def _valid() -> Column:
    needed = ("Invoice", "StockCode", "Quantity", "Price", "InvoiceDate")
    present = F.lit(True)
    for name in needed:
        present = present & F.col(name).isNotNull()
    return present & (F.col("Price") >= 0) & (F.col("Absolute_Quantity") > 0)


def clean(df: DataFrame) -> DataFrame:
    """Typed, trimmed lines with return flag and amount; invalid lines removed."""
    return _prepared(df).filter(_valid())


def retention(df: DataFrame) -> DataFrame:
    """Rows in, rows that survive cleaning, and their share in percent."""
    kept = F.count_if(_valid())
    return _prepared(df).agg(
        F.count(F.lit(1)).alias("rows_in"),
        kept.alias("rows_kept"),
        (ratio(kept, F.count(F.lit(1))) * 100).alias("retained_pct"),
    )


def add_features(
    df: DataFrame,
    rules=fixed.CATEGORY_RULES,
    price_edges=fixed.PRICE_EDGES,
    price_labels=fixed.PRICE_LABELS,
) -> DataFrame:
    """Date parts, signed revenue, category, price band and customer type."""
    when = F.col("InvoiceDate")
    amount = F.col("Total_Amount")
    return df.withColumns(
        {
            "Year": F.year(when),
            "Month": F.month(when),
            "Day": F.dayofmonth(when),
            "DayOfWeek": F.weekday(when),
            "Date": F.to_date(when),
            "Hour": F.hour(when),
            "Revenue": F.when(F.col("Is_Return"), -amount).otherwise(amount).cast(MONEY),
            "Product_Category": categorize(F.col("Description"), rules),
            "Price_Range": cut(F.col("Price"), price_edges, price_labels),
            "Customer_Type": F.when(F.col("Customer_ID").isNull(), fixed.GUEST).otherwise(
                fixed.REGISTERED
            ),
        }
    )


def registered(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("Customer_ID").isNotNull())


def sales_only(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("Revenue") > 0)
