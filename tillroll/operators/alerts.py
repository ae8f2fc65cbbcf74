"""Business alerts. Each check is one row; thresholds are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import ratio


def _alert(kind: str, severity: str, message: Column, metric: Column, fired: Column) -> list[Column]:
    return [
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        message.alias("message"),
        metric.alias("metric_pct"),
        F.coalesce(fired, F.lit(False)).alias("fired"),
        F.lit(fixed.ALERT_ACTIONS[kind]).alias("action"),
    ]


def alert_revenue_drop(
    tx: DataFrame,
    order: Sequence[str],
    recent: int = fixed.ALERT_RECENT_ROWS,
    drop_ratio: float = fixed.ALERT_DROP_RATIO,
) -> DataFrame:
    """Mean of the last rows against the mean of all rows before them.

    The last rows are a bounded top-k; the earlier mean is the total less those rows.
    """
    last = tx.select(*order, "Revenue").orderBy(*[F.desc(c) for c in order]).limit(recent)
    tail = last.agg(
        F.struct(F.sum("Revenue").alias("s"), F.count("Revenue").alias("n")).alias("t")
    ).scalar()
    whole = tx.agg(F.sum("Revenue").alias("s"), F.count("Revenue").alias("n"))
    both = whole.withColumn("t", tail)
    recent_avg = ratio(F.col("t.s"), F.col("t.n"))
    earlier = ratio(F.col("s") - F.col("t.s"), F.col("n") - F.col("t.n"))
    both = both.withColumn("recent_avg", recent_avg).withColumn(
        "historical_avg", F.when(F.col("n") > recent, earlier).otherwise(F.col("recent_avg"))
    )
    drop = ratio(F.col("historical_avg") - F.col("recent_avg"), F.col("historical_avg")) * 100
    return both.select(
        *_alert(
            "revenue_drop",
            "high",
            F.format_string("Revenue dropped %.1f%% recently", drop),
            drop,
            (F.col("n") > 1) & (F.col("recent_avg") < F.col("historical_avg") * drop_ratio),
        ),
        "recent_avg",
        "historical_avg",
    )


def alert_concentration(
    customers: DataFrame,
    n: int = fixed.ALERT_TOP_CUSTOMERS,
    pct: float = fixed.ALERT_CONCENTRATION_PCT,
) -> DataFrame:
    """Share of spend held by the n best customer rows."""
    best = customers.orderBy(F.desc("Total_Spent"), "Customer_ID", "Country").limit(n)
    top = best.agg(F.sum("Total_Spent")).scalar()
    share = ratio(F.col("top_spent"), F.col("total_spent")) * 100
    return (
        customers.agg(F.sum("Total_Spent").alias("total_spent"))
        .withColumn("top_spent", top)
        .select(
            *_alert(
                "customer_concentration",
                "medium",
                F.format_string(f"Top {n} customers represent %.1f%% of revenue", share),
                share,
                share > pct,
            )
        )
    )


def alert_dead_stock(products: DataFrame, pct: float = fixed.ALERT_DEAD_STOCK_PCT) -> DataFrame:
    """Share of products whose revenue is exactly zero."""
    counted = products.agg(
        F.count_if(F.col("Total_Revenue") == 0).alias("dead_stock_count"),
        F.count(F.lit(1)).alias("total_products"),
    )
    share = ratio(F.col("dead_stock_count"), F.col("total_products")) * 100
    return counted.select(
        *_alert(
            "inventory_anomaly",
            "medium",
            F.format_string("%.1f%% of products have zero revenue", share),
            share,
            share > pct,
        ),
        "dead_stock_count",
        "total_products",
    )


def alerts(
    tx: DataFrame,
    customers: DataFrame,
    products: DataFrame,
    order: Sequence[str],
    drop_ratio: float = fixed.ALERT_DROP_RATIO,
    concentration_pct: float = fixed.ALERT_CONCENTRATION_PCT,
    dead_stock_pct: float = fixed.ALERT_DEAD_STOCK_PCT,
) -> DataFrame:
    """The alerts that fired."""
    shown = ("type", "severity", "message", "metric_pct", "action")
    checks = (
        alert_revenue_drop(tx, order, drop_ratio=drop_ratio),
        alert_concentration(customers, pct=concentration_pct),
        alert_dead_stock(products, dead_stock_pct),
    )
    fired = [c.filter("fired").select(*shown) for c in checks]
    return fired[0].unionByName(fired[1]).unionByName(fired[2])
