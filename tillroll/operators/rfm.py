"""Recency, frequency and monetary features, quintile scores and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import cut, mean_of, ratio
from tillroll.operators.aggregates import TOTAL
from tillroll.operators.ordering import durable, rank_in_groups
from tillroll.operators.selection import column_quantiles, quantile


def _as_of(last_days: DataFrame, last: str, as_of) -> Column:
    """The day recency is measured from: given, or the latest last purchase."""
    if as_of is not None:
        return F.lit(as_of).cast("date")
    return last_days.agg(F.max(last)).scalar()


def rfm_lines(tx: DataFrame, as_of=None) -> DataFrame:
    """Line-count RFM: frequency and variety count lines, returns lower the spend.

    Guests stay in as one pseudo-customer with a null key. The fact is read once: the
    customer rows are stored, and the analysis day comes from them.
    """
    grouped = durable(
        tx.groupBy("Customer_ID").agg(
            F.count("Invoice").alias("Frequency"),
            F.sum("Revenue").cast(TOTAL).alias("Monetary"),
            mean_of(F.col("Total_Amount")).alias("Avg_Order_Value"),
            F.count("StockCode").alias("Product_Variety"),
            F.max("Date").alias("Last_Purchase_Date"),
            F.min("Date").alias("First_Purchase_Date"),
        )
    )
    day = _as_of(grouped, "Last_Purchase_Date", as_of)
    return (
        grouped.filter(F.col("Monetary") > 0)
        .withColumn("Recency", F.datediff(day, F.col("Last_Purchase_Date")))
        .withColumns(
            {
                "Purchase_Frequency": ratio(F.col("Frequency"), F.col("Recency") + 1),
                "Tenure_Days": F.datediff("Last_Purchase_Date", "First_Purchase_Date") + 1,
            }
        )
    )


def rfm_features(sales: DataFrame, as_of=None, time: str = "InvoiceDate") -> DataFrame:
    """Distinct-count RFM over registered sales.

    The country is that of the earliest line, ties by name. It is found per (customer,
    country) first, so that every aggregate over the fact has fixed-width state and none
    needs a sort. The customer rows are stored, because scores and models read
    them several times.
    """
    grouped = sales.groupBy("Customer_ID").agg(
        F.max("Date").alias("Last_Purchase"),
        F.min("Date").alias("First_Purchase"),
        F.countDistinct("Invoice").alias("Frequency"),
        F.sum("Revenue").cast(TOTAL).alias("Monetary"),
        F.sum("Quantity").alias("Total_Items"),
        F.count(F.lit(1)).alias("Transaction_Count"),
        F.countDistinct("StockCode").alias("Product_Variety"),
    )
    country = (
        sales.groupBy("Customer_ID", "Country")
        .agg(F.min(time).alias("_t"))
        .groupBy("Customer_ID")
        .agg(F.min_by("Country", F.struct("_t", "Country")).alias("Country"))
    )
    base = durable(grouped.join(country, "Customer_ID"))
    day = _as_of(base, "Last_Purchase", as_of)
    return base.withColumns(
        {
            "Recency": F.datediff(day, F.col("Last_Purchase")),
            "Tenure_Days": F.datediff(day, F.col("First_Purchase")),
        }
    ).withColumns(
        {
            "Avg_Order_Value": ratio(F.col("Monetary"), F.col("Frequency")),
            "Purchase_Frequency": ratio(F.col("Frequency"), F.col("Tenure_Days") + 1) * 30,
            "Customer_Value_Score": F.col("Monetary").cast("double") * F.col("Frequency"),
        }
    )


_BINS = 5
_METRICS = ("Recency", "Frequency", "Monetary")


def _bin_ends(rfm: DataFrame) -> Column:
    """The (value, customer) at the end of each rank quintile, per metric.

    With r = 1..n the quintile of rank r is the smallest k with 5(r-1) <= (n-1)k, so
    bin k ends at rank 1 + (n-1)k div 5. Only those twelve rows leave the ranking.
    """
    long = rfm.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.col(m).cast(TOTAL).alias("value"),
                        F.col("Customer_ID").alias("id"),
                    )
                    for m in _METRICS
                ]
            )
        )
    )
    ranked = rank_in_groups(long, ["metric"], ["value", "id"], "r")
    n = rfm.agg(F.count(F.lit(1))).scalar()
    wanted = ranked.withColumn(
        "k", F.explode(F.array(*[F.lit(k) for k in range(1, _BINS)]))
    ).filter(F.col("r") == 1 + F.floor((n - 1) * F.col("k") / _BINS))
    return wanted.agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(
                    F.concat("metric", F.col("k").cast("string")), F.struct("value", "id")
                )
            )
        )
    ).scalar()


def rfm_scores(rfm: DataFrame) -> DataFrame:
    """Scores 1-5 by rank quintile (ties by customer), their text, sum and segment.

    The table is ranked for the bin ends only; scoring itself reads each row once.
    """
    ends = _bin_ends(rfm)

    def score(metric: str) -> Column:
        value, out = F.col(metric).cast(TOTAL), F.lit(_BINS)
        for k in range(_BINS - 1, 0, -1):
            end = F.element_at(F.col("_ends"), F.lit(f"{metric}{k}"))
            inside = (value < end["value"]) | (
                (value == end["value"]) & (F.col("Customer_ID") <= end["id"])
            )
            out = F.when(inside, F.lit(k)).otherwise(out)
        return out

    scored = rfm.withColumn("_ends", ends).withColumns(
        {
            "R_Score": F.lit(_BINS + 1) - score("Recency"),
            "F_Score": score("Frequency"),
            "M_Score": score("Monetary"),
        }
    )
    total = F.col("R_Score") + F.col("F_Score") + F.col("M_Score")
    segment = F.lit(fixed.RFM_REST)
    for lowest, name in reversed(fixed.RFM_SEGMENTS):
        segment = F.when(total >= lowest, F.lit(name)).otherwise(segment)
    return scored.drop("_ends").withColumns(
        {
            "RFM_Score": F.concat(*[F.col(f"{m}_Score").cast("string") for m in "RFM"]),
            "RFM_Score_Numeric": total,
            "RFM_Segment": segment,
        }
    )


def customer_base_overview(rfm: DataFrame) -> DataFrame:
    return rfm.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("Monetary").cast(TOTAL).alias("total_revenue"),
        mean_of(F.col("Monetary")).alias("avg_clv"),
        mean_of(F.col("Recency")).alias("avg_recency"),
        mean_of(F.col("Frequency")).alias("avg_frequency"),
    )


def _churn_mean(df: DataFrame, name: str) -> list[Column]:
    return [F.avg("Churn_Probability").alias(name)] if "Churn_Probability" in df.columns else []


def rfm_segment_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("RFM_Segment").agg(
        F.count(F.lit(1)).alias("Customer_Count"),
        F.sum("Monetary").cast(TOTAL).alias("Total_Revenue"),
        mean_of(F.col("Monetary")).alias("Avg_CLV"),
        mean_of(F.col("Frequency")).alias("Avg_Frequency"),
        mean_of(F.col("Recency")).alias("Avg_Recency"),
        *_churn_mean(scored, "Avg_Churn_Risk"),
    )


def ml_cluster_summary(clustered: DataFrame) -> DataFrame:
    predicted = (
        [F.avg("Predicted_CLV").alias("Predicted_CLV")]
        if "Predicted_CLV" in clustered.columns
        else []
    )
    return clustered.groupBy("ML_Cluster").agg(
        F.count(F.lit(1)).alias("Customer_Count"),
        F.sum("Monetary").cast(TOTAL).alias("Total_Revenue"),
        mean_of(F.col("Monetary")).alias("Avg_CLV"),
        *predicted,
        *_churn_mean(clustered, "Avg_Churn_Risk"),
    )


def high_value_customers(rfm: DataFrame, q: float = 0.8) -> DataFrame:
    """Customers at or above the spend quantile: how many, and their revenue share."""
    limit = quantile(rfm, "Monetary", q)
    flagged = rfm.withColumn("_high", F.col("Monetary").cast("double") >= limit)
    of_high = F.when(F.col("_high"), F.col("Monetary"))
    risk = (
        [F.avg(F.when(F.col("_high"), F.col("Churn_Probability"))).alias("avg_churn_risk")]
        if "Churn_Probability" in rfm.columns
        else []
    )
    return flagged.agg(
        F.count(of_high).alias("count"),
        (ratio(F.count(of_high), F.count(F.lit(1))) * 100).alias("percentage"),
        (ratio(F.sum(of_high), F.sum("Monetary")) * 100).alias("revenue_contribution"),
        mean_of(of_high).alias("avg_clv"),
        *risk,
    )


def churn_labels(
    rfm: DataFrame,
    days: int = fixed.CHURN_DAYS,
    alternatives: Sequence[int] = fixed.CHURN_ALTERNATIVES,
    fallback: float = fixed.CHURN_FALLBACK_QUANTILE,
) -> DataFrame:
    """Adds `Is_Churned` and the rule used.

    The first threshold that leaves both classes wins; without one, the customers low
    in both frequency and spend count as churned. All thresholds are tried in one pass,
    of which one row comes back.
    """
    tried = [days, *alternatives]
    row = rfm.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("Recency") > d).alias(f"c{d}") for d in tried]
    ).first()
    for d in tried:
        if 0 < row[f"c{d}"] < row["n"]:
            label, rule = F.col("Recency") > d, f"recency > {d}"
            break
    else:
        label = (F.col("Frequency").cast("double") <= quantile(rfm, "Frequency", fallback)) & (
            F.col("Monetary").cast("double") <= quantile(rfm, "Monetary", fallback)
        )
        rule = "low frequency and spend"
    return rfm.withColumns({"Is_Churned": label.cast("int"), "Churn_Rule": F.lit(rule)})


def churn_labels_quantile(customers: DataFrame, tx: DataFrame, q: float = 0.7) -> DataFrame:
    """Customers joined with days since their last purchase; churned above the quantile."""
    last = durable(tx.groupBy("Customer_ID").agg(F.max("Date").alias("_last")))
    joined = durable(
        customers.join(last, "Customer_ID", "left")
        .withColumn("Days_Since_Last", F.datediff(_as_of(last, "_last", None), F.col("_last")))
        .drop("_last")
    )
    limit = quantile(joined, "Days_Since_Last", q)
    return joined.withColumn(
        "Is_Churned",
        F.coalesce(F.col("Days_Since_Last").cast("double") > limit, F.lit(False)).cast("int"),
    )


def with_risk_band(df: DataFrame, probability: str = "Churn_Probability") -> DataFrame:
    return df.withColumn("Churn_Risk", cut(F.col(probability), fixed.RISK_EDGES, fixed.RISK_LABELS))


def with_levels(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """One row per level, also for levels the table lacks."""
    labels = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, levels))).alias(col))
    return labels.join(df, col, "left")


def churn_risk_summary(df: DataFrame) -> DataFrame:
    """Customers, spend and mean predicted value per risk band; empty bands stay."""
    grouped = df.groupBy("Churn_Risk").agg(
        F.count(F.lit(1)).alias("Customer_Count"),
        F.sum("Monetary").cast(TOTAL).alias("Total_Revenue"),
        F.avg("Predicted_CLV").alias("Predicted_CLV"),
    )
    return with_levels(grouped, "Churn_Risk", fixed.RISK_LABELS).fillna(
        0, subset=["Customer_Count", "Total_Revenue"]
    )


def retention_actions(df: DataFrame) -> DataFrame:
    """One row per rule that holds for at least one customer: customers and value."""
    q = (
        column_quantiles(df, ("Frequency", "Monetary"), (0.3, 0.7)).withColumnRenamed("column", "m")
        .agg(
            F.struct(
                F.max(F.when((F.col("m") == "Frequency") & (F.col("prob") == 0.3), F.col("value"))).alias("f"),
                F.max(F.when((F.col("m") == "Monetary") & (F.col("prob") == 0.7), F.col("value"))).alias("m"),
            )
        )
        .scalar()
    )
    at_risk = F.col("Churn_Risk") == "High"
    rare_rich = (F.col("Frequency").cast("double") <= q["f"]) & (
        F.col("Monetary").cast("double") >= q["m"]
    )
    champion = F.col("RFM_Segment") == "Champions"
    rules = zip(
        fixed.RETENTION_RULES,
        (at_risk, rare_rich, champion),
        ("Predicted_CLV", "Predicted_CLV", "Monetary"),
    )
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(F.coalesce(test, F.lit(False))).alias("customers"),
            F.sum(F.when(test, F.col(value).cast("double"))).alias("revenue"),
            F.lit(action).alias("action"),
        )
        for (name, action), test, value in rules
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r")).filter(F.col("customers") > 0)


def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls become the column's exact median."""
    medians = (
        column_quantiles(df, cols, (0.5,))
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))))
        .scalar()
    )
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.element_at(medians, F.lit(c))) for c in cols}
    )
