"""Registered queries: alerts, RFM, churn labels and customer summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.operators import alerts as AL
from tillroll.operators import rfm as R
from tillroll.operators.aggregates import customer_analysis, product_performance
from tillroll.operators.ordering import durable
from tillroll.plans.base_sql import CUSTOMERS, PRODUCTS, TX, with_
from tillroll.plans.star_tables import StarTables
from tillroll.sources import star

QUERIES = {}


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = (build, sql)


def features(t: StarTables):
    return R.rfm_features(t.buyers_sales)


def scored(t: StarTables):
    return R.rfm_scores(features(t))


RFM = (
    TX
    + """,
sales AS (SELECT * FROM tx WHERE Customer_ID IS NOT NULL AND Revenue > 0),
rfm0 AS (
  SELECT Customer_ID, max("Date") AS Last_Purchase, min("Date") AS First_Purchase,
         count(DISTINCT Invoice) AS Frequency, sum(Revenue) AS Monetary,
         CAST(sum(Quantity) AS BIGINT) AS Total_Items, count(*) AS Transaction_Count,
         count(DISTINCT StockCode) AS Product_Variety,
         arg_min(Country, (InvoiceDate, Country)) AS Country
  FROM sales GROUP BY 1),
rfm AS (
  SELECT *, CAST(date_diff('day', Last_Purchase, (SELECT max("Date") FROM sales)) AS INTEGER) AS Recency,
         CAST(date_diff('day', First_Purchase, (SELECT max("Date") FROM sales)) AS INTEGER) AS Tenure_Days,
         CAST(Monetary AS DOUBLE) / Frequency AS Avg_Order_Value,
         CAST(Frequency AS DOUBLE) / (date_diff('day', First_Purchase, (SELECT max("Date") FROM sales)) + 1) * 30 AS Purchase_Frequency,
         CAST(Monetary AS DOUBLE) * Frequency AS Customer_Value_Score
  FROM rfm0)"""
)

SCORED = (
    RFM
    + """,
ranked AS (
  SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY Recency, Customer_ID) AS rr,
         row_number() OVER (ORDER BY Frequency, Customer_ID) AS rf,
         row_number() OVER (ORDER BY Monetary, Customer_ID) AS rm FROM rfm),
marks AS (
  SELECT *, CAST(6 - greatest(1, ((rr - 1) * 5 + n - 2) // (n - 1)) AS INTEGER) AS R_Score,
         CAST(greatest(1, ((rf - 1) * 5 + n - 2) // (n - 1)) AS INTEGER) AS F_Score,
         CAST(greatest(1, ((rm - 1) * 5 + n - 2) // (n - 1)) AS INTEGER) AS M_Score FROM ranked),
scored AS (
  SELECT *, R_Score || '' || F_Score || '' || M_Score AS RFM_Score,
         R_Score + F_Score + M_Score AS RFM_Score_Numeric,
         CASE WHEN R_Score + F_Score + M_Score >= 13 THEN 'Champions'
              WHEN R_Score + F_Score + M_Score >= 11 THEN 'Loyal Customers'
              WHEN R_Score + F_Score + M_Score >= 9 THEN 'Potential Loyalists'
              WHEN R_Score + F_Score + M_Score >= 7 THEN 'New Customers'
              WHEN R_Score + F_Score + M_Score >= 5 THEN 'Promising'
              WHEN R_Score + F_Score + M_Score >= 3 THEN 'Need Attention' ELSE 'At Risk' END AS RFM_Segment
  FROM marks)"""
)

add(
    "rfm_lines",
    lambda t: R.rfm_lines(t.tx).withColumn("Customer_ID", F.col("Customer_ID").cast("string")),
    with_(TX, """, g AS (SELECT Customer_ID, max("Date") AS l, min("Date") AS f, count(Invoice) AS Frequency,
        sum(Revenue) AS Monetary, CAST(sum(Total_Amount) AS DOUBLE) / count(Total_Amount) AS Avg_Order_Value,
        count(StockCode) AS Product_Variety,
        date_diff('day', max("Date"), (SELECT max("Date") FROM tx)) AS Recency FROM tx GROUP BY 1)
      SELECT CAST(Customer_ID AS VARCHAR) AS Customer_ID, CAST(Recency AS INTEGER) AS Recency, Frequency,
        CAST(Monetary AS DOUBLE) AS Monetary, Avg_Order_Value, Product_Variety,
        strftime(l, '%Y-%m-%d') AS Last_Purchase_Date, strftime(f, '%Y-%m-%d') AS First_Purchase_Date,
        CAST(Frequency AS DOUBLE) / (Recency + 1) AS Purchase_Frequency,
        CAST(date_diff('day', f, l) + 1 AS INTEGER) AS Tenure_Days FROM g WHERE Monetary > 0"""),
)
_RFM_COLS = """Customer_ID, strftime(Last_Purchase, '%Y-%m-%d') AS Last_Purchase,
  strftime(First_Purchase, '%Y-%m-%d') AS First_Purchase, Frequency, CAST(Monetary AS DOUBLE) AS Monetary,
  Total_Items, Transaction_Count, Product_Variety, Country, Recency, Tenure_Days, Avg_Order_Value,
  Purchase_Frequency, Customer_Value_Score"""
add("rfm_features", features, with_(RFM, f"SELECT {_RFM_COLS} FROM rfm"))
_SCORES = "Customer_ID, R_Score, F_Score, M_Score, RFM_Score, RFM_Score_Numeric, RFM_Segment"
add(
    "rfm_scores",
    lambda t: scored(t).select(*_SCORES.split(", ")),
    with_(SCORED, f"SELECT {_SCORES} FROM scored"),
)
add(
    "rfm_segment_summary",
    lambda t: R.rfm_segment_summary(scored(t)),
    with_(SCORED, """SELECT RFM_Segment, count(*) AS Customer_Count, CAST(sum(Monetary) AS DOUBLE) AS Total_Revenue,
      CAST(sum(Monetary) AS DOUBLE) / count(*) AS Avg_CLV, CAST(sum(Frequency) AS DOUBLE) / count(*) AS Avg_Frequency,
      CAST(sum(Recency) AS DOUBLE) / count(*) AS Avg_Recency FROM scored GROUP BY 1"""),
)
add(
    "customer_base_overview",
    lambda t: R.customer_base_overview(features(t)),
    with_(RFM, """SELECT count(*) AS total_customers, CAST(sum(Monetary) AS DOUBLE) AS total_revenue,
      CAST(sum(Monetary) AS DOUBLE) / count(*) AS avg_clv, CAST(sum(Recency) AS DOUBLE) / count(*) AS avg_recency,
      CAST(sum(Frequency) AS DOUBLE) / count(*) AS avg_frequency FROM rfm"""),
)
add(
    "high_value_customers",
    lambda t: R.high_value_customers(features(t)),
    with_(RFM, """, q AS (SELECT quantile_cont(CAST(Monetary AS DOUBLE), 0.8) AS q FROM rfm),
      h AS (SELECT *, CAST(Monetary AS DOUBLE) >= (SELECT q FROM q) AS high FROM rfm)
      SELECT count(*) FILTER (high) AS "count", CAST(count(*) FILTER (high) AS DOUBLE) / count(*) * 100 AS percentage,
      CAST(sum(Monetary) FILTER (high) AS DOUBLE) / CAST(sum(Monetary) AS DOUBLE) * 100 AS revenue_contribution,
      CAST(sum(Monetary) FILTER (high) AS DOUBLE) / count(*) FILTER (high) AS avg_clv FROM h"""),
)
add(
    "churn_labels",
    lambda t: R.churn_labels(features(t)).select("Customer_ID", "Is_Churned", "Churn_Rule"),
    with_(RFM, """SELECT Customer_ID, CAST(Recency > 30 AS INTEGER) AS Is_Churned, 'recency > 30' AS Churn_Rule
      FROM rfm"""),
)
# A threshold no customer reaches, so that the quantile rule has to decide.
add(
    "churn_labels_fallback",
    lambda t: R.churn_labels(features(t), 100_000, (200_000,)).select(
        "Customer_ID", "Is_Churned", "Churn_Rule"
    ),
    with_(RFM, """, q AS (SELECT quantile_cont(CAST(Frequency AS DOUBLE), 0.2) AS f,
        quantile_cont(CAST(Monetary AS DOUBLE), 0.2) AS m FROM rfm)
      SELECT Customer_ID, CAST(Frequency <= f AND CAST(Monetary AS DOUBLE) <= m AS INTEGER) AS Is_Churned,
      'low frequency and spend' AS Churn_Rule FROM rfm, q"""),
)
add(
    "churn_labels_quantile",
    lambda t: R.churn_labels_quantile(t.customers, t.tx).select(
        "Customer_ID", "Country", "Days_Since_Last", "Is_Churned"
    ),
    with_(CUSTOMERS, """, d AS (SELECT c.Customer_ID, c.Country,
        CAST(date_diff('day', l, (SELECT max("Date") FROM tx)) AS INTEGER) AS Days_Since_Last FROM customers c
        LEFT JOIN (SELECT Customer_ID, max("Date") AS l FROM tx GROUP BY 1) USING (Customer_ID))
      SELECT *, CAST(Days_Since_Last > (SELECT quantile_cont(CAST(Days_Since_Last AS DOUBLE), 0.7) FROM d) AS INTEGER)
      AS Is_Churned FROM d"""),
)


def risked(t: StarTables):
    """Scores with a stand-in probability and value, so that SQL can state the result."""
    s = scored(t)
    longest = s.agg(F.max("Recency")).scalar()
    s = s.withColumn("Churn_Probability", F.col("Recency").cast("double") / longest).withColumn(
        "Predicted_CLV", F.col("Monetary").cast("double")
    )
    return R.with_risk_band(s)


RISKED = (
    SCORED
    + """,
risked0 AS (SELECT *, CAST(Recency AS DOUBLE) / (SELECT max(Recency) FROM scored) AS p FROM scored),
risked AS (SELECT *, CASE WHEN p > 0 AND p <= 0.3 THEN 'Low' WHEN p > 0.3 AND p <= 0.7 THEN 'Medium'
  WHEN p > 0.7 AND p <= 1 THEN 'High' END AS Churn_Risk FROM risked0)"""
)
add(
    "churn_risk_bands",
    lambda t: risked(t).select("Customer_ID", "Churn_Risk"),
    with_(RISKED, "SELECT Customer_ID, Churn_Risk FROM risked"),
)
add(
    "churn_risk_summary",
    lambda t: R.churn_risk_summary(risked(t)).select(
        "Churn_Risk", "Customer_Count", "Total_Revenue",
        F.round("Predicted_CLV", 4).alias("Predicted_CLV"),
    ),
    with_(RISKED, """SELECT l.Churn_Risk, count(Customer_ID) AS Customer_Count,
      coalesce(CAST(sum(Monetary) AS DOUBLE), 0.0) AS Total_Revenue,
      round(CAST(sum(Monetary) AS DOUBLE) / count(Customer_ID), 4) AS Predicted_CLV
      FROM (VALUES ('Low'), ('Medium'), ('High')) l(Churn_Risk)
      LEFT JOIN risked r USING (Churn_Risk) GROUP BY 1"""),
)
add(
    "retention_actions",
    lambda t: R.retention_actions(risked(t)).select(
        "rule", "customers", F.round("revenue", 2).alias("revenue"), "action"
    ),
    with_(RISKED, """, q AS (SELECT quantile_cont(CAST(Frequency AS DOUBLE), 0.3) AS f,
        quantile_cont(CAST(Monetary AS DOUBLE), 0.7) AS m FROM risked),
      r AS (SELECT 'churn_prevention' AS rule, count(*) AS customers, CAST(sum(Monetary) AS DOUBLE) AS revenue
        FROM risked WHERE Churn_Risk = 'High'
        UNION ALL SELECT 'engagement_opportunity', count(*), CAST(sum(Monetary) AS DOUBLE) FROM risked, q
        WHERE Frequency <= f AND CAST(Monetary AS DOUBLE) >= m
        UNION ALL SELECT 'vip_program', count(*), CAST(sum(Monetary) AS DOUBLE) FROM risked
        WHERE RFM_Segment = 'Champions')
      SELECT rule, customers, round(revenue, 2) AS revenue, action FROM r
      JOIN (VALUES """ + ", ".join(f"('{rule}', '{action}')" for rule, action in fixed.RETENTION_RULES) + """) a(rule, action)
      USING (rule) WHERE customers > 0"""),
)
add(
    "fill_median",
    lambda t: R.fill_median(
        t.table("orders").select(
            "o_orderkey",
            F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
            F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("cust"),
        ),
        ["price", "cust"],
    ),
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END,
        (SELECT quantile_cont(o_totalprice, 0.5) FROM orders WHERE o_orderstatus <> 'P')) AS price,
      coalesce(CASE WHEN o_orderstatus <> 'F' THEN CAST(o_custkey AS DOUBLE) END,
        (SELECT quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) FROM orders WHERE o_orderstatus <> 'F')) AS cust
      FROM orders""",
)

# --- alerts ----------------------------------------------------------------
_DROP = """, last AS (SELECT Revenue FROM tx ORDER BY InvoiceDate DESC, Invoice DESC, StockCode DESC,
    Quantity DESC, Price DESC LIMIT 100),
  m AS (SELECT CAST((SELECT sum(Revenue) FROM last) AS DOUBLE) / (SELECT count(*) FROM last) AS recent_avg,
    CAST((SELECT sum(Revenue) FROM tx) - (SELECT sum(Revenue) FROM last) AS DOUBLE) /
      ((SELECT count(*) FROM tx) - (SELECT count(*) FROM last)) AS historical_avg),
  d AS (SELECT *, (historical_avg - recent_avg) / historical_avg * 100 AS pct FROM m)"""
_TOP = """, s AS (SELECT CAST((SELECT sum(Total_Spent) FROM (SELECT Total_Spent FROM customers
    ORDER BY Total_Spent DESC LIMIT 5)) AS DOUBLE) / CAST(sum(Total_Spent) AS DOUBLE) * 100 AS pct FROM customers)"""
_DEAD = """, z AS (SELECT count(*) FILTER (Total_Revenue = 0) AS dead_stock_count, count(*) AS total_products,
    CAST(count(*) FILTER (Total_Revenue = 0) AS DOUBLE) / count(*) * 100 AS pct FROM products)"""
_DROP_COLS = """'revenue_drop' AS type, 'high' AS severity, printf('Revenue dropped %.1f%% recently', pct) AS message,
  pct AS metric_pct"""
_TOP_COLS = """'customer_concentration' AS type, 'medium' AS severity,
  printf('Top 5 customers represent %.1f%% of revenue', pct) AS message, pct AS metric_pct"""
_DEAD_COLS = """'inventory_anomaly' AS type, 'medium' AS severity,
  printf('%.1f%% of products have zero revenue', pct) AS message, pct AS metric_pct"""
_ACT = (
    "'Review pricing strategy and customer retention' AS action",
    "'Diversify customer base to reduce risk' AS action",
    "'Review product portfolio and discontinue dead stock' AS action",
)
add(
    "alert_revenue_drop",
    lambda t: AL.alert_revenue_drop(t.stored_tx, star.LINE_ORDER),
    with_(TX, _DROP + f""" SELECT {_DROP_COLS}, recent_avg < historical_avg * 0.8 AS fired, {_ACT[0]},
      recent_avg, historical_avg FROM d"""),
)
add(
    "alert_concentration",
    lambda t: AL.alert_concentration(t.stored_customers),
    with_(CUSTOMERS, _TOP + f" SELECT {_TOP_COLS}, pct > 50 AS fired, {_ACT[1]} FROM s"),
)
add(
    "alert_dead_stock",
    lambda t: AL.alert_dead_stock(t.products),
    with_(PRODUCTS, _DEAD + f""" SELECT {_DEAD_COLS}, pct > 30 AS fired, {_ACT[2]}, dead_stock_count, total_products
      FROM z"""),
)
# Thresholds low enough that the check sees fired alerts.
add(
    "alerts",
    lambda t: AL.alerts(
        t.stored_tx, durable(customer_analysis(t.stored_tx, ordered=False)), product_performance(t.stored_tx, ordered=False), star.LINE_ORDER,
        drop_ratio=5.0, concentration_pct=0.01, dead_stock_pct=30,
    ),
    with_(CUSTOMERS + PRODUCTS[len(TX):], _DROP + _TOP + _DEAD + f"""
      SELECT {_DROP_COLS}, {_ACT[0]} FROM d WHERE recent_avg < historical_avg * 5.0
      UNION ALL SELECT {_TOP_COLS}, {_ACT[1]} FROM s WHERE pct > 0.01
      UNION ALL SELECT {_DEAD_COLS}, {_ACT[2]} FROM z WHERE pct > 30"""),
)
