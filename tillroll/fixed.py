"""Names, edges and rules that results have to agree with."""

# --- cleaning and features -------------------------------------------------
UNKNOWN = "UNKNOWN"
# Characters removed from both ends of a text field (Unicode white space).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# (word, category); a later match wins over an earlier one.
CATEGORY_RULES = (
    ("CHRISTMAS", "SEASONAL"),
    ("GIFT", "GIFTS"),
    ("BAG", "BAGS"),
    ("SET", "SETS"),
    ("LIGHT", "LIGHTING"),
)
CATEGORY_DEFAULT = "OTHER"
# Right-closed bands; None is an open end.
PRICE_EDGES = (0, 5, 20, 50, None)
PRICE_LABELS = ("LOW", "MEDIUM", "HIGH", "PREMIUM")
GUEST, REGISTERED = "GUEST", "REGISTERED"

# --- customers -------------------------------------------------------------
TIER_EDGES = (0, 100, 500, 1000, None)
TIER_LABELS = ("Bronze", "Silver", "Gold", "Platinum")
HIGH_VALUE_SPEND = 1000
QUARTILE_LABELS = ("Low", "Medium", "High", "Premium")
# (lowest score sum, segment), best first.
RFM_SEGMENTS = (
    (13, "Champions"),
    (11, "Loyal Customers"),
    (9, "Potential Loyalists"),
    (7, "New Customers"),
    (5, "Promising"),
    (3, "Need Attention"),
)
RFM_REST = "At Risk"
CHURN_DAYS = 30
CHURN_ALTERNATIVES = (15, 45, 60, 120)
CHURN_FALLBACK_QUANTILE = 0.2
RISK_EDGES = (0, 0.3, 0.7, 1.0)
RISK_LABELS = ("Low", "Medium", "High")
RETENTION_RULES = (
    (
        "churn_prevention",
        "Implement targeted retention campaigns for high-value, high-churn-risk customers",
    ),
    (
        "engagement_opportunity",
        "Increase purchase frequency through personalized recommendations and loyalty programs",
    ),
    (
        "vip_program",
        "Create VIP program with exclusive benefits and early access to new products",
    ),
)

# --- alerts ----------------------------------------------------------------
ALERT_RECENT_ROWS = 100
ALERT_DROP_RATIO = 0.8
ALERT_TOP_CUSTOMERS = 5
ALERT_CONCENTRATION_PCT = 50
ALERT_DEAD_STOCK_PCT = 30
ALERT_ACTIONS = {
    "revenue_drop": "Review pricing strategy and customer retention",
    "customer_concentration": "Diversify customer base to reduce risk",
    "inventory_anomaly": "Review product portfolio and discontinue dead stock",
}

# --- series ----------------------------------------------------------------
SALES_LAGS = (1, 7, 30)
SERIES_LAGS = (1, 3, 7, 14, 30)
ROLLING_WINDOWS = (3, 7, 14, 30)
EWM_ALPHAS = (0.1, 0.3, 0.5)
CHANGE_PERIODS = (1, 7)
SEASON = 7
# 5% critical value of the Dickey-Fuller t statistic with a constant.
DICKEY_FULLER_5PCT = -2.86
# MacKinnon's response surface for a constant and one series. Beyond the ends p is 0 or 1; up to the
# star the first polynomial holds, above it the second; the normal distribution of its value is p.
DICKEY_FULLER_ENDS = (-18.83, 2.74)
DICKEY_FULLER_STAR = -1.61
DICKEY_FULLER_LOW = (2.1659, 1.4412, 0.038269)
DICKEY_FULLER_HIGH = (1.7339, 0.93202, -0.12745, -0.010368)

# --- experiments -----------------------------------------------------------
ALPHA = 0.05
SEQUENTIAL_START, SEQUENTIAL_STEP, SEQUENTIAL_MIN_ROWS = 50, 10, 100
SEGMENT_MIN_ROWS = 10
BAYES_LAUNCH, BAYES_MEDIUM = 0.95, 0.8

# --- machine learning ------------------------------------------------------
SEED = 42
SEGMENT_FEATURES = (
    "Recency", "Frequency", "Monetary", "Avg_Order_Value",
    "Product_Variety", "Purchase_Frequency", "Tenure_Days",
)
CLUSTER_FEATURES = (
    "Recency", "Frequency", "Monetary", "Avg_Order_Value",
    "Purchase_Frequency", "Product_Variety", "Tenure_Days",
)
CLV_FEATURES = (
    "Recency", "Frequency", "Avg_Order_Value", "Purchase_Frequency",
    "Product_Variety", "Tenure_Days", "Transaction_Count",
)
CHURN_FEATURES = (
    "Frequency", "Monetary", "Avg_Order_Value", "Purchase_Frequency",
    "Product_Variety", "Tenure_Days", "Transaction_Count",
)
MLP_FEATURES = ("Total_Spent", "Total_Orders", "Avg_Order_Value")

# --- retrieval -------------------------------------------------------------
CHUNK_ROWS = 50
CHUNK_INDENT = "\n" + " " * 16

# --- warehouse -------------------------------------------------------------
NAMESPACES = ("raw", "processed", "analytics", "staging")
DATASETS = (
    "retail_transactions_processed", "daily_sales", "product_performance",
    "customer_analysis", "country_performance", "monthly_trends",
)
