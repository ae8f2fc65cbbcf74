"""Registered queries: cleaning, features, aggregates, reports, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import fixed
from tillroll.functions import columns as C
from tillroll.operators import aggregates as A
from tillroll.operators import etl
from tillroll.operators import reports as R
from tillroll.operators.ordering import durable
from tillroll.plans.base_sql import (
    CLEAN, COUNTRIES, CUSTOMERS, DAILY, MONTHLY, PRODUCTS, TIER, TX, with_,
)
from tillroll.plans.marts import FACT, business_report
from tillroll.schemas import TRANSACTIONS
from tillroll.sources import star, tables

QUERIES = {}

_TEXT_ID = "cast(Customer_ID as string) as Customer_ID"
_DAY = "strftime(\"Date\", '%Y-%m-%d') AS \"Date\""
_CUSTOMER_COLS = """Customer_ID, Country, CAST(Total_Spent AS DOUBLE) AS Total_Spent, Total_Orders,
  Total_Items, Avg_Order_Value, strftime(Last_Purchase_Date, '%Y-%m-%d %H:%M:%S') AS Last_Purchase_Date,
  strftime(First_Purchase_Date, '%Y-%m-%d %H:%M:%S') AS First_Purchase_Date"""
_PRODUCT_COLS = """StockCode, Description, Product_Category, CAST(Total_Revenue AS DOUBLE) AS Total_Revenue,
  Total_Quantity_Sold, Total_Orders, Avg_Price, Unique_Customers"""
_DAILY_COLS = f"""{_DAY}, Country, CAST(Total_Revenue AS DOUBLE) AS Total_Revenue, Total_Quantity,
  Total_Transactions, Unique_Customers, Avg_Unit_Price"""


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = (build, sql)


# --- cleaning and features -------------------------------------------------
add(
    "clean_transactions",
    lambda t: etl.clean(t.raw).selectExpr(
        "Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", _TEXT_ID,
        "Country", "Is_Return", "Absolute_Quantity", "Total_Amount",
    ),
    with_(CLEAN, """SELECT Invoice, StockCode, Description, Quantity,
      strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate, CAST(Price AS DOUBLE) AS Price,
      CAST(Customer_ID AS VARCHAR) AS Customer_ID, Country, Is_Return, Absolute_Quantity,
      CAST(Total_Amount AS DOUBLE) AS Total_Amount FROM clean"""),
)
add(
    "clean_retention",
    lambda t: etl.retention(t.raw),
    with_(CLEAN, """SELECT (SELECT count(*) FROM raw) AS rows_in, (SELECT count(*) FROM clean) AS rows_kept,
      CAST((SELECT count(*) FROM clean) AS DOUBLE) / (SELECT count(*) FROM raw) * 100 AS retained_pct"""),
)
add(
    "featured_transactions",
    lambda t: t.tx.select(
        "Invoice", "StockCode", "Quantity", "Price", "Year", "Month", "Day", "DayOfWeek", "Date",
        "Hour", "Revenue", "Product_Category", "Price_Range", "Customer_Type",
    ),
    with_(TX, f"""SELECT Invoice, StockCode, Quantity, CAST(Price AS DOUBLE) AS Price, "Year", "Month", "Day", DayOfWeek,
      {_DAY}, "Hour", CAST(Revenue AS DOUBLE) AS Revenue, Product_Category, Price_Range, Customer_Type FROM tx"""),
)
add(
    "product_category",
    lambda t: t.table("part").select(
        "p_partkey",
        C.categorize(C.clean_text(F.col("p_name")), star.CATEGORY_RULES).alias("category"),
    ),
    """SELECT p_partkey, CASE WHEN contains(upper(p_name), 'OLD') THEN 'CLEARANCE'
      WHEN contains(upper(p_name), 'BLUE') THEN 'BLUE RANGE' WHEN contains(upper(p_name), 'PLATE') THEN 'PLATES'
      WHEN contains(upper(p_name), 'GEAR') THEN 'GEARS' WHEN contains(upper(p_name), 'RING') THEN 'RINGS'
      ELSE 'OTHER' END AS category FROM part""",
)
add(
    "price_band",
    lambda t: t.tx.groupBy("Price_Range").agg(
        F.count(F.lit(1)).alias("n"), F.min("Price").alias("lowest"), F.max("Price").alias("highest")
    ),
    with_(TX, """SELECT Price_Range, count(*) AS n, CAST(min(Price) AS DOUBLE) AS lowest,
      CAST(max(Price) AS DOUBLE) AS highest FROM tx GROUP BY 1"""),
)
add(
    "customer_type",
    lambda t: t.tx.groupBy("Customer_Type").agg(F.count(F.lit(1)).alias("n")),
    with_(TX, "SELECT Customer_Type, count(*) AS n FROM tx GROUP BY 1"),
)
add(
    "registered_sales",
    lambda t: t.buyers_sales.agg(
        F.count(F.lit(1)).alias("lines"), F.sum("Revenue").alias("revenue")
    ),
    with_(TX, """SELECT count(*) AS lines, CAST(sum(Revenue) AS DOUBLE) AS revenue FROM tx
      WHERE Customer_ID IS NOT NULL AND Revenue > 0"""),
)
add(
    "spend_tier",
    lambda t: R.with_tier(t.customers, star.TIER_EDGES).select(
        "Customer_ID", "Country", "Total_Spent", "Segment"
    ),
    with_(CUSTOMERS, f"""SELECT Customer_ID, Country, CAST(Total_Spent AS DOUBLE) AS Total_Spent,
      {TIER} AS Segment FROM customers"""),
)
add(
    "ellipsized",
    lambda t: t.table("documents").select(
        "doc_id", C.ellipsize(F.col("text"), 50).alias("short_text")
    ),
    """SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END AS short_text
      FROM documents""",
)
add(
    "fill_zero",
    lambda t: C.fill_zero(t.table("orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("buyer")
    ), ["buyer"]),
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_custkey END, 0) AS buyer FROM orders""",
)
add(
    "calendar_features",
    lambda t: C.calendar_features(t.tx.select("Date").distinct()),
    with_(TX, """SELECT strftime(d, '%Y-%m-%d') AS "Date", CAST(year(d) AS INTEGER) AS "Year", CAST(month(d) AS INTEGER) AS "Month",
      CAST(day(d) AS INTEGER) AS "Day", CAST(isodow(d) - 1 AS INTEGER) AS DayOfWeek,
      CAST(dayofyear(d) AS INTEGER) AS DayOfYear, CAST(weekofyear(d) AS INTEGER) AS WeekOfYear,
      CAST(quarter(d) AS INTEGER) AS "Quarter", CAST(isodow(d) >= 6 AS INTEGER) AS IsWeekend,
      CAST(day(d) = 1 AS INTEGER) AS IsMonthStart, CAST(d = last_day(d) AS INTEGER) AS IsMonthEnd
      FROM (SELECT DISTINCT "Date" AS d FROM tx)"""),
)
add(
    "hour_of_events",
    lambda t: t.events.groupBy(F.hour("ts").alias("Hour")).agg(F.count(F.lit(1)).alias("n")),
    """SELECT CAST(hour(ts) AS INTEGER) AS "Hour", count(*) AS n FROM events GROUP BY 1""",
)

# --- the aggregate tables --------------------------------------------------
add("daily_sales", lambda t: t.daily, with_(DAILY, f"SELECT {_DAILY_COLS} FROM daily"))
add(
    "product_performance",
    lambda t: A.product_performance(t.tx),
    with_(PRODUCTS, f"SELECT {_PRODUCT_COLS} FROM products"),
)
add(
    "customer_analysis",
    lambda t: A.customer_analysis(t.tx),
    with_(CUSTOMERS, f"SELECT {_CUSTOMER_COLS} FROM customers"),
)
add(
    "country_performance",
    lambda t: A.country_performance(t.tx),
    with_(COUNTRIES, """SELECT Country, CAST(Total_Revenue AS DOUBLE) AS Total_Revenue, Total_Transactions,
      Unique_Customers, Avg_Transaction_Value FROM countries"""),
)
add(
    "monthly_trends",
    lambda t: t.monthly.orderBy("Year", "Month"),
    with_(MONTHLY, """SELECT "Year", "Month", CAST(Total_Revenue AS DOUBLE) AS Total_Revenue, Total_Quantity,
      Total_Transactions, Unique_Customers FROM monthly"""),
)
add(
    "processing_summary",
    lambda t: A.processing_summary(t.stored_tx),
    with_(TX, """SELECT count(*) AS total_records,
      strftime(min("Date"), '%Y-%m-%d') || ' to ' || strftime(max("Date"), '%Y-%m-%d') AS date_range,
      CAST(sum(Revenue) AS DOUBLE) AS total_revenue, count(DISTINCT StockCode) AS unique_products,
      count(DISTINCT Customer_ID) AS unique_customers, count(DISTINCT Country) AS countries FROM tx"""),
)
add(
    "distinct_counts",
    lambda t: A.distinct_counts(t.stored_tx, ["StockCode", "Customer_ID", "Country"]),
    with_(TX, """SELECT count(DISTINCT StockCode) AS StockCode, count(DISTINCT Customer_ID) AS Customer_ID,
      count(DISTINCT Country) AS Country FROM tx"""),
)
add(
    "value_counts",
    lambda t: A.value_counts(t.tx, "Product_Category"),
    with_(TX, "SELECT Product_Category, count(*) AS n FROM tx GROUP BY 1"),
)
add(
    "product_dim",
    lambda t: A.product_dim(t.tx),
    with_(TX, """SELECT StockCode, arg_min(Description, (InvoiceDate, Description)) AS Description FROM tx GROUP BY 1"""),
)
add(
    "busiest_customers",
    lambda t: A.busiest(t.tx, "Customer_ID"),
    with_(TX, """SELECT Customer_ID, count(*) AS Transactions FROM tx WHERE Customer_ID IS NOT NULL
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""),
)
add(
    "busiest_products",
    lambda t: A.busiest(t.tx, "StockCode"),
    with_(TX, "SELECT StockCode, count(*) AS Transactions FROM tx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
)
add(
    "filter_values",
    lambda t: A.filter_values(t.tx, "Country"),
    with_(TX, "SELECT DISTINCT Country FROM tx"),
)
add(
    "filter_dates",
    lambda t: A.date_range(t.daily),
    with_(DAILY, """SELECT strftime(min("Date"), '%Y-%m-%d') AS first_date,
      strftime(max("Date"), '%Y-%m-%d') AS last_date FROM daily"""),
)
add(
    "top_products",
    lambda t: A.top_n(t.products, "Total_Revenue", 10, ["StockCode", "Description"]).select(
        "StockCode", "Description", "Total_Revenue"
    ),
    with_(PRODUCTS, """SELECT StockCode, Description, CAST(Total_Revenue AS DOUBLE) AS Total_Revenue FROM products
      ORDER BY products.Total_Revenue DESC, StockCode, Description LIMIT 10"""),
)
add(
    "top_customers",
    lambda t: R.customer_table(
        A.top_n(t.customers, "Total_Spent", 20, ["Customer_ID", "Country"]), star.TIER_EDGES
    ),
    with_(CUSTOMERS, f"""SELECT Customer_ID, Country, CAST(Total_Spent AS DOUBLE) AS Total_Spent, Total_Orders,
      Total_Items, Avg_Order_Value, {TIER} AS Segment FROM customers
      ORDER BY customers.Total_Spent DESC, Customer_ID, Country LIMIT 20"""),
)

# --- reports ---------------------------------------------------------------
add(
    "overview",
    lambda t: R.overview(t.stored_tx),
    with_(TX, """SELECT count(*) AS total_transactions, CAST(sum(Revenue) AS DOUBLE) AS total_revenue,
      count(DISTINCT Customer_ID) AS unique_customers, count(DISTINCT StockCode) AS unique_products,
      count(DISTINCT Country) AS countries, strftime(min("Date"), '%Y-%m-%d') AS start_date,
      strftime(max("Date"), '%Y-%m-%d') AS end_date,
      CAST(sum(Total_Amount) AS DOUBLE) / count(Total_Amount) AS avg_order_value,
      (SELECT Country FROM tx GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_country FROM tx"""),
)
add(
    "kpi",
    lambda t: R.kpi(t.stored_tx, A.monthly_trends(t.stored_tx)),
    with_(MONTHLY, """, g AS (SELECT "Year", "Month",
        (CAST(Total_Revenue AS DOUBLE) / CAST(lag(Total_Revenue) OVER w AS DOUBLE) - 1) * 100 AS revenue_growth_pct,
        (CAST(Total_Transactions AS DOUBLE) / lag(Total_Transactions) OVER w - 1) * 100 AS transactions_growth_pct,
        (CAST(Unique_Customers AS DOUBLE) / lag(Unique_Customers) OVER w - 1) * 100 AS customers_growth_pct
        FROM monthly WINDOW w AS (ORDER BY "Year", "Month"))
      SELECT m.*, g.revenue_growth_pct, g.transactions_growth_pct, g.customers_growth_pct FROM (
        SELECT CAST(sum(Revenue) AS DOUBLE) AS revenue, count(*) AS transactions,
        CAST(sum(Total_Amount) AS DOUBLE) / count(Total_Amount) AS avg_order_value,
        count(DISTINCT Customer_ID) AS customers FROM tx) m,
        (SELECT * FROM g ORDER BY "Year" DESC, "Month" DESC LIMIT 1) g"""),
)
add(
    "business_summary_countries",
    lambda t: R.business_summary_countries(t.tx),
    with_(TX, "SELECT Country, count(*) AS transactions FROM tx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"),
)
add(
    "revenue_by_category",
    lambda t: R.revenue_by_category(t.tx),
    with_(TX, "SELECT Product_Category, CAST(sum(Revenue) AS DOUBLE) AS revenue FROM tx GROUP BY 1"),
)
add(
    "tier_analysis",
    lambda t: R.tier_analysis(t.customers, star.TIER_EDGES),
    with_(CUSTOMERS, f"""SELECT Segment, count(*) AS customers, CAST(sum(Total_Spent) AS DOUBLE) / count(*) AS avg_spent,
      CAST(sum(Total_Orders) AS DOUBLE) / count(*) AS avg_orders
      FROM (SELECT *, {TIER} AS Segment FROM customers) WHERE Segment IS NOT NULL GROUP BY 1"""),
)
add(
    "tier_totals",
    lambda t: R.tier_totals(t.customers, 1_000_000),
    with_(CUSTOMERS, """SELECT count(*) AS total_customers,
      count(*) FILTER (Total_Spent > 1000000) AS high_value_customers,
      count(*) FILTER (Total_Orders > 1) AS repeat_customers FROM customers"""),
)
add(
    "product_analysis",
    lambda t: R.product_analysis(t.stored_products),
    with_(PRODUCTS, """, q AS (SELECT quantile_cont(CAST(Total_Revenue AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST(Total_Revenue AS DOUBLE), 0.75) AS q3 FROM products)
      SELECT count(*) AS total_products, CAST(sum(Total_Revenue) AS DOUBLE) / count(*) AS avg_revenue_per_product,
      count(*) FILTER (CAST(Total_Revenue AS DOUBLE) < (SELECT q1 FROM q)) AS low_performing_products,
      count(*) FILTER (CAST(Total_Revenue AS DOUBLE) > (SELECT q3 FROM q)) AS high_performing_products FROM products"""),
)
add(
    "category_performance",
    lambda t: R.category_performance(t.products),
    with_(PRODUCTS, """SELECT Product_Category, CAST(sum(Total_Revenue) AS DOUBLE) AS revenue FROM products GROUP BY 1"""),
)
_SHARE = """CAST(Total_Revenue AS DOUBLE) / CAST((SELECT sum(Total_Revenue) FROM countries) AS DOUBLE) * 100"""
add(
    "top_markets",
    lambda t: R.top_markets(t.stored_countries).select("Country", "Total_Revenue", "Revenue_Share"),
    with_(COUNTRIES, f"""SELECT Country, CAST(Total_Revenue AS DOUBLE) AS Total_Revenue, {_SHARE} AS Revenue_Share
      FROM countries ORDER BY countries.Total_Revenue DESC, Country LIMIT 5"""),
)
add(
    "emerging_markets",
    lambda t: R.emerging_markets(t.countries).select("Country", "Total_Revenue"),
    with_(COUNTRIES, """SELECT Country, CAST(Total_Revenue AS DOUBLE) AS Total_Revenue
      FROM countries ORDER BY countries.Total_Revenue, Country LIMIT 5"""),
)
add(
    "market_analysis",
    lambda t: R.market_analysis(t.stored_countries),
    with_(COUNTRIES, """SELECT count(*) AS total_markets, CAST(sum(Total_Revenue) AS DOUBLE) AS total_revenue,
      CAST((SELECT sum(x) FROM (SELECT Total_Revenue AS x FROM countries ORDER BY 1 DESC, Country LIMIT 3)) AS DOUBLE)
        / CAST(sum(Total_Revenue) AS DOUBLE) * 100 AS market_concentration_pct FROM countries"""),
)
add(
    "daily_revenue_trend",
    lambda t: R.daily_trend(t.daily, "Total_Revenue"),
    with_(DAILY, f"SELECT {_DAY}, CAST(sum(Total_Revenue) AS DOUBLE) AS Total_Revenue FROM daily GROUP BY daily.\"Date\""),
)
add(
    "daily_transactions_trend",
    lambda t: R.daily_trend(t.daily, "Total_Transactions", "nation_3", "1996-01-01", "1997-12-31"),
    with_(DAILY, f"""SELECT {_DAY}, CAST(sum(Total_Transactions) AS BIGINT) AS Total_Transactions FROM daily
      WHERE upper(Country) = 'NATION_3' AND "Date" BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
      GROUP BY daily."Date" """),
)
add(
    "sales_page_metrics",
    lambda t: R.sales_page_metrics(t.daily, "Nation_5", "1996-01-01", "1998-12-31"),
    with_(DAILY, """SELECT CAST(sum(rev) AS DOUBLE) AS total_revenue, CAST(sum(n) AS BIGINT) AS total_transactions,
      CAST(sum(rev) AS DOUBLE) / count(rev) AS avg_daily_revenue FROM (
        SELECT "Date", sum(Total_Revenue) AS rev, sum(Total_Transactions) AS n FROM daily
        WHERE upper(Country) = 'NATION_5' AND "Date" BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1)"""),
)
add(
    "product_page_metrics",
    lambda t: R.product_page_metrics(t.products, "gears"),
    with_(PRODUCTS, """SELECT count(*) AS total_products, CAST(sum(Total_Revenue) AS DOUBLE) AS total_revenue,
      CAST(sum(Total_Revenue) AS DOUBLE) / count(*) AS avg_revenue FROM products
      WHERE upper(Product_Category) = 'GEARS'"""),
)
add(
    "products_per_category",
    lambda t: A.value_counts(t.products, "Product_Category").withColumnRenamed("n", "products"),
    with_(PRODUCTS, "SELECT Product_Category, count(*) AS products FROM products GROUP BY 1"),
)
add(
    "customer_page_metrics",
    lambda t: R.customer_page_metrics(t.customers),
    with_(CUSTOMERS, """SELECT count(*) AS total_customers, CAST(sum(Total_Spent) AS DOUBLE) / count(*) AS avg_spent,
      CAST(sum(Total_Orders) AS DOUBLE) / count(*) AS avg_orders,
      CAST(sum(Total_Items) AS DOUBLE) / count(*) AS avg_items FROM customers"""),
)
add(
    "spend_histogram",
    lambda t: R.spend_histogram(t.stored_customers),
    with_(CUSTOMERS, """, e AS (SELECT min(CAST(Total_Spent AS DOUBLE)) AS lo,
        (max(CAST(Total_Spent AS DOUBLE)) - min(CAST(Total_Spent AS DOUBLE))) / 50 AS w FROM customers)
      SELECT bin, count(*) AS customers, any_value(lo + bin * w) AS bin_start FROM (
        SELECT least(CAST(floor((CAST(Total_Spent AS DOUBLE) - lo) / w) AS INTEGER), 49) AS bin, lo, w
        FROM customers, e) GROUP BY 1"""),
)
add(
    "geo_page_metrics",
    lambda t: R.geo_page_metrics(t.countries),
    with_(COUNTRIES, """SELECT count(*) AS total_countries, arg_max(Country, (Total_Revenue, Country)) AS top_country,
      CAST(sum(Total_Revenue) AS DOUBLE) AS total_revenue FROM countries"""),
)
add(
    "transaction_context",
    lambda t: R.transaction_context(t.stored_tx),
    with_(TX, """SELECT count(*) AS "rows", CAST(min(Revenue) AS DOUBLE) AS min_revenue,
      CAST(max(Revenue) AS DOUBLE) AS max_revenue, strftime(min("Date"), '%Y-%m-%d') AS start_date,
      strftime(max("Date"), '%Y-%m-%d') AS end_date,
      (SELECT string_agg(Country, ', ' ORDER BY n DESC, Country) FROM (
         SELECT Country, count(*) AS n FROM tx GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)) AS top_countries FROM tx"""),
)
add(
    "product_table",
    lambda t: R.product_table(t.products),
    with_(PRODUCTS, """SELECT Description, Product_Category, CAST(Total_Revenue AS DOUBLE) AS Total_Revenue,
      Total_Quantity_Sold, Total_Orders, Avg_Price FROM products"""),
)
add(
    "customer_table",
    lambda t: R.customer_table(t.customers, star.TIER_EDGES),
    with_(CUSTOMERS, f"""SELECT Customer_ID, Country, CAST(Total_Spent AS DOUBLE) AS Total_Spent, Total_Orders,
      Total_Items, Avg_Order_Value, {TIER} AS Segment FROM customers"""),
)

# --- filtered, sorted, limited ---------------------------------------------
add(
    "daily_sales_filtered",
    lambda t: R.daily_sales_filtered(t.daily, "nation_7", "1996-01-01", "2000-12-31"),
    with_(DAILY, f"""SELECT {_DAILY_COLS} FROM daily WHERE upper(Country) = 'NATION_7'
      AND "Date" BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
      ORDER BY daily."Date" DESC, Country LIMIT 100"""),
)
add(
    "products_filtered",
    lambda t: R.products_filtered(t.products, "Rings"),
    with_(PRODUCTS, f"""SELECT {_PRODUCT_COLS} FROM products WHERE upper(Product_Category) = 'RINGS'
      ORDER BY products.Total_Revenue DESC, StockCode, Description LIMIT 20"""),
)
add(
    "customers_filtered",
    lambda t: R.customers_filtered(t.customers, None, 1_000_000),
    with_(CUSTOMERS, f"""SELECT {_CUSTOMER_COLS} FROM customers WHERE Total_Spent >= 1000000
      ORDER BY customers.Total_Spent DESC, Customer_ID, Country LIMIT 50"""),
)

# --- sources ---------------------------------------------------------------
add(
    "adhoc_sql",
    lambda t: tables.sql_over(
        t.spark,
        {"line_items": t.table("lineitem")},
        """SELECT l_returnflag, l_linestatus, count(*) AS row_count, sum(l_quantity) AS quantity
           FROM {line_items} GROUP BY l_returnflag, l_linestatus""",
    ),
    """SELECT l_returnflag, l_linestatus, count(*) AS row_count, sum(l_quantity) AS quantity
      FROM lineitem GROUP BY 1, 2""",
)
_PROFILED = tuple(
    (f.name, f.dataType.simpleString(), isinstance(f.dataType, T.NumericType)) for f in TRANSACTIONS.fields
)
add(
    "profile_transactions",
    lambda t: tables.profile(durable(t.tx)).withColumn("stddev", F.round("stddev", 4)),
    with_(TX, """, q AS (SELECT count(*) AS n FROM tx)""" + "".join(
        f""", {c.lower()}_p AS (SELECT '{c}' AS "column", '{typ}' AS type, count(*) AS "rows",
          count(*) - count({c}) AS nulls,
          CAST(count(*) - count({c}) AS DOUBLE) / count(*) * 100 AS null_pct,
          CAST(min({c}) AS VARCHAR) AS min_text, CAST(max({c}) AS VARCHAR) AS max_text,
          {mean} AS mean, {std} AS stddev, {q25} AS p25, {q50} AS p50, {q75} AS p75 FROM tx)"""
        for c, typ, num in _PROFILED
        for mean, std, q25, q50, q75 in [
            (
                f"CAST(sum({c}) AS DOUBLE) / count({c})",
                f"round(stddev_samp(CAST({c} AS DOUBLE)), 4)",
                f"quantile_cont(CAST({c} AS DOUBLE), 0.25)",
                f"quantile_cont(CAST({c} AS DOUBLE), 0.5)",
                f"quantile_cont(CAST({c} AS DOUBLE), 0.75)",
            )
            if num
            else ("CAST(NULL AS DOUBLE)",) * 5
        ]
    ) + " " + " UNION ALL ".join(f"SELECT * FROM {c.lower()}_p" for c, _, _ in _PROFILED)),
)
add(
    "sample_rows",
    lambda t: tables.sample_n(t.table("orders"), 1000, ["o_orderkey"]),
    f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders
      ORDER BY ('0x' || substr(md5('{fixed.SEED}:' || o_orderkey), 1, 15))::BIGINT, o_orderkey LIMIT 1000""",
)
add(
    "table_counts",
    lambda t: tables.count_frames(
        {"tx": t.stored_tx, "daily_sales": A.daily_sales(t.stored_tx), "customer_analysis": A.customer_analysis(t.stored_tx, False),
         "product_performance": A.product_performance(t.stored_tx, False),
         "country_performance": A.country_performance(t.stored_tx, False), "missing": None}
    ),
    with_(DAILY + CUSTOMERS[len(TX):] + PRODUCTS[len(TX):] + COUNTRIES[len(TX):], """
      SELECT 'tx' AS table_name, count(*) AS n FROM tx UNION ALL SELECT 'daily_sales', count(*) FROM daily
      UNION ALL SELECT 'customer_analysis', count(*) FROM customers
      UNION ALL SELECT 'product_performance', count(*) FROM products
      UNION ALL SELECT 'country_performance', count(*) FROM countries UNION ALL SELECT 'missing', 0"""),
)
add(
    "business_report",
    lambda t: business_report(
        {FACT: t.stored_tx, "customer_analysis": durable(A.customer_analysis(t.stored_tx, False)),
         "product_performance": durable(A.product_performance(t.stored_tx, False)),
         "country_performance": durable(A.country_performance(t.stored_tx, False))}, star.TIER_EDGES,
    ),
    with_(CUSTOMERS + PRODUCTS[len(TX):] + COUNTRIES[len(TX):], f""",
      q AS (SELECT quantile_cont(CAST(Total_Revenue AS DOUBLE), 0.25) AS q1,
        quantile_cont(CAST(Total_Revenue AS DOUBLE), 0.75) AS q3 FROM products),
      t AS (SELECT Segment, CAST(count(*) AS DOUBLE) AS customers, CAST(sum(Total_Spent) AS DOUBLE) / count(*) AS avg_spent,
        CAST(sum(Total_Orders) AS DOUBLE) / count(*) AS avg_orders
        FROM (SELECT *, {TIER} AS Segment FROM customers) WHERE Segment IS NOT NULL GROUP BY 1)
      SELECT section, metric, key, value FROM (
      SELECT 'business_summary' AS section, 'total_transactions' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM tx
      UNION ALL SELECT 'business_summary', 'total_revenue', '', CAST(sum(Revenue) AS DOUBLE) FROM tx
      UNION ALL SELECT 'business_summary', 'unique_customers', '', CAST(count(DISTINCT Customer_ID) AS DOUBLE) FROM tx
      UNION ALL SELECT 'business_summary', 'unique_products', '', CAST(count(DISTINCT StockCode) AS DOUBLE) FROM tx
      UNION ALL SELECT 'business_summary', 'countries', '', CAST(count(DISTINCT Country) AS DOUBLE) FROM tx
      UNION ALL SELECT 'business_summary', 'avg_order_value', '', CAST(sum(Total_Amount) AS DOUBLE) / count(*) FROM tx
      UNION ALL (SELECT 'business_summary', 'top_countries', Country, CAST(count(*) AS DOUBLE) FROM tx
        GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 5)
      UNION ALL SELECT 'business_summary', 'revenue_by_category', Product_Category, CAST(sum(Revenue) AS DOUBLE) FROM tx GROUP BY 3
      UNION ALL SELECT 'customers', 'total_customers', '', CAST(count(*) AS DOUBLE) FROM customers
      UNION ALL SELECT 'customers', 'high_value_customers', '', CAST(count(*) FILTER (Total_Spent > 1000) AS DOUBLE) FROM customers
      UNION ALL SELECT 'customers', 'repeat_customers', '', CAST(count(*) FILTER (Total_Orders > 1) AS DOUBLE) FROM customers
      UNION ALL SELECT 'customers', 'customers', Segment, customers FROM t
      UNION ALL SELECT 'customers', 'avg_spent', Segment, avg_spent FROM t
      UNION ALL SELECT 'customers', 'avg_orders', Segment, avg_orders FROM t
      UNION ALL SELECT 'products', 'total_products', '', CAST(count(*) AS DOUBLE) FROM products
      UNION ALL SELECT 'products', 'avg_revenue_per_product', '', CAST(sum(Total_Revenue) AS DOUBLE) / count(*) FROM products
      UNION ALL SELECT 'products', 'low_performing_products', '',
        CAST(count(*) FILTER (CAST(Total_Revenue AS DOUBLE) < (SELECT q1 FROM q)) AS DOUBLE) FROM products
      UNION ALL SELECT 'products', 'high_performing_products', '',
        CAST(count(*) FILTER (CAST(Total_Revenue AS DOUBLE) > (SELECT q3 FROM q)) AS DOUBLE) FROM products
      UNION ALL SELECT 'products', 'category_performance', Product_Category, CAST(sum(Total_Revenue) AS DOUBLE) FROM products GROUP BY 3
      UNION ALL SELECT 'markets', 'total_markets', '', CAST(count(*) AS DOUBLE) FROM countries
      UNION ALL SELECT 'markets', 'total_revenue', '', CAST(sum(Total_Revenue) AS DOUBLE) FROM countries
      UNION ALL SELECT 'markets', 'market_concentration_pct', '', CAST((SELECT sum(x) FROM (SELECT Total_Revenue AS x FROM countries
        ORDER BY 1 DESC, Country LIMIT 3)) AS DOUBLE) / CAST(sum(Total_Revenue) AS DOUBLE) * 100 FROM countries
      UNION ALL (SELECT 'markets', 'top_markets', Country, CAST(Total_Revenue AS DOUBLE) FROM countries
        ORDER BY countries.Total_Revenue DESC, Country LIMIT 5)
      UNION ALL (SELECT 'markets', 'emerging_markets', Country, CAST(Total_Revenue AS DOUBLE) FROM countries
        ORDER BY countries.Total_Revenue, Country LIMIT 5))"""),
)
