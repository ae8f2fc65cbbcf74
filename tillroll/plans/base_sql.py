"""Common table expressions shared by the check statements.

They state the same star-to-fact mapping, cleaning and features in plain SQL.
"""

RAW = """
raw AS (
  SELECT 'INV' || l_orderkey AS Invoice, 'PROD' || l_partkey AS StockCode, p_name AS Description,
         CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS INTEGER) AS Quantity,
         o_orderdate AS InvoiceDate, CAST(l_extendedprice AS DECIMAL(12,2)) AS Price,
         CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS Customer_ID, n_name AS Country
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

CLEAN = (
    RAW
    + """,
clean AS (
  SELECT Invoice, upper(trim(coalesce(StockCode, 'UNKNOWN'))) AS StockCode,
         upper(trim(coalesce(Description, 'UNKNOWN'))) AS Description, Quantity, InvoiceDate, Price,
         Customer_ID, upper(trim(coalesce(Country, 'UNKNOWN'))) AS Country,
         Quantity < 0 AS Is_Return, abs(Quantity) AS Absolute_Quantity,
         CAST(abs(Quantity) * Price AS DECIMAL(18,2)) AS Total_Amount
  FROM raw
  WHERE Invoice IS NOT NULL AND Quantity IS NOT NULL AND Price IS NOT NULL
    AND InvoiceDate IS NOT NULL AND Price >= 0 AND abs(Quantity) > 0
)"""
)

TX = (
    CLEAN
    + """,
tx AS (
  SELECT *, CAST(year(InvoiceDate) AS INTEGER) AS "Year", CAST(month(InvoiceDate) AS INTEGER) AS "Month",
         CAST(day(InvoiceDate) AS INTEGER) AS "Day", CAST(isodow(InvoiceDate) - 1 AS INTEGER) AS DayOfWeek,
         CAST(InvoiceDate AS DATE) AS "Date", CAST(hour(InvoiceDate) AS INTEGER) AS "Hour",
         CAST(CASE WHEN Is_Return THEN -Total_Amount ELSE Total_Amount END AS DECIMAL(18,2)) AS Revenue,
         CASE WHEN contains(Description, 'OLD') THEN 'CLEARANCE'
              WHEN contains(Description, 'BLUE') THEN 'BLUE RANGE'
              WHEN contains(Description, 'PLATE') THEN 'PLATES'
              WHEN contains(Description, 'GEAR') THEN 'GEARS'
              WHEN contains(Description, 'RING') THEN 'RINGS' ELSE 'OTHER' END AS Product_Category,
         CASE WHEN Price > 0 AND Price <= 5000 THEN 'LOW' WHEN Price > 5000 AND Price <= 20000 THEN 'MEDIUM'
              WHEN Price > 20000 AND Price <= 50000 THEN 'HIGH' WHEN Price > 50000 THEN 'PREMIUM' END AS Price_Range,
         CASE WHEN Customer_ID IS NULL THEN 'GUEST' ELSE 'REGISTERED' END AS Customer_Type
  FROM clean
)"""
)

DAILY = (
    TX
    + """,
daily AS (
  SELECT "Date", Country, sum(Revenue) AS Total_Revenue,
         CAST(sum(Absolute_Quantity) AS BIGINT) AS Total_Quantity, count(Invoice) AS Total_Transactions,
         count(DISTINCT Customer_ID) AS Unique_Customers,
         CAST(sum(Price) AS DOUBLE) / count(Price) AS Avg_Unit_Price
  FROM tx GROUP BY 1, 2
)"""
)

PRODUCTS = (
    TX
    + """,
products AS (
  SELECT StockCode, Description, Product_Category, sum(Revenue) AS Total_Revenue,
         CAST(sum(Absolute_Quantity) AS BIGINT) AS Total_Quantity_Sold, count(Invoice) AS Total_Orders,
         CAST(sum(Price) AS DOUBLE) / count(Price) AS Avg_Price,
         count(DISTINCT Customer_ID) AS Unique_Customers
  FROM tx GROUP BY 1, 2, 3
)"""
)

CUSTOMERS = (
    TX
    + """,
customers AS (
  SELECT Customer_ID, Country, sum(Revenue) AS Total_Spent, count(Invoice) AS Total_Orders,
         CAST(sum(Absolute_Quantity) AS BIGINT) AS Total_Items,
         CAST(sum(Total_Amount) AS DOUBLE) / count(Total_Amount) AS Avg_Order_Value,
         max(InvoiceDate) AS Last_Purchase_Date, min(InvoiceDate) AS First_Purchase_Date
  FROM tx WHERE Customer_ID IS NOT NULL GROUP BY 1, 2
)"""
)

COUNTRIES = (
    TX
    + """,
countries AS (
  SELECT Country, sum(Revenue) AS Total_Revenue, count(Invoice) AS Total_Transactions,
         count(DISTINCT Customer_ID) AS Unique_Customers,
         CAST(sum(Total_Amount) AS DOUBLE) / count(Total_Amount) AS Avg_Transaction_Value
  FROM tx GROUP BY 1
)"""
)

MONTHLY = (
    TX
    + """,
monthly AS (
  SELECT "Year", "Month", sum(Revenue) AS Total_Revenue,
         CAST(sum(Absolute_Quantity) AS BIGINT) AS Total_Quantity, count(Invoice) AS Total_Transactions,
         count(DISTINCT Customer_ID) AS Unique_Customers
  FROM tx GROUP BY 1, 2
)"""
)

TIER = """CASE WHEN Total_Spent > 0 AND Total_Spent <= 100000 THEN 'Bronze'
     WHEN Total_Spent > 100000 AND Total_Spent <= 500000 THEN 'Silver'
     WHEN Total_Spent > 500000 AND Total_Spent <= 1000000 THEN 'Gold'
     WHEN Total_Spent > 1000000 THEN 'Platinum' END"""


def with_(ctes: str, select: str) -> str:
    return "WITH " + ctes.strip() + "\n" + select.strip()
