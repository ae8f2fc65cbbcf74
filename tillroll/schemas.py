"""Explicit schemas; no reader in this package infers types."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "price": T.DecimalType(12, 2),
    "money": T.DecimalType(18, 2),
    "total": T.DecimalType(28, 2),
    "floats": T.ArrayType(T.FloatType()),
}


def _schema(spec: str) -> T.StructType:
    """`name type` pairs; a name may hold spaces."""
    pairs = [field.strip().rsplit(" ", 1) for field in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_LINES = _schema(
    "Invoice string, StockCode string, Description string, Quantity int, "
    "InvoiceDate timestamp_ntz, Price price, Customer ID bigint, Country string"
)

TRANSACTIONS = _schema(
    "Invoice string, StockCode string, Description string, Quantity int, "
    "InvoiceDate timestamp_ntz, Price price, Customer_ID bigint, Country string, "
    "Is_Return boolean, Absolute_Quantity int, Total_Amount money, "
    "Year int, Month int, Day int, DayOfWeek int, Date date, Hour int, "
    "Revenue money, Product_Category string, Price_Range string, Customer_Type string"
)

DAILY_SALES = _schema(
    "Date date, Country string, Total_Revenue total, Total_Quantity bigint, "
    "Total_Transactions bigint, Unique_Customers bigint, Avg_Unit_Price double"
)

PRODUCT_PERFORMANCE = _schema(
    "StockCode string, Description string, Product_Category string, "
    "Total_Revenue total, Total_Quantity_Sold bigint, Total_Orders bigint, "
    "Avg_Price double, Unique_Customers bigint"
)

CUSTOMER_ANALYSIS = _schema(
    "Customer_ID bigint, Country string, Total_Spent total, Total_Orders bigint, "
    "Total_Items bigint, Avg_Order_Value double, Last_Purchase_Date timestamp_ntz, "
    "First_Purchase_Date timestamp_ntz"
)

COUNTRY_PERFORMANCE = _schema(
    "Country string, Total_Revenue total, Total_Transactions bigint, "
    "Unique_Customers bigint, Avg_Transaction_Value double"
)

MONTHLY_TRENDS = _schema(
    "Year int, Month int, Total_Revenue total, Total_Quantity bigint, "
    "Total_Transactions bigint, Unique_Customers bigint"
)

PROCESSING_SUMMARY = _schema(
    "processing_date timestamp_ntz, total_records bigint, date_range string, "
    "total_revenue total, unique_products bigint, unique_customers bigint, "
    "countries bigint"
)

CHUNKS = _schema(
    "chunk_type string, chunk_id string, content string, metadata string, "
    "embedding floats, created_at timestamp"
)

BY_DATASET = {
    "retail_transactions_processed": TRANSACTIONS,
    "daily_sales": DAILY_SALES,
    "product_performance": PRODUCT_PERFORMANCE,
    "customer_analysis": CUSTOMER_ANALYSIS,
    "country_performance": COUNTRY_PERFORMANCE,
    "monthly_trends": MONTHLY_TRENDS,
}

# The five warehouse tables: the dataset's own columns plus the load time.
WAREHOUSE = {
    "retail_transactions": TRANSACTIONS,
    "product_performance": PRODUCT_PERFORMANCE,
    "customer_analysis": T.StructType(
        CUSTOMER_ANALYSIS.fields + [T.StructField("customer_segment", T.StringType())]
    ),
    "daily_sales": DAILY_SALES,
    "country_performance": COUNTRY_PERFORMANCE,
}
WAREHOUSE_SOURCE = {"retail_transactions": "retail_transactions_processed"}
