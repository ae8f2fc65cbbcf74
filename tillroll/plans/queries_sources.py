"""Registered queries that write tables and read them back: CSV, catalog, warehouse, reports.

They write under the shared folder of the session, or into the session's warehouse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.operators.aggregates import country_performance
from tillroll.operators.etl import add_features, clean
from tillroll.operators.ordering import durable, shared_folder
from tillroll.plans import marts, queries_experiments, queries_tables, refresh
from tillroll.plans.base_sql import COUNTRIES, CUSTOMERS, DAILY, MONTHLY, PRODUCTS, RAW, TX, with_
from tillroll.plans.star_tables import StarTables
from tillroll.schemas import RAW_LINES, WAREHOUSE
from tillroll.sources import sinks, star, tables, versions, warehouse

QUERIES = {}


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = (build, sql)


def _folder(t: StarTables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4()}"


def _csv_round_trip(t: StarTables):
    path = _folder(t, "lines")
    sinks.export_csv(t.raw.select(*RAW_LINES.fieldNames()), path)
    back = tables.read_table(t.spark, path, "csv", RAW_LINES)
    return back.withColumnRenamed("Customer ID", "Customer_ID")


add(
    "csv_round_trip",
    _csv_round_trip,
    with_(RAW, """SELECT Invoice, StockCode, Description, Quantity,
      strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate, CAST(Price AS DOUBLE) AS Price, Customer_ID, Country FROM raw"""),
)


def _checked_lines(t: StarTables):
    """Lines as CSV, some with a unit behind the quantity or a currency before the price, read back record by record."""
    path = _folder(t, "faulty-lines")
    lines = t.raw.select(*RAW_LINES.fieldNames())
    unit, currency = F.col("Quantity") % 10 == 0, F.col("StockCode").endswith("7")
    sinks.export_csv(
        lines.withColumns({
            "Quantity": F.when(unit, F.concat("Quantity", F.lit(" pcs"))).otherwise(F.col("Quantity").cast("string")),
            "Price": F.when(currency, F.concat(F.lit("GBP "), "Price")).otherwise(F.col("Price").cast("string")),
        }),
        path,
    )
    return tables.read_checked(t.spark, path, "csv", RAW_LINES)


_FAULTS = RAW + """, marked AS (SELECT *, Quantity % 10 = 0 AS q, StockCode LIKE '%7' AS p FROM raw)"""
add(
    "rejected_records",
    lambda t: tables.rejected_counts(_checked_lines(t)),
    with_(_FAULTS, """SELECT CASE WHEN q AND p THEN 'Quantity,Price' WHEN q THEN 'Quantity' WHEN p THEN 'Price' ELSE 'kept' END AS columns,
      count(*) AS records FROM marked GROUP BY 1"""),
)
add(
    "kept_records",
    lambda t: _checked_lines(t).kept.withColumnRenamed("Customer ID", "Customer_ID"),
    with_(_FAULTS, """SELECT Invoice, StockCode, Description, Quantity, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') AS InvoiceDate,
      CAST(Price AS DOUBLE) AS Price, Customer_ID, Country FROM marked WHERE NOT q AND NOT p"""),
)


def _stored(t: StarTables) -> dict:
    """The tables of the batch pipeline, written and read back."""
    return marts.run_pipeline(t.raw, _folder(t, "marts"), star.CATEGORY_RULES, star.PRICE_EDGES)


_COUNTS = with_(DAILY + CUSTOMERS[len(TX):] + PRODUCTS[len(TX):] + COUNTRIES[len(TX):] + MONTHLY[len(TX):], """
      SELECT 'retail_transactions_processed' AS table_name, count(*) AS n FROM tx UNION ALL SELECT 'daily_sales', count(*) FROM daily
      UNION ALL SELECT 'customer_analysis', count(*) FROM customers UNION ALL SELECT 'product_performance', count(*) FROM products
      UNION ALL SELECT 'country_performance', count(*) FROM countries UNION ALL SELECT 'monthly_trends', count(*) FROM monthly""")
add(
    "pipeline_tables",
    lambda t: tables.count_frames(_stored(t)).filter("table_name <> 'processing_summary'"),
    _COUNTS,
)


def _catalog_sql(t: StarTables):
    folder = _folder(t, "catalog")
    marts.run_pipeline(t.raw, folder, star.CATEGORY_RULES, star.PRICE_EDGES)
    tables.load_catalog(t.spark, folder)
    return tables.sql(t.spark, "SELECT Country, Total_Revenue, Total_Transactions FROM country_performance WHERE Total_Transactions > 10")


add(
    "catalog_sql",
    _catalog_sql,
    with_(COUNTRIES, """SELECT Country, CAST(Total_Revenue AS DOUBLE) AS Total_Revenue, Total_Transactions
      FROM countries WHERE Total_Transactions > 10"""),
)
add(
    "validate_transactions",
    lambda t: tables.validate_table(t.tx, ["Invoice", "customer_id", "price", "Tax"]),
    with_(TX, """, n AS (SELECT count(*) AS n, count(*) FILTER (Invoice IS NULL) AS a, count(*) FILTER (Customer_ID IS NULL) AS b,
        count(*) FILTER (Price IS NULL) AS c FROM tx)
      SELECT 'Invoice' AS required, 'Invoice' AS matched_column, true AS found, n AS "rows", n > 0 AS non_empty, a AS nulls FROM n
      UNION ALL SELECT 'customer_id', 'Customer_ID', true, n, n > 0, b FROM n
      UNION ALL SELECT 'price', 'Price', true, n, n > 0, c FROM n
      UNION ALL SELECT 'Tax', NULL, false, n, n > 0, NULL FROM n"""),
)


def _warehouse_load(t: StarTables):
    """Rows per warehouse table after a load, and how many have the load time."""
    warehouse.create_namespaces(t.spark)
    warehouse.create_tables(t.spark)
    # The fact is stored once, so that the star is not joined again for each table.
    tx = durable(t.tx)
    loaded = {"retail_transactions_processed": tx, **marts.aggregate_tables(tx, ordered=False)}
    warehouse.load_warehouse(t.spark, loaded)
    stamped = None
    for name in WAREHOUSE:
        part = t.spark.table(f"{warehouse.ANALYTICS}.{name}").agg(F.count("created_at").alias("stamped"))
        part = part.select(F.lit(f"{warehouse.ANALYTICS}.{name}").alias("table_name"), "stamped")
        stamped = part if stamped is None else stamped.unionByName(part)
    return warehouse.warehouse_counts(t.spark).join(stamped, "table_name")


add(
    "warehouse_load",
    _warehouse_load,
    with_(DAILY + CUSTOMERS[len(TX):] + PRODUCTS[len(TX):] + COUNTRIES[len(TX):], """, c AS (
      SELECT 'analytics.retail_transactions' AS table_name, count(*) AS n FROM tx UNION ALL SELECT 'analytics.daily_sales', count(*) FROM daily
      UNION ALL SELECT 'analytics.customer_analysis', count(*) FROM customers
      UNION ALL SELECT 'analytics.product_performance', count(*) FROM products
      UNION ALL SELECT 'analytics.country_performance', count(*) FROM countries)
      SELECT table_name, n, n AS stamped FROM c"""),
)


def _report_json(t: StarTables):
    build, _ = queries_tables.QUERIES["business_report"]
    report, path = build(t), _folder(t, "report")
    sinks.save_report(report, path)
    return tables.read_table(t.spark, path, "json", report.schema)


add("report_json", _report_json, queries_tables.QUERIES["business_report"][1])


def _results_json(t: StarTables):
    """The t test's row, appended twice."""
    build, _ = queries_experiments.QUERIES["ab_ttest"]
    result, path = build(t), _folder(t, "results")
    for _ in range(2):
        sinks.append_results(result, path)
    return tables.read_table(t.spark, path, "json", result.schema)


add(
    "results_json",
    _results_json,
    f"SELECT * FROM ({queries_experiments.QUERIES['ab_ttest'][1]}) UNION ALL SELECT * FROM ({queries_experiments.QUERIES['ab_ttest'][1]})",
)


# --- incremental refresh ---------------------------------------------------
def _loaded_in_parts(t: StarTables):
    """The lines loaded as three batches: early ones, later ones, and late lines of all days besides the last ones."""
    root = _folder(t, "store")
    late = F.crc32(F.col("Invoice").cast("binary")) % 50 == 0
    year = F.year("InvoiceDate")
    part = F.when(late | (year >= 2000), 3).when(year >= 1997, 2).otherwise(1)
    sinks.save_tables({"lines": t.raw.withColumn("part", part)}, root, partition_by={"lines": ["part"]})
    for k in (1, 2, 3):
        lines = tables.read_table(t.spark, f"{root}/lines/part={k}")
        refresh.load(lines, root, f"part {k}", star.CATEGORY_RULES, star.PRICE_EDGES)
    return root


add(
    "refreshed_daily_sales",
    lambda t: refresh.read(t.spark, _loaded_in_parts(t), "daily_sales"),
    queries_tables.QUERIES["daily_sales"][1],
)
# The other tables of the store in one query: table, key, measure, and its value as a number or a text.
_KEYS = {
    "product_performance": ("StockCode", "Description", "Product_Category"),
    "customer_analysis": ("Customer_ID", "Country"),
    "country_performance": ("Country",),
    "monthly_trends": ("Year", "Month"),
    "processing_summary": (),
}
_WORDS = {"date_range", "First_Purchase_Date", "Last_Purchase_Date"}


def _long_form(t: StarTables):
    root = _loaded_in_parts(t)
    _, manifest = versions.latest(t.spark, root)
    out = None
    for name, keys in _KEYS.items():
        df = refresh.read(t.spark, root, name, manifest).drop("processing_date")
        none = F.lit(None)
        cells = [
            F.struct(
                F.lit(c).alias("measure"),
                (none if c in _WORDS else F.col(c)).cast("double").alias("value"),
                ((F.col(c) if c == "date_range" else F.date_format(c, "yyyy-MM-dd HH:mm:ss")) if c in _WORDS else none).cast("string").alias("words"),
            )
            for c in df.columns
            if c not in keys
        ]
        part = df.select(F.lit(name).alias("mart"), F.concat_ws("|", *keys).alias("key"), F.inline(F.array(*cells)))
        out = part if out is None else out.unionAll(part)
    return out


def _long_sql() -> str:
    parts = []
    for name, keys in _KEYS.items():
        statement = queries_tables.QUERIES[name][1]
        columns = [f.name for f in refresh.schema_of(name).fields if f.name not in (*keys, "processing_date")]
        key = " || '|' || ".join(f'CAST("{k}" AS VARCHAR)' for k in keys) or "''"
        parts += [
            f"""SELECT '{name}' AS mart, {key} AS key, '{c}' AS measure, {'CAST(NULL AS DOUBLE)' if c in _WORDS else f'CAST("{c}" AS DOUBLE)'} AS value,
              {f'CAST("{c}" AS VARCHAR)' if c in _WORDS else 'CAST(NULL AS VARCHAR)'} AS words FROM ({statement})"""
            for c in columns
        ]
    return " UNION ALL ".join(parts)


add("refreshed_tables", _long_form, _long_sql())


def _days_done(t: StarTables):
    _, manifest = versions.latest(t.spark, _loaded_in_parts(t))
    return refresh.days_done(t.spark, manifest).groupBy("day").agg(F.sum("rows").alias("rows"))


add(
    "refreshed_days",
    _days_done,
    with_(TX, """SELECT strftime("Date", '%Y-%m-%d') AS day, count(*) AS "rows" FROM tx GROUP BY 1"""),
)


# --- the star in buckets ---------------------------------------------------
def _stored_star(t: StarTables):
    """The star loaded into the session's warehouse, and its lines."""
    warehouse.store_star(*(t.table(n) for n in ("lineitem", "orders", "part", "customer", "nation")))
    return warehouse.stored_lines(t.spark)


add(
    "bucketed_invoices",
    lambda t: warehouse.invoice_totals(_stored_star(t)),
    with_(RAW, """SELECT CAST(replace(Invoice, 'INV', '') AS BIGINT) AS order_key, count(*) AS lines, CAST(sum(abs(Quantity)) AS BIGINT) AS items,
      CAST(sum(CAST(abs(Quantity) * Price AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM raw GROUP BY 1"""),
)
add(
    "bucketed_countries",
    lambda t: country_performance(add_features(clean(_stored_star(t)), star.CATEGORY_RULES, star.PRICE_EDGES, fixed.PRICE_LABELS), False),
    queries_tables.QUERIES["country_performance"][1],
)
