"""Registered queries: experiment statistics, chunks and vector search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillroll.operators import aggregates
from tillroll.operators import chunks as CH
from tillroll.operators import experiments as X
from tillroll.operators.ordering import durable, row_chunks, shared_folder, top_in_group
from tillroll.operators.similarity import cosine_topk
from tillroll.plans.base_sql import CUSTOMERS, PRODUCTS, TX, with_
from tillroll.plans.star_tables import StarTables
from tillroll.sources import sinks, star
from tillroll.sources.tables import scan_chunks

QUERIES = {}
_ARRIVAL = ("ts", "event_id")


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = (build, sql)


def _rounded(df, digits=6, but=()):
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" and c not in but else F.col(c) for c, kind in df.dtypes]
    )


EXP = """
ab AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS g, value AS x,
    event_type = 'purchase' AS hit, ts, event_id FROM events),
st AS (SELECT g, count(x) AS n, avg(x) AS m, stddev_pop(x) AS sd, var_samp(x) AS v, quantile_cont(x, 0.5) AS med
    FROM ab GROUP BY 1),
w AS (SELECT c.n AS n1, c.m AS m1, c.sd AS sd1, c.v AS v1, c.med AS med1, t.n AS n2, t.m AS m2, t.sd AS sd2, t.v AS v2,
    t.med AS med2, ((c.n - 1) * c.v + (t.n - 1) * t.v) / (c.n + t.n - 2) AS pool
    FROM st c, st t WHERE c.g = 'control' AND t.g = 'treatment'),
tt AS (SELECT *, (m1 - m2) / sqrt(pool * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t, (m2 - m1) / m1 * 100 AS rel,
    (m2 - m1) / sqrt(pool) AS d FROM w)"""


def _t_tail(source: str, keys: str, t: str, df: str) -> str:
    """Two-sided p of t by Simpson's rule over the density's tail, which u / (1 - u) maps to 0..1."""
    return f"""p AS (SELECT {keys}, 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi() * {df})
      * sum(CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(1 + pow(abs({t}) + (i / 4000.0::DOUBLE) / (1 - i / 4000.0::DOUBLE), 2) / {df}, -({df} + 1) / 2.0)
        / pow(1 - i / 4000.0::DOUBLE, 2)) / 12000 AS p_value
      FROM {source}, range(4000) AS grid(i) GROUP BY {keys}, {t}, {df})"""


add(
    "ab_ttest",
    lambda t: _rounded(X.ab_ttest(t.experiment, "group", "metric")),
    with_(EXP, ", " + _t_tail("tt", "n1, n2", "t", "(n1 + n2 - 2)") + """SELECT n1 AS control_n, round(m1, 6) AS control_mean, round(sd1, 6) AS control_std,
      round(med1, 6) AS control_median, n2 AS treatment_n, round(m2, 6) AS treatment_mean, round(sd2, 6) AS treatment_std,
      round(med2, 6) AS treatment_median, round(t, 6) AS t_statistic, n1 + n2 - 2 AS degrees_of_freedom,
      round(m2 - m1, 6) AS absolute_difference, round(rel, 6) AS relative_change_percent,
      round(d, 6) AS effect_size_cohens_d, round(p_value, 6) AS p_value FROM tt JOIN p USING (n1, n2)"""),
)
add(
    "ab_mann_whitney",
    lambda t: _rounded(X.ab_mann_whitney(t.experiment, "group", "metric")),
    with_(EXP, """, r AS (SELECT g, x, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r
        FROM ab),
      k AS (SELECT sum(p * p * p - p) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS p FROM ab GROUP BY x)),
      u AS (SELECT sum(r) FILTER (g = 'control') - count(*) FILTER (g = 'control') * (count(*) FILTER (g = 'control') + 1) / 2.0::DOUBLE AS u,
        CAST(count(*) FILTER (g = 'control') AS DOUBLE) AS n1, CAST(count(*) FILTER (g = 'treatment') AS DOUBLE) AS n2 FROM r),
      zz AS (SELECT u, n1, n2, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) /
        sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u, k),
      -- twice the upper tail, by Simpson's rule over 12 units from z on
      p AS (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * exp(-pow(z + i * 0.003::DOUBLE, 2) / 2)) * 0.003::DOUBLE / 3 * 2 / sqrt(2 * pi()) AS p FROM zz, range(4001) AS grid(i))
      SELECT u AS u_statistic, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(z, 6) AS z,
      round(least(1.0::DOUBLE, p), 6) AS p_value FROM zz, p"""),
)
add(
    "ab_bootstrap_ci",
    lambda t: X.ab_bootstrap_ci(t.experiment, "group", "metric"),
)
# |t| at 5% and 1% for these degrees of freedom stands in for p, which SQL lacks.
add(
    "ab_verdict",
    lambda t: X.ab_verdict(X.ab_ttest(t.experiment, "group", "metric")).select(
        "significant", "launch", "confidence_level", "significance", "effect_magnitude", "recommendation"
    ),
    with_(EXP, """, p AS (SELECT abs(t) > 1.9602 AS p5, abs(t) > 2.5763 AS p1, rel, abs(d) AS d FROM tt)
      SELECT p5 AS significant, CASE WHEN p5 AND rel > 0 THEN 'Launch' ELSE 'Don''t Launch' END AS launch,
      CASE WHEN p1 THEN 'High' WHEN p5 THEN 'Medium' ELSE 'Low' END AS confidence_level,
      CASE WHEN p1 THEN 'Highly significant (p < 0.01)' WHEN p5 THEN 'Significant (p < 0.05)'
        ELSE 'Not significant (p >= 0.05)' END AS significance,
      CASE WHEN d < 0.2 THEN 'Small effect' WHEN d < 0.5 THEN 'Medium effect' ELSE 'Large effect' END AS effect_magnitude,
      CASE WHEN NOT p5 THEN 'Insufficient evidence to launch' WHEN rel > 2 THEN 'Strong recommendation to launch'
        WHEN rel > 0 THEN 'Moderate recommendation to launch' ELSE 'Do not launch - negative impact' END AS recommendation
      FROM p"""),
)
QUARTILES = CUSTOMERS + """,
qq AS (SELECT quantile_cont(CAST(Total_Spent AS DOUBLE), 0.25) AS a, quantile_cont(CAST(Total_Spent AS DOUBLE), 0.5) AS b,
    quantile_cont(CAST(Total_Spent AS DOUBLE), 0.75) AS c FROM customers),
seg AS (SELECT *, CAST(Total_Spent AS DOUBLE) AS x, CASE WHEN CAST(Total_Spent AS DOUBLE) <= a THEN 'Low'
    WHEN CAST(Total_Spent AS DOUBLE) <= b THEN 'Medium' WHEN CAST(Total_Spent AS DOUBLE) <= c THEN 'High'
    ELSE 'Premium' END AS Spending_Quartile FROM customers, qq)"""


def _quartiles(t: StarTables):
    return X.quartile_segment(t.stored_customers, "Total_Spent")


add(
    "quartile_segment",
    lambda t: _quartiles(t).select("Customer_ID", "Country", "Spending_Quartile"),
    with_(QUARTILES, "SELECT Customer_ID, Country, Spending_Quartile FROM seg"),
)
add(
    "segment_summary",
    lambda t: _rounded(X.segment_summary(_quartiles(t)), 3, ("mean_spent", "mean_orders")),
    with_(QUARTILES, """SELECT Spending_Quartile, count(*) AS customers,
      CAST(sum(Total_Spent) AS DOUBLE) / count(*) AS mean_spent, round(stddev_samp(x), 3) AS std_spent,
      CAST(sum(Total_Orders) AS DOUBLE) / count(*) AS mean_orders,
      round(avg(Avg_Order_Value), 3) AS mean_order_value, round(quantile_cont(x, 0.5), 3) AS median_spent
      FROM seg GROUP BY 1"""),
)
add(
    "segment_pairwise_ttest",
    lambda t: _rounded(X.segment_pairwise_ttest(_quartiles(t)), 3),
    with_(QUARTILES, """, s AS (SELECT Spending_Quartile AS k, CASE Spending_Quartile WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2
        WHEN 'High' THEN 3 ELSE 4 END AS i, count(x) AS n, avg(x) AS m, var_samp(x) AS v, var_pop(x) AS vp FROM seg GROUP BY 1),
      pairs AS (SELECT a.k AS k1, b.k AS k2, a.m AS m1, b.m AS m2, a.n AS n1, b.n AS n2, (b.m - a.m) / sqrt((a.vp + b.vp) / 2) AS e,
      (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)) AS t
      FROM s a JOIN s b ON a.i < b.i WHERE a.n > 10 AND b.n > 10), """ + _t_tail("pairs", "k1, k2", "t", "(n1 + n2 - 2)") + """
      SELECT k1 AS segment_1, k2 AS segment_2, round(m1, 3) AS segment_1_mean, round(m2, 3) AS segment_2_mean,
      round(m2 - m1, 3) AS difference, round(t, 3) AS t_statistic, round(p_value, 3) AS p_value, p_value < 0.05 AS significant,
      round(e, 3) AS effect_size, n1 AS sample_size_1, n2 AS sample_size_2 FROM pairs JOIN p USING (k1, k2)"""),
)
add(
    "ab_bayes_posterior",
    lambda t: X.bayes_posterior(t.experiment, "group", "converted"),
    with_(EXP, """, c AS (SELECT count(*) FILTER (g = 'control' AND hit) AS a, count(*) FILTER (g = 'control') AS an,
        count(*) FILTER (g = 'treatment' AND hit) AS b, count(*) FILTER (g = 'treatment') AS bn FROM ab)
      SELECT a AS control_conversions, an AS control_total, b AS treatment_conversions, bn AS treatment_total,
      CAST(a AS DOUBLE) / an AS control_rate, a + 1 AS control_alpha, an - a + 1 AS control_beta,
      CAST(b AS DOUBLE) / bn AS treatment_rate, b + 1 AS treatment_alpha, bn - b + 1 AS treatment_beta FROM c"""),
)
add("ab_bayes", lambda t: X.ab_bayes(t.experiment, "group", "converted"))
_SEQ = """, rn AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY ts, event_id) AS r FROM ab),
  run AS (SELECT g, r, avg(x) OVER o AS m, var_samp(x) OVER o AS v FROM rn
    WINDOW o AS (PARTITION BY g ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  looks AS (SELECT c.r AS n, (c.m - t.m) / sqrt((c.v + t.v) / c.r) AS t FROM run c JOIN run t ON c.r = t.r
    WHERE c.g = 'control' AND t.g = 'treatment' AND c.r >= 50 AND c.r % 10 = 0
    AND c.r < (SELECT min(n) FROM st))"""
add(
    "sequential_looks",
    lambda t: _rounded(X.sequential_looks(t.experiment, "group", "metric", _ARRIVAL), 5),
    with_(EXP, _SEQ + ", " + _t_tail("looks", "n", "t", "(2 * n - 2)") + """
      SELECT n AS sample_size, round(t, 5) AS t_statistic, round(p_value, 5) AS p_value FROM looks JOIN p USING (n)"""),
)
add(
    "sequential_test",
    lambda t: _rounded(X.sequential_test(t.experiment, "group", "metric", _ARRIVAL), but=("alpha_spent_per_test",)),
    with_(EXP, _SEQ + ", " + _t_tail("looks", "n", "t", "(2 * n - 2)") + """,
      l AS (SELECT *, 0.05::DOUBLE / count(*) OVER () AS level FROM p),
      e AS (SELECT (SELECT min(n) FROM st) AS total_samples_available, count(*) AS tests_performed, max(level) AS alpha_spent_per_test,
        min(n) FILTER (p_value < level) AS early_stopping_point, round(max_by(p_value, n), 6) AS final_p_value FROM l)
      SELECT *, CASE WHEN early_stopping_point IS NULL THEN 'Continue to planned sample size' ELSE 'Stop early' END
      AS recommendation FROM e"""),
)
add(
    "assign_variants",
    lambda t: X.assign_variants(t.table("customer"), "c_custkey", ["control", "a", "b"], [0.5, 0.25, 0.25], "s1")
    .select("c_custkey", "variant"),
    f"""SELECT c_custkey, CASE WHEN h < {1 << 59} THEN 'control' WHEN h < {3 << 58} THEN 'a' ELSE 'b' END AS variant
      FROM (SELECT c_custkey, ('0x' || substr(md5('s1:' || c_custkey), 1, 15))::BIGINT AS h FROM customer)""",
)

# --- blocks of rows and chunks ---------------------------------------------
_LINES = "InvoiceDate, Invoice, StockCode, Quantity, Price"
add(
    "row_chunks",
    lambda t: row_chunks(t.tx.select(*star.LINE_ORDER, "Revenue"), star.LINE_ORDER, 50)
    .groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum("Revenue").alias("revenue")),
    with_(TX, f""", r AS (SELECT Revenue, (row_number() OVER (ORDER BY {_LINES}) - 1) // 50 + 1 AS chunk FROM tx)
      SELECT chunk, count(*) AS "rows", CAST(sum(Revenue) AS DOUBLE) AS revenue FROM r GROUP BY 1"""),
)
add(
    "top_in_group",
    lambda t: top_in_group(t.tx, ["Product_Category"], "Country", 3),
    with_(TX, """, c AS (SELECT Product_Category, Country, count(*) AS n FROM tx GROUP BY 1, 2)
      SELECT Product_Category, Country, n, CAST(place AS INTEGER) AS place FROM (
        SELECT *, row_number() OVER (PARTITION BY Product_Category ORDER BY n DESC, Country) AS place FROM c)
      WHERE place <= 3"""),
)


def _chunk_sql(ctes: str, src: str, order: str, top: str) -> str:
    """Row blocks, and `{'A': 3, 'B': 1}` text of a column's counts per block."""
    col, n = top.split(":")
    limit = f"WHERE k <= {n}" if n else ""
    return ctes + f""",
r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS "row" FROM {src}),
c AS (SELECT *, ("row" - 1) // 50 + 1 AS chunk FROM r),
tc AS (SELECT chunk, '{{' || string_agg('''' || v || ''': ' || n, ', ' ORDER BY n DESC, v) || '}}' AS counted FROM (
    SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY n DESC, v) AS k FROM (
      SELECT chunk, {col} AS v, count(*) AS n FROM c GROUP BY 1, 2)) {limit} GROUP BY 1)"""


add(
    "transaction_chunks",
    lambda t: CH.transaction_chunks(t.tx, star.LINE_ORDER).select(
        "chunk_id", "start_idx", "end_idx", "rows", "revenue", "customers", "products", "date_range",
        "top_countries", "avg_order_value", F.regexp_count("content", F.lit("\n")).alias("line_breaks"),
    ),
    with_(_chunk_sql(TX, "tx", _LINES, "Country:3"), """SELECT 'transactions_' || chunk AS chunk_id, (chunk - 1) * 50 AS start_idx,
      (chunk - 1) * 50 + count(*) AS end_idx, count(*) AS "rows", CAST(sum(Revenue) AS DOUBLE) AS revenue,
      CAST(count(DISTINCT Customer_ID) AS INTEGER) AS customers, CAST(count(DISTINCT StockCode) AS INTEGER) AS products,
      strftime(min("Date"), '%Y-%m-%d') || ' to ' || strftime(max("Date"), '%Y-%m-%d') AS date_range,
      any_value(counted) AS top_countries, CAST(sum(Total_Amount) AS DOUBLE) / count(*) AS avg_order_value, 7::INTEGER AS line_breaks
      FROM c JOIN tc USING (chunk) GROUP BY chunk"""),
)
add(
    "customer_chunks",
    lambda t: CH.customer_chunks(t.customers, [F.desc("Total_Spent"), "Customer_ID", "Country"]).select(
        "chunk_id", "start_idx", "end_idx", "rows", "total_spent", "avg_spent", "min_spent", "max_spent", "top_countries"
    ),
    with_(_chunk_sql(CUSTOMERS, "customers", "Total_Spent DESC, Customer_ID, Country", "Country:3"),
          """SELECT 'customers_' || chunk AS chunk_id, (chunk - 1) * 50 AS start_idx, (chunk - 1) * 50 + count(*) AS end_idx,
      count(*) AS "rows", CAST(sum(Total_Spent) AS DOUBLE) AS total_spent, CAST(sum(Total_Spent) AS DOUBLE) / count(*) AS avg_spent,
      CAST(min(Total_Spent) AS DOUBLE) AS min_spent, CAST(max(Total_Spent) AS DOUBLE) AS max_spent,
      any_value(counted) AS top_countries FROM c JOIN tc USING (chunk) GROUP BY chunk"""),
)
add(
    "product_chunks",
    lambda t: CH.product_chunks(t.products, [F.desc("Total_Revenue"), "StockCode", "Description"]).select(
        "chunk_id", "start_idx", "end_idx", "rows", "total_revenue", "min_revenue", "max_revenue", "top_product",
        "top_revenue", "categories",
    ),
    with_(_chunk_sql(PRODUCTS, "products", "Total_Revenue DESC, StockCode, Description", "Product_Category:"),
          """SELECT 'products_' || chunk AS chunk_id, (chunk - 1) * 50 AS start_idx, (chunk - 1) * 50 + count(*) AS end_idx,
      count(*) AS "rows", CAST(sum(Total_Revenue) AS DOUBLE) AS total_revenue, CAST(min(Total_Revenue) AS DOUBLE) AS min_revenue,
      CAST(max(Total_Revenue) AS DOUBLE) AS max_revenue, arg_min(StockCode, "row") AS top_product,
      CAST(arg_min(Total_Revenue, "row") AS DOUBLE) AS top_revenue, any_value(counted) AS categories
      FROM c JOIN tc USING (chunk) GROUP BY chunk"""),
)


def _catalog(t: StarTables):
    """The fact, stored once, and the customers and products made from it, so that the star is joined once."""
    tx = t.stored_tx
    return {
        "retail_transactions_processed": tx,
        "customer_analysis": aggregates.customer_analysis(tx, ordered=False),
        "product_performance": aggregates.product_performance(tx, ordered=False),
    }


add(
    "chunk_stats",
    lambda t: CH.chunk_stats(CH.build_chunks(_catalog(t), star.LINE_ORDER)),
    with_(CUSTOMERS + PRODUCTS[len(TX):], """, n AS (
        SELECT 'transactions' AS chunk_type, (count(*) + 49) // 50 AS chunks FROM tx
        UNION ALL SELECT 'customer_analysis', (count(*) + 49) // 50 FROM customers
        UNION ALL SELECT 'product_performance', (count(*) + 49) // 50 FROM products)
      SELECT * FROM n UNION ALL SELECT 'total', CAST(sum(chunks) AS BIGINT) FROM n"""),
)


def _all_chunks(t: StarTables):
    """Chunks of the fact, the customers and the products."""
    return durable(CH.build_chunks(_catalog(t), star.LINE_ORDER))


add(
    "embed_chunks",
    lambda t: CH.embed_chunks(_all_chunks(t)).select("chunk_type", "chunk_id", F.size("embedding").alias("dims")),
)


def _search(t: StarTables):
    chunks = _all_chunks(t)
    model = CH.embedder().fit(chunks)
    embedded = CH.apply_embedder(model, chunks)
    return CH.search_chunks(model, embedded, "top product revenue range", 5, ["product_performance"])


add(
    "search_chunks",
    lambda t: _search(t).select("chunk_type", "chunk_id", "place", "relevance_pct", "metadata"),
)


def _centroids(t: StarTables):
    """One query vector per label: the mean of the label's vectors."""
    cells = t.table("embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg("x").alias("x"))
    # A label's list holds one value per dimension.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda e: e["x"]).alias("embedding"))


def _topk(t: StarTables, vectors, k: int):
    queries = _centroids(t).select(F.col("label").cast("long").alias("vec_id"), "embedding")
    return cosine_topk(queries, vectors, k).withColumn("similarity", F.round("similarity", 6))


def _topk_sql(k: int, where: str = "true") -> str:
    return f"""WITH cells AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
        FROM embeddings),
      c AS (SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM cells GROUP BY 1, 2) GROUP BY 1),
      q AS (SELECT CAST(c.label AS BIGINT) AS query_id, e.vec_id AS vector_id,
        list_cosine_similarity(c.v, e.embedding::DOUBLE[]) AS s FROM c, embeddings e WHERE {where}),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vector_id) AS place FROM q)
      SELECT query_id, vector_id, round(s, 6) AS similarity, CAST(place AS INTEGER) AS place FROM r WHERE place <= {k}"""


add("cosine_topk", lambda t: _topk(t, t.table("embeddings"), 5), _topk_sql(5))
add(
    "cosine_topk_typed",
    lambda t: _topk(t, scan_chunks(t.table("embeddings"), [1, 2, 3], "label"), 3),
    _topk_sql(3, "e.label IN (1, 2, 3)"),
)
add(
    "chunks_by_type",
    lambda t: scan_chunks(t.table("embeddings"), [1, 2], "label").select("vec_id", "label"),
    "SELECT vec_id, label FROM embeddings WHERE label IN (1, 2)",
)


def _documents(t: StarTables, fresh: bool):
    """Documents as chunks; the fresh load has the English ones again, with a mark."""
    text = F.concat("text", F.lit(" v2")) if fresh else F.col("text")
    docs = t.table("documents")
    docs = docs.filter(F.col("lang") == "en") if fresh else docs
    return docs.select(
        F.col("source").alias("chunk_type"), F.col("doc_id").cast("string").alias("chunk_id"), text.alias("content")
    )


_UPSERTED = """SELECT source AS chunk_type, CAST(doc_id AS VARCHAR) AS chunk_id,
      md5(CASE WHEN lang = 'en' THEN text || ' v2' ELSE text END) AS content_md5 FROM documents"""


def _sums(chunks):
    return chunks.select("chunk_type", "chunk_id", F.md5("content").alias("content_md5"))


add(
    "upsert_chunks",
    lambda t: _sums(CH.upsert_chunks(_documents(t, False), _documents(t, True))),
    _UPSERTED,
)


def _chunk_store(t: StarTables):
    """Chunks stored, and replaced in place by a merge with a fresh load."""
    root = f"{shared_folder(t.spark)}/chunks-{uuid.uuid4()}"
    number = sinks.save_chunks(_documents(t, False), root)
    old = sinks.stored_chunks(t.spark, root)[1]
    sinks.save_chunks(CH.upsert_chunks(old.select("chunk_type", "chunk_id", "content"), _documents(t, True)), root, number)
    return _sums(sinks.stored_chunks(t.spark, root)[1])


add("chunk_store", _chunk_store, _UPSERTED)
