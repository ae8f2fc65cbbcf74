"""Summary chunks of tables: blocks of rows, rendered text, embeddings and search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import counted_map, mean_of
from tillroll.operators.aggregates import TOTAL
from tillroll.operators.ordering import row_chunks
from tillroll.operators.similarity import cosine_topk, with_details


def _frequent(values: Column, n: int | None = None) -> Column:
    """(key, n) of the values in a block's list, most frequent first, ties by key."""
    counted = F.transform(
        F.array_distinct(values),
        lambda v: F.struct(
            (-F.size(F.filter(values, lambda x: x == v))).alias("neg"), v.alias("key")
        ),
    )
    ranked = F.transform(
        F.array_sort(counted), lambda e: F.struct(e["key"].alias("key"), (-e["neg"]).alias("n"))
    )
    return ranked if n is None else F.slice(ranked, 1, n)


def _pounds(c: Column, grouped: bool = True) -> Column:
    return F.format_string("£%,.2f" if grouped else "£%.2f", c.cast("double"))


def _text(title: Column, lines: Sequence[tuple[str, Column]]) -> Column:
    parts = [title] + [F.concat(F.lit(f"- {label}: "), c.cast("string")) for label, c in lines]
    return F.concat_ws(fixed.CHUNK_INDENT, *parts)


def _finish(df: DataFrame, kind: str, prefix: str, size: int, content: Column, meta: Sequence[str]):
    first = (F.col("chunk") - 1) * size
    framed = df.withColumns({"start_idx": first, "end_idx": first + F.col("rows")})
    return framed.withColumns(
        {
            "chunk_type": F.lit(kind),
            "chunk_id": F.concat(F.lit(f"{prefix}_"), F.col("chunk").cast("string")),
            "content": content,
            "metadata": F.to_json(F.struct("start_idx", "end_idx", *meta)),
        }
    )


def transaction_chunks(tx: DataFrame, order: Sequence, size: int = fixed.CHUNK_ROWS) -> DataFrame:
    """One row per block of fact rows. A block's lists hold at most `size` values."""
    slim = tx.select(
        *{c: None for c in [*order, "Revenue", "Total_Amount", "Customer_ID", "StockCode", "Country", "Date"]}
    )
    blocks = (
        row_chunks(slim, order, size)
        .groupBy("chunk")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("Revenue").cast(TOTAL).alias("revenue"),
            mean_of(F.col("Total_Amount")).alias("avg_order_value"),
            F.size(F.collect_set("Customer_ID")).alias("customers"),
            F.size(F.collect_set("StockCode")).alias("products"),
            F.collect_list("Country").alias("_countries"),
            F.concat(
                F.min("Date").cast("string"), F.lit(" to "), F.max("Date").cast("string")
            ).alias("date_range"),
        )
        .withColumn("top_countries", counted_map(_frequent(F.col("_countries"), 3)))
        .drop("_countries")
    )
    content = _text(
        F.concat(F.lit("Transaction Segment "), F.col("chunk").cast("string"), F.lit(":")),
        [
            ("Date Range", F.col("date_range")),
            ("Total Revenue", _pounds(F.col("revenue"))),
            ("Unique Customers", F.col("customers")),
            ("Unique Products", F.col("products")),
            ("Top Countries", F.col("top_countries")),
            ("Transaction Count", F.col("rows")),
            ("Average Order Value", _pounds(F.col("avg_order_value"), grouped=False)),
        ],
    )
    return _finish(
        blocks, "transactions", "transactions", size, content,
        ["revenue", "date_range", "customers", "products"],
    )


def customer_chunks(customers: DataFrame, order: Sequence, size: int = fixed.CHUNK_ROWS) -> DataFrame:
    blocks = (
        row_chunks(customers, order, size)
        .groupBy("chunk")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("Total_Spent").cast(TOTAL).alias("total_spent"),
            mean_of(F.col("Total_Spent")).alias("avg_spent"),
            F.min("Total_Spent").alias("min_spent"),
            F.max("Total_Spent").alias("max_spent"),
            F.collect_list("Country").alias("_countries"),
        )
        .withColumn("top_countries", counted_map(_frequent(F.col("_countries"), 3)))
        .withColumn("customer_count", F.col("rows"))
        .drop("_countries")
    )
    spending = F.concat(
        _pounds(F.col("min_spent"), grouped=False), F.lit(" - "), _pounds(F.col("max_spent"), grouped=False)
    )
    content = _text(
        F.concat(F.lit("Customer Segment "), F.col("chunk").cast("string"), F.lit(":")),
        [
            ("Customer Count", F.col("rows")),
            ("Total Spending", _pounds(F.col("total_spent"))),
            ("Average Spending", _pounds(F.col("avg_spent"), grouped=False)),
            ("Countries", F.col("top_countries")),
            ("Spending Range", spending),
        ],
    )
    return _finish(
        blocks, "customer_analysis", "customers", size, content, ["total_spent", "customer_count"]
    )


def product_chunks(products: DataFrame, order: Sequence, size: int = fixed.CHUNK_ROWS) -> DataFrame:
    blocks = (
        row_chunks(products, order, size)
        .groupBy("chunk")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("Total_Revenue").cast(TOTAL).alias("total_revenue"),
            F.min("Total_Revenue").alias("min_revenue"),
            F.max("Total_Revenue").alias("max_revenue"),
            F.min_by(F.struct("StockCode", "Total_Revenue"), "row").alias("_top"),
            F.collect_list("Product_Category").alias("_categories"),
        )
        .withColumn("categories", counted_map(_frequent(F.col("_categories"))))
        .withColumn("top_product", F.col("_top.StockCode"))
        .withColumn("top_revenue", F.col("_top.Total_Revenue"))
        .withColumn("product_count", F.col("rows"))
        .drop("_top", "_categories")
    )
    revenue = F.concat(
        _pounds(F.col("min_revenue"), grouped=False), F.lit(" - "), _pounds(F.col("max_revenue"), grouped=False)
    )
    content = _text(
        F.concat(F.lit("Product Performance Segment "), F.col("chunk").cast("string"), F.lit(":")),
        [
            ("Product Count", F.col("rows")),
            ("Total Revenue", _pounds(F.col("total_revenue"))),
            ("Categories", F.col("categories")),
            ("Top Product", F.concat(F.col("top_product"), F.lit(" ("), _pounds(F.col("top_revenue")), F.lit(")"))),
            ("Revenue Range", revenue),
        ],
    )
    return _finish(
        blocks, "product_performance", "products", size, content, ["total_revenue", "product_count"]
    )


def embedder(dims: int = 1024) -> Pipeline:
    """Hashed TF-IDF of unit length. The fitted model also embeds query texts."""
    return Pipeline(
        stages=[
            Tokenizer(inputCol="content", outputCol="_words"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_vector"),
        ]
    )


def apply_embedder(model, df: DataFrame) -> DataFrame:
    return (
        model.transform(df)
        .withColumn("embedding", vector_to_array("_vector", "float32"))
        .drop("_words", "_tf", "_tfidf", "_vector")
    )


def embed_chunks(chunks: DataFrame, dims: int = 1024) -> DataFrame:
    """Adds `embedding` to rows with `content`."""
    return apply_embedder(embedder(dims).fit(chunks), chunks)


def _slim(df: DataFrame) -> DataFrame:
    return df.select("chunk_type", "chunk_id", "content", "metadata")


def build_chunks(catalog: Mapping[str, DataFrame], tx_order: Sequence, size: int = fixed.CHUNK_ROWS) -> DataFrame:
    """Chunks of the fact, the customers and the products that the catalog holds."""
    makers = {
        "retail_transactions_processed": lambda d: transaction_chunks(d, tx_order, size),
        "customer_analysis": lambda d: customer_chunks(
            d, [F.desc("Total_Spent"), "Customer_ID", "Country"], size
        ),
        "product_performance": lambda d: product_chunks(
            d, [F.desc("Total_Revenue"), "StockCode", "Description"], size
        ),
    }
    out = None
    for name, make in makers.items():
        if name in catalog:
            part = _slim(make(catalog[name]))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the catalog holds none of the tables that are cut into chunks")
    return out


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables with one row per (type, id); a new row replaces an old one, and of rows equally new
    the later and then the greater one stays.

    The winner is a maximum, so copies of one key shrink before the shuffle.
    """
    both = old.withColumn("_version", F.lit(0)).unionByName(new.withColumn("_version", F.lit(1)))
    rest = [c for c in old.columns if c not in ("chunk_type", "chunk_id")]
    order = [*[c for c in rest if c == "created_at"], F.to_json(F.struct(*rest))]
    newest = F.max_by(F.struct(*rest), F.struct("_version", *order))
    return (
        both.groupBy("chunk_type", "chunk_id")
        .agg(newest.alias("_row"))
        .select("chunk_type", "chunk_id", "_row.*")
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Rows per type, and a total."""
    return (
        chunks.rollup("chunk_type")
        .agg(F.count(F.lit(1)).alias("chunks"), F.grouping("chunk_type").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, "total").otherwise(F.col("chunk_type")).alias("chunk_type"), "chunks"
        )
    )


def search_chunks(
    model, embedded: DataFrame, query: str, k: int = 5, types: Sequence[str] | None = None
) -> DataFrame:
    """The k chunks nearest to a query text, with text, metadata and relevance."""
    spark = embedded.sparkSession
    asked = apply_embedder(model, spark.createDataFrame([("query", query)], "_key string, content string"))
    pool = embedded.filter(F.col("chunk_type").isin(list(types))) if types else embedded
    pool = pool.withColumn("_key", F.concat_ws("/", "chunk_type", "chunk_id"))
    hits = cosine_topk(asked, pool, k, "_key", "_key")
    return with_details(hits, pool, "_key", ["chunk_type", "chunk_id", "content", "metadata"])
