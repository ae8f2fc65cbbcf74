"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    edit_counts, language_model, lexical, mixing, neighbours, ngram_join, packing, quality, sharding, sql, topk, toxicity, warc, whitening,
)
from tillroll.llm.common import key_residue, seeded_hash, stored, table, training_marks, word_count


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents interleaved into 24 shards; the law is `rows`."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    return sharding.assign(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labelled ones outside the held-out fifth."""
    held_out = key_residue(F.col("doc_id"), 5) == 0
    features = stored(quality.measured(table(spark, sf_dir, "documents")))
    marks = training_marks(table(spark, sf_dir, "labels"), "quality", ~held_out, "doc_id")
    train = quality.labelled(features, marks)
    return quality.scored(features, quality.fit(train)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents concatenated and cut into windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest inner products of every 50th vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0, 5)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from the documents outside the held-out fifth."""
    held_out = key_residue(F.col("doc_id"), 5) == 1
    return language_model.score(table(spark, sf_dir, "documents"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every 100th vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0, 10)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: 4-word sets, similarity 0.85 or more."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by words, sources weighing 5, 2, 1 in turn, at most 3 times their size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("words"), F.md5("text").alias("mark"))
    return mixing.mix(docs, F.col("words"), mark=F.col("mark")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"), "source",
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits of its own.

    Seventeen characters go at one place, the source and language come in at another, and the first
    character becomes a heading mark; the places follow from the doc_id.
    """
    chars = F.coalesce(F.length("text"), F.lit(0)) + 1

    def change(place, removed, inserted):
        return F.struct(place.cast("long").alias("at"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))

    named = F.concat(F.lit(" "), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit(": "))
    edits = F.array(
        change(F.pmod(seeded_hash(F.col("doc_id"), "cut"), chars), 17, F.lit("")),
        change(F.pmod(seeded_hash(F.col("doc_id"), "put"), chars), 0, named),
        change(F.lit(0), 1, F.lit("# ")),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    done = edit_counts.edited(stored(edit_counts.counted(docs)), edits)
    return done.select(
        "doc_id", "tokens_before", "tokens", F.length("text").cast("long").alias("chars"), "recounted",
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labelled ones outside the held-out third."""
    held_out = key_residue(F.col("doc_id"), 3) == 1
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first 32 whitened components, fitted to all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, "embedding", 32)
    white = whitening.transform(rows, "vec_id", "embedding", model)
    shares = [] if model is None else model.explained.tolist()
    return white.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("key").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(0 if model is None else model.n).cast("long").alias("n"),
        "deviation", "whitened", F.element_at(F.array(*map(F.lit, shares or [0.0])), F.col("at") + 1).alias("explained"),
        F.lit(0.0 if model is None else model.identity_error).alias("identity_error"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back from the archives."""
    path = warc.new_folder(spark)
    pages = table(spark, sf_dir, "pages")
    warc.write(pages, path, "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    return warc.resolved(warc.read(spark, path)).select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_key").cast(kind).alias("refers_to"), "status",
    )


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    found = lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_packing": op3_packing,
    "op4_topk": op4_topk,
    "op5_language_model": op5_language_model,
    "op6_ngram_join": op6_ngram_join,
    "op7_neighbours": op7_neighbours,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_warc": op12_warc,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL = {
    "op1_sharding": sql.SHARDING,
    "op4_topk": sql.TOP_K,
    "op8_mixing": sql.MIXING,
    "op12_warc": sql.WARC,
    "op13_lexical": sql.LEXICAL,
}
