"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import mixing, ngram_join, packing, quality, toxicity
from tillroll.llm.common import keep_rows, key_residue, stored, table, training_marks, word_count


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3, learned from the labelled ones outside the held-out fifth."""
    learn = key_residue(F.col("doc_id"), 5) != 0
    marks = training_marks(table(spark, sf_dir, "labels"), "quality", learn, "doc_id")
    known = docs.join(F.broadcast(marks), docs["doc_id"] == marks["_key"], "left_semi")
    model = quality.fit(quality.labelled(quality.measured(known), marks))
    return keep_rows(docs, "text", quality.tester(model, 0.3))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7, learned from the labelled ones outside the held-out third."""
    learn = key_residue(F.col("doc_id"), 3) != 1
    train = toxicity.labelled(docs, table(spark, sf_dir, "labels"), "toxic", learn)
    return keep_rows(docs, "text", toxicity.tester(toxicity.fit(train), 0.7))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word sets, similarity 0.8 or more) the smallest doc_id."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 by words; a document taken twice is there twice."""
    return mixing.repeated(docs, word_count(F.col("text")), mark=F.md5("text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages fit models and run a tokenizer, which SQL cannot; tests hold stages against labels and the operators by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
