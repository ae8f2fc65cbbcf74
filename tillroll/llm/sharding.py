"""Sharding by proportional stratified interleaving.

Rows of each source are put in seeded-shuffled order. Row r of n gets the fraction
(2r - 1) / 2n, all rows are put in order of their fraction, and that order is cut into blocks
whose lengths differ by one at most. Every block then holds the sources in the proportion of
the whole table, give or take one row for each source.

Ranks come from bucket counts: a bucket is a range of hashes (then of fractions) that is
expected to hold `BUCKET_ROWS` rows, so a source with a third of all rows is spread over as many
tasks as its size asks for. A rank is the count of the buckets before plus the place inside.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import HASH_BITS, seeded_hash, stored

BUCKET_ROWS = 2048


def assign(
    docs: DataFrame, shards: int, key: str = "doc_id", source: str = "source", seed: str = "shard"
) -> DataFrame:
    """`docs` with `shard` (0 to shards - 1) and `slot` (from 0 in each shard) added, or put in place of others.

    The law is `rows`: shard counts are at most one apart, whatever the texts are, so equal texts
    may lie in different shards. A null source is a source of its own, a null key hashes as the
    word null, and rows that agree in every column are interchangeable. An empty table gives no
    rows. All columns of `docs` travel with the rows: pass only those that are wanted.
    """
    laid = stored(
        docs.select(
            F.struct("*").alias("row"), F.col(key).alias("key"), F.col(source).alias("source"),
            seeded_hash(F.col(key), seed).alias("hash"), F.xxhash64(F.struct("*")).alias("tie"),
        )
    )
    total = laid.count()
    bits = max(0, math.ceil(math.log2(max(1, total / BUCKET_ROWS))))

    laid = laid.withColumn("bin", F.shiftright("hash", HASH_BITS - bits))
    counts = laid.groupBy(F.col("source").alias("_source"), F.col("bin").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("_source").orderBy("_bin")
    before = counts.withColumn("_before", F.sum("_n").over(run) - F.col("_n")).withColumn(
        "_all", F.sum("_n").over(Window.partitionBy("_source"))
    )
    inside = Window.partitionBy("source", "bin").orderBy("hash", "key", "tie")
    ranked = laid.withColumn("_at", F.row_number().over(inside)).join(
        before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin"))
    )
    share = ((2 * (F.col("_before") + F.col("_at")) - 1) / (2 * F.col("_all"))).cast("double")
    spread = ranked.select("row", "key", "source", "hash", "tie", share.alias("share"))

    spread = spread.withColumn("bin", F.floor(F.col("share") * (1 << bits)))
    sums = spread.groupBy(F.col("bin").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per bucket, of about BUCKET_ROWS rows each.
    starts = sums.withColumn("_start", F.sum("_n").over(Window.orderBy("_bin")) - F.col("_n")).drop("_n")
    order = Window.partitionBy("bin").orderBy("share", "hash", "source", "key", "tie")
    placed = spread.withColumn("_at", F.row_number().over(order)).join(starts, F.col("bin") == F.col("_bin"))
    # Whole-number division, so that the cut does not hang on rounding.
    placed = placed.withColumn("place", F.col("_start") + F.col("_at") - 1)
    shard = F.expr(f"(place * {shards}L) div {max(1, total)}L")
    placed = placed.withColumn("shard", shard)
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*kept, F.col("shard").cast("int").alias("shard"), (F.col("place") - first).cast("long").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder `shard=<n>` per shard, its rows in slot order; a shard's size is its table's / shards."""
    (
        assigned.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
