import collections
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tillroll.llm import mixing, queries, sharding, sql
from tillroll.llm.common import seeded_hash, word_count


def test_shards_hold_the_mixture(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source")
    )
    rows = sharding.assign(docs, 24).collect()
    total = collections.Counter(r["source"] for r in rows)
    by_shard = collections.defaultdict(collections.Counter)
    slots = collections.defaultdict(list)
    for r in rows:
        by_shard[r["shard"]][r["source"]] += 1
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 6000 and sorted(by_shard) == list(range(24))
    assert {len(x) for x in slots.values()} == {250}
    assert all(sorted(x) == list(range(250)) for x in slots.values())
    for counts in by_shard.values():
        assert all(abs(counts[s] - n / 24) <= 1.5 for s, n in total.items())


def test_shard_sizes_differ_by_one(spark):
    rows = sharding.assign(spark.range(53).select(F.col("id").alias("doc_id"), F.lit("x").alias("source")), 24).collect()
    assert set(collections.Counter(r["shard"] for r in rows).values()) == {2, 3}


def test_sharding_edges(edge_docs, edge_rows, no_docs):
    got = sharding.assign(edge_docs, 5)
    assert len(got.columns) == len(edge_docs.columns) + 1  # shard was there, slot is new
    assert got.count() == len(edge_rows)
    assert sharding.assign(no_docs, 5).count() == 0


def test_written_shards(spark, edge_docs, edge_rows, tmp_path):
    sharding.write_shards(sharding.assign(edge_docs.select("doc_id", "text", "source"), 4), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(edge_rows) and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_crc_and_size(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op1_sharding(spark, sf_dir).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "rows")


def _targets(sizes: dict, weights=(5, 2, 1), limit=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, fixed = {}, set()
    while True:
        left = sum(sizes.values()) - sum(limit * sizes[s] for s in fixed)
        share = sum(weight[s] for s in names if s not in fixed)
        target = {s: limit * sizes[s] if s in fixed else left * weight[s] / share for s in names}
        over = {s for s in names if s not in fixed and target[s] > limit * sizes[s]}
        if not over:
            return target
        fixed |= over


def test_targets_and_sums(spark):
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 50 == 1, "a").when(F.col("id") % 3 == 0, "z").otherwise("m").alias("source"),
        (F.pmod(F.xxhash64("id"), F.lit(200)) + 1).alias("words"),
    )
    rows = mixing.mix(docs, F.col("words")).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["mix_size"]
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        assert 0 <= r["mix_copies"] <= 3
    want = _targets(dict(sizes))
    for r in rows:
        assert math.isclose(r["mix_target"], want[r["source"]], rel_tol=1e-12) and r["mix_source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 200 for s in sizes)
    assert sorted((r["doc_id"], r["mix_copies"]) for r in mixing.mix(docs.repartition(7), F.col("words")).collect()) == sorted((r["doc_id"], r["mix_copies"]) for r in rows)


def test_budgets_are_nested(spark):
    sizes = spark.range(3000).select(F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"), seeded_hash(F.col("id"), "t").alias("hash"))
    rows = mixing.thresholds(sizes, budgets=(0.1, 0.5, 0.9)).orderBy("budget").collect()
    bounds = [r["bound"] for r in rows]
    assert bounds == sorted(bounds) and len(rows) == 3
    hashes = [r[0] for r in sizes.select("hash").collect()]
    assert [3 * sum(h < b for h in hashes) for b in bounds] == [900, 4500, 8100]


def test_mixing_edges(spark, edge_docs, edge_rows, no_docs):
    words = word_count(F.col("text"))
    rows = mixing.mix(edge_docs, words).collect()
    assert len(rows) == len(edge_rows)
    count = {(x[0], x[1]): len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in edge_rows}
    assert all(r["mix_size"] == count[r["doc_id"], r["text"]] for r in rows)
    assert mixing.repeated(edge_docs, words).columns == edge_docs.columns
    assert mixing.repeated(edge_docs, words).count() == sum(r["mix_copies"] for r in rows)
    assert mixing.mix(no_docs, words).count() == 0
    silent = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], no_docs.schema)
    assert [r["mix_copies"] for r in mixing.mix(silent, words).collect()] == [0, 0]
    same = spark.createDataFrame([(7, "w w", "en", "a", 0)] * 10, no_docs.schema)
    assert {r["mix_copies"] for r in mixing.mix(same, words).collect()} == {1}


@pytest.mark.parametrize("texts", [1, 1000])
def test_hot_key_on_the_boundary(spark, texts):
    """A third of the source's rows under one doc_id, with one text or with many: the target is met to a document."""
    rows = [(7, " ".join(["w"] * 9 + [f"x{i % texts}"]), "en", "a", 0) for i in range(1000)]
    rows += [(100 + i, " ".join(["v"] * 10), "en", "a", 0) for i in range(2000)]
    rows += [(None, " ".join(["u"] * 10), "en", None, 0) for _ in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(7)
    words, mark = word_count(F.col("text")), F.md5("text")
    got = mixing.mix(docs, words, mark=mark).collect()
    assert len(got) == len(rows)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        target[r["source"]] = r["mix_target"]
    assert all(abs(taken[s] - target[s]) <= 5 for s in target)
    assert mixing.repeated(docs, words, mark=mark).count() == sum(r["mix_copies"] for r in got)

    def digest(found):
        return sorted(((r["source"] or "", r["doc_id"] or 0, r["text"], r["mix_copies"]) for r in found))

    assert digest(mixing.mix(docs.repartition(3), words, mark=mark).collect()) == digest(got)
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(sql.MIXING.replace("SELECT doc_id, size, source_size, target", "SELECT doc_id, text, copies, source_size, target")).fetchall()
    assert sorted((x[-1] or "", x[0] or 0, x[1], x[2]) for x in want) == digest(got)
