import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillroll.llm import mixing, ngram_join, packing, queries
from tillroll.llm.common import stored, table


def test_stage_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_copies", "mixing", "packing"]


@pytest.fixture(scope="module")
def passed(spark):
    """What each stage was given and gave, over one table."""
    sf, out = "/root/testdata/sf0.01", []
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, sf))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_take_effect(passed):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, before, after in passed[:-1]:
        assert after.columns == columns, name
    sizes = [passed[0][1].count(), *(after.count() for _, _, after in passed)]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    labels = table(passed[0][1].sparkSession, "/root/testdata/sf0.01", "labels")
    lost = passed[0][1].join(passed[0][2], "doc_id", "left_anti").join(labels, "doc_id").filter("quality = 1").count()
    kept = passed[0][2].join(labels, "doc_id").filter("quality = 0").count()
    assert lost <= 3 and kept <= 3
    assert passed[1][1].join(passed[1][2], "doc_id", "left_anti").join(labels, "doc_id").filter("toxic = 0").count() <= 3


def test_near_copies_stage(passed):
    _, before, after = passed[2]
    found = ngram_join.near_duplicates(before, size=5, percent=80).filter("doc_id = component_id")
    assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in after.select("doc_id").collect())


def test_mixing_stage_repeats(passed):
    _, before, after = passed[3]
    mixed = mixing.mix(before, queries.word_count(F.col("text")), mark=F.md5("text")).collect()
    got = collections.Counter(r[0] for r in after.select("doc_id").collect())
    assert got == collections.Counter({r["doc_id"]: r["mix_copies"] for r in mixed if r["mix_copies"]})


def test_packing_stage(passed):
    _, before, after = passed[4]
    tokens = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n <> 2048").count()
    assert tokens <= 1
    copies = before.groupBy("doc_id").count().collect()
    first = {r["doc_id"]: r["count"] for r in after.filter("start = 0").groupBy("doc_id").count().collect()}
    assert first == {r["doc_id"]: r["count"] for r in copies}


def test_stages_on_odd_and_empty_tables(spark, edge_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for empty, docs in ((False, edge_docs), (True, no_docs)):
        for name, stage in corpus_pipeline.STAGES:
            after = stored(stage(spark, docs, sf))
            if name != "packing":
                assert after.columns == docs.columns, name
            assert (after.count() == 0) == empty, name
            docs = after if name != "packing" else docs


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == packing.pack(table(spark, sf_dir, "documents").limit(0)).columns
