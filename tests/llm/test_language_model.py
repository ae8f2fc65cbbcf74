import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tillroll.llm import language_model, queries

_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_LOW)), None]


def _check_base(rows, texts, learned):
    count = collections.Counter()
    for k, t in texts:
        if learned(k):
            count.update(_tokens(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for k, t in texts:
        w = _tokens(t)
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) if n else None
        want[k, len(w), sum(count[x] > 0 for x in w), n, base and round(base, 5)] += 1
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows)
    assert got == want


def test_query_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_language_model(spark, sf).collect()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    _check_base(rows, texts, lambda k: zlib.crc32(str(k).encode()) % 5 != 1)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    by = {r["held_out"]: r for r in language_model.perplexity(queries.op5_language_model(spark, sf)).collect()}
    assert by[True]["perplexity"] < by[True]["base_perplexity"]


def test_probabilities_sum_to_one(spark):
    """One-word texts: a word after the start of a document, and its end after the word."""
    r = np.random.default_rng(0)
    words = [f"w{i}" for i in range(12)]
    train = [(i, " ".join(words[j] for j in r.zipf(1.6, 8) % 12)) for i in range(300)]
    probes = [(1000 + i, w) for i, w in enumerate([*words, "unseen"])]
    docs = spark.createDataFrame(train + probes, "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in language_model.score(docs, F.col("doc_id") < 1000, context_share=0.01).collect()}
    # P(w) P(end | w) over all w is at most one; with P(empty) it stays so.
    assert 0 < sum(10 ** got[1000 + i] for i in range(13)) < 1


def test_seating_follows_the_restaurant():
    random = np.random.default_rng(1)
    c = np.array([1, 2, 50, 5000, 0])
    draws = np.mean([language_model._seat(random, c, np.full(5, 0.5), np.full(5, 10.0), 1.0, 0.5) for _ in range(400)], axis=0)
    assert draws[0] == 1 and draws[4] == 0 and (draws <= c).all()
    # Second customer: new with (1 + 0.5 * 11) * 0.5 against 0.5 at the first table.
    assert abs(draws[1] - 1 - 3.25 / 3.75) < 0.06
    exact, seated = 1.0, 1  # expectation of the third by one-by-one simulation
    sims = []
    for _ in range(400):
        t = 1
        for i in range(1, 50):
            new = (1 + 0.5 * (10 + t)) * 0.5
            t += random.random() < new / (new + i - 0.5 * t)
        sims.append(t)
    assert abs(draws[2] / np.mean(sims) - 1) < 0.1


def test_small_packets_and_ranges(spark, monkeypatch, edge_rows):
    texts = [(x[0], x[1]) for x in edge_rows if x[0] != 8]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(language_model, "PACKET_TOKENS", 100)
    monkeypatch.setattr(language_model, "RANGE_ENTRIES", 50)
    learned = lambda k: k is not None and k % 3 != 1
    rows = language_model.score(docs, F.col("doc_id") % 3 != 1, context_share=0.01).collect()
    _check_base(rows, texts, learned)
    assert all(np.isfinite(r["score"]) for r in rows)


def test_reruns_agree(spark, sf_dir):
    a, b = (sorted(map(tuple, queries.op5_language_model(spark, sf_dir).collect())) for _ in range(2))
    assert a == b


def test_edges(spark, edge_docs, edge_rows, no_docs):
    rows = language_model.score(edge_docs, F.col("doc_id") > 50).collect()
    assert len(rows) == len(edge_rows) and all(np.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {1}
    assert language_model.score(no_docs, F.lit(True)).count() == 0
    untrained = language_model.score(edge_docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untrained} == {0} and all(np.isfinite(r["score"]) for r in untrained)


def _one_table_each(texts, learned):
    """log10 of each text's probability where every pair and every word has one table."""
    words, pairs = collections.Counter(), collections.Counter()
    for k, t in texts:
        if learned(k):
            w = _tokens(t)
            words.update(w)
            pairs.update(zip([None, *w], w))
    contexts, root = collections.Counter(u for u, _ in pairs), collections.Counter(w for _, w in pairs)

    def discount(counts):
        once, twice = (sum(c == i for c in counts.values()) for i in (1, 2))
        return min(0.95, max(0.05, once / (once + 2 * twice)))

    d, dr, n = discount(pairs), discount(root), sum(root.values())

    def probability(u, w):
        parent = (root[w] - dr * (root[w] > 0) + (1 + dr * len(root)) / (len(words) + 1)) / (1 + n)
        return (pairs[u, w] - d * (pairs[u, w] > 0) + (1 + d * contexts[u]) * parent) / (1 + words[u])

    return {k: sum(math.log10(probability(u, w)) for u, w in zip([None, *_tokens(t)], _tokens(t))) for k, t in texts}


def test_every_context_against_brute_force(spark, monkeypatch):
    """Without sweeps each pair has one table; words of one token in 20,000 have their restaurant all the same."""
    r = np.random.default_rng(2)
    texts = [(i, " ".join(f"w{j}" for j in r.zipf(1.3, 250) % 3000)) for i in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(language_model, "PACKET_TOKENS", 3000)
    monkeypatch.setattr(language_model, "RANGE_ENTRIES", 1000)
    got = {x["doc_id"]: x["score"] for x in language_model.score(docs, F.col("doc_id") % 3 != 1, sweeps=0).collect()}
    want = _one_table_each(texts, lambda k: k % 3 != 1)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)


def test_rare_words_are_contexts(spark):
    """A pair seen three times among 40,000 tokens is likelier than its words apart."""
    r = np.random.default_rng(3)
    train = [(i, " ".join(f"w{j}" for j in r.integers(0, 50, 400))) for i in range(100)] + [(100 + i, "left right") for i in range(3)]
    docs = spark.createDataFrame([*train, (1000, "w1 left right w2"), (1001, "w1 right left w2")], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in language_model.score(docs, F.col("doc_id") < 1000).collect()}
    assert got[1000] > got[1001] + 2
