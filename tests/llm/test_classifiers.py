import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import quality, queries, toxicity
from tillroll.llm.common import training_marks


def _held_out(spark, sf_dir, rows, label):
    marks = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [(r["score"], r["predicted"], marks[r["doc_id"]]) for r in rows if r["held_out"] and marks.get(r["doc_id"]) is not None]
    return got


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    got = _held_out(spark, sf, rows, "quality")
    assert all(0 <= s <= 1 and p == (s >= 0.3) for s, p, _ in got)
    assert np.mean([p == y for _, p, y in got]) >= 0.95


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).collect()
    got = _held_out(spark, sf, rows, "toxic")
    assert all(0 <= s <= 1 and p == (s >= 0.7) for s, p, _ in got)
    clean = [p for _, p, y in got if not y]
    toxic = [p for _, p, y in got if y]
    assert np.mean(clean) <= 0.01 and np.mean(toxic) >= 0.8


def test_cholesky_gives_the_gaussian_density():
    r = np.random.default_rng(3)
    a = r.normal(size=(4, 4))
    cov = a @ a.T + np.eye(4)
    factor = np.linalg.cholesky(cov)
    model = {
        "centre": np.zeros(4), "spread": np.ones(4), "mean": {0: np.zeros(4), 1: np.ones(4)},
        "inverse": {0: np.linalg.inv(factor), 1: np.eye(4)}, "log_det": {0: 2 * np.log(np.diag(factor)).sum(), 1: 0.0},
    }
    x = r.normal(size=(5, 4))
    want = -0.5 * ((x - 1) ** 2).sum(1) + 0.5 * (np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x) + np.linalg.slogdet(cov)[1])
    assert np.allclose(np.sinh(quality.difference(x, model)), want)


def test_quality_edges(spark, edge_docs, edge_rows, no_docs):
    features = quality.measured(edge_docs)
    assert features.count() == len(edge_rows)
    assert all(np.isfinite(r["features"]).all() for r in features.collect())
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 130)] + [(None, 1), (1, None)], "doc_id long, quality int")
    marks = training_marks(labels, "quality", F.lit(True), "doc_id")
    model = quality.fit(quality.labelled(features, marks))
    scores = quality.scored(features, model).collect()
    assert len(scores) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in scores)
    none = quality.fit(quality.labelled(features, marks.filter("label = 1")))
    assert {r["score"] for r in quality.scored(features, none).collect()} == {1.0}
    assert quality.scored(quality.measured(no_docs), model).count() == 0


def test_training_rows_are_bounded(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert 800 < training_marks(labels, "toxic", F.lit(True), "doc_id", rows=1000).count() < 1200


def _distance(a: str, b: str) -> dict:
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d


@pytest.mark.parametrize("seed", range(12))
def test_automaton_against_edit_distance(seed):
    r = random.Random(seed)
    terms = {}
    for _ in range(5):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        if word not in terms and word + "*" not in terms:
            terms[word + r.choice(["", "*"])] = toxicity.edits_allowed(word)
    lexicon = toxicity.Lexicon(terms)
    for _ in range(150):
        word = "".join(r.choice("abc") for _ in range(r.randint(0, 11)))
        want = []
        for term, k in terms.items():
            stem = term.rstrip("*")
            d = _distance(word, stem)
            e = min(d[i, len(stem)] for i in range(len(word) + 1)) if term.endswith("*") else d[len(word), len(stem)]
            want += [e] if e <= k else []
        got = lexicon.match(word)
        assert (got and got[0]) == min(want, default=None), (word, terms)


def test_context_decides():
    lexicon = toxicity.Lexicon({"stupid": 1, "trash": 1})
    names = toxicity.FEATURES
    plain = dict(zip(names, toxicity.hit_features("what a stupid idea", lexicon)))
    misspelt = dict(zip(names, toxicity.hit_features("what a stupdi idea", lexicon)))
    quoted = dict(zip(names, toxicity.hit_features('the word "stupid" is short', lexicon)))
    reported = dict(zip(names, toxicity.hit_features("she said stupid once", lexicon)))
    aimed = dict(zip(names, toxicity.hit_features("you are trash", lexicon)))
    assert plain["hits"] > 0 and not plain["quoted"] and not plain["misspelt"]
    assert misspelt["hits"] == plain["hits"] and misspelt["misspelt"] > 0
    assert quoted["quoted"] > 0 and not quoted["hits"] and reported["quoted"] > 0
    assert aimed["aimed"] > 0


def test_misspelt_and_quoted_documents(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(400)]
    rows = []
    for i in range(600):
        body = r.choices(words, k=40)
        if i % 4 == 0:
            for _ in range(3):
                body[r.randrange(40)] = r.choice(["worthless", "disgusting", "pathetic"])
        rows.append((i, " ".join(body), int(i % 4 == 0)))
    train = spark.createDataFrame(rows, "doc_id long, text string, label int").select("text", "label")
    model = toxicity.fit(train)
    assert {"worthless", "disgusting", "pathetic"} <= set(model["terms"])
    body = " ".join(r.choices(words, k=20))
    cases = spark.createDataFrame(
        [(1, f"{body} wortless {body} digusting pathetc"), (2, f'{body} they wrote "worthless" and "disgusting" {body}'), (3, body), (4, None), (5, "")],
        "doc_id long, text string",
    )
    got = {x["doc_id"]: x["score"] for x in toxicity.score(cases, model).collect()}
    assert got[1] > 0.7 and max(got[2], got[3], got[4], got[5]) < 0.5


def test_toxicity_edges(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 130)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(edge_docs, labels, "toxic", F.lit(True)))
    rows = toxicity.score(edge_docs, model).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(no_docs, model).count() == 0
    empty = toxicity.fit(toxicity.labelled(no_docs, labels, "toxic", F.lit(True)))
    assert empty["terms"] == {} and toxicity.score(edge_docs, empty).count() == len(edge_rows)


def test_rare_terms_are_learned(spark):
    """A term in 1.5% of the toxic texts and in no clean one; words that are rare by chance are none."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(3000)]
    rows = []
    for i in range(6000):
        body = r.choices(words, k=15)
        if i % 5 == 0:
            body[3] = "vermin" if i % 335 == 0 else "worthless"
        rows.append((" ".join(body), int(i % 5 == 0)))
    train = spark.createDataFrame(rows, "text string, label int")
    model = toxicity.fit(train)
    assert set(model["terms"]) == {"vermin", "worthless"}
    cases = spark.createDataFrame([(1, " ".join([*words[:9], "vermin"])), (2, " ".join(words[:9]))], "doc_id long, text string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(cases, model).collect()}
    assert got[1] > 0.7 > got[2]


def test_automaton_forgets_states(monkeypatch):
    terms = {"worthless": 2, "vermin*": 1}
    cases = ["wortless", "verminous", "vrmin", "worth", "none", "worthless"] * 3
    want = [toxicity.Lexicon(terms).match(w) for w in cases]
    monkeypatch.setattr(toxicity, "CACHE_MEMBERS", 5)
    lexicon = toxicity.Lexicon(terms)
    assert [lexicon.match(w) for w in cases] == want
