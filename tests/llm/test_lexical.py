"""Ranked lexical search against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 75 + (25 * sum(c.values()) * n) // length
            s = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, q in Counter(terms(text)).items() if t in c
            )
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k):
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    for name in ("key", "item", "place", "score", "segment", "term"):
        left, right = left.withColumn(name, F.lit("x")), right.withColumn(name, F.lit("x"))
    return sorted((tuple(r) for r in lexical.search(left, right, k).collect()), key=str)


def corpus(seed, n, words=60):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(words)]
    return [(i, " ".join(r.choices(common, [1 / (1 + j) for j in range(words)], k=r.randint(1, 40)))) for i in range(n)]


@pytest.fixture()
def small_parts(monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 16)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "STEPS", (7, 3))


def test_against_brute_force(spark, small_parts):
    docs = corpus(1, 400)
    items = [(i, t) for i, t in corpus(2, 25)]
    assert found(spark, docs, items, 10) == brute(docs, items, 10)


def test_shared_slots(spark, small_parts, monkeypatch):
    """More coordinates than a summary has room for: slots are shared, and the result stays exact."""
    monkeypatch.setattr(lexical, "SUMMARY_CELLS", 1000)
    docs, items = corpus(3, 200, 400), corpus(4, 10, 400)
    questions = lexical.Questions([(i, lexical.terms(t.encode())) for i, t in items])
    assert questions.width < questions.size
    assert found(spark, docs, items, 5) == brute(docs, items, 5)


def test_blocks_of_items(spark, small_parts, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 4)
    docs, items = corpus(5, 120), corpus(6, 11)
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_odd_rows(spark, small_parts):
    docs = [
        (1, "Straße ÜBER naïve x1 don't stop-word"), (1, "Straße ÜBER naïve x1 don't stop-word"), (2, None), (3, ""), (4, " ,.;\n\x00\x1f "),
        (None, "x1 x1 naïve"), (None, "naïve"), (5, "naïve"), (6, "naïve"), (7, "long " * 50_000 + "naïve end"), (8, "ÜBER über"), (9, "{x1}|~`[]^_@"),
    ]
    items = [(1, "naïve X1, über!"), (1, "naïve"), (2, None), (3, ""), (4, "absent words"), (None, "don t don"), (5, "ÜBER ÜBER x1 x1 x1"), (6, "long end")]
    assert found(spark, docs, items, 4) == brute(docs, items, 4)


def test_ties_and_equal_documents(spark, small_parts):
    docs = [(i, "same text here") for i in range(100, 0, -1)] + [(i, f"other {i}") for i in range(200, 260)]
    items = [(1, "same here"), (2, "other 205"), (3, "here here same")]
    assert found(spark, docs, items, 20) == brute(docs, items, 20)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 3) == []
    assert found(spark, [(1, "a b")], [], 3) == []
    assert found(spark, [(1, None)], [(1, "a")], 3) == []


def _segments(questions, docs):
    """The segments of one task, made without Spark."""
    sizes = [Counter(map(questions.numbers.get, lexical.terms(t.encode()))) for _, t in docs]
    for c in sizes:
        c.pop(None, None)
    ids = [np.array(sorted(c), np.int32) for c in sizes]
    n, length = len(docs), sum(len(terms(t)) for _, t in docs)
    df = Counter(i for c in sizes for i in c)
    questions.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[i] + 1))) for i in range(questions.size)], np.int64)
    row = {
        "segment": 0, "step": 2, "keys": [d for d, _ in docs], "lengths": np.array([len(terms(t)) for _, t in docs], np.int64).tobytes(),
        "ends": np.cumsum([len(x) for x in ids], dtype=np.int32).tobytes(), "ids": np.concatenate(ids).tobytes(),
        "tfs": np.concatenate([np.array([c[i] for i in x.tolist()], np.int32) for c, x in zip(sizes, ids)]).tobytes(),
    }
    sketches = np.random.default_rng(7).standard_normal((questions.size, lexical.SKETCH)).astype(np.float32)
    return lexical._segment(row, questions, sketches, n, length)


def test_blocks_are_skipped_and_bounds_hold(monkeypatch):
    """Topics make similar documents; blocks of other topics are skipped, and no bound is under a score."""
    monkeypatch.setattr(lexical, "BLOCK", 8)
    r = random.Random(9)
    docs = []
    for i in range(600):
        topic = i % 12
        docs.append((i, " ".join([f"t{topic}x{r.randint(0, 30)}" for _ in range(20)] + [f"c{r.randint(0, 20)}" for _ in range(20)])))
    items = [(t, " ".join([f"t{t}x{j}" for j in range(0, 30, 3)] + ["c1", "c2", "c3"])) for t in range(12)]
    questions = lexical.Questions([(i, lexical.terms(t.encode())) for i, t in items])
    docs = [d for d in docs if any(t in questions.numbers for t in lexical.terms(d[1].encode()))]
    segment = lexical.Segment(_segments(questions, docs), questions)
    for i in range(len(items)):
        ids, repeats = questions.items[i]
        weights = questions.weights[ids] * repeats
        segment.weights[ids] = weights
        scores = segment._scores(np.arange(len(docs)))
        segment.weights[ids] = 0
        for t, (first, last, peaks) in segment.lists.items():
            if t not in ids:
                continue
            bounds = peaks[:, np.searchsorted(questions.slots[t], ids % questions.width)].astype(np.int64) @ weights
            for b in range(first, last):
                held = segment.members[(segment.block_ends[b - 1] if b else 0) : segment.block_ends[b]]
                assert scores[held].max() <= bounds[b - first]
        best = segment.best(i, 1, 5)
        assert [s for s, _ in best] == sorted(scores.tolist(), reverse=True)[:5]
    assert segment.skipped > segment.read
