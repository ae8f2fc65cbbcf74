import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import ngram_join, queries
from tillroll.llm.components import components
from tillroll.llm.words import shingles, word_hashes

_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_LOW))


def _set(text, size):
    w = _words(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def _brute(rows, size, percent):
    """(size of set, smallest key reachable) per key."""
    sets = {k: _set(t, size) for k, t in rows}
    up = {k: k for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(s), top(k)) for k, s in sets.items()}


def test_words_as_the_contract_has_them(edge_rows):
    texts = [x[1] for x in edge_rows] + ["A b\x0bc\x0c", "É e", "x" * 70_000 + " y", "  "]
    seen = {}
    for t in texts:
        hashes, words = word_hashes(t).tolist(), _words(t)
        assert len(hashes) == len(words)
        for h, w in zip(hashes, words):
            assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(seen.values()))
    assert np.array_equal(shingles("a b c d a b c d", 4), shingles("A B C D A B C D", 4)) and len(shingles("a b", 4)) == 1


def test_long_texts_in_pieces(monkeypatch):
    from tillroll.llm import words

    text = " ".join(f"w{i}x{'é' * (i % 50)}" for i in range(3000))
    whole = word_hashes(text)
    monkeypatch.setattr(words, "_PIECE", 100)
    assert np.array_equal(word_hashes(text), whole)


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_against_all_pairs(spark, size, percent):
    r = random.Random(size)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = r.choices(vocabulary, k=60)
    rows, k = [], 0
    for group in range(12):
        text = r.choices(vocabulary, k=r.choice([3, 9, 30, 120, 400]))
        for _ in range(r.choice([1, 2, 6, 30])):
            copy = list(text)
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                at = r.randrange(len(copy))
                copy[at : at + r.choice([0, 1, 1])] = [r.choice(vocabulary)]
            if r.random() < 0.2:
                copy = [x.upper() for x in copy]
            rows.append((k := k + 1, " ".join(copy)))
    for _ in range(40):  # one passage in many documents that are otherwise strangers
        rows.append((k := k + 1, " ".join([*r.choices(vocabulary, k=30), *common, *r.choices(vocabulary, k=30)])))
    # a chain: each text loses words of the one before
    chain = r.choices(vocabulary, k=100)
    rows += [(k := k + 1, " ".join(chain[: 100 - 3 * i])) for i in range(12)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.near_duplicates(docs, size=size, percent=percent).collect()}
    assert got == _brute(rows, size, percent)


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in queries.op6_ngram_join(spark, sf_dir).collect()}
    assert got == _brute(rows, 4, 85)


def test_no_pairs_inside_a_group_of_copies(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    r, rows = random.Random(2), []
    for i in range(400):
        copy = list(base)
        copy[r.randrange(200)] = f"own{i}"
        rows.append((i, " ".join(copy)))
    tested = []
    old = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *a: tested.append(pairs.count()) or old(pairs, *a))
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["component_id"] for x in found} == {0} and sum(tested) < 4 * 400


def test_frequencies_add_up_over_levels(spark, monkeypatch):
    docs = spark.range(40).select(F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(8)], F.col("id").cast("string")).alias("text")).repartition(9)
    whole = ngram_join._frequencies(docs, 4)
    monkeypatch.setattr(ngram_join, "_FAN_IN", 2)
    assert np.array_equal(ngram_join._frequencies(docs, 4), whole) and whole.max() > 0


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = ngram_join.near_duplicates(edge_docs, size=4, percent=85).collect()
    assert len(got) == len(edge_rows)
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert component[1] == component[2] == component[3] == 1 and component[9] == 9 and component[None] is None
    assert component[7] == component[10] == 7 and (component[4], component[5], component[6]) == (4, 5, 6)
    kept = ngram_join.one_of_each(edge_docs, size=4, percent=85)
    assert kept.columns == edge_docs.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert ids == [1, 4, 5, 6, 7, 8, 9, 11, *range(100, 130), None]
    assert ngram_join.near_duplicates(no_docs).count() == 0 and ngram_join.one_of_each(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 140)] + [(5, 5), (201, 200), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{x: 100 for x in range(100, 140)}, 200: 200, 201: 200}


def test_rows_that_share_a_key(spark):
    """A third of the rows under one key with texts of their own; copies of two of them under other keys."""
    r = random.Random(7)
    texts = [" ".join(f"t{i}x{r.randrange(500)}" for _ in range(40)) for i in range(60)]
    rows = [(5, t, i) for i, t in enumerate(texts[:30])] + [(10 + i, t, i) for i, t in enumerate(texts[30:])]
    rows += [(3, texts[0] + " more", 0), (200, texts[1] + " more", 1), (5, texts[2].upper(), 2), (5, texts[3], 3), (5, texts[4] + " more", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(6)
    got = sorted((x["doc_id"], x["component_id"]) for x in ngram_join.near_duplicates(docs).collect())
    assert got == sorted([(3, 3), (5, 3), *[(5, 5)] * 32, (200, 5), *[(10 + i, 10 + i) for i in range(30)]])
    kept = [tuple(x) for x in ngram_join.one_of_each(docs).collect()]
    assert sorted(n for k, _, n in kept if k == 5) == list(range(1, 30))
    assert sorted(k for k, _, _ in kept if k != 5) == [3, *range(10, 40)]
    assert sorted(kept) == sorted(tuple(x) for x in ngram_join.one_of_each(docs.repartition(3)).collect())


def test_rows_without_key_hold_chains_together(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (None, " ".join(words[:190])), (2, " ".join(words[:172])), (None, " ".join(words[:186])),
            (None, "a b c d e f"), (None, "A b c d e f"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 197, 1), (0, 187, 1), (2, 169, 1), (0, 183, 1), (0, 3, None), (0, 3, None), (0, 0, None)], key=str)
    kept = [r["doc_id"] for r in ngram_join.one_of_each(docs).collect()]
    assert sorted(k or 0 for k in kept) == [0] * 5 + [1]


@pytest.mark.parametrize("packet,span", [(50, 40), (1, 7), (1 << 20, 1 << 20)])
def test_shared_tokens_of_packets_and_ranges(spark, monkeypatch, packet, span):
    """One token is in a third of all sets, many are in two sets, most in one."""
    monkeypatch.setattr(ngram_join, "_PACKET", packet)
    monkeypatch.setattr(ngram_join, "_RANGE", span)
    r = random.Random(packet)
    rows, held = [], {}
    for rep in range(300):
        first = sorted({r.randrange(-(1 << 63), 1 << 63), r.randrange(400), *([7 << 50] if rep % 3 == 0 else [])}) if rep % 10 else []
        rows.append((rep << 33, len(first) + 5, first))
        for at, token in enumerate(first):
            held.setdefault(token, []).append((rep << 33, len(first) + 5, at))
    reps = spark.createDataFrame(rows, "rep long, n long, first array<long>").repartition(4)
    found = {}
    for x in ngram_join._shared_tokens(reps, sum(len(x[2]) for x in rows)).collect():
        found.setdefault(x["token"], []).append((x["rep"], x["n"], x["at"]))
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in held.values() if len(v) > 1)
    assert ngram_join._shared_tokens(reps.limit(0), 0).count() == 0


def test_only_open_tokens_stay(spark):
    """Token 1 lies in one component, 2 in two of them, 3 in a component and a row without label."""
    rows = [(1, 10), (1, 11), (2, 10), (2, 12), (2, 13), (3, 11), (3, 14), (4, 12), (4, 13)]
    index = spark.createDataFrame([(t, r, 100, 0) for t, r in rows], "token long, rep long, n long, at int")
    labels = spark.createDataFrame([(10, 10), (11, 10), (12, 12), (13, 12)], "node long, component long")
    got = sorted((r["token"], r["rep"]) for r in ngram_join._open_tokens(index, labels).collect())
    assert got == [x for x in rows if x[0] in (2, 3)]


def test_texts_of_single_rows_are_not_shuffled_to_sort_them_out(spark, monkeypatch):
    """Repeated rows of a node count once; without any, texts are stored as they were read."""
    made, old = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, *a, **k: made.append(df) or old(df, *a, **k))
    text = " ".join(f"w{i}" for i in range(60))
    for repeated in (False, True):
        made.clear()
        rows = [(1, text), (2, text + " tail"), (3, "w " + text)] * (1 + repeated)
        found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(found) == len(rows) and {r["component_id"] for r in found} == {1}
        of_texts = [df for df in made if df.columns == ["node", "text"]]
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in of_texts]
        assert any("Aggregate" in x for x in plans) == repeated
