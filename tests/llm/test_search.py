import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import neighbours, queries, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def odd_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=6).astype(float).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6, 0) for i in range(60)]  # ties
    rows += [(7, rows[7][1], 0)] * 3  # repeated rows
    rows += [(400, None, 0), (401, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (402, [float("nan")] * 6, 0), (403, [float("inf")] * 6, 0), (None, [1.0] * 6, 0)]
    return rows + [(450, [0.0] * 6, 0)]


def _valid(rows, zero):
    keep = [(k, np.array(v, np.float32).astype(float)) for k, v, _ in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [(k, v) for k, v in keep if zero or v.any()]


def test_top_k_against_brute_force(spark, odd_vectors):
    df = spark.createDataFrame(odd_vectors, SCHEMA).withColumn("q", F.lit(1)).withColumn("score", F.lit(1)).repartition(4)
    got = {}
    for r in topk.top_k(df, lambda key: key % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = [(k, np.floor(256 * v).astype(int)) for k, v in _valid(odd_vectors, True)]
    for k, v in {k: v for k, v in rows if k % 50 == 0}.items():
        best = sorted(((-int(v @ w), j) for j, w in rows if j != k))[:5]
        assert sorted(got.pop(k)) == [(i + 1, j, -s) for i, (s, j) in enumerate(best)]
    assert not got


def test_top_k_many_blocks(spark, odd_vectors, monkeypatch):
    from tillroll.llm import vectors

    df = spark.createDataFrame(odd_vectors, SCHEMA)
    whole = sorted(map(tuple, topk.top_k(df, lambda key: key % 10 == 0, 5).collect()))
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(topk, "STEP_BITS", 5)
    assert sorted(map(tuple, topk.top_k(df.repartition(5), lambda key: key % 10 == 0, 5).collect())) == whole


def test_top_k_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0), (2, [-3.0], 0)], SCHEMA)
    assert sorted(map(tuple, topk.top_k(few, lambda key: key == 0, 5).collect())) == [(0, 1, 1, 131072), (0, 2, 2, -196608)]
    assert topk.top_k(few.limit(0), lambda key: key == 0, 5).count() == 0
    assert topk.top_k(few.filter("vec_id = 0"), lambda key: key == 0, 5).count() == 0


def test_vectors_of_several_lengths(spark):
    rows = [(0, [1.0, 2.0, 0.5], 0), (1, [2.0], 0), (2, [-3.0, 4.0], 0), (3, [0.0, 0.0, 8.0], 0), (4, [], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    full = {k: np.array([*v, 0.0, 0.0, 0.0][:3]) for k, v, _ in rows}
    score = {k: int(np.floor(256 * full[0]) @ np.floor(256 * v)) for k, v in full.items() if k}
    want = [(0, i + 1, k, score[k]) for i, k in enumerate(sorted(score, key=lambda k: (-score[k], k)))]
    assert sorted(map(tuple, topk.top_k(df, lambda key: key == 0, 5).collect())) == want
    far = {k: float(np.sqrt(((v - full[0]) ** 2).sum())) for k, v in full.items() if k not in (0, 4)}
    want = [(i + 1, k, far[k]) for i, k in enumerate(sorted(far, key=lambda k: (far[k], k)))]
    assert _by_query(neighbours.nearest(df, lambda key: key == 0)) == {0: want}


def test_large_components(spark):
    """Sums beyond 2^53 are exact, those beyond a long are held at its end, and cancelled ones are right again."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4).tolist(), 0) for i in range(40)]
    rows += [(100, [1e12, -1e12, 3.0, 0.5], 0), (101, [1e12, 1e12, 1.0, 1.0], 0), (102, [1e300, 0.0, 0.0, -1e300], 0), (103, [3e6, 7e6, -9e6, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    most = topk.LARGEST
    whole = {k: [max(-most, min(most, math.floor(256 * x) if abs(x) < 1e200 else int(np.sign(x)) * most)) for x in v] for k, v, _ in rows}
    want = []
    for q in whole:
        score = {k: max(-most, min(most, sum(a * b for a, b in zip(whole[q], w)))) for k, w in whole.items() if k != q}
        want += [(q, i + 1, k, score[k]) for i, k in enumerate(sorted(score, key=lambda k: (-score[k], k))[:5])]
    assert sorted(map(tuple, topk.top_k(df, lambda key: key >= 0, 5).collect())) == sorted(want)


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (1, [2.0, 0.0], 0), (2, [4.0, 0.0], 0), (0, [1.0, 0.0], 0)]
    got = _by_query(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), lambda key: key == 0, 10))
    assert got == {0: [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, 2, 3.0)]}


def test_hilbert_keys_walk_to_neighbouring_cells():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), axis=-1).reshape(-1, d)
        keys = neighbours.hilbert_keys(cells, bits)
        walk = cells[np.lexsort(keys.T[::-1])]
        assert len(np.unique(keys, axis=0)) == len(cells) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def _recall(spark, rows, got, k, every):
    valid = {k_: v for k_, v in _valid(rows, False)}
    ids, x = np.array(list(valid)), np.array(list(valid.values()))
    hit = total = 0
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - valid[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[: min(k, len(ids) - 1)]]
        mine = got[q]
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(best)
        assert np.allclose([m[2] for m in mine], [np.sqrt(((valid[m[1]] - valid[q]) ** 2).sum()) for m in mine], rtol=1e-14)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hit, total = hit + len({m[1] for m in mine} & set(best)), total + len(best)
    return hit / total


def _by_query(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {k: sorted(v) for k, v in got.items()}


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert _recall(spark, rows, _by_query(queries.op7_neighbours(spark, sf)), 10, 100) >= 0.9


def test_clusters_need_a_short_window(spark, monkeypatch):
    r = np.random.default_rng(4)
    centres = r.normal(size=(50, 16)) * 5
    rows = [(i, (centres[i % 50] + 0.1 * r.normal(size=16)).tolist(), 0) for i in range(4000)]
    windows = []
    old = neighbours._window
    monkeypatch.setattr(neighbours, "_window", lambda *a: windows.append(old(*a)) or windows[-1])
    got = _by_query(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), lambda key: key % 100 == 0))
    assert _recall(spark, rows, got, 10, 100) >= 0.9 and windows[0] < 200


def test_neighbours_edges(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    df = spark.createDataFrame(odd_vectors, SCHEMA).withColumn("place", F.lit("x")).repartition(3)
    got = _by_query(neighbours.nearest(df, lambda key: key % 50 == 0, 10))
    assert _recall(spark, odd_vectors, got, 10, 50) >= 0.9 and 450 not in got
    few = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0), (2, [-3.0], 0)], SCHEMA)
    assert _by_query(neighbours.nearest(few, lambda key: key == 0)) == {0: [(1, 1, 1.0), (2, 2, 4.0)]}
    assert neighbours.nearest(few.limit(0), lambda key: key == 0).count() == 0
    assert neighbours.nearest(few.filter("vec_id = 0"), lambda key: key == 0).count() == 0
