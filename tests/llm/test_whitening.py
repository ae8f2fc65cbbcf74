"""Whitening against eigenvectors of the exact covariance, and on odd tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.llm import queries, whitening


def table(spark, vectors, keys=None):
    keys = range(len(vectors)) if keys is None else keys
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v]) for k, v in zip(keys, vectors)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for name in ("key", "whitened", "deviation", "n", "i", "row", "length"):
        df = df.withColumn(name, F.lit("x"))
    return df


def brute(vectors):
    """n, sums and the covariance of x, from whole numbers."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n = len(x)
    sums = [sum(col) for col in zip(*x)]
    far = [[n * c - s for c, s in zip(row, sums)] for row in x]
    return n, far, np.array(far, float).T @ np.array(far, float) / n**3


def check(found, model, vectors, keys, components, tolerance=1e-7):
    n, far, covariance = brute(vectors)
    values = np.linalg.eigvalsh(covariance)[::-1]
    got = {r["key"]: r for r in found.collect()}
    assert sorted(got) == sorted(keys) and model.n == n
    assert len(model.values) == components
    np.testing.assert_allclose(model.values, values[:components], rtol=1e-9)
    np.testing.assert_allclose(model.explained, values[:components] / np.trace(covariance), rtol=1e-6)
    np.testing.assert_allclose(covariance @ model.vectors, model.vectors * model.values, atol=1e-9 * values[0])
    white = np.array([got[k]["whitened"] for k in keys])
    np.testing.assert_allclose(white, np.array(far, float) / n @ model.vectors / np.sqrt(model.values), atol=1e-8)
    assert [got[k]["deviation"] for k in keys] == [sum(c * c for c in row) for row in far]
    np.testing.assert_allclose(white.T @ white / n, np.eye(components), atol=tolerance)
    assert model.identity_error < tolerance


def test_against_eigenvectors(spark):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(400, 12)) @ r.normal(size=(12, 12)) * 3 + 5
    df = table(spark, vectors)
    model = whitening.fit(df, "v", 7)
    check(whitening.transform(df, "id", "v", model), model, vectors, range(400), 7)


def test_columns_of_very_different_spread(spark):
    r = np.random.default_rng(2)
    vectors = r.normal(size=(300, 6)) * np.array([1e6, 1e4, 1e2, 1, 1e3, 10])
    df = table(spark, vectors)
    model = whitening.fit(df, "v")
    assert len(model.values) == 6 and model.identity_error < 1e-6
    _, _, covariance = brute(vectors)
    np.testing.assert_allclose(model.values, np.linalg.eigvalsh(covariance)[::-1], rtol=1e-6)


def test_dependent_columns_give_fewer_components(spark):
    r = np.random.default_rng(3)
    base = r.integers(-40, 40, size=(200, 3))
    vectors = np.hstack([base, base[:, :2] - base[:, 1:], np.full((200, 1), 7)])
    df = table(spark, vectors)
    model = whitening.fit(df, "v")
    check(whitening.transform(df, "id", "v", model), model, vectors, range(200), 3)


def test_fewer_rows_than_columns(spark):
    vectors = np.random.default_rng(4).normal(size=(5, 20)) * 9
    model = whitening.fit(table(spark, vectors), "v")
    assert len(model.values) == 4 and model.identity_error < 1e-6


def test_rows_that_take_no_part(spark):
    r = np.random.default_rng(5)
    good = (r.normal(size=(60, 4)) * 4).tolist()
    odd = [None, [], [1, 2, None, 4], [1, 2, float("nan"), 4], [1, 2, float("inf"), 4], [1e300, 0, 0, 0], [1, 2, 3], [1, 2, 3, 4, 5]]
    df = table(spark, good + odd)
    model = whitening.fit(df, "v")
    check(whitening.transform(df, "id", "v", model), model, good, range(60), 4)


def test_null_and_repeated_keys(spark):
    r = np.random.default_rng(6)
    vectors = (r.normal(size=(50, 3)) * 4).tolist()
    df = table(spark, vectors + vectors[:2], [None, *range(1, 50), None, 1])
    model = whitening.fit(df, "v")
    assert model.n == 52
    rows = whitening.transform(df, "id", "v", model).collect()
    assert len(rows) == 52 and sum(r["key"] is None for r in rows) == 2


def test_deviation_beyond_a_long_is_null(spark):
    df = table(spark, [[1e12, 0], [-1e12, 1], [5, 2], [6, 3]])
    model = whitening.fit(df, "v")
    n, far, _ = brute([[1e12, 0], [-1e12, 1], [5, 2], [6, 3]])
    exact = [sum(c * c for c in row) for row in far]
    got = {r["key"]: r["deviation"] for r in whitening.transform(df, "id", "v", model).collect()}
    assert got == {k: (d if d < 2**63 else None) for k, d in enumerate(exact)} and None in got.values()


@pytest.mark.parametrize("vectors", [[], [[1, 2]], [[3, 3]] * 5, [None, []]])
def test_nothing_to_whiten(spark, vectors):
    df = table(spark, vectors) if vectors else spark.createDataFrame([], "id long, v array<double>")
    model = whitening.fit(df, "v")
    assert model is None
    assert whitening.transform(df, "id", "v", model).count() == 0


def test_solve_rows():
    r = np.random.default_rng(8)
    factor = np.triu(r.normal(size=(5, 5))) + 3 * np.eye(5)
    z = r.normal(size=(9, 5))
    y = z @ factor
    whitening.solve_rows(y, factor)
    np.testing.assert_allclose(y, z, atol=1e-12)


def test_query(spark, sf_dir):
    rows = queries.op11_whitening(spark, sf_dir).toPandas()
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    n, far, covariance = brute(list(vectors.values()))
    values, turned = np.linalg.eigh(covariance)
    values, turned = values[::-1][:32], turned[:, ::-1][:, :32]
    wide = rows.pivot(index="vec_id", columns="component", values="whitened").loc[list(vectors)].to_numpy()
    want = np.array(far, float) / n @ turned / np.sqrt(values)
    signs = np.sign((wide * want).sum(axis=0))
    np.testing.assert_allclose(wide, want * signs, atol=1e-6)
    assert (rows["n"] == n).all() and rows["identity_error"].max() < 1e-9
    shares = rows.groupby("component")["explained"].first().to_numpy()
    np.testing.assert_allclose(shares, values / np.trace(covariance), rtol=1e-6)
    deviations = rows.groupby("vec_id")["deviation"].first()
    assert [int(deviations[k]) for k in vectors] == [sum(c * c for c in row) for row in far]
