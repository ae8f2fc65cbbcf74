"""Quantiles by histogram refinement against numpy."""

import numpy as np
import pytest

from tillroll.operators import selection as S

PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


def check(spark, columns, groups=None):
    names = list(columns)
    n = len(next(iter(columns.values())))
    groups = [0] * n if groups is None else groups
    rows = [(g, *[None if v is None else float(v) for v in vs]) for g, *vs in zip(groups, *columns.values())]
    df = spark.createDataFrame(rows, "g int, " + ", ".join(f"`{c}` double" for c in names)).repartition(5)
    got = {(r["g"], r["column"], r["prob"]): r["value"] for r in S.column_quantiles(df, names, PROBS, ["g"]).collect()}
    want = {}
    for g in set(groups):
        for c in names:
            held = np.array([v for v, h in zip(columns[c], groups) if h == g and v is not None], float)
            if len(held):
                want |= {(g, c, p): float(np.quantile(held, p)) for p in PROBS}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, rel=1e-12, abs=1e-300), k
    return df


@pytest.fixture(params=[S.LAST_ROWS, 20, 0], ids=["one round", "some rounds", "all rounds"])
def rounds(request, monkeypatch):
    monkeypatch.setattr(S, "LAST_ROWS", request.param)


def test_many_columns_and_groups(spark, rounds):
    r = np.random.default_rng(1)
    n = 500
    columns = {
        "normal": r.normal(size=n), "money": np.round(r.exponential(50, n), 2), "few": r.integers(-2, 3, n),
        "wide": r.normal(size=n) * 10.0 ** r.integers(-200, 200, n), "a b": [None if i % 3 else i for i in range(n)],
        "same": [7] * n, "tiny": r.integers(0, 9, n) * 5e-324,
    }
    check(spark, columns, r.integers(0, 4, n).tolist())


def test_signs_zeros_and_infinities(spark, rounds):
    check(spark, {"x": [-0.0, 0.0, -1e-300, 1e-300, -5, 5, -1e308, 1e308, 3, 3, 3]})
    values = spark.createDataFrame([(v,) for v in (float("-inf"), -1.0, 2.0, float("inf"), float("nan"))], "x double")
    got = [r["value"] for r in S.quantiles(values, "x", (0.0, 0.25, 0.5, 0.75, 1.0)).orderBy("prob").collect()]
    assert got[:4] == [float("-inf"), -1.0, 2.0, float("inf")] and np.isnan(got[4])


def test_null_groups_and_no_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None), ("b", 5.0)], "g string, x double")
    got = {(r["g"], r["value"]) for r in S.quantiles(df, "x", (0.5,), ["g"]).collect()}
    assert got == {(None, 2.0), ("b", 5.0)}
    assert S.quantiles(df.filter("false"), "x", (0.5,)).count() == 0
    assert df.select(S.quantile(df.filter("false"), "x", 0.5).alias("q")).first()["q"] is None


def test_many_groups_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_GROUPS", 2)
    r = np.random.default_rng(2)
    check(spark, {"x": r.normal(size=90), "y": r.normal(size=90)}, r.integers(0, 5, 90).tolist())


def test_counts_are_sorted_not_the_column(spark, monkeypatch):
    """Below the running sums over bins, no plan of a round sorts or ranges rows."""
    plans = []
    located = S._located

    def spy(counted, asked):
        plans.append(counted._jdf.queryExecution().executedPlan().toString())
        return located(counted, asked)

    monkeypatch.setattr(S, "_located", spy)
    monkeypatch.setattr(S, "LAST_ROWS", 100)
    df = spark.range(5000).selectExpr("id % 997 AS x", "id % 3 AS g")
    S.quantiles(df, "x", (0.5,), ["g"])
    assert len(plans) > 1 and not any("Sort" in p or "rangepartitioning" in p for p in plans)


def test_keys_keep_the_order():
    values = np.array([-np.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.5, 1e300, np.inf, np.nan])
    keys = S.keys_of(values)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert [S.value_of(int(k)) for k in keys[:-1]] == values[:-1].tolist()
    assert S.keys_of(np.array([-0.0])) == S.keys_of(np.array([0.0]))
