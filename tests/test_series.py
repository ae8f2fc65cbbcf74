import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.functions.columns import calendar_features
from tillroll.operators import series as S

V = "Daily_Revenue"


def days(spark, n=90, seed=1):
    rng = np.random.default_rng(seed)
    x = (100 + np.arange(n) + 20 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, 5, n)).round(2)
    start = dt.date(2021, 1, 1)
    pdf = pd.DataFrame({"Date": [start + dt.timedelta(days=i) for i in range(n)], V: x})
    df = spark.createDataFrame([(d, Decimal(f"{v:.2f}")) for d, v in pdf.itertuples(index=False)],
                               f"Date date, {V} decimal(28,2)")
    return pdf, df.repartition(4)


def column(df, name):
    return [None if r[0] is None else float(r[0]) for r in df.orderBy("Date").select(name).collect()]


def same(got, want):
    want = [None if pd.isna(v) else float(v) for v in want]
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None) == (w is None)
        if w is not None:
            assert g == pytest.approx(w, rel=1e-9, abs=1e-9)


def test_lag_features_equal_pandas(spark):
    pdf, df = days(spark)
    out = S.lag_features(df, V, "Date").cache()
    x = pdf[V]
    for p in (1, 3, 7, 14, 30):
        same(column(out, f"{V}_lag_{p}"), x.shift(p))
    for w in (3, 7, 14, 30):
        r = x.rolling(w)
        for name, want in (("mean", r.mean()), ("std", r.std()), ("max", r.max()), ("min", r.min())):
            same(column(out, f"{V}_rolling_{name}_{w}"), want)
    for a, tag in ((0.1, "01"), (0.3, "03"), (0.5, "05")):
        same(column(out, f"{V}_ewm_{tag}"), x.ewm(alpha=a).mean())
    for p in (1, 7):
        same(column(out, f"{V}_diff_{p}"), x.diff(p))
        same(column(out, f"{V}_pct_change_{p}"), x.pct_change(p))


def test_change_from_zero_is_null(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1), 0.0), (dt.date(2021, 1, 2), 4.0)], "Date date, x double")
    assert column(S.pct_changes(df, "x", [1], "Date"), "x_pct_change_1") == [None, None]


def test_decompose_equals_brute_force(spark):
    pdf, df = days(spark, 80)
    x = pdf[V].to_numpy()
    trend = np.full(len(x), np.nan)
    for i in range(3, len(x) - 3):
        trend[i] = x[i - 3 : i + 4].mean()
    means = np.array([np.nanmean((x - trend)[k::7]) for k in range(7)])
    season = np.array([(means - means.mean())[i % 7] for i in range(len(x))])
    residual = x - trend - season
    out = S.decompose(df, V, "Date")
    same(column(out, "trend"), trend)
    same(column(out, "seasonal"), season)
    same(column(out, "residual"), residual)
    stats = S.decompose_stats(out, "Date").first()
    keep = ~np.isnan(residual)
    r = residual[keep]
    assert stats["trend_strength"] == pytest.approx(1 - r.var(ddof=1) / (trend[keep] + r).var(ddof=1))
    assert stats["seasonal_strength"] == pytest.approx(1 - r.var(ddof=1) / (season[keep] + r).var(ddof=1))
    assert stats["trend_direction"] == "increasing"
    assert stats["residual_autocorr"] == pytest.approx(pd.Series(r).autocorr())


def test_decompose_per_series_equals_each_alone(spark):
    _, a = days(spark, 60, 1)
    _, b = days(spark, 60, 2)
    both = a.withColumn("s", F.lit("a")).unionByName(b.withColumn("s", F.lit("b")))
    whole = S.decompose(both, V, "Date", series="s")
    for name, one in (("a", a), ("b", b)):
        same(column(whole.filter(F.col("s") == name), "residual"), column(S.decompose(one, V, "Date"), "residual"))


def test_spine_fills_gaps(spark):
    d = dt.date(2021, 1, 30)
    df = spark.createDataFrame([("a", d, 5), ("b", d + dt.timedelta(days=3), 2)], "k string, Date date, n int")
    out = S.date_spine(df, "Date", 0, "k")
    assert out.count() == 8 and out.agg(F.sum("n")).first()[0] == 7
    assert S.date_spine(df.drop("k"), "Date").count() == 4


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 3),), (dt.date(2021, 1, 31),), (dt.date(2021, 2, 1),)], "Date date")
    a, b, c = calendar_features(df).orderBy("Date").collect()
    assert (a["WeekOfYear"], a["DayOfWeek"], a["IsWeekend"]) == (53, 6, 1)
    assert (b["IsMonthEnd"], c["IsMonthStart"], c["IsWeekend"], c["Quarter"]) == (1, 1, 0, 1)


@pytest.mark.parametrize("block", [7, 16, 100_000])
def test_sequences_with_a_hot_customer(spark, block):
    rng = np.random.default_rng(2)
    who = np.where(rng.random(400) < 0.5, 1, rng.integers(2, 40, 400))
    pdf = pd.DataFrame({"k": who, "t": rng.permutation(400), "v": rng.integers(0, 1000, 400)})
    got = S.sequences(spark.createDataFrame(pdf), "k", "v", ["t"], 5, 10, 8, block)
    got = sorted((r["k"], r["row"], tuple(r["sequence"]), r["target"]) for r in got.collect())
    sizes = pdf.groupby("k").size()
    order = sizes[sizes >= 10].reset_index(name="n").sort_values(["n", "k"], ascending=[False, True])["k"].head(8)
    want = []
    for k in order:
        v = list(pdf[pdf["k"] == k].sort_values("t")["v"])
        want += [(k, i + 1, tuple(v[i - 5 : i]), v[i]) for i in range(5, len(v))]
    assert got == sorted(want)


def test_stationarity_matches_least_squares(spark):
    pdf, df = days(spark, 60)
    x = pdf[V].to_numpy()
    design = np.column_stack([np.ones(59), x[:-1]])
    beta, rss = np.linalg.lstsq(design, np.diff(x), rcond=None)[:2]
    se = np.sqrt(rss[0] / 57 * np.linalg.inv(design.T @ design)[1, 1])
    got = S.stationarity(df, V, "Date").first()
    assert got["df_statistic"] == pytest.approx(beta[1] / se)
    assert got["is_stationary"] == bool(beta[1] / se < -2.86)


def test_time_folds(spark):
    _, df = days(spark, 22)
    folds = column(S.time_folds(df, "Date", 3), "fold")
    assert folds == [0.0] * 7 + [1.0] * 5 + [2.0] * 5 + [3.0] * 5


def test_even_period(spark):
    import numpy as np

    x = np.arange(24) * 2.0 + np.tile([3, -1, 0, 5, -4, -3], 4)
    rows = [(i, float(v)) for i, v in enumerate(x)]
    got = S.decompose(spark.createDataFrame(rows, "t int, v double"), "v", "t", period=6).orderBy("t").collect()
    weights = np.array([0.5, 1, 1, 1, 1, 1, 0.5]) / 6
    for i, r in enumerate(got):
        want = weights @ x[i - 3 : i + 4] if 3 <= i < 21 else None
        assert (r["trend"] is None) == (want is None) and (want is None or abs(r["trend"] - want) < 1e-9)
        assert want is None or abs(r["residual"]) < 1e-9


def test_ewm_with_gaps(spark):
    import pandas as pd

    values = [1.0, 2.0, None, 4.0, None, None, 3.0]
    df = spark.createDataFrame(list(enumerate(values)), "t int, v double")
    got = [r[2] for r in S.ewm(df, "v", [0.3], "t").orderBy("t").collect()]
    want = pd.Series(values).ewm(alpha=0.3).mean().tolist()
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_sequences_longer_than_a_block(spark):
    df = spark.createDataFrame([("k", i, float(i)) for i in range(40)], "k string, t int, v double")
    got = S.sequences(df, "k", "v", ["t"], 5, 10, None, 3).collect()
    assert len(got) == 35 and all(r["sequence"] == [r["target"] - j for j in range(5, 0, -1)] for r in got)


def _least_squares(x, lag, max_lag):
    """Statistic and AIC from numpy, on the rows that have all `max_lag` lags."""
    d = np.diff(x)
    y = d[max_lag:]
    level = x[max_lag:-1] - x.mean()  # the constant takes up the shift, and the products stay exact
    cols = [np.ones(len(y)), level] + [d[max_lag - k : len(d) - k] for k in range(1, lag + 1)]
    a = np.column_stack(cols)
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    rss = ((y - a @ beta) ** 2).sum()
    cov = rss / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)
    return beta[1] / np.sqrt(cov[1, 1]), len(y) * np.log(rss / len(y)) + 2 * a.shape[1], len(y)


def test_lagged_stationarity_matches_least_squares(spark):
    r = np.random.default_rng(5)
    walk, back = 1e6 + np.cumsum(r.normal(size=120)), np.zeros(120)
    for i in range(1, 120):
        back[i] = 0.5 * back[i - 1] + r.normal() + 0.3 * (back[i - 1] - back[max(0, i - 2)])
    days_ = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [(k, d, float(v)) for k, xs in (("walk", walk), ("back", back), ("flat", np.ones(120))) for d, v in zip(days_, xs)]
    rows += [("short", days_[i], float(i * i)) for i in range(6)]
    df = spark.createDataFrame(rows, "s string, day date, v double").repartition(4)
    got = {(x["s"], x["lag"]): x for x in S.lagged_stationarity(df, "v", "day", "s").collect()}
    for name, xs in (("walk", walk), ("back", back)):
        aics = []
        for lag in range(6):
            stat, aic, n = _least_squares(xs, lag, 5)
            row = got[name, lag]
            assert row["n"] == n and row["df_statistic"] == pytest.approx(stat, rel=1e-6) and row["aic"] == pytest.approx(aic, rel=1e-6)
            aics.append(aic)
        assert [got[name, lag]["chosen"] for lag in range(6)] == [a == min(aics) for a in aics]
    assert got["back", 0]["is_stationary"] and got["back", 0]["p_value"] < 0.01 and got["walk", 0]["p_value"] > 0.05
    assert all(got["flat", lag]["df_statistic"] is None and not got["flat", lag]["chosen"] for lag in range(6))
    assert ("short", 0) not in got


@pytest.mark.parametrize("stat, p", [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (-0.44, 0.90), (-0.07, 0.95), (0.6, 0.99), (-20, 0.0), (3, 1.0)])
def test_p_values_at_the_known_points(stat, p):
    assert S._dickey_fuller_p(stat) == pytest.approx(p, abs=0.004)
