import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillroll.functions import pvalues
from tillroll.operators import experiments as X


def groups(spark, n=400, seed=4, shift=0.3, ties=False):
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.6, "control", "treatment")
    x = rng.normal(10, 2, n) + shift * (g == "treatment")
    pdf = pd.DataFrame({"g": g, "x": x.round(0 if ties else 6), "t": rng.permutation(n), "hit": rng.random(n) < 0.3})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_stored_t_and_p(spark):
    """Moments and results of a stored simulation run."""
    m = spark.createDataFrame(
        [(1000, 100.38664111644651, 19.574524154947085, 1000, 106.41672474498311, 19.939110505892604)],
        "n1 long, m1 double, s1 double, n2 long, m2 double, s2 double",
    )
    var = [F.col(f"s{i}") * F.col(f"s{i}") * F.col(f"n{i}") / (F.col(f"n{i}") - 1) for i in (1, 2)]
    t = X._pooled_t(F.col("n1"), F.col("m1"), var[0], F.col("n2"), F.col("m2"), var[1])
    row = m.select(t.alias("t")).withColumn("p", pvalues.t_pvalue(F.col("t"), F.lit(1998))).first()
    assert row["t"] == pytest.approx(-6.821118762322212, rel=1e-10)
    assert row["p"] == pytest.approx(1.1930227028536482e-11, rel=1e-8)


def test_stored_mann_whitney_p():
    u, n = 410838.0, 1000.0
    z = (n * n - u - n * n / 2 - 0.5) / np.sqrt(n * n / 12 * (2 * n + 1))
    assert pvalues.normal_two_sided(z) == pytest.approx(5.031171078462739e-12, rel=1e-9)


def test_p_values_at_known_points():
    # For one degree of freedom the t distribution is Cauchy: p(1) = 1/2.
    assert pvalues.t_two_sided(1.0, 1.0) == pytest.approx(0.5)
    # For two: p = 1 - t / sqrt(2 + t^2).
    assert pvalues.t_two_sided(2.0, 2.0) == pytest.approx(1 - 2 / np.sqrt(6))
    assert pvalues.t_two_sided(0.0, 30.0) == pytest.approx(1.0)
    assert pvalues.t_two_sided(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)


def test_ttest_by_hand(spark):
    pdf, df = groups(spark)
    a, b = (pdf[pdf["g"] == k]["x"].to_numpy() for k in ("control", "treatment"))
    pool = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    row = X.ab_ttest(df, "g", "x").first()
    assert row["t_statistic"] == pytest.approx((a.mean() - b.mean()) / np.sqrt(pool * (1 / len(a) + 1 / len(b))))
    assert row["control_median"] == pytest.approx(np.median(a)) and row["control_std"] == pytest.approx(a.std())
    assert row["effect_size_cohens_d"] == pytest.approx((b.mean() - a.mean()) / np.sqrt(pool))
    assert row["relative_change_percent"] == pytest.approx((b.mean() / a.mean() - 1) * 100)


@pytest.mark.parametrize("ties", [False, True])
def test_mann_whitney_by_pairs(spark, ties):
    pdf, df = groups(spark, ties=ties)
    a, b = (pdf[pdf["g"] == k]["x"].to_numpy() for k in ("control", "treatment"))
    u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    n1, n2 = len(a), len(b)
    t = pd.Series(np.r_[a, b]).value_counts().to_numpy(dtype=float)
    n = n1 + n2
    sd = np.sqrt(n1 * n2 / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
    row = X.ab_mann_whitney(df, "g", "x").first()
    assert row["u_statistic"] == u
    assert row["z"] == pytest.approx((max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd)
    assert 0 < row["p_value"] <= 1


def test_bootstrap_is_repeatable_and_near_the_normal_interval(spark):
    pdf, df = groups(spark, 3000)
    one = X.ab_bootstrap_ci(df, "g", "x", 500).first()
    two = X.ab_bootstrap_ci(df.repartition(3), "g", "x", 500).first()
    assert one["ci_lower"] == pytest.approx(two["ci_lower"]) and one["replicates"] == 500
    a, b = (pdf[pdf["g"] == k]["x"] for k in ("control", "treatment"))
    half = 1.96 * np.sqrt(a.var() / len(a) + b.var() / len(b))
    middle = b.mean() - a.mean()
    assert one["ci_lower"] == pytest.approx(middle - half, abs=half * 0.25)
    assert one["ci_upper"] == pytest.approx(middle + half, abs=half * 0.25)


def test_bootstrap_keeps_the_width(spark):
    """The interval of a larger table has the right width too."""
    pdf, df = groups(spark, 20_000)
    row = X.ab_bootstrap_ci(df, "g", "x", 500).first()
    a, b = (pdf[pdf["g"] == k]["x"] for k in ("control", "treatment"))
    width = 2 * 1.96 * np.sqrt(a.var() / len(a) + b.var() / len(b))
    assert row["ci_upper"] - row["ci_lower"] == pytest.approx(width, rel=0.2)


def test_bootstrap_over_values_agrees_with_one_over_rows(spark):
    """Few values, many equal rows, one value with most of them: the interval of a resampling row by row."""
    r = np.random.default_rng(8)
    control, treatment = r.choice([0.0, 1.0, 5.0], 4000, p=[0.8, 0.15, 0.05]), r.choice([0.0, 1.0, 5.0], 3000, p=[0.7, 0.2, 0.1])
    rows = [("control", float(x)) for x in control] + [("treatment", float(x)) for x in treatment] + [("other", 9.0), ("control", None)]
    got = X.ab_bootstrap_ci(spark.createDataFrame(rows, "g string, x double"), "g", "x", 2000).first()
    drawn = [r.choice(treatment, 3000).mean() - r.choice(control, 4000).mean() for _ in range(2000)]
    low, high = np.quantile(drawn, [0.025, 0.975])
    assert got["ci_lower"] == pytest.approx(low, abs=0.1 * (high - low)) and got["ci_upper"] == pytest.approx(high, abs=0.1 * (high - low))


def test_verdicts(spark):
    df = spark.createDataFrame(
        [(0.001, 5.0, 0.3), (0.03, 1.0, 0.1), (0.2, 9.0, 0.9), (0.01, -3.0, -0.6)],
        "p_value double, relative_change_percent double, effect_size_cohens_d double",
    )
    rows = X.ab_verdict(df).collect()
    assert [r["launch"] for r in rows] == ["Launch", "Launch", "Don't Launch", "Don't Launch"]
    assert [r["confidence_level"] for r in rows] == ["High", "Medium", "Low", "Medium"]
    assert [r["effect_magnitude"] for r in rows] == ["Medium effect", "Small effect", "Large effect", "Large effect"]
    assert [r["recommendation"] for r in rows] == [
        "Strong recommendation to launch", "Moderate recommendation to launch",
        "Insufficient evidence to launch", "Do not launch - negative impact",
    ]


def test_segments(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"Total_Spent": rng.integers(0, 500, 203) / 1.0})
    want = pd.qcut(pdf["Total_Spent"], 4, labels=["Low", "Medium", "High", "Premium"]).astype(str)
    df = X.quartile_segment(spark.createDataFrame(pdf), "Total_Spent")
    got = df.groupBy("Spending_Quartile").count().collect()
    assert {r[0]: r[1] for r in got} == want.value_counts().to_dict()
    pairs = X.segment_pairwise_ttest(df).collect()
    assert len(pairs) == 6 and all(r["p_value"] < 1e-6 and r["significant"] for r in pairs)
    low, high = (pdf["Total_Spent"][want == k] for k in ("Low", "High"))
    row = next(r for r in pairs if (r["segment_1"], r["segment_2"]) == ("Low", "High"))
    assert row["effect_size"] == pytest.approx(
        (high.mean() - low.mean()) / np.sqrt((np.var(low.to_numpy()) + np.var(high.to_numpy())) / 2)
    )
    assert X.segment_pairwise_ttest(df, min_rows=1000).count() == 0


def test_bayes(spark):
    pdf, df = groups(spark, 2000)
    row = X.ab_bayes(df, "g", "hit", draws=4000).first()
    a, b = (pdf[pdf["g"] == k]["hit"] for k in ("control", "treatment"))
    assert (row["control_conversions"], row["control_total"]) == (a.sum(), len(a))
    assert row["control_alpha"] == a.sum() + 1 and row["treatment_beta"] == len(b) - b.sum() + 1
    sd = np.sqrt(a.mean() * (1 - a.mean()) / len(a))
    assert row["control_lower"] == pytest.approx(a.mean() - 1.96 * sd, abs=sd * 0.3)
    assert row["prob_treatment_better"] == X.ab_bayes(df.repartition(2), "g", "hit", draws=4000).first()["prob_treatment_better"]


def test_sequential_by_prefixes(spark):
    pdf, df = groups(spark, 400, shift=1.0)
    pdf = pdf.sort_values("t")
    a, b = (pdf[pdf["g"] == k]["x"].to_numpy() for k in ("control", "treatment"))
    sizes = list(range(50, min(len(a), len(b)), 10))
    want = {
        n: (a[:n].mean() - b[:n].mean()) / np.sqrt((a[:n].var(ddof=1) + b[:n].var(ddof=1)) / n) for n in sizes
    }
    looks = {r["sample_size"]: r for r in X.sequential_looks(df, "g", "x", ["t"]).collect()}
    assert sorted(looks) == sizes
    for n, t in want.items():
        assert looks[n]["t_statistic"] == pytest.approx(t)
    level = 0.05 / len(sizes)
    first = next((n for n in sizes if looks[n]["p_value"] < level), None)
    row = X.sequential_test(df, "g", "x", ["t"]).first()
    assert row["tests_performed"] == len(sizes) and row["alpha_spent_per_test"] == pytest.approx(level)
    assert row["early_stopping_point"] == first
    assert row["recommendation"] == ("Stop early" if first else "Continue to planned sample size")
    assert row["final_p_value"] == pytest.approx(looks[sizes[-1]]["p_value"])
    with pytest.raises(ValueError):
        X.sequential_test(df.limit(50), "g", "x", ["t"])


def test_running_moments_over_many_buckets(spark):
    pdf, df = groups(spark, 300)
    small = X.running_moments(df, "g", "x", ["t"], 10, bucket=3).orderBy("g", "block").collect()
    big = X.running_moments(df, "g", "x", ["t"], 10).orderBy("g", "block").collect()
    for r, s in zip(small, big):
        assert (r["g"], r["block"], r["n"]) == (s["g"], s["block"], s["n"])
        assert r["s"] == pytest.approx(s["s"], abs=1e-9) and r["q"] == pytest.approx(s["q"])


def test_assignment(spark):
    df = spark.range(20_000)
    out = X.assign_variants(df, "id", ["a", "b", "c"], [0.5, 0.3, 0.2], "exp1")
    got = {r[0]: r[1] / 20_000 for r in out.groupBy("variant").count().collect()}
    assert got["a"] == pytest.approx(0.5, abs=0.02) and got["c"] == pytest.approx(0.2, abs=0.02)
    again = X.assign_variants(df.repartition(9), "id", ["a", "b", "c"], [0.5, 0.3, 0.2], "exp1")
    assert out.exceptAll(again).count() == 0
    with pytest.raises(ValueError):
        X.assign_variants(df, "id", ["a"], [0.5, 0.5], "s")
    with pytest.raises(ValueError):
        X.assign_variants(df, "id", ["a", "b"], [0.5, 0.4], "s")


def test_tiny_shares_get_rows(spark):
    out = X.assign_variants(spark.range(400_000), "id", ["a", "b"], [0.00004, 0.99996], "s")
    assert 4 <= out.filter("variant = 'a'").count() <= 40


def test_sequential_looks_skip_nulls(spark):
    rows = [(i, "control" if i % 2 else "treatment", float(i % 7 + i % 2)) for i in range(400)]
    gaps = [(1000 + i, "control" if i % 2 else "treatment", None) for i in range(50)]
    order = [(float(r[0]) if r[0] < 1000 else r[0] - 1000 + 0.5, *r[1:]) for r in rows + gaps]
    schema = "t double, g string, x double"
    whole = X.sequential_looks(spark.createDataFrame([r for r in order if r[2] is not None], schema), "g", "x", ["t"])
    holes = X.sequential_looks(spark.createDataFrame(order, schema), "g", "x", ["t"])
    got, want = (np.array(sorted(map(tuple, x.collect()))) for x in (holes, whole))
    assert len(want) and np.allclose(got, want, rtol=1e-9)


def test_no_p_value_is_no_evidence(spark):
    schema = "p_value double, relative_change_percent double, effect_size_cohens_d double"
    rows = spark.createDataFrame([(None, 5.0, 0.1), (0.2, 5.0, 0.1), (0.01, 5.0, 0.1), (0.01, 1.0, 0.1), (0.01, -1.0, 0.1)], schema)
    said = [r["recommendation"].split()[0] for r in X.ab_verdict(rows).collect()]
    assert said == ["Insufficient", "Insufficient", "Strong", "Moderate", "Do"]
