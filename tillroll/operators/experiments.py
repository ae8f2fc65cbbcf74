"""A/B statistics on observed rows: group tests, segments, sequential looks, assignment."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import HASH_BITS, key_hash, mean_of, ratio
from tillroll.functions.pvalues import t_pvalue, upper_normal_pvalue
from tillroll.operators.ordering import rank_in_groups, running_totals
from tillroll.operators.selection import quantiles

CONTROL, TREATMENT = "control", "treatment"


def _pooled_t(n1, m1, v1, n2, m2, v2) -> Column:
    """Student's t from counts, means and sample variances."""
    pooled = ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    return F.try_divide(m1 - m2, F.sqrt(pooled * (ratio(F.lit(1), n1) + ratio(F.lit(1), n2))))


def group_stats(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Size, mean, population deviation and median of each group."""
    x = F.col(metric).cast("double")
    stats = df.filter(F.col(metric).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.var_samp(x).alias("var"),
    )
    medians = quantiles(df, metric, (0.5,), [group]).select(group, F.col("value").alias("median"))
    return stats.join(medians, group)


def ab_ttest(
    df: DataFrame, group: str, metric: str, control: str = CONTROL, treatment: str = TREATMENT
) -> DataFrame:
    """One row: both groups' statistics, pooled t test, change and Cohen's d."""
    stats = group_stats(df, group, metric)
    wide = stats.agg(
        *[
            F.max(F.when(F.col(group) == who, F.col(c))).alias(f"{tag}_{c}")
            for who, tag in ((control, "control"), (treatment, "treatment"))
            for c in ("n", "mean", "std", "median", "var")
        ]
    )
    n1, m1, v1 = (F.col(f"control_{c}") for c in ("n", "mean", "var"))
    n2, m2, v2 = (F.col(f"treatment_{c}") for c in ("n", "mean", "var"))
    pooled_sd = F.sqrt(ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    wide = wide.withColumns(
        {
            "t_statistic": _pooled_t(n1, m1, v1, n2, m2, v2),
            "degrees_of_freedom": n1 + n2 - 2,
            "absolute_difference": m2 - m1,
            "relative_change_percent": ratio(m2 - m1, m1) * 100,
            "effect_size_cohens_d": F.try_divide(m2 - m1, pooled_sd),
        }
    )
    return wide.withColumn(
        "p_value", t_pvalue(F.col("t_statistic"), F.col("degrees_of_freedom"))
    ).drop("control_var", "treatment_var")


def ab_mann_whitney(
    df: DataFrame, group: str, metric: str, control: str = CONTROL, treatment: str = TREATMENT
) -> DataFrame:
    """One row: U of the control group, z with tie and continuity correction, p.

    Equal values are counted first, so U needs one running total over distinct values:
    each control value beats the treatment values below it and half of its ties.
    """
    g = F.col(group)
    counts = (
        df.filter(F.col(metric).isNotNull() & g.isin(control, treatment))
        .groupBy(F.col(metric).alias("v"))
        .agg(F.count_if(g == control).alias("a"), F.count_if(g == treatment).alias("b"))
    )
    run = running_totals(counts, ["v"], ["b"])
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    t = a + b
    sums = run.agg(
        F.sum(a * (F.col("run_b") - b + b / 2)).alias("u_statistic"),
        F.sum(a).alias("n1"),
        F.sum(b).alias("n2"),
        F.sum(t * t * t - t).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    middle = n1 * n2 / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    larger = F.greatest(F.col("u_statistic"), n1 * n2 - F.col("u_statistic"))
    z = F.try_divide(larger - middle - 0.5, spread)
    return sums.select(
        "u_statistic", n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), z.alias("z")
    ).withColumn("p_value", upper_normal_pvalue(F.col("z")))


def _resampled(b: int):
    """Per task: for every resample, sums of weighted values and weights of both groups."""

    def run(batches):
        total = np.zeros((4, b))
        for batch in batches:
            columns = (batch[c].to_numpy() for c in ("h", "x", "m", "treated"))
            for h, x, m, treated in zip(*columns):
                w = np.random.Generator(np.random.Philox(key=int(h) & (1 << 64) - 1)).poisson(m, b)
                at = 2 if treated else 0
                total[at] += x * w
                total[at + 1] += w
        yield pd.DataFrame(
            {"replicate": np.arange(b, dtype=np.int32), "s0": total[0], "n0": total[1], "s1": total[2], "n1": total[3]}
        )

    return run


def ab_bootstrap_ci(
    df: DataFrame,
    group: str,
    metric: str,
    b: int = 1000,
    seed: int = fixed.SEED,
    control: str = CONTROL,
    treatment: str = TREATMENT,
) -> DataFrame:
    """95% interval of the difference of means from `b` Poisson resamples of the rows.

    A row's weight in a resample is Poisson(1), so m rows of one group and value weigh Poisson(m)
    together, in one draw: equal rows are counted first, and only their counts are shuffled.
    Draws are seeded by group and value, so a retried task draws the same. Each task keeps two running
    sums per group and resample and sends those on.
    """
    rows = df.filter(F.col(metric).isNotNull() & F.col(group).isin(control, treatment)).select(
        (F.col(group) == treatment).alias("treated"), F.col(metric).cast("double").alias("x")
    )
    counted = rows.groupBy("treated", "x").agg(F.count(F.lit(1)).alias("m"))
    # Few bytes, much to compute: the counts keep all shuffle partitions, which adaptive execution would merge.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeded = counted.withColumn("h", F.xxhash64("treated", "x", F.lit(seed))).repartition(parts, "h")
    sums = seeded.mapInPandas(_resampled(b), "replicate int, s0 double, n0 double, s1 double, n1 double")
    diffs = sums.groupBy("replicate").agg(
        (ratio(F.sum("s1"), F.sum("n1")) - ratio(F.sum("s0"), F.sum("n0"))).alias("diff")
    )
    # `b` rows are left, so the built-in exact percentile is small.
    return diffs.agg(
        F.count("diff").alias("replicates"),
        F.percentile("diff", F.lit(0.025)).alias("ci_lower"),
        F.percentile("diff", F.lit(0.975)).alias("ci_upper"),
    )


def ab_verdict(tests: DataFrame) -> DataFrame:
    """Launch decision and wording for rows of `ab_ttest`; without a p-value there is no evidence."""
    p, change = F.col("p_value"), F.col("relative_change_percent")
    d = F.abs(F.col("effect_size_cohens_d"))
    return tests.withColumns(
        {
            "significant": p < 0.05,
            "launch": F.when((p < 0.05) & (change > 0), "Launch").otherwise("Don't Launch"),
            "confidence_level": F.when(p < 0.01, "High").when(p < 0.05, "Medium").otherwise("Low"),
            # The wording shown to readers.
            "significance": F.when(p < 0.01, "Highly significant (p < 0.01)")
            .when(p < 0.05, "Significant (p < 0.05)")
            .otherwise("Not significant (p >= 0.05)"),
            "effect_magnitude": F.when(d < 0.2, "Small effect")
            .when(d < 0.5, "Medium effect")
            .otherwise("Large effect"),
            "recommendation": F.when((p < 0.05) & (change > 2), "Strong recommendation to launch")
            .when((p < 0.05) & (change > 0), "Moderate recommendation to launch")
            .when(p < 0.05, "Do not launch - negative impact")
            .otherwise("Insufficient evidence to launch"),
        }
    )


def quartile_segment(
    df: DataFrame, value: str, labels: Sequence[str] = fixed.QUARTILE_LABELS
) -> DataFrame:
    """Adds `Spending_Quartile` by value quartiles; the lowest value counts in."""
    q = (
        quantiles(df, value, (0.25, 0.5, 0.75))
        .agg(F.map_from_entries(F.collect_list(F.struct("prob", "value"))))
        .scalar()
    )
    x = F.col(value).cast("double")
    out = F.when(x.isNull(), F.lit(None))
    for p, label in zip((0.25, 0.5, 0.75), labels):
        out = out.when(x <= F.element_at(q, F.lit(p)), F.lit(label))
    return df.withColumn("Spending_Quartile", out.otherwise(F.lit(labels[3])))


def segment_moments(df: DataFrame, segment: str, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.groupBy(segment).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.var_samp(x).alias("var"),
        F.var_pop(x).alias("var_pop"),
    )


def segment_pairs(moments: DataFrame, segment: str, labels: Sequence[str]) -> DataFrame:
    """Each ordered pair of labels with both sides' moments.

    Every segment row names the pairs it belongs to and its side, and one grouping by
    pair brings the two sides together.
    """
    sides = [
        F.struct(F.lit(a).alias("segment_1"), F.lit(b).alias("segment_2"), F.lit(own).alias("own"))
        for i, a in enumerate(labels)
        for b in labels[i + 1 :]
        for own in (a, b)
    ]
    long = moments.select("*", F.explode(F.array(*sides)).alias("pair")).filter(
        F.col("pair.own") == F.col(segment)
    )
    cols = ("n", "mean", "var", "var_pop")
    return long.groupBy(F.col("pair.segment_1"), F.col("pair.segment_2")).agg(
        *[
            F.max(F.when(F.col("pair.own") == F.col(f"pair.segment_{i}"), F.col(c))).alias(f"{c}_{i}")
            for i in (1, 2)
            for c in cols
        ]
    )


def segment_pairwise_ttest(
    df: DataFrame,
    segment: str = "Spending_Quartile",
    value: str = "Total_Spent",
    labels: Sequence[str] = fixed.QUARTILE_LABELS,
    min_rows: int = fixed.SEGMENT_MIN_ROWS,
) -> DataFrame:
    """t test and effect size for each pair of segments with more than `min_rows` rows."""
    pairs = segment_pairs(segment_moments(df, segment, value), segment, labels).filter(
        (F.col("n_1") > min_rows) & (F.col("n_2") > min_rows)
    )
    side = [[F.col(f"{c}_{i}") for c in ("n", "mean", "var")] for i in (1, 2)]
    difference = F.col("mean_2") - F.col("mean_1")
    tested = pairs.select(
        "segment_1",
        "segment_2",
        F.col("mean_1").alias("segment_1_mean"),
        F.col("mean_2").alias("segment_2_mean"),
        difference.alias("difference"),
        _pooled_t(*side[0], *side[1]).alias("t_statistic"),
        F.try_divide(difference, F.sqrt((F.col("var_pop_1") + F.col("var_pop_2")) / 2)).alias("effect_size"),
        F.col("n_1").alias("sample_size_1"),
        F.col("n_2").alias("sample_size_2"),
    )
    p = t_pvalue(F.col("t_statistic"), F.col("sample_size_1") + F.col("sample_size_2") - 2)
    return tested.withColumn("p_value", p).withColumn("significant", F.col("p_value") < fixed.ALPHA)


def segment_summary(df: DataFrame, segment: str = "Spending_Quartile") -> DataFrame:
    spent = F.col("Total_Spent").cast("double")
    stats = df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("customers"),
        mean_of(F.col("Total_Spent")).alias("mean_spent"),
        F.stddev_samp(spent).alias("std_spent"),
        mean_of(F.col("Total_Orders")).alias("mean_orders"),
        F.avg("Avg_Order_Value").alias("mean_order_value"),
    )
    medians = quantiles(df, "Total_Spent", (0.5,), [segment]).select(
        segment, F.col("value").alias("median_spent")
    )
    return stats.join(medians, segment)


def bayes_posterior(
    df: DataFrame, group: str, converted: str, control: str = CONTROL, treatment: str = TREATMENT
) -> DataFrame:
    """Conversions, totals, rates and Beta posteriors (uniform prior) of both groups."""
    g, hit = F.col(group), F.coalesce(F.col(converted).cast("boolean"), F.lit(False))
    counted = df.agg(
        *[
            c
            for who, tag in ((control, "control"), (treatment, "treatment"))
            for c in (
                F.count_if((g == who) & hit).alias(f"{tag}_conversions"),
                F.count_if(g == who).alias(f"{tag}_total"),
            )
        ]
    )
    made = {}
    for tag in ("control", "treatment"):
        hits, total = F.col(f"{tag}_conversions"), F.col(f"{tag}_total")
        made[f"{tag}_rate"] = ratio(hits, total)
        made[f"{tag}_alpha"] = hits + 1
        made[f"{tag}_beta"] = total - hits + 1
    return counted.withColumns(made)


def ab_bayes(
    df: DataFrame,
    group: str,
    converted: str,
    draws: int = 10_000,
    seed: int = fixed.SEED,
    control: str = CONTROL,
    treatment: str = TREATMENT,
) -> DataFrame:
    """One row: posteriors, P(treatment better), lift and 95% intervals, decision."""
    post = bayes_posterior(df, group, converted, control, treatment)
    shape = ("control_alpha", "control_beta", "treatment_alpha", "treatment_beta")

    @F.pandas_udf("c double, t double")
    def draw(i: pd.Series, ca: pd.Series, cb: pd.Series, ta: pd.Series, tb: pd.Series) -> pd.DataFrame:
        # One generator per draw number: the same draws under any batching.
        out = np.empty((len(i), 2))
        for j, n in enumerate(i):
            rng = np.random.default_rng([seed, n])
            out[j] = rng.beta(ca[j], cb[j]), rng.beta(ta[j], tb[j])
        return pd.DataFrame(out, columns=["c", "t"])

    drawn = (
        df.sparkSession.range(draws)
        .withColumn("p", post.select(F.struct(*shape)).scalar())
        .select(draw("id", *[F.col(f"p.{s}") for s in shape]).alias("d"))
        .select("d.c", "d.t", F.try_divide(F.col("d.t") - F.col("d.c"), F.col("d.c")).alias("lift"))
    )

    def ends(c: str):
        return [F.percentile(c, F.lit(q)).alias(f"{c}_{s}") for q, s in ((0.025, "lo"), (0.975, "hi"))]

    summary = drawn.agg(
        F.struct(
            F.avg((F.col("t") > F.col("c")).cast("double")).alias("better"),
            F.avg("lift").alias("lift"),
            *ends("c"), *ends("t"), *ends("lift"),
        ).alias("s")
    ).scalar()
    better = F.col("prob_treatment_better")
    confident = better > fixed.BAYES_LAUNCH
    return (
        post.withColumn("s", summary)
        .select(
            *post.columns,
            F.col("s.better").alias("prob_treatment_better"),
            (F.col("s.lift") * 100).alias("expected_lift_percent"),
            (F.col("s.lift_lo") * 100).alias("lift_lower"),
            (F.col("s.lift_hi") * 100).alias("lift_upper"),
            F.col("s.c_lo").alias("control_lower"),
            F.col("s.c_hi").alias("control_upper"),
            F.col("s.t_lo").alias("treatment_lower"),
            F.col("s.t_hi").alias("treatment_upper"),
        )
        .withColumns(
            {
                "decision": F.when(confident, "Launch").otherwise("Don't Launch"),
                "confidence": F.when(confident, "High")
                .when(better > fixed.BAYES_MEDIUM, "Medium")
                .otherwise("Low"),
            }
        )
    )


_BLOCKS_PER_BUCKET = 100_000


def running_moments(
    df: DataFrame,
    group: str,
    metric: str,
    order: Sequence[str],
    step: int = fixed.SEQUENTIAL_STEP,
    bucket: int = _BLOCKS_PER_BUCKET,
) -> DataFrame:
    """Per group, count, sum and sum of squares of its first 10, 20, 30, ... rows with a metric.

    Rows are numbered in order and summed in blocks of `step`. Running sums are built
    inside buckets of blocks and then shifted by the buckets before, so no window holds
    a whole group. The metric is centred on its mean, which keeps the squares accurate.
    """
    df = df.filter(F.col(metric).isNotNull())
    centre = df.agg(F.avg(F.col(metric).cast("double"))).scalar()
    ranked = rank_in_groups(df.select(group, *order, metric), [group], list(order), "row")
    x = F.col("x")
    blocks = (
        ranked.withColumn("x", F.col(metric).cast("double") - centre)
        .groupBy(group, F.floor((F.col("row") - 1) / step).cast("long").alias("block"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
        .withColumn("bucket", F.floor(F.col("block") / bucket))
    )
    inside = (
        Window.partitionBy(group, "bucket")
        .orderBy("block")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = ("n", "s", "q")
    before = (
        blocks.groupBy(group, "bucket")
        .agg(*[F.sum(c).alias(c) for c in names])
        .select(group, "bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in names])
    )
    return (
        blocks.withColumns({c: F.sum(c).over(inside) for c in names})
        .join(before, [group, "bucket"])
        .select(group, "block", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in names])
    )


def align_at_n(
    running: DataFrame, group: str, control: str = CONTROL, treatment: str = TREATMENT
) -> DataFrame:
    """Control and treatment moments at the same sample size, where both are there."""
    sides = ((control, 1), (treatment, 2))
    wide = running.groupBy("block").agg(
        *[
            F.max(F.when(F.col(group) == who, F.col(c))).alias(f"{c}{i}")
            for who, i in sides
            for c in ("n", "s", "q")
        ]
    )
    return wide.filter(F.col("n1") == F.col("n2"))


def sequential_looks(
    df: DataFrame,
    group: str,
    metric: str,
    order: Sequence[str],
    start: int = fixed.SEQUENTIAL_START,
    step: int = fixed.SEQUENTIAL_STEP,
    control: str = CONTROL,
    treatment: str = TREATMENT,
) -> DataFrame:
    """One row per look: sample size per group, t and p over the first observed rows of each group."""
    df = df.filter(F.col(metric).isNotNull())
    sizes = df.agg(
        F.least(F.count_if(F.col(group) == control), F.count_if(F.col(group) == treatment))
    ).scalar()
    aligned = align_at_n(running_moments(df, group, metric, order, step), group, control, treatment)
    n = F.col("n1")
    looks = aligned.filter((n % step == 0) & (n >= start) & ((n - start) % step == 0) & (n < sizes))

    def mean(i):
        return F.col(f"s{i}") / n

    def var(i):
        return (F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / n) / (n - 1)

    return looks.select(
        n.alias("sample_size"), _pooled_t(n, mean(1), var(1), n, mean(2), var(2)).alias("t_statistic")
    ).withColumn("p_value", t_pvalue(F.col("t_statistic"), 2 * F.col("sample_size") - 2))


def sequential_test(
    df: DataFrame,
    group: str,
    metric: str,
    order: Sequence[str],
    control: str = CONTROL,
    treatment: str = TREATMENT,
) -> DataFrame:
    """One row: rows in the smaller group, looks, corrected level, first look that passes it, last p."""
    if df.filter(F.col(metric).isNotNull()).limit(fixed.SEQUENTIAL_MIN_ROWS).count() < fixed.SEQUENTIAL_MIN_ROWS:
        raise ValueError(f"a sequential test needs {fixed.SEQUENTIAL_MIN_ROWS} rows")
    looks = sequential_looks(df, group, metric, order, control=control, treatment=treatment)
    level = F.lit(fixed.ALPHA) / looks.agg(F.count(F.lit(1))).scalar()
    observed = df.filter(F.col(metric).isNotNull()).agg(
        F.least(F.count_if(F.col(group) == control), F.count_if(F.col(group) == treatment))
    )
    judged = looks.withColumn("_level", level)
    return judged.agg(
        F.max(observed.scalar()).alias("total_samples_available"),
        F.count(F.lit(1)).alias("tests_performed"),
        F.max("_level").alias("alpha_spent_per_test"),
        F.min(F.when(F.col("p_value") < F.col("_level"), F.col("sample_size"))).alias("early_stopping_point"),
        F.max_by("p_value", "sample_size").alias("final_p_value"),
    ).withColumn(
        "recommendation",
        F.when(F.col("early_stopping_point").isNotNull(), "Stop early").otherwise(
            "Continue to planned sample size"
        ),
    )


def assign_variants(
    df: DataFrame, key: str, segments: Sequence[str], ratios: Sequence[float], salt: str
) -> DataFrame:
    """Adds `variant` by a salted 60-bit hash of the key: stable, and no shuffle."""
    if len(segments) != len(ratios):
        raise ValueError("segments and ratios differ in length")
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("ratios must sum to 1")
    place = key_hash(salt, key)
    out = F.lit(segments[-1])
    for i in range(len(segments) - 2, -1, -1):
        bound = int(math.fsum(ratios[: i + 1]) * 2.0**HASH_BITS)
        out = F.when(place < bound, F.lit(segments[i])).otherwise(out)
    return df.withColumn("variant", out)
