"""Time series operators.

Facts are reduced to one row per day (per series) first, so an unpartitioned window
here runs over at most one calendar. With `series` each series is its own window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import mean_of, ratio
from tillroll.operators.aggregates import TOTAL, distinct_per, value_counts
from tillroll.operators.ordering import rank_in_groups


def daily_series(sales: DataFrame) -> DataFrame:
    """One row per day of sales: revenue, orders, customers, items and products.

    Each distinct count reads the day and its own column, so `sales` should be a stored table.
    """
    seen = distinct_per(
        sales, "Date", {"Daily_Orders": "Invoice", "Daily_Customers": "Customer_ID", "Daily_Products": "StockCode"}
    )
    summed = sales.groupBy("Date").agg(
        F.sum("Revenue").cast(TOTAL).alias("Daily_Revenue"), F.sum("Quantity").alias("Daily_Items")
    )
    return summed.join(seen, "Date").select(
        "Date", "Daily_Revenue", "Daily_Orders", "Daily_Customers", "Daily_Items", "Daily_Products"
    )


def date_spine(df: DataFrame, date: str, fill: int = 0, series: str | None = None) -> DataFrame:
    """Every day between the first and the last, per series; missing numbers become `fill`."""
    span = df.agg(F.struct(F.min(date).alias("a"), F.max(date).alias("b")).alias("s")).scalar()
    keys = df.select(series).distinct() if series else df.sparkSession.range(1).select()
    days = keys.withColumn("_s", span).withColumn(
        date, F.explode(F.sequence(F.col("_s.a"), F.col("_s.b")))
    ).drop("_s")
    return days.join(df, [series, date] if series else [date], "left").fillna(fill)


def _over(order: str, series: str | None):
    base = Window.partitionBy(series) if series else Window.partitionBy()
    return base.orderBy(order)


def lags(
    df: DataFrame,
    value: str,
    periods: Sequence[int],
    order: str,
    series: str | None = None,
    fill=None,
) -> DataFrame:
    w = _over(order, series)
    made = {f"{value}_lag_{p}": F.lag(value, p).over(w) for p in periods}
    if fill is not None:
        made = {n: F.coalesce(c, F.lit(fill)) for n, c in made.items()}
    return df.withColumns(made)


def _full(order: str, series: str | None, rows: int, value: str, c) -> Column:
    w = _over(order, series).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) == rows, c(w))


def rolling_stats(
    df: DataFrame,
    value: str,
    windows: Sequence[int],
    order: str,
    series: str | None = None,
) -> DataFrame:
    """Mean, sample deviation, maximum and minimum; null until the window is full."""
    made = {}
    for n in windows:
        for name, stat in (
            ("mean", lambda w, n=n: F.sum(value).over(w).cast("double") / n),
            ("std", lambda w: F.stddev_samp(F.col(value).cast("double")).over(w)),
            ("max", lambda w: F.max(value).over(w)),
            ("min", lambda w: F.min(value).over(w)),
        ):
            made[f"{value}_rolling_{name}_{n}"] = _full(order, series, n, value, stat)
    return df.withColumns(made)


def _tag(alpha: float) -> str:
    return str(alpha).replace(".", "")


def _discounted(values: Column, keep: float) -> Column:
    """The last value plus `keep` times the one before, and so on; a null counts as 0 in its place."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc * keep + F.coalesce(x["v"], F.lit(0.0)))


def ewm(
    df: DataFrame,
    value: str,
    alphas: Sequence[float],
    order: str,
    series: str | None = None,
) -> DataFrame:
    """Exponentially weighted mean with weights (1-a)^i scaled to sum to one.

    A null has no weight but keeps its place, so what lies before it fades as much. Weights below 1e-17 cannot change a double, which bounds the frame.
    """
    made = {}
    for a in alphas:
        keep = 1.0 - a
        rows = math.ceil(math.log(1e-17) / math.log(keep))
        x = F.col(value).cast("double")
        over = _over(order, series).rowsBetween(-rows, 0)
        # Structs, because collected lists leave nulls out.
        frame = F.collect_list(F.struct(x.alias("v"))).over(over)
        there = F.collect_list(F.struct(x.isNotNull().cast("double").alias("v"))).over(over)
        made[f"{value}_ewm_{_tag(a)}"] = F.try_divide(_discounted(frame, keep), _discounted(there, keep))
    return df.withColumns(made)


def diffs(
    df: DataFrame, value: str, periods: Sequence[int], order: str, series: str | None = None
) -> DataFrame:
    w = _over(order, series)
    return df.withColumns(
        {f"{value}_diff_{p}": F.col(value) - F.lag(value, p).over(w) for p in periods}
    )


def pct_changes(
    df: DataFrame, value: str, periods: Sequence[int], order: str, series: str | None = None
) -> DataFrame:
    """Relative change; null where the earlier value is zero."""
    w = _over(order, series)
    return df.withColumns(
        {
            f"{value}_pct_change_{p}": ratio(F.col(value), F.lag(value, p).over(w)) - 1
            for p in periods
        }
    )


def lag_features(df: DataFrame, value: str, order: str, series: str | None = None) -> DataFrame:
    """All lag, rolling, weighted, difference and change columns."""
    out = lags(df, value, fixed.SERIES_LAGS, order, series)
    out = rolling_stats(out, value, fixed.ROLLING_WINDOWS, order, series)
    out = ewm(out, value, fixed.EWM_ALPHAS, order, series)
    out = diffs(out, value, fixed.CHANGE_PERIODS, order, series)
    return pct_changes(out, value, fixed.CHANGE_PERIODS, order, series)


def decompose(
    df: DataFrame, value: str, order: str, period: int = fixed.SEASON, series: str | None = None
) -> DataFrame:
    """Additive trend, season and residual.

    The trend is a centred mean over one period, its two ends weighing half each if the period
    is even; the season is the mean detrended value per place in the period, shifted to sum to zero.
    """
    half = period // 2
    key = [series] if series else []
    x = F.col(value).cast("double")
    around = _over(order, series).rowsBetween(-half, half)
    total = F.sum(value).over(around).cast("double")
    if period % 2 == 0:
        ends = F.lag(x, half).over(_over(order, series)) + F.lead(x, half).over(_over(order, series))
        total = total - ends / 2
    trend = F.when(F.count(value).over(around) == 2 * half + 1, total / period)
    base = df.withColumns({"_t": F.row_number().over(_over(order, series)) - 1, "trend": trend})
    base = base.withColumns({"_place": F.col("_t") % period, "_detrended": x - F.col("trend")})
    per_place = Window.partitionBy(*key, "_place")
    with_mean = base.withColumn("_mean", F.avg("_detrended").over(per_place))
    # The mean of the place means, each place counted once.
    places = (
        with_mean.groupBy(*key, "_place").agg(F.max("_mean").alias("_mean"))
        .groupBy(*key).agg(F.avg("_mean").alias("_level"))
    )
    if series:
        joined = with_mean.join(places, series)
    else:
        joined = with_mean.withColumn("_level", places.select("_level").scalar())
    seasonal = joined.withColumn("seasonal", F.col("_mean") - F.col("_level"))
    return seasonal.withColumn(
        "residual", x - F.col("trend") - F.col("seasonal")
    ).drop("_t", "_place", "_detrended", "_mean", "_level")


def decompose_stats(parts: DataFrame, order: str, series: str | None = None) -> DataFrame:
    """Strength of trend and season, direction, and lag-1 correlation of the residual."""
    w = _over(order, series)
    r = F.col("residual")
    out = parts.withColumn("_r1", F.lag("residual").over(w)).groupBy(*([series] if series else [])).agg(
        (1 - ratio(F.var_samp(r), F.var_samp(F.col("trend") + r))).alias("trend_strength"),
        (1 - ratio(F.var_samp(r), F.var_samp(F.col("seasonal") + r))).alias("seasonal_strength"),
        F.when(
            F.max_by("trend", F.when(F.col("trend").isNotNull(), F.col(order)))
            > F.min_by("trend", F.when(F.col("trend").isNotNull(), F.col(order))),
            "increasing",
        ).otherwise("decreasing").alias("trend_direction"),
        F.corr("residual", "_r1").alias("residual_autocorr"),
    )
    return out


def stationarity(
    df: DataFrame,
    value: str,
    order: str,
    series: str | None = None,
    critical: float = fixed.DICKEY_FULLER_5PCT,
) -> DataFrame:
    """Dickey-Fuller t statistic with a constant and no extra lags."""
    x = F.col(value).cast("double")
    before = F.lag(x).over(_over(order, series))
    pairs = df.withColumns({"_x0": before}).withColumn("_d", x - F.col("_x0"))
    g = pairs.groupBy(*([series] if series else [])).agg(
        F.regr_count("_d", "_x0").alias("n"),
        F.regr_sxx("_d", "_x0").alias("sxx"),
        F.regr_syy("_d", "_x0").alias("syy"),
        F.regr_sxy("_d", "_x0").alias("sxy"),
    )
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    variance = F.try_divide(F.col("syy") - slope * F.col("sxy"), F.col("n") - 2)
    stat = F.try_divide(slope, F.sqrt(F.try_divide(variance, F.col("sxx"))))
    return g.select(
        *([series] if series else []),
        "n",
        stat.alias("df_statistic"),
        F.lit(critical).alias("critical_value"),
        (stat < critical).alias("is_stationary"),
    )


def lagged_stationarity(
    df: DataFrame, value: str, order: str, series: str | None = None, max_lag: int = 5, critical: float = fixed.DICKEY_FULLER_5PCT
) -> DataFrame:
    """Augmented Dickey-Fuller tests with a constant and 0 to `max_lag` lagged differences: a row per lag.

    One pass takes the covariances of the difference, the level before it and the lagged differences, over the
    rows that have all of them. The regression of every order is solved from a part of that matrix, so the
    orders share their rows and their AIC can be compared; `chosen` marks the smallest. `series`, `lag`, `n`,
    `df_statistic`, `p_value`, `aic`, `critical_value`, `is_stationary`, `chosen`. Statistics are null where a
    regression has no answer (too few rows, or constant values).
    """
    w = _over(order, series)
    x = F.col(value).cast("double")
    level = df.withColumn("_level", F.lag(x).over(w)).withColumn("_d0", x - F.col("_level"))
    names = ["_d0", "_level", *[f"_d{k}" for k in range(1, max_lag + 1)]]
    lagged = level.withColumns({f"_d{k}": F.lag("_d0", k).over(w) for k in range(1, max_lag + 1)}).dropna(subset=names)
    keys = [series] if series else []
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covariances")
    )
    size = len(names)

    def solve(batches):
        upper = np.triu_indices(size)
        for batch in batches:
            rows = []
            for at, (n, held) in enumerate(zip(batch["n"], batch["covariances"])):
                whole = np.zeros((size, size))
                if n:
                    whole[upper] = held
                    whole = whole + np.triu(whole, 1).T
                rows += [(at, lag, *_regressed(whole, int(n), lag)) for lag in range(max_lag + 1)]
            out = pd.DataFrame(rows, columns=["at", "lag", "df_statistic", "p_value", "aic"])
            for c in ("n", *keys):
                out[c] = batch[c].to_numpy()[out["at"]]
            best = out.groupby("at")["aic"].transform("min")
            out["chosen"] = out["aic"].notna() & (out["aic"] == best)
            yield out[[*keys, "lag", "n", "df_statistic", "p_value", "aic", "chosen"]]

    key_type = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    solved = moments.mapInPandas(solve, f"{key_type}lag int, n long, df_statistic double, p_value double, aic double, chosen boolean")
    stat = F.col("df_statistic")
    return solved.select(
        *keys, "lag", "n", "df_statistic", "p_value", "aic", F.lit(critical).alias("critical_value"),
        (stat < critical).alias("is_stationary"), "chosen",
    )


def _regressed(covariances: np.ndarray, n: int, lag: int) -> tuple:
    """Statistic, p and AIC of the regression on the level and `lag` lagged differences; Nones without an answer."""
    free = n - lag - 2
    a, b = covariances[1 : lag + 2, 1 : lag + 2], covariances[1 : lag + 2, 0]
    scale = np.sqrt(np.diag(a))
    if free <= 0 or not (scale > 0).all():
        return None, None, None
    unit = a / np.outer(scale, scale)
    if np.linalg.cond(unit) > 1e12:
        return None, None, None
    inverse = np.linalg.inv(unit) / np.outer(scale, scale)
    slopes = inverse @ b
    rest = covariances[0, 0] - slopes @ b
    if rest <= 0:
        return None, None, None
    stat = slopes[0] / math.sqrt(rest * n / free * inverse[0, 0] / n)
    return stat, _dickey_fuller_p(stat), n * math.log(rest) + 2 * (lag + 2)


def _dickey_fuller_p(stat: float) -> float:
    low, high = fixed.DICKEY_FULLER_ENDS
    if not low <= stat <= high:
        return 0.0 if stat < low else 1.0
    terms = fixed.DICKEY_FULLER_LOW if stat <= fixed.DICKEY_FULLER_STAR else fixed.DICKEY_FULLER_HIGH
    z = sum(c * stat**k for k, c in enumerate(terms))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def seasonality(df: DataFrame, value: str = "Daily_Revenue") -> DataFrame:
    """Best and worst weekday and month, and the weekend to weekday ratio."""
    means = {
        kind: df.groupBy(F.col(kind).alias("k")).agg(mean_of(F.col(value)).alias("m"))
        for kind in ("DayOfWeek", "Month")
    }
    best = {
        kind: g.agg(
            F.struct(
                F.max_by("k", F.struct("m", -F.col("k"))).alias("best"),
                F.min_by("k", F.struct("m", "k")).alias("worst"),
            )
        ).scalar()
        for kind, g in means.items()
    }
    weekend, weekday = (mean_of(F.when(F.col("IsWeekend") == i, F.col(value))) for i in (1, 0))
    return df.agg(ratio(weekend, weekday).alias("weekend_vs_weekday_ratio")).select(
        best["DayOfWeek"]["best"].alias("best_day_of_week"),
        best["DayOfWeek"]["worst"].alias("worst_day_of_week"),
        best["Month"]["best"].alias("best_month"),
        best["Month"]["worst"].alias("worst_month"),
        "weekend_vs_weekday_ratio",
    )


def seasonality_means(df: DataFrame, kind: str, value: str = "Daily_Revenue") -> DataFrame:
    return df.groupBy(kind).agg(mean_of(F.col(value)).alias(f"avg_{value}"))


def series_performance(
    df: DataFrame, value: str = "Daily_Revenue", date: str = "Date", recent: int = 30
) -> DataFrame:
    """Totals and spread, and whether the last days lie above the mean. Needs a full calendar."""
    last = df.agg(F.max(date)).scalar()
    flagged = df.withColumn(
        "_recent", F.when(F.col(date) > F.date_sub(last, recent), F.col(value))
    )
    return flagged.agg(
        F.sum(value).cast(TOTAL).alias("total_historical_revenue"),
        mean_of(F.col(value)).alias("avg_daily_revenue"),
        F.sum("_recent").cast(TOTAL).alias("recent_revenue"),
        F.when(mean_of(F.col("_recent")) > mean_of(F.col(value)), "increasing")
        .otherwise("decreasing")
        .alias("revenue_trend"),
        F.max(value).alias("best_day_revenue"),
        F.min(value).alias("worst_day_revenue"),
        F.stddev_samp(F.col(value).cast("double")).alias("revenue_volatility"),
    )


def revenue_summary(daily: DataFrame) -> DataFrame:
    """Mean daily total, the last day's total, and how far that is off the mean."""
    per_day = daily.groupBy("Date").agg(F.sum("Total_Revenue").alias("rev"))
    out = per_day.agg(
        mean_of(F.col("rev")).alias("avg_revenue"),
        F.max_by("rev", "Date").cast("double").alias("last_revenue"),
    )
    gap = ratio(F.col("last_revenue") - F.col("avg_revenue"), F.col("avg_revenue"))
    return out.withColumn("trend", F.when(F.col("avg_revenue") > 0, gap).otherwise(F.lit(0.0)))


_BLOCK = 100_000


def sequences(
    tx: DataFrame,
    key: str,
    value: str,
    order: Sequence[str],
    length: int = 5,
    min_rows: int = 10,
    top: int | None = None,
    block: int = _BLOCK,
) -> DataFrame:
    """The `length` values before each row, for all keys with enough rows, or the `top` ones.

    A key's rows are numbered in order and cut into blocks, of `length` rows at least; each block
    also receives the last rows of the block before it, so a hot key is spread over many
    tasks and every window is still whole.
    """
    block = max(block, length)
    keys = value_counts(tx, key).filter(F.col("n") >= min_rows)
    if top is not None:
        keys = keys.limit(top)
    rows = rank_in_groups(
        tx.join(keys.select(key), key).select(key, *[c for c in order if c != key], value),
        [key], list(order), "row",
    )
    at = F.floor((F.col("row") - 1) / block).cast("long")
    spill = F.col("row") > (at + 1) * block - length
    blocks = F.when(spill, F.array(at, at + 1)).otherwise(F.array(at))
    cut = rows.select(key, "row", value, at.alias("own"), F.explode(blocks).alias("block"))
    w = Window.partitionBy(key, "block").orderBy("row").rowsBetween(-length, -1)
    return (
        cut.withColumn("sequence", F.collect_list(value).over(w))
        .filter((F.col("own") == F.col("block")) & (F.size("sequence") == length))
        .select(key, "row", "sequence", F.col(value).alias("target"))
    )


def time_folds(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    """Adds `fold`: 0 is training only; fold k is tested on rows of fold k and trained
    on all rows of lower folds. The n test folds have equal size and end the series."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    size = F.floor(F.col("_n") / (n + 1))
    start = F.col("_n") - size * n
    place = F.row_number().over(_over(order, None)) - 1
    return (
        df.withColumns({"_n": rows, "_i": place})
        .withColumn(
            "fold",
            F.when(F.col("_i") < start, F.lit(0))
            .otherwise(1 + F.floor(F.try_divide(F.col("_i") - start, size)))
            .cast("int"),
        )
        .drop("_n", "_i")
    )
