"""Revenue forecasting: tree and linear models, Holt-Winters and ARIMA per series.

Errors are measured on days after the training days. The per-series fits run as one
Spark task per series; a series has one row per day, which bounds a task's input.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import calendar_features, fill_zero, ratio
from tillroll.operators.learning import assemble, importances, metric_rows, regression
from tillroll.operators.ordering import durable
from tillroll.operators.series import lag_features, lags, time_folds

FOREST, BOOSTED, LINEAR = "random_forest", "gradient_boosting", "linear_regression"
_CALENDAR = (
    "Year", "Month", "Day", "DayOfWeek", "DayOfYear", "WeekOfYear", "Quarter",
    "IsWeekend", "IsMonthStart", "IsMonthEnd",
)


class Forecast(NamedTuple):
    metrics: DataFrame
    models: dict
    features: list
    importances: dict


def _scores(spark, name: str, tested: DataFrame, label: str) -> list[tuple]:
    return [(name, m, regression(m, label).evaluate(tested)) for m in ("rmse", "mse", "mae", "r2")]


def daily_features(daily: DataFrame, periods: Sequence[int] = fixed.SALES_LAGS) -> tuple[DataFrame, list]:
    """Calendar parts (Sunday is day 1) and per-country lags of revenue."""
    d = F.col("Date")
    base = daily.select("Date", "Country", F.col("Total_Revenue").cast("double").alias("label"))
    base = base.withColumns(
        {
            "Year": F.year(d), "Month": F.month(d), "Day": F.dayofmonth(d),
            "DayOfWeek": F.dayofweek(d), "DayOfYear": F.dayofyear(d),
        }
    )
    out = fill_zero(lags(base, "label", periods, "Date", "Country"))
    return out, ["Year", "Month", "Day", "DayOfWeek", "DayOfYear"] + [f"label_lag_{p}" for p in periods]


def forecast_models(
    daily: DataFrame,
    periods: Sequence[int] = fixed.SALES_LAGS,
    train_frac: float = 0.8,
    trees: int = 100,
    seed: int = fixed.SEED,
) -> Forecast:
    """Forest and linear model of country-day revenue, tested on the last days."""
    spark = daily.sparkSession
    featured, features = daily_features(daily, periods)
    data = durable(assemble(featured, features))
    ends = data.agg(F.min("Date").alias("a"), F.max("Date").alias("b")).first()
    split = F.date_add(F.lit(ends["a"]), int((ends["b"] - ends["a"]).days * train_frac))
    train, test = data.filter(F.col("Date") <= split), data.filter(F.col("Date") > split)
    models = {
        FOREST: RandomForestRegressor(labelCol="label", numTrees=trees, seed=seed).fit(train),
        LINEAR: LinearRegression(labelCol="label").fit(train),
    }
    rows = [r for n, m in models.items() for r in _scores(spark, n, m.transform(test), "label")]
    return Forecast(
        metric_rows(spark, rows), models, features,
        {FOREST: importances(spark, models[FOREST], features)},
    )


def forecast_week(daily: DataFrame, fitted: Forecast, days: int = 7) -> DataFrame:
    """Total revenue per model for the days after the history, and their mean.

    Lags of a future day come from the history where it reaches that far, and are the
    country's last known value otherwise.
    """
    periods = [int(f.rsplit("_", 1)[1]) for f in fitted.features if "_lag_" in f]
    base = daily.select("Date", "Country", F.col("Total_Revenue").cast("double").alias("label"))
    last = base.agg(F.max("Date")).scalar()
    # The tail of each country's history, at most as long as the longest lag.
    newest = Window.partitionBy("Country").orderBy(F.desc("Date"))
    tail = (
        base.withColumn("back", F.row_number().over(newest))
        .filter(F.col("back") <= max(periods))
        .groupBy("Country")
        .agg(F.map_from_entries(F.collect_list(F.struct("back", "label"))).alias("past"))
    )
    ahead = tail.withColumn("_last", last).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(days)))
    )
    past = F.col("past")
    d = F.col("Date")
    rows = ahead.withColumn("Date", F.date_add("_last", F.col("step"))).withColumns(
        {
            "Year": F.year(d), "Month": F.month(d), "Day": F.dayofmonth(d),
            "DayOfWeek": F.dayofweek(d), "DayOfYear": F.dayofyear(d),
            **{
                f"label_lag_{p}": F.coalesce(
                    F.try_element_at(past, F.greatest(p - F.col("step") + 1, F.lit(1)).cast("int")),
                    F.try_element_at(past, F.lit(1)),
                )
                for p in periods
            },
        }
    )
    vectors = assemble(rows.select("Country", *dict.fromkeys(["Date", *fitted.features])), fitted.features)
    for name, model in fitted.models.items():
        vectors = model.setPredictionCol(name).transform(vectors)
    names = list(fitted.models)
    out = vectors.groupBy("Date").agg(*[F.sum(n).alias(n) for n in names])
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    return out.withColumns({"ensemble": mean, "day_of_week": F.date_format("Date", "EEEE")}).orderBy("Date")


def forecast_comparison(week: DataFrame, summary: DataFrame) -> DataFrame:
    """One row over `forecast_week` and `revenue_summary`: trend, confidence, agreement."""
    s = summary.select(F.struct("avg_revenue", "last_revenue")).scalar()
    out = week.agg(
        F.avg(FOREST).alias("random_forest_avg"),
        F.avg(LINEAR).alias("linear_regression_avg"),
        F.avg("ensemble").alias("forecast_avg"),
        F.sum("ensemble").alias("total_forecast_revenue"),
    ).withColumn("s", s)
    recent, ahead = F.col("s.last_revenue"), F.col("forecast_avg")
    forest, linear = F.col("random_forest_avg"), F.col("linear_regression_avg")
    pct = F.when(recent > 0, ratio(ahead - recent, recent) * 100).otherwise(F.lit(0.0))
    apart = F.try_divide(F.abs(forest - linear), F.greatest(forest, linear))
    return out.select(
        "random_forest_avg", "linear_regression_avg", "forecast_avg", "total_forecast_revenue",
        F.col("s.avg_revenue").alias("avg_historical_revenue"),
        recent.alias("recent_revenue"),
        F.when(ahead > recent, "Increasing").when(ahead < recent, "Decreasing").otherwise("Stable")
        .alias("revenue_trend"),
        pct.alias("trend_percentage"),
        F.when(F.abs(pct) < 10, "Medium").otherwise("High").alias("confidence_level"),
        F.when(apart < 0.1, "High").otherwise("Medium").alias("model_agreement"),
        F.when(F.abs(forest - recent) < F.abs(linear - recent), "Random Forest")
        .otherwise("Linear Regression").alias("recommended_model"),
    )


def series_features(series: DataFrame, value: str = "Daily_Revenue") -> tuple[DataFrame, list]:
    """Complete rows of all lag features and calendar parts."""
    base = series.withColumn(value, F.col(value).cast("double"))
    full = calendar_features(lag_features(base, value, "Date"))
    features = [c for c in full.columns if c not in ("Date", value)]
    return full.dropna(), features


def _estimators(label: str, trees: int, iters: int, seed: int) -> dict:
    return {
        FOREST: RandomForestRegressor(labelCol=label, numTrees=trees, seed=seed),
        BOOSTED: GBTRegressor(labelCol=label, maxIter=iters, maxDepth=3, stepSize=0.1, seed=seed),
        LINEAR: LinearRegression(labelCol=label),
    }


def ts_ml_models(
    series: DataFrame,
    value: str = "Daily_Revenue",
    folds: int = 3,
    trees: int = 100,
    iters: int = 100,
    recent: int = 30,
    seed: int = fixed.SEED,
) -> Forecast:
    """Three models: errors over expanding folds, and on the last `recent` days by a fit without them.

    The returned models are fitted on all days. A series needs twice `recent` days with features.
    """
    spark = series.sparkSession
    clean, features = series_features(series, value)
    data = durable(assemble(time_folds(clean, "Date", folds), features).select("Date", value, "fold", "features"))
    ends = data.agg(F.max("Date").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if ends["n"] < 2 * recent:
        raise ValueError(f"{ends['n']} days with features; {2 * recent} are needed to hold out {recent}")
    cut = F.date_sub(F.lit(ends["b"]), recent)
    rows, models, weights = [], {}, {}
    for name, estimator in _estimators(value, trees, iters, seed).items():
        errors = []
        for k in range(1, folds + 1):
            model = estimator.fit(data.filter(F.col("fold") < k))
            tested = model.transform(data.filter(F.col("fold") == k))
            errors.append(regression("rmse", value).evaluate(tested))
        mean = sum(errors) / folds
        rows += [
            (name, "cv_rmse_mean", mean),
            (name, "cv_rmse_std", (sum((e - mean) ** 2 for e in errors) / folds) ** 0.5),
        ]
        held_out = estimator.fit(data.filter(F.col("Date") <= cut))
        rows += _scores(spark, name, held_out.transform(data.filter(F.col("Date") > cut)), value)
        models[name] = estimator.fit(data)
        if name != LINEAR:
            weights[name] = importances(spark, models[name], features)
    return Forecast(metric_rows(spark, rows), models, features, weights)


def future_rows(series: DataFrame, features: Sequence[str], value: str, days: int) -> DataFrame:
    """Calendar rows after the history. The first day's lags are known values; every other
    feature is its median over the history."""
    clean, _ = series_features(series, value)
    made = [f for f in features if f not in _CALENDAR]
    # One row per day of history: the built-in median holds a calendar at most.
    medians = clean.agg(F.struct(*[F.median(f).alias(f) for f in made])).scalar()
    known = {f"{value}_lag_{p}": p for p in fixed.SERIES_LAGS}
    tail = (
        series.select("Date", F.col(value).cast("double").alias("v"))
        .orderBy(F.desc("Date"))
        .limit(max(known.values()))
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("Date", "v")))))
        .scalar()
    )
    last = series.agg(F.max("Date")).scalar()
    spine = (
        series.sparkSession.range(1)
        .select(last.alias("_last"), medians.alias("_m"), tail.alias("_t"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(days))))
        .withColumn("Date", F.date_add("_last", F.col("step")))
    )
    filled = {}
    for f in made:
        median = F.col(f"_m.{f}")
        if f in known:
            lag = F.get(F.col("_t"), F.lit(known[f] - 1))["v"]
            filled[f] = F.when((F.col("step") == 1) & lag.isNotNull(), lag).otherwise(median)
        else:
            filled[f] = median
    return calendar_features(spine).withColumns(filled).select("Date", *features)


def forecast_future(
    series: DataFrame, fitted: Forecast, value: str = "Daily_Revenue", days: int = 30
) -> DataFrame:
    """Date, model, forecast for each fitted model, and their mean as `ensemble`."""
    vectors = assemble(future_rows(series, fitted.features, value, days), fitted.features)
    for name, model in fitted.models.items():
        vectors = model.setPredictionCol(name).transform(vectors)
    names = list(fitted.models)
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    return vectors.withColumn("ensemble", mean).select(
        "Date",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("model"), F.col(n).alias("forecast"))
                    for n in [*names, "ensemble"]
                ]
            )
        ),
    )


def naive_forecasts(
    series: DataFrame, value: str = "Daily_Revenue", periods: Sequence[int] = (1, 7, 30), days: int = 30
) -> tuple[DataFrame, DataFrame]:
    """Forecasts that repeat the last 1, 7 or 30 days: what any fitted model has to beat.

    Returns (model, metric, value) rows with the errors over all days that have every lag, and
    Date, model, forecast rows of the days to come with the models' mean as `ensemble`. The series
    has one row per day; one shorter than the longest period forecasts null.
    """
    slim = series.select("Date", F.col(value).cast("double").alias("v"))
    w = Window.orderBy("Date")  # one row per day
    gaps = slim.select(*[(F.col("v") - F.lag("v", p).over(w)).alias(f"e{p}") for p in periods]).filter(F.col(f"e{max(periods)}").isNotNull())
    names = {p: f"last_{p}_days" for p in periods}
    metrics = gaps.agg(
        F.array(
            *[F.struct(F.lit(names[p]).alias("model"), F.lit(m).alias("metric"), c.alias("value"))
              for p in periods
              for m, c in (("rmse", F.sqrt(F.avg(F.col(f"e{p}") ** 2))), ("mae", F.avg(F.abs(f"e{p}"))))]
        ).alias("r")
    ).select(F.inline("r"))
    tail = slim.orderBy(F.desc("Date")).limit(max(periods)).agg(
        F.max("Date").alias("_last"), F.array_sort(F.collect_list(F.struct("Date", "v"))).alias("_t")
    )
    ahead = tail.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumns(
        {"Date": F.date_add("_last", F.col("step")),
         **{names[p]: F.get("_t", F.size("_t") - p + (F.col("step") - 1) % p)["v"] for p in periods}}
    )
    mean = sum((F.col(n) for n in list(names.values())[1:]), F.col(names[periods[0]])) / len(periods)
    shown = [F.struct(F.lit(n).alias("model"), F.col(n).alias("forecast")) for n in names.values()]
    shown.append(F.struct(F.lit("ensemble").alias("model"), mean.alias("forecast")))
    return metrics, ahead.select("Date", F.inline(F.array(*shown)))


def forecast_totals(future: DataFrame) -> DataFrame:
    return future.groupBy("model").agg(
        F.sum("forecast").alias("total_forecasted_revenue"), F.avg("forecast").alias("daily_avg")
    )


def forecast_insights(future: DataFrame, performance: DataFrame, best: DataFrame) -> DataFrame:
    """The ensemble's total against the last days, with a confidence from the best error."""
    p = performance.select(F.struct("recent_revenue", "avg_daily_revenue")).scalar()
    rmse = best.select("best_rmse").scalar()
    out = future.filter(F.col("model") == "ensemble").agg(
        F.sum("forecast").alias("predicted_revenue"), F.avg("forecast").alias("predicted_daily_avg")
    )
    return out.withColumn("p", p).withColumn("best_rmse", rmse).select(
        "predicted_revenue",
        (ratio(F.col("predicted_revenue"), F.col("p.recent_revenue")) * 100 - 100).alias("vs_recent_pct"),
        "predicted_daily_avg",
        F.when(F.col("best_rmse") < F.col("p.avg_daily_revenue") * 0.2, "high").otherwise("medium")
        .alias("forecast_confidence"),
    )


def _errors(actual: np.ndarray, forecast: np.ndarray) -> dict:
    gap = actual - forecast
    mse = float(np.mean(gap**2)) if len(gap) else None
    return {
        "rmse": None if mse is None else mse**0.5,
        "mse": mse,
        "mae": float(np.mean(np.abs(gap))) if len(gap) else None,
    }


def _criteria(sse: float, n: int, k: int) -> tuple[float, float]:
    base = n * np.log(max(sse, 1e-300) / n)
    return float(base + 2 * k), float(base + k * np.log(n))


# Smoothing constants tried for level, trend and season.
_GRID = np.array([0.05, 0.1, 0.2, 0.4, 0.7])


def _smooth(x: np.ndarray, period: int, horizon: int):
    """All grid settings at once: states are vectors over the grid."""
    a, b, g = (m.ravel() for m in np.meshgrid(_GRID, _GRID, _GRID, indexing="ij"))
    first, second = x[:period].mean(), x[period : 2 * period].mean()
    level, trend = np.full(len(a), first), np.full(len(a), (second - first) / period)
    season = [np.full(len(a), v - first) for v in x[:period]]
    sse = np.zeros(len(a))
    for i in range(period, len(x)):
        s = season[i % period]
        sse += (x[i] - (level + trend + s)) ** 2
        old = level
        level = a * (x[i] - s) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend
        season[i % period] = g * (x[i] - level) + (1 - g) * s
    j = int(np.argmin(sse))
    ahead = [
        level[j] + h * trend[j] + season[(len(x) + h - 1) % period][j] for h in range(1, horizon + 1)
    ]
    return np.array(ahead), float(sse[j]), (float(a[j]), float(b[j]), float(g[j]))


def holt_winters(
    series: DataFrame,
    value: str = "Daily_Revenue",
    period: int = fixed.SEASON,
    train_frac: float = 0.8,
    key: str = "series",
    horizon: int = 30,
) -> DataFrame:
    """Additive trend and season per series: constants, errors on the last days, forecast.

    A series with fewer than two periods to train on has nulls and its `train_rows`.
    """
    schema = (
        f"{key} string, alpha double, beta double, gamma double, aic double, bic double, "
        "rmse double, mse double, mae double, train_rows int, forecast array<double>"
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("Date")["x"].to_numpy(dtype=float)
        cut = int(len(x) * train_frac)
        if cut < 2 * period:
            return _unfitted(schema, key, pdf, cut)
        ahead, sse, (a, b, g) = _smooth(x[:cut], period, len(x) - cut)
        aic, bic = _criteria(sse, cut, 4 + period)
        row = {key: pdf[key].iloc[0], "alpha": a, "beta": b, "gamma": g, "aic": aic, "bic": bic}
        row |= _errors(x[cut:], ahead) | {"train_rows": cut, "forecast": _smooth(x, period, horizon)[0]}
        return pd.DataFrame([row])

    slim = series.select(F.col(key).cast("string"), "Date", F.col(value).cast("double").alias("x"))
    return slim.groupBy(key).applyInPandas(fit, schema)


def _unfitted(schema: str, key: str, pdf: pd.DataFrame, train_rows: int) -> pd.DataFrame:
    row = dict.fromkeys([c.split()[0] for c in schema.split(", ")])
    return pd.DataFrame([row | {key: pdf[key].iloc[0], "train_rows": train_rows}])


def _lagged(x: np.ndarray, count: int, start: int) -> list[np.ndarray]:
    return [x[start - k : len(x) - k] for k in range(1, count + 1)]


def _arma(z: np.ndarray, p: int, q: int):
    """Least squares with q lags of the residuals of a long autoregression."""
    residual = np.zeros(len(z))
    long = 0
    if q:
        long = max(2 * (p + q), 7)
        design = np.column_stack([np.ones(len(z) - long), *_lagged(z, long, long)])
        beta = np.linalg.lstsq(design, z[long:], rcond=None)[0]
        residual[long:] = z[long:] - design @ beta
    start = max(p, long + q)
    design = np.column_stack(
        [np.ones(len(z) - start), *_lagged(z, p, start), *_lagged(residual, q, start)]
    )
    beta = np.linalg.lstsq(design, z[start:], rcond=None)[0]
    fitted = design @ beta
    residual[start:] = z[start:] - fitted
    return beta, residual, float(np.sum((z[start:] - fitted) ** 2)), len(z) - start


def _ahead(z: np.ndarray, residual: np.ndarray, beta: np.ndarray, p: int, q: int, steps: int):
    past, shocks, out = list(z[-p:]) if p else [], list(residual[-q:]) if q else [], []
    for _ in range(steps):
        v = beta[0]
        v += sum(beta[1 + i] * past[-1 - i] for i in range(p))
        v += sum(beta[1 + p + i] * shocks[-1 - i] for i in range(q))
        out.append(v)
        past.append(v)
        shocks.append(0.0)
    return np.array(out)


def ar_grid(
    series: DataFrame,
    value: str = "Daily_Revenue",
    ps: Sequence[int] = (0, 1, 2),
    ds: Sequence[int] = (0, 1),
    qs: Sequence[int] = (0, 1, 2),
    train_frac: float = 0.8,
    key: str = "series",
) -> DataFrame:
    """Order of lowest AIC per series by least squares, with errors on the last days.

    A series too short for every order has nulls and its `train_rows`.
    """
    schema = (
        f"{key} string, p int, d int, q int, aic double, bic double, rmse double, mse double, "
        "mae double, train_rows int, forecast array<double>"
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("Date")["x"].to_numpy(dtype=float)
        cut = int(len(x) * train_frac)
        best = None
        for d in ds:
            z = np.diff(x[:cut], d)
            for p in ps:
                for q in qs:
                    if len(z) < max(20 + 4 * (p + q), 4 * max(2 * (p + q), 7) if q else 0):
                        continue
                    beta, residual, sse, n = _arma(z, p, q)
                    # Compared per row, because orders use different numbers of rows.
                    aic, bic = _criteria(sse, n, p + q + 1)
                    if best is None or aic / n < best[0]:
                        best = (aic / n, aic, bic, p, d, q, z, beta, residual)
        if best is None:
            return _unfitted(schema, key, pdf, cut)
        _, aic, bic, p, d, q, z, beta, residual = best
        ahead = _ahead(z, residual, beta, p, q, len(x) - cut)
        if d:
            ahead = x[cut - 1] + np.cumsum(ahead)
        row = {key: pdf[key].iloc[0], "p": p, "d": d, "q": q, "aic": aic, "bic": bic}
        row |= _errors(x[cut:], ahead) | {"train_rows": cut, "forecast": ahead}
        return pd.DataFrame([row])

    slim = series.select(F.col(key).cast("string"), "Date", F.col(value).cast("double").alias("x"))
    return slim.groupBy(key).applyInPandas(fit, schema)
