"""Registered queries: clusters, value and churn models, forecasts and factors.

Every model is fitted with its operator's defaults. Queries that show different sides of one fit
share it: a session fits each model of a table once and keeps its stored rows.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.operators import clustering as CL
from tillroll.operators import factors as FA
from tillroll.operators import forecasting as FO
from tillroll.operators import lifetime as LT
from tillroll.operators import rfm as R
from tillroll.operators import series as S
from tillroll.operators.aggregates import product_dim
from tillroll.operators.learning import best_model
from tillroll.operators.ordering import durable, shared_folder
from tillroll.plans.base_sql import TX, with_
from tillroll.plans.queries_customers import RISKED, SCORED, features, risked, scored
from tillroll.plans.queries_series import SERIES, days
from tillroll.plans.star_tables import StarTables
from tillroll.sources import sinks

QUERIES = {}
_FITS: dict = {}


def forget() -> None:
    """Fits anew from here on."""
    _FITS.clear()


def _once(t: StarTables, name: str, fit):
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _FITS:
        _FITS[key] = fit()
    return _FITS[key]


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = (build, sql)


def _lines(t: StarTables):
    """Registered customers only: a pseudo-customer of all guests is no point to cluster."""
    return R.rfm_lines(t.tx).filter(F.col("Customer_ID").isNotNull())


def _kmeans(t: StarTables):
    return _once(t, "kmeans", lambda: CL.kmeans_segments(_lines(t)))


def _sweep(t: StarTables):
    return _once(t, "sweep", lambda: CL.cluster_sweep(features(t)))


add("kmeans_segments", lambda t: _kmeans(t).segmented.select("Customer_ID", "Segment"))
add("kmeans_centers", lambda t: _kmeans(t).centers)
add("segment_stats", lambda t: CL.segment_stats(_kmeans(t).segmented))
# Frequency scores stand in for clusters here and below, so that SQL can state the results.
add(
    "score_stats",
    lambda t: CL.segment_stats(scored(t).withColumn("Segment", F.col("F_Score"))),
    with_(SCORED, """SELECT F_Score AS Segment, count(*) AS Customer_Count, CAST(sum(Recency) AS DOUBLE) / count(*) AS Avg_Recency,
      CAST(sum(Frequency) AS DOUBLE) / count(*) AS Avg_Frequency, CAST(sum(Monetary) AS DOUBLE) / count(*) AS Avg_Monetary,
      CAST(sum(Monetary) AS DOUBLE) AS Total_Revenue FROM scored GROUP BY 1"""),
)
add(
    "score_cluster_summary",
    lambda t: R.ml_cluster_summary(risked(t).withColumn("ML_Cluster", F.col("F_Score"))).withColumns(
        {c: F.round(c, 4) for c in ("Predicted_CLV", "Avg_Churn_Risk")}
    ),
    with_(RISKED, """SELECT F_Score AS ML_Cluster, count(*) AS Customer_Count, CAST(sum(Monetary) AS DOUBLE) AS Total_Revenue,
      CAST(sum(Monetary) AS DOUBLE) / count(*) AS Avg_CLV, round(CAST(sum(Monetary) AS DOUBLE) / count(*), 4) AS Predicted_CLV,
      round(avg(p), 4) AS Avg_Churn_Risk FROM risked GROUP BY 1"""),
)


def _segment_table(t: StarTables):
    """The customers' segments written as a table of the store and read back."""
    root = f"{shared_folder(t.spark)}/segments-{uuid.uuid4()}"
    sinks.save_tables({"customer_segments": scored(t)}, root, partition_by={"customer_segments": ["RFM_Segment"]})
    back = t.spark.read.parquet(f"{root}/customer_segments")
    return back.select("Customer_ID", "R_Score", "F_Score", "M_Score", "RFM_Segment")


add(
    "segment_table",
    _segment_table,
    with_(SCORED, "SELECT Customer_ID, R_Score, F_Score, M_Score, RFM_Segment FROM scored"),
)


def _saved_model(t: StarTables):
    """The model of the clusters saved, loaded and run again: customers, and those it puts elsewhere now."""
    path = f"{shared_folder(t.spark)}/kmeans-{uuid.uuid4()}"
    fit = _kmeans(t)
    sinks.save_model(fit.model, path)
    again = PipelineModel.load(path).transform(fit.segmented.withColumnRenamed("Segment", "_was"))
    return again.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("Segment") != F.col("_was")).alias("moved"))


add(
    "saved_model",
    _saved_model,
    with_(TX, """SELECT count(*) AS customers, CAST(0 AS BIGINT) AS moved FROM (SELECT Customer_ID FROM tx
      WHERE Customer_ID IS NOT NULL GROUP BY 1 HAVING sum(Revenue) > 0)"""),
)
add("tune_kmeans", lambda t: CL.tune_kmeans(_lines(t)))
add("cluster_sweep", lambda t: _sweep(t).centers)


def _features_sql(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT F_Score, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM {table}" for f in fixed.CLUSTER_FEATURES
    )


add(
    "cluster_profiles",
    lambda t: CL.cluster_profiles(scored(t), cluster="F_Score").select(
        "F_Score", "feature", "size", "percentage",
        *[F.round(c, 3).alias(c) for c in ("mean", "std", "median")],
    ),
    with_(SCORED, f""", l AS ({_features_sql('scored')})
      SELECT F_Score, feature, count(*) AS size, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM scored) * 100 AS percentage,
      round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS std, round(quantile_cont(x, 0.5), 3) AS median
      FROM l GROUP BY 1, 2"""),
)
add(
    "ml_cluster_profiles",
    lambda t: CL.cluster_profiles(_sweep(t).segmented),
)


def _clv(t: StarTables):
    """Predictions on the scored customers, so that the table of all models can be built on them."""

    def fit():
        fitted = LT.clv_model(scored(t))
        return fitted._replace(predictions=durable(fitted.predictions))

    return _once(t, "clv", fit)


add("clv_model", lambda t: _clv(t).predictions.select("Customer_ID", "Monetary", "Predicted_CLV"))
add("clv_metrics", lambda t: _clv(t).metrics)
add("clv_importances", lambda t: _clv(t).importances)


def _churn(t: StarTables):
    def fit():
        fitted = LT.churn_model(R.churn_labels(_clv(t).predictions))
        return fitted._replace(predictions=durable(fitted.predictions))

    return _once(t, "churn", fit)


add("churn_model", lambda t: _churn(t).predictions.select("Customer_ID", "Is_Churned", "Churn_Probability", "Churn_Risk"))
add("churn_metrics", lambda t: _churn(t).metrics)
add(
    "churn_mlp",
    lambda t: LT.churn_mlp(R.churn_labels_quantile(t.customers, t.tx)).metrics,
)


def _segmented(t: StarTables):
    """Scores, clusters, predicted value and churn risk in one customer table."""
    return _once(t, "segmented", lambda: CL.cluster_sweep(_churn(t).predictions).segmented)


add("ml_cluster_summary", lambda t: R.ml_cluster_summary(_segmented(t)))
add("customer_segments", lambda t: _segmented(t).drop("Churn_Rule"))


def _week(t: StarTables):
    return _once(t, "week", lambda: FO.forecast_models(t.daily))


add("forecast_models", lambda t: _week(t).metrics)
add("forecast_importances", lambda t: _week(t).importances[FO.FOREST])
add("forecast_week", lambda t: FO.forecast_week(t.daily, _week(t)))
add(
    "forecast_comparison",
    lambda t: FO.forecast_comparison(FO.forecast_week(t.daily, _week(t)), S.revenue_summary(t.daily)),
)


def _country_calendar(t: StarTables):
    daily = t.daily.select("Date", F.col("Country").alias("series"), "Total_Revenue")
    return S.date_spine(daily, "Date", 0, "series")


def _by_step(fitted):
    """One row per series and day ahead."""
    rest = [c for c in fitted.columns if c != "forecast"]
    return fitted.select(*rest, F.posexplode_outer("forecast").alias("step", "forecast"))


add(
    "holt_winters",
    lambda t: _by_step(FO.holt_winters(_country_calendar(t), "Total_Revenue")),
)
add(
    "ar_grid",
    lambda t: _by_step(FO.ar_grid(_country_calendar(t), "Total_Revenue")),
)


def _history(t: StarTables):
    """One row per day, read many times by fits and future rows."""
    return _once(t, "history", lambda: durable(days(t).select("Date", "Daily_Revenue")))


def _ts(t: StarTables):
    return _once(t, "ts", lambda: FO.ts_ml_models(_history(t)))


add("ts_ml_models", lambda t: _ts(t).metrics)
add("best_model", lambda t: best_model(_ts(t).metrics))


def _future(t: StarTables):
    return FO.forecast_future(_history(t), _ts(t))


add("forecast_future", _future)
add("forecast_totals", lambda t: FO.forecast_totals(_future(t)))


def _insights(t: StarTables):
    return FO.forecast_insights(_future(t), S.series_performance(_history(t)), best_model(_ts(t).metrics))


add("forecast_insights", _insights)


# Repeated days stand in for the fitted models, so that SQL can state what is made of forecasts.
def _naive(t: StarTables):
    return FO.naive_forecasts(_history(t))


def _naive_week(t: StarTables):
    """The first seven days in the form of `forecast_week`."""
    ahead = _naive(t)[1]
    wide = ahead.groupBy("Date").agg(
        *[F.max(F.when(F.col("model") == m, F.col("forecast"))).alias(n)
          for m, n in (("last_7_days", FO.FOREST), ("last_1_days", FO.LINEAR), ("ensemble", "ensemble"))]
    )
    return wide.orderBy("Date").limit(7)


def _cents(df, digits=3):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


NAIVE = (
    SERIES
    + """,
periods AS (SELECT unnest([1, 7, 30]) AS p),
gaps AS (SELECT p, a.x - b.x AS e FROM f a, periods JOIN f b ON b.i = a.i - p WHERE a.i >= 30),
errors AS (SELECT 'last_' || p || '_days' AS model, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae FROM gaps GROUP BY p),
steps AS (SELECT CAST(unnest(range(30)) AS INTEGER) AS h),
each AS (SELECT CAST((SELECT max("Date") FROM f) + to_days(h + 1) AS DATE) AS "Date", 'last_' || p || '_days' AS model, x AS forecast
  FROM steps, periods JOIN f ON i = (SELECT count(*) FROM f) - p + h % p),
ahead AS (SELECT * FROM each UNION ALL SELECT "Date", 'ensemble', avg(forecast) FROM each GROUP BY 1),
week AS (SELECT "Date", max(forecast) FILTER (model = 'last_7_days') AS a, max(forecast) FILTER (model = 'last_1_days') AS b,
  max(forecast) FILTER (model = 'ensemble') AS e FROM ahead GROUP BY 1 ORDER BY 1 LIMIT 7)"""
)
add(
    "naive_errors",
    lambda t: _cents(_naive(t)[0]),
    with_(NAIVE, """SELECT model, 'rmse' AS metric, round(rmse, 3) AS value FROM errors
      UNION ALL SELECT model, 'mae', round(mae, 3) FROM errors"""),
)
add(
    "naive_best_model",
    lambda t: _cents(best_model(_naive(t)[0])),
    with_(NAIVE, "SELECT arg_min(model, rmse) AS best_model, round(min(rmse), 3) AS best_rmse FROM errors"),
)
add(
    "naive_forecasts",
    lambda t: _cents(_naive(t)[1]),
    with_(NAIVE, """SELECT strftime("Date", '%Y-%m-%d') AS "Date", model, round(forecast, 3) AS forecast FROM ahead"""),
)
add(
    "naive_totals",
    lambda t: _cents(FO.forecast_totals(_naive(t)[1])),
    with_(NAIVE, """SELECT model, round(sum(forecast), 3) AS total_forecasted_revenue, round(avg(forecast), 3) AS daily_avg
      FROM ahead GROUP BY 1"""),
)
add(
    "naive_insights",
    lambda t: _cents(FO.forecast_insights(_naive(t)[1], S.series_performance(_history(t)), best_model(_naive(t)[0]))),
    with_(NAIVE, """, s AS (SELECT CAST(sum(v) AS DOUBLE) / count(*) AS daily,
        CAST(sum(v) FILTER ("Date" > (SELECT max("Date") FROM f) - INTERVAL 30 DAY) AS DOUBLE) AS recent FROM f),
      e AS (SELECT sum(forecast) AS total, avg(forecast) AS mean FROM ahead WHERE model = 'ensemble')
      SELECT round(total, 3) AS predicted_revenue, round(total / recent * 100 - 100, 3) AS vs_recent_pct,
      round(mean, 3) AS predicted_daily_avg,
      CASE WHEN (SELECT min(rmse) FROM errors) < daily * 0.2::DOUBLE THEN 'high' ELSE 'medium' END AS forecast_confidence FROM s, e"""),
)
add(
    "naive_comparison",
    lambda t: _cents(FO.forecast_comparison(_naive_week(t), S.revenue_summary(t.stored_daily))),
    with_(NAIVE, """, r0 AS (SELECT "Date", sum(Revenue) AS rev FROM tx GROUP BY 1),
      r AS (SELECT CAST(sum(rev) AS DOUBLE) / count(rev) AS h, CAST(arg_max(rev, "Date") AS DOUBLE) AS l FROM r0),
      w AS (SELECT avg(a) AS a, avg(b) AS b, avg(e) AS e, sum(e) AS s FROM week),
      x AS (SELECT *, CASE WHEN l > 0 THEN (e - l) / l * 100 ELSE 0.0 END AS pct FROM w, r)
      SELECT round(a, 3) AS random_forest_avg, round(b, 3) AS linear_regression_avg, round(e, 3) AS forecast_avg,
      round(s, 3) AS total_forecast_revenue, round(h, 3) AS avg_historical_revenue, round(l, 3) AS recent_revenue,
      CASE WHEN e > l THEN 'Increasing' WHEN e < l THEN 'Decreasing' ELSE 'Stable' END AS revenue_trend,
      round(pct, 3) AS trend_percentage, CASE WHEN abs(pct) < 10 THEN 'Medium' ELSE 'High' END AS confidence_level,
      CASE WHEN abs(a - b) / greatest(a, b) < 0.1::DOUBLE THEN 'High' ELSE 'Medium' END AS model_agreement,
      CASE WHEN abs(a - l) < abs(b - l) THEN 'Random Forest' ELSE 'Linear Regression' END AS recommended_model FROM x"""),
)


def _factors(t: StarTables):
    return _once(t, "factors", lambda: FA.customer_product_factors(t.tx))


add("customer_product_factors", lambda t: _factors(t).metrics)
add("similar_customers", lambda t: FA.similar_customers(_factors(t).customers, t.tx))
add(
    "similar_products",
    lambda t: FA.similar_products(_factors(t).products, t.tx, product_dim(t.tx)),
)
