"""Registered queries: daily series, windows, decomposition, sequences."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import calendar_features
from tillroll.operators import series as S
from tillroll.operators.etl import sales_only
from tillroll.operators.ordering import shared_folder
from tillroll.plans.base_sql import DAILY, TX, with_
from tillroll.plans.star_tables import StarTables
from tillroll.sources import star
from tillroll.streaming import revenue_watch as RW

QUERIES = {}
V = "Daily_Revenue"


def add(name: str, build, sql: str | None = None) -> None:
    QUERIES[name] = (build, sql)


def days(t: StarTables):
    """The full calendar of sales."""
    return S.date_spine(S.daily_series(sales_only(t.stored_tx)), "Date")


SERIES = (
    TX
    + """,
days AS (SELECT "Date", sum(Revenue) AS Daily_Revenue, count(DISTINCT Invoice) AS Daily_Orders,
    count(DISTINCT Customer_ID) AS Daily_Customers, CAST(sum(Quantity) AS BIGINT) AS Daily_Items,
    count(DISTINCT StockCode) AS Daily_Products FROM tx WHERE Revenue > 0 GROUP BY 1),
spine AS (SELECT CAST(d AS DATE) AS "Date" FROM (SELECT unnest(generate_series(
    (SELECT min("Date") FROM days)::TIMESTAMP, (SELECT max("Date") FROM days)::TIMESTAMP, INTERVAL 1 DAY)) AS d)),
full_days AS (SELECT s."Date", coalesce(Daily_Revenue, 0) AS Daily_Revenue, coalesce(Daily_Orders, 0) AS Daily_Orders,
    coalesce(Daily_Customers, 0) AS Daily_Customers, coalesce(Daily_Items, 0) AS Daily_Items,
    coalesce(Daily_Products, 0) AS Daily_Products FROM spine s LEFT JOIN days d ON s."Date" = d."Date"),
f AS (SELECT "Date", Daily_Revenue AS v, CAST(Daily_Revenue AS DOUBLE) AS x,
    row_number() OVER (ORDER BY "Date") - 1 AS i FROM full_days)"""
)
_D = "strftime(\"Date\", '%Y-%m-%d') AS \"Date\""
_DAYCOLS = f"""{_D}, CAST(Daily_Revenue AS DOUBLE) AS Daily_Revenue, Daily_Orders, Daily_Customers, Daily_Items,
  Daily_Products"""

add(
    "daily_series",
    lambda t: S.daily_series(sales_only(t.stored_tx)),
    with_(SERIES, f"SELECT {_DAYCOLS} FROM days"),
)
add("daily_calendar", days, with_(SERIES, f"SELECT {_DAYCOLS} FROM full_days"))
add(
    "daily_gap_filled",
    lambda t: S.date_spine(
        t.daily.select("Date", "Country", "Total_Revenue", "Total_Transactions"), "Date", 0, "Country"
    ),
    with_(DAILY, """, d AS (SELECT CAST(unnest(generate_series((SELECT min("Date") FROM daily)::TIMESTAMP,
        (SELECT max("Date") FROM daily)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS "Date"),
      k AS (SELECT DISTINCT Country FROM daily)
      SELECT strftime(d."Date", '%Y-%m-%d') AS "Date", k.Country,
      CAST(coalesce(Total_Revenue, 0) AS DOUBLE) AS Total_Revenue,
      coalesce(Total_Transactions, 0) AS Total_Transactions
      FROM d CROSS JOIN k LEFT JOIN daily y ON y."Date" = d."Date" AND y.Country = k.Country"""),
)
add(
    "lags",
    lambda t: S.lags(
        t.daily.select("Date", "Country", "Total_Revenue"), "Total_Revenue", fixed.SALES_LAGS,
        "Date", "Country", 0,
    ),
    with_(DAILY, f"""SELECT {_D}, Country, CAST(Total_Revenue AS DOUBLE) AS Total_Revenue,
      """ + ", ".join(
        f"CAST(coalesce(lag(Total_Revenue, {p}) OVER w, 0) AS DOUBLE) AS Total_Revenue_lag_{p}"
        for p in fixed.SALES_LAGS
    ) + """ FROM daily WINDOW w AS (PARTITION BY Country ORDER BY daily."Date")"""),
)
add(
    "series_lags",
    lambda t: S.lags(days(t).select("Date", V), V, fixed.SERIES_LAGS, "Date"),
    with_(SERIES, f"SELECT {_D}, x AS Daily_Revenue, " + ", ".join(
        f"lag(x, {p}) OVER (ORDER BY i) AS Daily_Revenue_lag_{p}" for p in fixed.SERIES_LAGS
    ) + " FROM f"),
)


def _rolling(t: StarTables):
    df = S.rolling_stats(days(t).select("Date", V), V, fixed.ROLLING_WINDOWS, "Date")
    return df.select(
        *[F.round(c, 3).alias(c) if "_std_" in c else F.col(c) for c in df.columns]
    )


def _full(expr: str, n: int, name: str) -> str:
    return f"CASE WHEN count(*) OVER w{n} = {n} THEN {expr} OVER w{n} END AS {name}"


add(
    "rolling_stats",
    _rolling,
    with_(SERIES, f"SELECT {_D}, x AS Daily_Revenue, " + ", ".join(
        f"""CASE WHEN count(*) OVER w{n} = {n} THEN CAST(sum(v) OVER w{n} AS DOUBLE) / {n} END AS Daily_Revenue_rolling_mean_{n},
        CASE WHEN count(*) OVER w{n} = {n} THEN round(stddev_samp(x) OVER w{n}, 3) END AS Daily_Revenue_rolling_std_{n},
        {_full("max(x)", n, f"Daily_Revenue_rolling_max_{n}")}, {_full("min(x)", n, f"Daily_Revenue_rolling_min_{n}")}"""
        for n in fixed.ROLLING_WINDOWS
    ) + " FROM f WINDOW " + ", ".join(
        f"w{n} AS (ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for n in fixed.ROLLING_WINDOWS
    )),
)


def _ewm(t: StarTables):
    df = S.ewm(days(t).select("Date", V), V, fixed.EWM_ALPHAS, "Date")
    return df.select(*[F.round(c, 3).alias(c) if "_ewm_" in c else F.col(c) for c in df.columns])


add(
    "ewm",
    _ewm,
    with_(SERIES, f"""SELECT strftime(a."Date", '%Y-%m-%d') AS "Date", a.x AS Daily_Revenue, """ + ", ".join(
        f"round(sum(b.x * pow(1 - {a}, a.i - b.i)) / sum(pow(1 - {a}, a.i - b.i)), 3) AS Daily_Revenue_ewm_{str(a).replace('.', '')}"
        for a in fixed.EWM_ALPHAS
    ) + " FROM f a JOIN f b ON b.i <= a.i GROUP BY a.\"Date\", a.x"),
)
add(
    "diffs",
    lambda t: S.diffs(days(t).select("Date", V), V, fixed.CHANGE_PERIODS, "Date"),
    with_(SERIES, f"SELECT {_D}, x AS Daily_Revenue, " + ", ".join(
        f"CAST(v - lag(v, {p}) OVER (ORDER BY i) AS DOUBLE) AS Daily_Revenue_diff_{p}"
        for p in fixed.CHANGE_PERIODS
    ) + " FROM f"),
)
add(
    "pct_changes",
    lambda t: S.pct_changes(days(t).select("Date", V), V, fixed.CHANGE_PERIODS, "Date"),
    with_(SERIES, f"SELECT {_D}, x AS Daily_Revenue, " + ", ".join(
        f"x / nullif(lag(x, {p}) OVER (ORDER BY i), 0) - 1 AS Daily_Revenue_pct_change_{p}"
        for p in fixed.CHANGE_PERIODS
    ) + " FROM f"),
)
add(
    "complete_feature_rows",
    lambda t: S.lag_features(days(t).select("Date", V), V, "Date").dropna().agg(
        F.count(F.lit(1)).alias("rows"), F.min("Date").alias("first_day")
    ),
    with_(SERIES, """SELECT count(*) AS "rows", strftime(min("Date"), '%Y-%m-%d') AS first_day FROM (
      SELECT "Date", i, lag(x, 1) OVER (ORDER BY i) AS a, lag(x, 7) OVER (ORDER BY i) AS b FROM f)
      WHERE i >= 30 AND a <> 0 AND b <> 0"""),
)
_PARTS = """, p0 AS (SELECT *, CASE WHEN count(*) OVER c = 7 THEN CAST(sum(v) OVER c AS DOUBLE) / 7 END AS trend
    FROM f WINDOW c AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  p1 AS (SELECT i % 7 AS place, avg(x - trend) AS m FROM p0 GROUP BY 1),
  p2 AS (SELECT p0.*, m - (SELECT avg(m) FROM p1) AS seasonal FROM p0 JOIN p1 ON i % 7 = place),
  parts AS (SELECT *, x - trend - seasonal AS residual FROM p2)"""


def _decompose(t: StarTables):
    return S.decompose(days(t).select("Date", V), V, "Date")


add(
    "decompose",
    lambda t: _decompose(t).select(
        "Date", V, "trend", F.round("seasonal", 3).alias("seasonal"),
        F.round("residual", 3).alias("residual"),
    ),
    with_(SERIES, _PARTS + f""" SELECT {_D}, x AS Daily_Revenue, trend, round(seasonal, 3) AS seasonal,
      round(residual, 3) AS residual FROM parts"""),
)
add(
    "decompose_stats",
    lambda t: S.decompose_stats(_decompose(t), "Date").select(
        F.round("trend_strength", 6).alias("trend_strength"),
        F.round("seasonal_strength", 6).alias("seasonal_strength"),
        "trend_direction",
        F.round("residual_autocorr", 6).alias("residual_autocorr"),
    ),
    with_(SERIES, _PARTS + """ SELECT round(1 - var_samp(residual) / var_samp(trend + residual), 6) AS trend_strength,
      round(1 - var_samp(residual) / var_samp(seasonal + residual), 6) AS seasonal_strength,
      CASE WHEN arg_max(trend, i) > arg_min(trend, i) THEN 'increasing' ELSE 'decreasing' END AS trend_direction,
      round(corr(residual, r1), 6) AS residual_autocorr
      FROM (SELECT *, lag(residual) OVER (ORDER BY i) AS r1 FROM parts)"""),
)
_DF = """, d AS (SELECT {k} x - lag(x) OVER w AS d, lag(x) OVER w AS x0 FROM {src} WINDOW w AS ({p} ORDER BY "Date")),
  g AS (SELECT {k} regr_count(d, x0) AS n, regr_sxx(d, x0) AS sxx, regr_syy(d, x0) AS syy, regr_sxy(d, x0) AS sxy
    FROM d {by}),
  s AS (SELECT {k} CAST(n AS BIGINT) AS n, sxy / sxx / sqrt((syy - sxy / sxx * sxy) / (n - 2) / sxx) AS st FROM g)
  SELECT {k} n, round(st, 6) AS df_statistic, -2.86::DOUBLE AS critical_value, st < -2.86 AS is_stationary FROM s"""
add(
    "stationarity",
    lambda t: S.stationarity(days(t), V, "Date").withColumn(
        "df_statistic", F.round("df_statistic", 6)
    ),
    with_(SERIES, _DF.format(k="", src="f", p="", by="")),
)
add(
    "stationarity_by_country",
    lambda t: S.stationarity(t.daily, "Total_Revenue", "Date", "Country").withColumn(
        "df_statistic", F.round("df_statistic", 6)
    ),
    with_(DAILY, ", y AS (SELECT Country, \"Date\", CAST(Total_Revenue AS DOUBLE) AS x FROM daily)"
          + _DF.format(k="Country,", src="y", p="PARTITION BY Country", by="GROUP BY 1")),
)


def _adf_sql(src: str, key: str, max_lag: int = 5) -> str:
    """Least squares by taking one lagged difference after the other out of all columns; `key` is '' or a column of `src`."""
    part, by = (f"PARTITION BY {key}", f"{key}, ") if key else ("", "")
    names = ["d", "x0", *[f"d{k}" for k in range(1, max_lag + 1)]]
    steps = [
        f"""z0 AS (SELECT {by}"Date", x - lag(x) OVER w AS d, lag(x) OVER w AS x0 FROM {src} WINDOW w AS ({part} ORDER BY "Date"))""",
        f"""z1 AS (SELECT *, {", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, max_lag + 1))} FROM z0 WINDOW w AS ({part} ORDER BY "Date"))""",
        f"""r0 AS (SELECT {by}{", ".join(f"{c} - avg({c}) OVER w AS {c}" for c in names)} FROM z1
          WHERE d{max_lag} IS NOT NULL AND d IS NOT NULL WINDOW w AS ({part}))""",
    ]
    for k in range(1, max_lag + 1):
        kept = [c for c in names if c in ("d", "x0") or int(c[1:]) > k]
        out = ", ".join(f"{c} - d{k} * (sum({c} * d{k}) OVER w / sum(d{k} * d{k}) OVER w) AS {c}" for c in kept)
        steps.append(f"r{k} AS (SELECT {by}{out} FROM r{k - 1} WINDOW w AS ({part}))")
    fits = " UNION ALL ".join(
        f"SELECT {by}{k} AS lag, count(*) AS n, sum(x0 * x0) AS sxx, sum(d * d) AS syy, sum(d * x0) AS sxy FROM r{k} {'GROUP BY ' + key if key else ''}"
        for k in range(max_lag + 1)
    )
    low, high = (" + ".join(f"{c!r}::DOUBLE * power(t, {i})" for i, c in enumerate(x)) for x in (fixed.DICKEY_FULLER_LOW, fixed.DICKEY_FULLER_HIGH))
    odd = "exp((2 * k + 1) * ln(abs(z)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))"
    return f""", {", ".join(steps)}, fits AS ({fits}),
      s AS (SELECT *, syy - sxy * sxy / sxx AS rss FROM fits),
      st AS (SELECT *, sxy / sxx / sqrt(rss / (n - lag - 2) / sxx) AS t, n * ln(rss / n) + 2 * (lag + 2) AS aic FROM s),
      zs AS (SELECT *, CASE WHEN t <= {fixed.DICKEY_FULLER_STAR} THEN {low} ELSE {high} END AS z FROM st),
      ps AS (SELECT *, 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(160), lambda k: {odd})) AS p FROM zs)
      SELECT {by}lag::INTEGER AS lag, n, round(t, 5) AS df_statistic,
        CASE WHEN t < {fixed.DICKEY_FULLER_ENDS[0]} THEN 0 WHEN t > {fixed.DICKEY_FULLER_ENDS[1]} THEN 1 ELSE round(p, 6) END::DOUBLE AS p_value, round(aic, 4) AS aic, -2.86::DOUBLE AS critical_value,
        t < -2.86 AS is_stationary, aic = min(aic) OVER ({part}) AS chosen FROM ps"""


def _rounded_adf(df):
    return df.withColumns({"df_statistic": F.round("df_statistic", 5), "p_value": F.round("p_value", 6), "aic": F.round("aic", 4)})


add(
    "stationarity_lags",
    lambda t: _rounded_adf(S.lagged_stationarity(days(t), V, "Date")),
    with_(SERIES, ', y AS (SELECT "Date", v AS x FROM f)' + _adf_sql("y", "")),
)
add(
    "stationarity_lags_by_country",
    lambda t: _rounded_adf(S.lagged_stationarity(t.daily, "Total_Revenue", "Date", "Country")),
    with_(DAILY, ', y AS (SELECT Country, "Date", CAST(Total_Revenue AS DOUBLE) AS x FROM daily)' + _adf_sql("y", "Country")),
)
_CAL = """, c AS (SELECT v, CAST(isodow("Date") - 1 AS INTEGER) AS dow, CAST(month("Date") AS INTEGER) AS mon, isodow("Date") >= 6 AS we FROM f),
  w AS (SELECT dow AS k, CAST(sum(v) AS DOUBLE) / count(v) AS m FROM c GROUP BY 1),
  mo AS (SELECT mon AS k, CAST(sum(v) AS DOUBLE) / count(v) AS m FROM c GROUP BY 1)"""
add(
    "seasonality",
    lambda t: S.seasonality(calendar_features(days(t))),
    with_(SERIES, _CAL + """ SELECT (SELECT k FROM w ORDER BY m DESC, k LIMIT 1) AS best_day_of_week,
      (SELECT k FROM w ORDER BY m, k LIMIT 1) AS worst_day_of_week,
      (SELECT k FROM mo ORDER BY m DESC, k LIMIT 1) AS best_month, (SELECT k FROM mo ORDER BY m, k LIMIT 1) AS worst_month,
      (SELECT CAST(sum(v) AS DOUBLE) / count(v) FROM c WHERE we) / (SELECT CAST(sum(v) AS DOUBLE) / count(v) FROM c WHERE NOT we)
        AS weekend_vs_weekday_ratio"""),
)
add(
    "seasonality_by_weekday",
    lambda t: S.seasonality_means(calendar_features(days(t)), "DayOfWeek"),
    with_(SERIES, _CAL + ' SELECT k AS DayOfWeek, m AS "avg_Daily_Revenue" FROM w'),
)
add(
    "seasonality_by_month",
    lambda t: S.seasonality_means(calendar_features(days(t)), "Month"),
    with_(SERIES, _CAL + ' SELECT k AS "Month", m AS "avg_Daily_Revenue" FROM mo'),
)
add(
    "series_performance",
    lambda t: S.series_performance(days(t)).withColumn(
        "revenue_volatility", F.round("revenue_volatility", 3)
    ),
    with_(SERIES, """, l AS (SELECT CAST(sum(v) AS DOUBLE) AS s, count(*) AS n FROM f
        WHERE "Date" > (SELECT max("Date") FROM f) - INTERVAL 30 DAY)
      SELECT CAST(sum(v) AS DOUBLE) AS total_historical_revenue, CAST(sum(v) AS DOUBLE) / count(*) AS avg_daily_revenue,
      (SELECT s FROM l) AS recent_revenue,
      CASE WHEN (SELECT s / n FROM l) > CAST(sum(v) AS DOUBLE) / count(*) THEN 'increasing' ELSE 'decreasing' END
        AS revenue_trend, max(x) AS best_day_revenue, min(x) AS worst_day_revenue,
      round(stddev_samp(x), 3) AS revenue_volatility FROM f"""),
)
add(
    "revenue_summary",
    lambda t: S.revenue_summary(t.daily),
    with_(DAILY, """, d AS (SELECT "Date", sum(Total_Revenue) AS rev FROM daily GROUP BY 1),
      a AS (SELECT CAST(sum(rev) AS DOUBLE) / count(rev) AS avg_revenue,
        CAST(arg_max(rev, "Date") AS DOUBLE) AS last_revenue FROM d)
      SELECT *, CASE WHEN avg_revenue > 0 THEN (last_revenue - avg_revenue) / avg_revenue ELSE 0 END AS trend FROM a"""),
)
add(
    "sequences",
    lambda t: S.sequences(t.tx, "Customer_ID", "Revenue", star.LINE_ORDER).withColumn(
        "sequence", F.concat_ws(",", F.col("sequence").cast("array<string>"))
    ),
    with_(TX, """, k AS (SELECT Customer_ID FROM tx WHERE Customer_ID IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
      r AS (SELECT Customer_ID, Revenue, row_number() OVER (PARTITION BY Customer_ID
        ORDER BY InvoiceDate, Invoice, StockCode, Quantity, Price) AS "row" FROM tx JOIN k USING (Customer_ID)),
      s AS (SELECT Customer_ID, "row", Revenue, list(CAST(Revenue AS VARCHAR)) OVER (PARTITION BY Customer_ID
        ORDER BY "row" ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l FROM r)
      SELECT Customer_ID, "row", array_to_string(l, ',') AS "sequence", CAST(Revenue AS DOUBLE) AS target
      FROM s WHERE len(l) = 5"""),
)
add(
    "time_folds",
    lambda t: S.time_folds(days(t).select("Date"), "Date"),
    with_(SERIES, f""", n AS (SELECT count(*) AS n, count(*) // 4 AS size FROM f)
      SELECT {_D}, CAST(CASE WHEN i < n - size * 3 THEN 0 ELSE 1 + (i - (n - size * 3)) // size END AS INTEGER) AS fold
      FROM f, n"""),
)

# --- the batch twin of the stream ------------------------------------------
_HOURS = """, h AS (SELECT date_trunc('hour', ts) AS s, sum(CAST(value AS DECIMAL(18,2))) AS revenue, count(*) AS n
    FROM events GROUP BY 1)"""
_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _hours(t: StarTables):
    return RW.window_revenue(t.events.withColumn("value", F.col("value").cast("decimal(18,2)")))


add(
    "window_revenue",
    _hours,
    f"""WITH {_HOURS[2:]} SELECT {_STAMP.format("s")} AS window_start, {_STAMP.format("s + INTERVAL 1 HOUR")} AS window_end,
      CAST(revenue AS DOUBLE) AS revenue, n AS "rows" FROM h""",
)
add(
    "revenue_alerts",
    lambda t: RW.revenue_alerts(_hours(t)),
    f"""WITH {_HOURS[2:]}, a AS (SELECT s, CAST(revenue AS DOUBLE) AS revenue,
        CAST(sum(revenue) OVER w AS DOUBLE) / count(revenue) OVER w AS e FROM h
        WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT {_STAMP.format("s")} AS window_start, {_STAMP.format("s + INTERVAL 1 HOUR")} AS window_end, revenue,
      e AS earlier_avg, (e - revenue) / e * 100 AS drop_pct FROM a WHERE revenue < e * 0.8::DOUBLE""",
)


def _watched(t: StarTables):
    """The events folder read as a stream to its end; alerts of the windows it closed."""
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet")
    stream = source.parquet(t.sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))
    folder = f"{shared_folder(t.spark)}/revenue-watch-{uuid.uuid4()}"
    RW.stream_revenue_alerts(stream, folder).awaitTermination()
    return t.spark.read.parquet(f"{folder}/alerts").drop("epoch")


# A window is closed once the watermark, ten minutes behind the last event, has passed it.
add(
    "stream_revenue_alerts",
    _watched,
    f"""WITH {_HOURS[2:]}, c AS (SELECT * FROM h WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE),
      a AS (SELECT s, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER w AS DOUBLE) / count(revenue) OVER w AS e FROM c
        WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT {_STAMP.format("s")} AS window_start, {_STAMP.format("s + INTERVAL 1 HOUR")} AS window_end, revenue,
      e AS earlier_avg, (e - revenue) / e * 100 AS drop_pct FROM a WHERE revenue < e * 0.8::DOUBLE""",
)


def _watched_series(t: StarTables):
    """The events folder read as a stream to its end, a series per event type; every window that closed."""
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet")
    stream = source.parquet(t.sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))
    folder = f"{shared_folder(t.spark)}/series-watch-{uuid.uuid4()}"
    RW.watch_series(stream, folder, "event_type").awaitTermination()
    return t.spark.read.parquet(f"{folder}/windows")


add(
    "stream_series_alerts",
    _watched_series,
    f"""WITH h AS (SELECT event_type AS series, date_trunc('hour', ts) AS s, sum(CAST(value AS DECIMAL(18,2))) AS revenue, count(*) AS n
        FROM events GROUP BY ALL),
      c AS (SELECT * FROM h WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE),
      a AS (SELECT series, s, n, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER w AS DOUBLE) / count(revenue) OVER w AS e FROM c
        WINDOW w AS (PARTITION BY series ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT series, {_STAMP.format("s")} AS window_start, {_STAMP.format("s + INTERVAL 1 HOUR")} AS window_end, revenue, n AS "rows",
        CASE WHEN e <> 'nan'::DOUBLE THEN e END AS earlier_avg, CASE WHEN revenue < e * 0.8::DOUBLE THEN (e - revenue) / e * 100 END AS drop_pct,
        coalesce(revenue < e * 0.8::DOUBLE, false) AS fired FROM a""",
)
