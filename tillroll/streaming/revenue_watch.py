"""Revenue per time window from a stream, with alerts on drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tillroll import fixed
from tillroll.functions.columns import ratio


def window_revenue(
    events: DataFrame,
    time: str = "ts",
    value: str = "value",
    window: str = "1 hour",
    delay: str | None = None,
) -> DataFrame:
    """Revenue per tumbling window. With `delay`, a stream drops rows later than that."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if delay is not None:
        timed = timed.withWatermark(time, delay)
    return (
        timed.groupBy(F.window(time, window).alias("w"))
        .agg(F.sum(value).alias("revenue"), F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "revenue", "rows")
    )


def revenue_alerts(
    windows: DataFrame, drop_ratio: float = fixed.ALERT_DROP_RATIO, total=None, count: int = 0
) -> DataFrame:
    """Windows below `drop_ratio` times the mean of all earlier windows.

    `total` and `count` sum up windows before the first of these. One row per time window comes in,
    so ordering them is small work.
    """
    earlier = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, -1)
    kind = windows.schema["revenue"].dataType
    start = F.lit(0 if total is None else total).cast(kind)
    judged = windows.withColumn(
        "earlier_avg",
        ratio(start + F.coalesce(F.sum("revenue").over(earlier), F.lit(0).cast(kind)), F.lit(count) + F.count("revenue").over(earlier)),
    )
    return judged.filter(F.col("revenue") < F.col("earlier_avg") * drop_ratio).select(
        "window_start",
        "window_end",
        "revenue",
        "earlier_avg",
        ((F.col("earlier_avg") - F.col("revenue")) / F.col("earlier_avg") * 100).alias("drop_pct"),
    )


def stream_revenue_alerts(
    events: DataFrame,
    folder: str,
    time: str = "ts",
    value: str = "value",
    window: str = "1 hour",
    delay: str = "10 minutes",
    drop_ratio: float = fixed.ALERT_DROP_RATIO,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the watch on a streaming DataFrame.

    Closed windows are written under `folder/windows`, alerts under `folder/alerts`, one
    sub-folder per epoch that a retry overwrites. Windows close in order of time, so all earlier
    windows belong to earlier epochs: `folder/state` holds their sum and number after each epoch. An
    epoch reads its own windows and the state of the epoch before, whatever was stored by then, and a
    retry gives the same alerts.
    """

    closed = window_revenue(events, time, value, window, delay)

    def close(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/windows/epoch={epoch}")
        mine = spark.read.schema(closed.schema).parquet(f"{folder}/windows/epoch={epoch}")
        total, count = None, 0
        if epoch:
            total, count = spark.read.parquet(f"{folder}/state/epoch={epoch - 1}").select("total", "n").first()
        revenue_alerts(mine, drop_ratio, total, count).write.mode("overwrite").parquet(f"{folder}/alerts/epoch={epoch}")
        kind = closed.schema["revenue"].dataType
        state = mine.agg(
            (F.lit(total or 0).cast(kind) + F.coalesce(F.sum("revenue"), F.lit(0).cast(kind))).alias("total"),
            (F.lit(count) + F.count("revenue")).alias("n"),
        )
        state.write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")

    return (
        closed.writeStream.outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(close)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Judge(StatefulProcessor):
    """Holds the sum and number of a series' closed windows, and sets each new one against their mean."""

    def __init__(self, drop_ratio: float, kind: str):
        self.drop_ratio, self.kind = drop_ratio, kind

    def init(self, handle) -> None:
        self.before = handle.getValueState("before", f"total {self.kind}, n long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.before.get()
        total, n = (None, 0) if held is None else (held[0], held[1])
        # A batch brings a series its newly closed windows, and all windows before them came with earlier batches.
        for row in sorted(rows, key=lambda r: r["window_start"]):
            revenue = row["revenue"]
            mean = float(total) / n if n else None
            fired = mean is not None and revenue is not None and float(revenue) < mean * self.drop_ratio
            drop = (mean - float(revenue)) / mean * 100 if fired and mean else None
            yield Row(
                series=key[0], window_start=row["window_start"], window_end=row["window_end"], revenue=revenue,
                rows=row["rows"], earlier_avg=mean, drop_pct=drop, fired=fired,
            )
            if revenue is not None:
                total, n = (revenue if total is None else total + revenue), n + 1
        if n:
            self.before.update((total, n))

    def close(self) -> None:
        pass


def watch_series(
    events: DataFrame,
    folder: str,
    series: str,
    time: str = "ts",
    value: str = "value",
    window: str = "1 hour",
    delay: str = "10 minutes",
    drop_ratio: float = fixed.ALERT_DROP_RATIO,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a watch of every series by itself, with all its state in the stream.

    Spark's own aggregation holds the open windows, adds up rows before they are shuffled, and drops late ones. What it
    closes goes by series to a keyed state of one sum and one number. Closed windows are written to
    `folder/windows` once each, with `earlier_avg`, `drop_pct` and `fired`; the alerts are the rows that fired. No
    earlier output is read, and a restart goes on from the checkpoint. A null series is a series.
    """
    spark = events.sparkSession
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    closed = (
        timed.groupBy(F.col(series).alias("series"), F.window(time, window).alias("w"))
        .agg(F.sum(value).alias("revenue"), F.count(F.lit(1)).alias("rows"))
        .select("series", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "revenue", "rows")
    )
    kind = closed.schema["revenue"].dataType
    total = "decimal(38,%d)" % kind.scale if isinstance(kind, T.DecimalType) else kind.simpleString()
    out = T.StructType(
        [
            *closed.schema.fields, T.StructField("earlier_avg", T.DoubleType()), T.StructField("drop_pct", T.DoubleType()),
            T.StructField("fired", T.BooleanType()),
        ]
    )
    judged = closed.groupBy("series").transformWithState(_Judge(drop_ratio, total), out, "append", "none")
    provider = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (
            judged.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{folder}/windows")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        spark.conf.set(_PROVIDER, provider)
