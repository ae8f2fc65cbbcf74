import datetime as dt

from pyspark.sql import functions as F

from tillroll.streaming import revenue_watch as RW

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, value double"


def events(spark):
    rows = []
    for h in range(12):
        low = h in (5, 9)
        for m in range(0, 60, 5):
            rows.append((len(rows), START + dt.timedelta(hours=h, minutes=m), 1.0 if low else 10.0 + h % 3))
    return rows


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}")


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    rows = events(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # Three files, one per micro batch; the last one also brings a row far behind the watermark.
    cuts = [rows[:60], rows[60:110], rows[110:] + [(999, START + dt.timedelta(minutes=1), 1e6)]]
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)
        RW.stream_revenue_alerts(stream, out, delay="10 minutes").awaitTermination()
    windows = read(spark, out, "windows").drop("epoch")
    batch = RW.window_revenue(spark.createDataFrame(rows, SCHEMA))
    # Windows still open at the end are not written.
    closed = windows.agg(F.max("window_start")).first()[0]
    want = batch.filter(F.col("window_start") <= F.lit(closed))
    assert windows.count() == want.count() >= 10
    assert windows.exceptAll(want).count() == 0
    fired = read(spark, out, "alerts").drop("epoch")
    twin = RW.revenue_alerts(want)
    assert fired.count() == twin.count() == 2
    assert fired.exceptAll(twin).count() == 0


def test_restart_without_new_data_adds_nothing(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(events(spark), SCHEMA).coalesce(1).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        RW.stream_revenue_alerts(stream, out).awaitTermination()
    windows = read(spark, out, "windows")
    assert windows.count() == windows.select("window_start").distinct().count()


def series_events(spark):
    rows = []
    for h in range(12):
        for m in range(0, 60, 5):
            for k, name in enumerate(("a", "b", None)):
                low = (h, k) in ((5, 0), (9, 1), (7, 2))
                rows.append((len(rows), name, START + dt.timedelta(hours=h, minutes=m), 1.0 if low else 10.0 + (h + k) % 3))
    return rows


SERIES = "event_id long, name string, ts timestamp_ntz, value double"


def by_hand(rows, last):
    """Windows closed by the end, per series, with their means and alerts."""
    sums = {}
    for _, name, ts, value in rows:
        hour = ts.replace(minute=0)
        total, n = sums.get((name, hour), (0.0, 0))
        sums[name, hour] = (total + value, n + 1)
    out, before = set(), {}
    for (name, hour), (total, n) in sorted(sums.items(), key=lambda x: (str(x[0][0]), x[0][1])):
        if hour + dt.timedelta(hours=1) > last - dt.timedelta(minutes=10):
            continue
        s, k = before.get(name, (0.0, 0))
        mean = s / k if k else None
        out.add((name, hour, round(total, 6), n, None if mean is None else round(mean, 6), mean is not None and total < mean * 0.8))
        before[name] = (s + total, k + 1)
    return out


def test_series_watch_over_restarts_with_late_rows(spark, tmp_path):
    rows = series_events(spark)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    late = (9999, "a", START + dt.timedelta(minutes=1), 1e6)
    for i, part in enumerate([rows[:180], rows[180:330], rows[330:] + [late]]):
        spark.createDataFrame(part, SERIES).coalesce(1).write.parquet(f"{source}/{i}")
        stream = spark.readStream.schema(SERIES).option("recursiveFileLookup", True).parquet(source)
        RW.watch_series(stream, out, "name").awaitTermination()
    got = spark.read.parquet(f"{out}/windows").collect()
    seen = {
        (r["series"], r["window_start"], round(r["revenue"], 6), r["rows"], None if r["earlier_avg"] is None else round(r["earlier_avg"], 6), r["fired"])
        for r in got
    }
    assert len(got) == len(seen) and seen == by_hand(rows, max(r[2] for r in rows))
    assert sorted((str(r["series"]), r["window_start"].hour) for r in got if r["fired"]) == [("None", 7), ("a", 5), ("b", 9)]
    assert all((r["drop_pct"] is not None) == r["fired"] for r in got)


def test_series_watch_restarted_without_new_rows(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(series_events(spark), SERIES).coalesce(1).write.parquet(source)
    counts = []
    for _ in range(2):
        RW.watch_series(spark.readStream.schema(SERIES).parquet(source), out, "name").awaitTermination()
        counts.append(spark.read.parquet(f"{out}/windows").count())
    assert counts[0] == counts[1] > 0
