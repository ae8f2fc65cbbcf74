"""Incremental refresh of the aggregate tables.

A load brings a batch of raw lines under a name. Its lines are cleaned and stored once, and reduced to day
states (`operators/day_state.py`); only these two steps read lines, and only the batch's. Then the months that the
batch touches are made anew from the day states of their days, and the tables over all time from month states.
Other months stay as they are. Loading a batch name again replaces what it brought before. Lines are not shuffled when they
are stored, nor are products and pairs by day and month; only the tables over all time gather these.

The store's document (`sources/versions.py`) is the manifest: batches done with their days and rows, and for each month
and table the folder that counts. Rows carry their month and lie sorted by it, and a reader of some months filters by
it, which files, row groups and pages answer from their ranges; a folder per day would be thousands of tiny files.

| key | value |
| --- | --- |
| batches | name -> {folder, compacted, days: {day -> rows}}: the fact and the day states; those of products and pairs are in `compacted` |
| months | month -> folder of its month states, daily_sales and monthly_trends; products and pairs of a month that one batch brought stay in `compacted` |
| tables | name -> folder |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import fixed
from tillroll.operators import day_state
from tillroll.operators.etl import add_features, clean
from tillroll.schemas import BY_DATASET, PROCESSING_SUMMARY, TRANSACTIONS
from tillroll.sources import versions
from tillroll.sources.sinks import at_once

FACT = "retail_transactions_processed"
#: Folders of data that a store may hold.
_KINDS = ["batches", "months", "tables"]
#: The month of a row, as 2001-12.
_MONTH = "in_month"


def load(
    raw: DataFrame,
    root: str,
    batch: str,
    rules=fixed.CATEGORY_RULES,
    price_edges=fixed.PRICE_EDGES,
    price_labels=fixed.PRICE_LABELS,
) -> dict:
    """Brings a batch of raw lines into the store at `root` and returns the published manifest."""
    spark = raw.sparkSession
    number, manifest = versions.latest(spark, root)
    before = manifest.get("batches", {})
    folder = versions.new_folder(root, "batches")
    _write(add_features(clean(raw), rules, price_edges, price_labels), f"{folder}/{FACT}")
    lines = spark.read.schema(TRANSACTIONS).parquet(f"{folder}/{FACT}")
    compacted = versions.new_folder(root, "months")
    states = day_state.day_states(lines)
    _write_all(spark, {f"{compacted if name in day_state.COMPACTED else folder}/{name}": state for name, state in states.items()})
    day = F.col("Date").cast("string").alias("day")
    sales = spark.read.schema(day_state.state_schema("sales", "Date date")).parquet(f"{folder}/sales")
    counted = sales.groupBy(day).agg(F.sum("lines").alias("n")).collect()
    entry = {"folder": folder, "compacted": compacted, "days": {r["day"]: int(r["n"]) for r in counted}}
    touched = {d[:7] for d in [*entry["days"], *before.get(batch, {}).get("days", {})]}
    manifest = {"batches": {**before, batch: entry}, "months": manifest.get("months", {})}
    manifest["months"] = _months(spark, root, manifest, touched)
    manifest["tables"] = _tables(spark, root, manifest)
    versions.publish(spark, root, number, manifest)
    return manifest


def read(spark: SparkSession, root: str, name: str, manifest: dict | None = None) -> DataFrame:
    """A table of the store as of one manifest (the current one if none is given)."""
    manifest = versions.latest(spark, root)[1] if manifest is None else manifest
    schema = schema_of(name)
    if name in ("daily_sales", "monthly_trends"):
        return _months_of(spark, manifest["months"], name, schema)
    paths = [f"{b['folder']}/{FACT}" for b in manifest["batches"].values()] if name == FACT else [manifest["tables"][name]]
    return spark.read.schema(schema).parquet(*paths)


def schema_of(name: str) -> T.StructType:
    return PROCESSING_SUMMARY if name == "processing_summary" else BY_DATASET[name]


def days_done(spark: SparkSession, manifest: dict) -> DataFrame:
    """day, batch, rows: the lines that each batch brought for each day."""
    rows = [(day, name, n) for name, b in sorted(manifest["batches"].items()) for day, n in sorted(b["days"].items())]
    return spark.createDataFrame(rows, "day string, batch string, rows long")


def left_over(spark: SparkSession, root: str) -> list[str]:
    """Data folders that the current manifest does not name; older readers may still use them."""
    manifest = versions.latest(spark, root)[1]
    named = {f for b in manifest.get("batches", {}).values() for f in (b["folder"], _compacted(b))}
    named |= {f for kind in _KINDS[1:] for f in manifest.get(kind, {}).values()}
    named = {"/".join(f.split("/")[: len(root.rstrip("/").split("/")) + 2]) for f in named}
    return versions.unnamed_folders(spark, root, named, _KINDS)


def _write(df: DataFrame, path: str) -> None:
    """Rows with their month, in its order inside each file; they stay in the task that made them."""
    if _MONTH not in df.columns:
        df = df.withColumn(_MONTH, F.date_format("Date", "yyyy-MM"))
    df.sortWithinPartitions(_MONTH).write.option("compression", "zstd").parquet(path)


def _write_all(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    jobs = [lambda path=path, df=df: _write(df, path) for path, df in frames.items()]
    at_once(spark, jobs, len(jobs))


def _with_month(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_MONTH, T.StringType())])


def _months_of(spark: SparkSession, months: dict, name: str, schema: T.StructType) -> DataFrame:
    """A table of the months, each from the folder that counts for it; the filter reaches the scan."""
    folders: dict[str, list[str]] = {}
    for month, folder in sorted(months.items()):
        folders.setdefault(folder, []).append(month)
    out = None
    for folder, held in folders.items():
        part = spark.read.schema(_with_month(schema)).parquet(f"{folder}/{name}").filter(F.col(_MONTH).isin(held))
        part = part.select(*schema.fieldNames())
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    return out


def _of_batches(spark: SparkSession, manifest: dict, name: str, months: set[str]) -> DataFrame:
    """The day states of some months, from the batches that have lines of them."""
    held = [b for b in manifest["batches"].values() if months & {d[:7] for d in b["days"]}]
    folders = [_compacted(b) if name in day_state.COMPACTED else b["folder"] for b in held]
    schema = _with_month(day_state.state_schema(name, "Date date"))
    return spark.read.schema(schema).parquet(*[f"{f}/{name}" for f in folders]).filter(F.col(_MONTH).isin(sorted(months)))


def _compacted(batch: dict) -> str:
    """Where a batch's products and pairs are; stores written before that had a folder of its own have them with the rest."""
    return batch.get("compacted", batch["folder"])


def _alone(manifest: dict) -> dict[str, str]:
    """Months with the lines of one batch only, and where its compacted states are: they are also those of the month."""
    holders: dict[str, set[str]] = {}
    for b in manifest["batches"].values():
        for month in {d[:7] for d in b["days"]}:
            holders.setdefault(month, set()).add(_compacted(b))
    return {m: next(iter(f)) for m, f in holders.items() if len(f) == 1}


def _months(spark: SparkSession, root: str, manifest: dict, touched: set[str]) -> dict:
    """The touched months made anew from day states; a month that lost all its lines is gone."""
    held = {d[:7] for b in manifest["batches"].values() for d in b["days"]} & touched
    after = {m: f for m, f in manifest["months"].items() if m not in touched}
    if not held:
        return after
    folder = versions.new_folder(root, "months")
    shared = held - set(_alone(manifest))
    days = {name: _of_batches(spark, manifest, name, held) for name in day_state.STATES}
    by_month = {}
    for name, state in days.items():
        if name not in day_state.COMPACTED:
            by_month[f"{folder}/{name}"] = day_state.merged(state, name, (_MONTH,))
        elif shared:
            state = _of_batches(spark, manifest, name, shared)
            by_month[f"{folder}/{name}"] = day_state.compacted(state, name, (_MONTH,))
    _write_all(spark, {f"{folder}/daily_sales": day_state.daily_sales(days["sales"], days["customers"]), **by_month})
    months = {n: spark.read.schema(day_state.state_schema(n, f"{_MONTH} string")).parquet(f"{folder}/{n}") for n in ("sales", "customers")}
    _write(day_state.monthly_trends(**months, month=_MONTH), f"{folder}/monthly_trends")
    return after | dict.fromkeys(held, folder)


def _tables(spark: SparkSession, root: str, manifest: dict) -> dict:
    """The tables over all time, from the month states that count now."""
    months = manifest["months"]
    compact = months | _alone(manifest)
    states = {
        name: _months_of(spark, compact if name in day_state.COMPACTED else months, name, day_state.state_schema(name))
        for name in day_state.STATES
    }
    folder = versions.new_folder(root, "tables")
    whole = day_state.whole_tables(states)
    jobs = [lambda name=name, df=df: df.write.parquet(f"{folder}/{name}") for name, df in whole.items()]
    at_once(spark, jobs, len(jobs))
    # The summary counts keys, which the stored tables hold already.
    products, customers = (spark.read.schema(schema_of(n)).parquet(f"{folder}/{n}") for n in ("product_performance", "customer_analysis"))
    summary = day_state.processing_summary(states["sales"], products, customers)
    summary.write.parquet(f"{folder}/processing_summary")
    return {name: f"{folder}/{name}" for name in (*whole, "processing_summary")}
