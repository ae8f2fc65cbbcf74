"""Writers: tables, CSV exports, JSON results and reports, models."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from tillroll.functions.columns import rounded
from tillroll.sources import versions


#: Tables written side by side, so that the last tasks of one leave no cores idle.
_WRITERS = 4


def at_once(spark: SparkSession, jobs: Sequence[Callable], width: int) -> list:
    """Results of independent jobs, `width` of them started together; the first failure is raised."""
    carried = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, min(width, len(jobs)))) as pool:
        return [done.result() for done in [pool.submit(carried(job)) for job in jobs]]


def save_tables(
    tables: Mapping[str, DataFrame],
    folder: str,
    fmt: str = "parquet",
    digits: int | None = None,
    partition_by: Mapping[str, Sequence[str]] | None = None,
) -> list[str]:
    """Write each table to `folder/name`, over what an earlier run left there, some side by side.

    The names of the tables that have rows come back. Whether there are any is read from what was
    written, so no table is computed twice.
    """

    def save(name: str, df: DataFrame) -> bool:
        out = df if digits is None else rounded(df, digits)
        writer = out.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True).option("escape", '"')
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.save(f"{folder}/{name}")
        reader = df.sparkSession.read.schema(out.schema)
        return not reader.option("header", fmt == "csv").format(fmt).load(f"{folder}/{name}").isEmpty()

    if not tables:
        return []
    spark = next(iter(tables.values())).sparkSession
    filled = at_once(spark, [lambda name=name, df=df: save(name, df) for name, df in tables.items()], _WRITERS)
    return [name for name, rows in zip(tables, filled) if rows]


def export_csv(df: DataFrame, path: str) -> None:
    """A query result as header CSV, one file per partition."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_results(df: DataFrame, path: str) -> None:
    """Test results as JSON lines, added to those already there."""
    df.write.mode("append").json(path)


def save_report(report: DataFrame, path: str) -> None:
    """A report's rows (section, metric, key, value) as JSON lines."""
    report.write.mode("overwrite").json(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def save_chunks(chunks: DataFrame, root: str, after: int | None = None) -> int:
    """Store chunks by type, so that a search of some types reads only those; the new state's number.

    A merge may read the store it replaces. Readers see the old chunks until the new ones are published whole.
    """
    return versions.replace(chunks.sparkSession, root, {"chunks": chunks}, {"chunks": ["chunk_type"]}, after)


def stored_chunks(spark: SparkSession, root: str) -> tuple[int, DataFrame | None]:
    """The number of the newest state and its chunks, None before the first."""
    number, tables = versions.current(spark, root)
    return number, tables.get("chunks")
