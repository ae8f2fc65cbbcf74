"""Ranks, running totals and exact quantiles over a whole table.

An unpartitioned window would put every row on one task. Here the rows are range
partitioned by a total order, sorted inside each partition and stored once.
A row's place is then (partition, position), and only one number per partition is
needed to turn that into a place in the whole table. Range bounds are cut anywhere
in the order key, so a hot leading value spreads over many partitions.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_stored")
    return context.getCheckpointDir()


def session_folder(spark: SparkSession) -> str:
    """Where this session's intermediate tables are."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def drop_session_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; frames that read them are of no use after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows written once under the session's part of the shared folder and read back.

    Lineage is cut and the rows survive a lost executor. Being a columnar table, a later
    read takes only the columns it needs, and Spark knows its size when it plans joins.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one range of a large table, about; of a small one, of which the shuffle setting makes fewer ranges.
RANGE_ROWS, SMALL_RANGE_ROWS = 1_000_000, 10_000


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds `_part` and `_pos` (from 1): the row's place in the sorted table.

    The rows are stored before they are sorted, so that finding the range bounds does not compute
    them a second time, and the number of ranges grows with theirs beyond the shuffle setting.
    """
    kept = durable(df)
    rows = kept.count()
    setting = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, math.ceil(rows / RANGE_ROWS), min(setting, math.ceil(rows / SMALL_RANGE_ROWS)))
    laid = kept.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The id holds the partition number above bit 33 and the row's position below it.
    # It is written with the rows, so that a later read cannot number them anew.
    return (
        durable(laid.withColumn("_id", F.monotonically_increasing_id()))
        .withColumn("_part", F.shiftright("_id", 33).cast("int"))
        .withColumn("_pos", F.col("_id").bitwiseAND((1 << 33) - 1) + 1)
        .drop("_id")
    )


def _before(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sum over earlier partitions. One row per partition, hence small."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_part", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"_before_{n}") for n in names]
    )


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """`row_number` over the whole table; `order` has to be a total order."""
    placed = _placed(df, order)
    sizes = placed.groupBy("_part").agg(F.max("_pos").alias("rows"))
    return (
        placed.join(F.broadcast(_before(sizes, ["rows"])), "_part")
        .withColumn(name, F.col("_before_rows") + F.col("_pos"))
        .drop("_part", "_pos", "_before_rows")
    )


def rank_in_groups(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "rank"
) -> DataFrame:
    """`row_number` per group, with a hot group spread over many partitions.

    The groups are stored, so that Spark knows their size when it plans the join. Found out later, two small
    groups are no broadcast for it, as they fill too few partitions, and all rows of a group go to one task.
    """
    ranked = global_rank(df, [*groups, *order], "_rank")
    first = durable(ranked.groupBy(*groups).agg(F.min("_rank").alias("_first")))
    return (
        ranked.join(first, list(groups))
        .withColumn(name, F.col("_rank") - F.col("_first") + 1)
        .drop("_rank", "_first")
    )


def running_totals(df: DataFrame, order: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Adds `run_<measure>`: the inclusive running sum in the given total order."""
    placed = _placed(df, order)
    w = (
        Window.partitionBy("_part")
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = placed.groupBy("_part").agg(*[F.sum(m).alias(m) for m in measures])
    inside = placed.withColumns({f"run_{m}": F.sum(m).over(w) for m in measures})
    return (
        inside.join(F.broadcast(_before(totals, measures)), "_part")
        .withColumns({f"run_{m}": F.col(f"run_{m}") + F.col(f"_before_{m}") for m in measures})
        .drop("_part", "_pos", *[f"_before_{m}" for m in measures])
    )


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation: groups, `prob`, `value`.

    Equal values are counted before the shuffle, so a value held by most rows costs
    one row, and no task ever holds a whole group.
    """
    groups = list(groups)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    run = running_totals(counts, [*groups, "_v"], ["_n"])
    # Running sums go across groups; take off what lies before the group.
    base = run.groupBy(*groups).agg(
        F.min(F.col("run__n") - F.col("_n")).alias("_base"), F.sum("_n").alias("_size")
    )
    if groups:
        run = run.join(base, groups)
    else:
        whole = base.select(F.struct("_base", "_size").alias("b")).scalar()
        run = run.withColumn("_b", whole).select("*", "_b._base", "_b._size").drop("_b")
    last = F.col("run__n") - F.col("_base")
    place = (F.col("_size") - 1) * F.col("prob")
    picked = (
        run.withColumn("_last", last)
        .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
        .withColumns({"_lo": F.floor(place), "_hi": F.ceil(place), "_t": place - F.floor(place)})
    )
    first = F.col("_last") - F.col("_n")

    def held(at: str):
        return (F.col(at) >= first) & (F.col(at) < F.col("_last"))

    v = F.col("_v").cast("double")
    return (
        picked.filter(held("_lo") | held("_hi"))
        .groupBy(*groups, "prob")
        .agg(
            F.max(F.when(held("_lo"), v)).alias("_a"),
            F.max(F.when(held("_hi"), v)).alias("_b"),
            F.max("_t").alias("_t"),
        )
        .select(*groups, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")).alias("value"))
    )


def quantile(df: DataFrame, value: str, prob: float):
    """One exact quantile as a scalar column."""
    return quantiles(df, value, (prob,)).select("value").scalar()


def row_chunks(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Blocks of `size` consecutive rows: adds `row` (from 1) and `chunk` (from 1)."""
    return global_rank(df, order, "row").withColumn(
        "chunk", F.floor((F.col("row") - 1) / size).cast("long") + 1
    )


def top_in_group(df: DataFrame, groups: Sequence[str], value: str, n: int) -> DataFrame:
    """The n most frequent values per group, ties by value.

    Rows are counted per (group, value) first, and Spark keeps only n rows per group
    and task before it shuffles for the ranking.
    """
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups).orderBy(F.desc("n"), value)
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
