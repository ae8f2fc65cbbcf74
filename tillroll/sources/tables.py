"""Table readers, ad-hoc SQL, validation, profiling and sampling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import fixed
from tillroll.functions.columns import key_hash, mean_of, ratio, strip
from tillroll.operators.ordering import durable
from tillroll.operators.selection import column_quantiles
from tillroll.schemas import BY_DATASET


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Parquet, ORC, JSON or header CSV; CSV and JSON need a schema.

    Whole numbers in CSV may be written with a fraction of zero, as tools do that hold a
    column with gaps in floating point: `13085.0` reads as 13085; with any other fraction a
    cell is null, as if it were no number. Quotes inside a quoted CSV field are doubled.
    """
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs an explicit schema")
    if fmt == "json":
        return spark.read.schema(schema).json(path)
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    text = T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.IntegralType) else f.dataType)
            for f in schema.fields
        ]
    )
    df = spark.read.schema(text).option("header", True).option("escape", '"').csv(path)
    return df.select(
        *[
            _whole(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, T.IntegralType)
            else F.col(f"`{f.name}`")
            for f in schema.fields
        ]
    )


def _whole(text):
    """The text as a decimal, null unless it is a whole number."""
    exact = text.try_cast("decimal(38,18)")
    return F.when(exact == F.floor(exact), exact)


class Checked(NamedTuple):
    """Rows that fit the schema, and the others: file, columns, record."""

    kept: DataFrame
    rejected: DataFrame


_BROKEN = "_corrupt_record"


def read_checked(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> Checked:
    """CSV with a header or JSON lines, every record either kept or listed with its file.

    A record is listed if it cannot be split into the schema's fields (`columns` is null and `record`
    the line itself), or if a cell is no value of its column's type: `columns` names those, in the order of the
    schema, and `record` holds all cells as JSON. Whole numbers may have a fraction of zero; a decimal
    must fit its places. Absent and blank cells are null and no fault. Both tables are read from one
    stored pass over the files, so kept and rejected records add up to all of them.
    """
    names = schema.fieldNames()
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BROKEN]])
    reader = spark.read.schema(text).option("columnNameOfCorruptRecord", _BROKEN)
    if fmt == "csv":
        raw = reader.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        raw = reader.json(path)
    else:
        raise ValueError(f"{fmt} files carry their types")
    values, faults = [], []
    for f in schema.fields:
        cell = F.col(f"`{f.name}`")
        value = _typed(cell, f.dataType)
        values.append(value.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            faults.append(F.when((strip(cell) != "") & value.isNull(), F.lit(f.name)))
    read = durable(
        raw.select(
            F.struct(*values).alias("row"), F.array_join(F.array(*faults), ",").alias("columns"), F.col(_BROKEN).alias("line"),
            F.to_json(F.struct(*[F.col(f"`{n}`") for n in names])).alias("cells"), F.col("_metadata.file_path").alias("file"),
        ).withColumn("cells", F.when((F.col("columns") != "") & F.col("line").isNull(), F.col("cells")))
    )
    whole = F.col("line").isNull() & (F.col("columns") == "")
    rejected = read.filter(~whole).select(
        "file", F.when(F.col("line").isNull(), F.col("columns")).alias("columns"), F.coalesce("line", "cells").alias("record")
    )
    return Checked(read.filter(whole).select("row.*"), rejected)


def _typed(cell, kind: T.DataType):
    """The cell as the type, null where it is no value of it."""
    if isinstance(kind, T.StringType):
        return cell
    if isinstance(kind, T.IntegralType):
        return _whole(cell).try_cast(kind)
    value = strip(cell).try_cast(kind)
    if isinstance(kind, T.DecimalType):
        places = 38 - (kind.precision - kind.scale)
        return F.when(value == cell.try_cast(T.DecimalType(38, places)), value)
    return value


def rejected_counts(checked: Checked) -> DataFrame:
    """columns, records: how many records were kept (`kept`), listed by their faulty columns, or no record (`line`)."""
    kept = checked.kept.agg(F.lit("kept").alias("columns"), F.count(F.lit(1)).alias("records"))
    listed = checked.rejected.groupBy(F.coalesce("columns", F.lit("line")).alias("columns")).agg(F.count(F.lit(1)).alias("records"))
    return kept.unionByName(listed)


def load_catalog(
    spark: SparkSession,
    folder: str,
    fmt: str = "parquet",
    names: Iterable[str] = fixed.DATASETS,
) -> dict[str, DataFrame]:
    """Temp views over the named datasets under `folder`; absent ones are skipped."""
    found = {}
    for name in names:
        try:
            df = read_table(spark, f"{folder}/{name}", fmt, BY_DATASET.get(name))
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        df.createOrReplaceTempView(name)
        found[name] = df
    return found


def sql(spark: SparkSession, text: str) -> DataFrame:
    """Any statement Spark SQL takes, over the catalog's tables and views."""
    return spark.sql(text)


def sql_over(spark: SparkSession, frames: Mapping[str, DataFrame], text: str) -> DataFrame:
    """A statement that names DataFrames in braces."""
    return spark.sql(text, **frames)


def scan_chunks(df: DataFrame, types: Sequence | None = None, column: str = "chunk_type") -> DataFrame:
    """All rows, or those of the given types; the filter reaches the file scan."""
    return df if not types else df.filter(F.col(column).isin(list(types)))


def validate_table(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required name: is there a column containing it, and how many nulls."""
    lower = {c.lower(): c for c in df.columns}
    match = {
        name: next((c for low, c in lower.items() if name.lower() in low), None)
        for name in required
    }
    nulls = [
        F.count_if(F.col(f"`{c}`").isNull()) if c else F.lit(None).cast("long")
        for c in match.values()
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("required"),
                F.lit(c).cast("string").alias("matched_column"),
                F.lit(c is not None).alias("found"),
                F.col("n").alias("rows"),
                (F.col("n") > 0).alias("non_empty"),
                F.col(f"k{i}").alias("nulls"),
            )
            for i, (name, c) in enumerate(match.items())
        ]
    )
    counted = df.agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(f"k{i}") for i, c in enumerate(nulls)]
    )
    return counted.select(F.inline(rows))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, range, and for numbers mean, spread and quartiles.

    Counts, ranges and moments of all columns come from one pass. Quartiles are exact and come from
    histograms of all columns together.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    n = F.count(F.lit(1))
    measures = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        is_num = f.name in numeric
        none = F.lit(None).cast("double")
        measures.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                n.alias("rows"),
                (n - F.count(c)).alias("nulls"),
                (ratio(n - F.count(c), n) * 100).alias("null_pct"),
                F.min(c).cast("string").alias("min_text"),
                F.max(c).cast("string").alias("max_text"),
                (mean_of(c) if is_num else none).alias("mean"),
                (F.stddev_samp(c.cast("double")) if is_num else none).alias("stddev"),
            )
        )
    base = df.agg(F.array(*measures).alias("m")).select(F.inline("m"))
    if not numeric:
        return base.withColumns({p: F.lit(None).cast("double") for p in ("p25", "p50", "p75")})
    spread = column_quantiles(df, numeric, (0.25, 0.5, 0.75))
    wide = spread.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{int(p * 100)}")
          for p in (0.25, 0.5, 0.75)]
    )
    return base.join(wide, "column", "left")


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = fixed.SEED) -> DataFrame:
    """n rows by hash order of the key: the same rows under any partitioning."""
    return df.orderBy(key_hash(seed, *key), *key).limit(n)


def count_frames(frames: Mapping[str, DataFrame | None]) -> DataFrame:
    """Rows per table; a missing table counts 0."""
    spark = next(f for f in frames.values() if f is not None).sparkSession
    out = None
    for name, df in frames.items():
        counted = (
            spark.range(1).select(F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("n"))
            if df is None
            else df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        )
        out = counted if out is None else out.unionByName(counted)
    return out


def table_counts(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Rows per catalog table; a table that does not exist counts 0."""
    frames = {n: spark.table(n) if spark.catalog.tableExists(n) else None for n in names}
    if not any(f is not None for f in frames.values()):
        return spark.createDataFrame([(n, 0) for n in names], "table_name string, n long")
    return count_frames(frames)
