"""Vectors as rows of bytes, and the grid in which a query set meets all rows in blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of either side that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


def prepared(rows: DataFrame, key: str, vector: str, transform, zero: bool) -> DataFrame:
    """key, v (bytes of 64-bit numbers) of the rows whose vector and components are all there and finite.

    `transform` maps an array of finite components to the numbers to keep. Vectors of zeros only
    are kept if `zero` says so. Where lengths differ, missing last components count as zeros.
    """
    v = F.col(vector)
    clean = rows.select(F.col(key).cast("long").alias("key"), F.transform(v, lambda x: x.cast("double")).alias("v")).filter(
        F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    if not zero:
        clean = clean.filter(F.exists("v", lambda x: x != 0))
    sizes = clean.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if sizes["a"] != sizes["b"]:
        clean = clean.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(sizes["b"]) - F.size("v"))))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = transform(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "v"])

    return clean.mapInArrow(run, "key long, v binary")


def matrix(column, dtype) -> np.ndarray:
    """The rows of a bytes column as a matrix."""
    rows = list(column)
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def meet(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, run, schema: str) -> DataFrame:
    """`run(rows, queries)` over pandas frames for every block of rows with every block of queries.

    Both sides are dealt out by their place in the stored table, so equal rows do not gather in
    one block. Each task holds one block of either side.
    """
    stripes, blocks = max(1, math.ceil(n_rows / BLOCK_ROWS)), max(1, math.ceil(n_queries / BLOCK_QUERIES))
    place = F.monotonically_increasing_id()
    left = rows.withColumn("_stripe", F.pmod(F.xxhash64(place), F.lit(stripes))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    right = queries.withColumn("_block", F.pmod(F.xxhash64(place), F.lit(blocks))).withColumn(
        "_stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long")))
    )
    grid = ("_stripe", "_block")
    return left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(run, schema)
