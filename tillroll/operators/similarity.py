"""Exact cosine top-k of a table of query vectors against a table of vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of which one task holds a block each.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 2_048
_CHUNK = 128


def _unit(column: pd.Series) -> np.ndarray:
    v = np.stack(column.to_numpy()).astype(float)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _best_of(k: int, skip_self: bool):
    """The k best vectors of a block for each query of a block, ties at the k-th place by id."""

    def scan(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": queries["query_id"][:0], "vector_id": vectors["vector_id"][:0], "similarity": np.zeros(0)})]
        if len(vectors) and len(queries):
            vectors = vectors.sort_values("vector_id")
            v, found = _unit(vectors["vector"]), vectors["vector_id"].to_numpy()
            q, ids = _unit(queries["vector"]), queries["query_id"].to_numpy()
            for at in range(0, len(q), _CHUNK):
                similarity, own = q[at : at + _CHUNK] @ v.T, ids[at : at + _CHUNK]
                if skip_self:
                    similarity = np.where(own[:, None] == found[None, :], -np.inf, similarity)
                order = np.argsort(-similarity, axis=1, kind="stable")[:, :k]
                best = np.take_along_axis(similarity, order, axis=1)
                row, place = np.nonzero(np.isfinite(best))
                parts.append(
                    pd.DataFrame({"query_id": own[row], "vector_id": found[order[row, place]], "similarity": best[row, place]})
                )
        return pd.concat([p for p in parts if len(p)] or parts[:1])

    return scan


def cosine_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 5,
    query_id: str = "vec_id",
    vector_id: str = "vec_id",
    vector: str = "embedding",
    skip_self: bool = False,
) -> DataFrame:
    """`query_id, vector_id, similarity, place` of the k nearest vectors of each query.

    Query ids are unique. Both sides stay tables: they are cut into blocks by a hash of their id,
    every block of queries meets every block of vectors in a task of its own, and k rows per query
    and block go on to the ranking.
    """
    id_type = vectors.schema[vector_id].dataType.simpleString()
    slim = vectors.select(F.col(vector_id).alias("vector_id"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")
    wanted = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector")).filter("vector IS NOT NULL")
    stripes = max(1, math.ceil(slim.count() / BLOCK_VECTORS))
    blocks = max(1, math.ceil(wanted.count() / BLOCK_QUERIES))

    def dealt(df: DataFrame, key: str, mine: str, parts: int, other: str, copies: int) -> DataFrame:
        return df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(parts))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long")))
        )

    left = dealt(slim, "vector_id", "_stripe", stripes, "_block", blocks)
    right = dealt(wanted, "query_id", "_block", blocks, "_stripe", stripes)
    right = right.toDF(*right.columns)
    grid = ("_stripe", "_block")
    out = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(
        _best_of(k, skip_self), f"query_id {id_type}, vector_id {id_type}, similarity double"
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vector_id")
    return out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def with_details(hits: DataFrame, vectors: DataFrame, vector_id: str, cols: Sequence[str]) -> DataFrame:
    """Adds columns of the found vectors and the similarity in percent."""
    found = vectors.select(F.col(vector_id).alias("vector_id"), *cols)
    return found.join(hits, "vector_id").withColumn("relevance_pct", F.round(F.col("similarity") * 100, 1))
