"""Exact top-k by distributed histogram selection.

Every row is scored against every query, in blocks. The k-th best score of each query is found
from histograms over all scores: the first tells the range of scores apart coarsely, each next
one refines only the bin in which the k-th score lies. With that score known, rows above it and
the ties with the smallest ids are kept.

A task counts only its own k best scores in the bin under refinement: whatever it leaves out has k
better scores in the same task, so the counts above the k-th score stay exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored
from tillroll.llm.vectors import matrix, meet, prepared

#: Bits of the score that one histogram tells apart.
STEP_BITS = 12
#: Scores and components count up to this size; what is larger counts as this.
LARGEST = (1 << 62) - 1
#: Queries scored at once inside a task.
_CHUNK = 64


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as 64-bit integers, held at LARGEST beyond it."""
    return np.floor(256.0 * np.clip(x, -(2.0**55), 2.0**55)).clip(-(2.0**62), 2.0**62).astype(np.int64).clip(-LARGEST, LARGEST)


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, held at LARGEST and -LARGEST.

    Integer sums wrap round at 2^64, so they are right wherever the true sum is a long. A floating-point
    sum with its error bound tells where that is so and where the sum is surely too large;
    the few in between are made in unbounded integers.
    """
    s, x, y = q @ c.T, q.astype(float), c.astype(float)
    about = x @ y.T
    error = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))[None, :] * (q.shape[1] + 4) * 2.0**-52
    beyond = np.abs(about) - error > 2.0**62
    s = np.where(beyond, np.where(about > 0, LARGEST, -LARGEST), s)
    for i, j in zip(*np.nonzero(~beyond & (np.abs(about) + error >= 2.0**62))):
        s[i, j] = max(-LARGEST, min(LARGEST, sum(a * b for a, b in zip(q[i].tolist(), c[j].tolist()))))
    return s


def _scores(rows: pd.DataFrame, queries: pd.DataFrame, bound: int):
    """Per chunk of queries: its frame and the matrix of scores + bound; -1 for rows of the query's own id.

    Sums under 2^53 are exact in floating point, larger ones are made in integers.
    """
    kind = np.float64 if bound < 1 << 53 else np.int64
    c, ids = matrix(rows["v"], np.int64).astype(kind), rows["key"].to_numpy()
    for at in range(0, len(queries), _CHUNK):
        q = queries.iloc[at : at + _CHUNK]
        x = matrix(q["v"], np.int64).astype(kind)
        s = (_exact(x, c) if bound == LARGEST else (x @ c.T).astype(np.int64)) + bound
        s[q["key"].to_numpy()[:, None] == ids[None, :]] = -1
        yield q, s


def _largest(s: np.ndarray, k: int) -> np.ndarray:
    return s if s.shape[1] <= k else np.partition(s, s.shape[1] - k, axis=1)[:, -k:]


def top_k(rows: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, <key>, score: the k rows of highest inner product for each query row.

    Components count as floor(256 x), so scores are whole numbers. Queries are the rows that meet
    `is_query`, a column expression over the key `_key`; candidates are all rows of another key. Ties go
    to the smaller key. Rows with a null key or vector, or null or non-finite components, take no
    part; of vectors of several lengths the shorter ones end in zeros. Scores are exact up to
    2^62 - 1; scores and components beyond that count as that, so such ties go to the smaller key too. Rows repeated under one key are candidates as often as they occur, and one query. A
    query with fewer candidates returns them all; an empty table gives no rows.
    """
    base = stored(prepared(rows, key, vector, whole_numbers, zero=True))
    asked = stored(
        base.filter(is_query(F.col("key"))).dropDuplicates().withColumn("q", F.monotonically_increasing_id())
    )
    n_rows, n_queries = base.count(), asked.count()

    def norms(batches):
        for batch in batches:
            m = matrix(batch.column(0).to_pylist(), np.int64).astype(float) if batch.num_rows else np.zeros((0, 1))
            norm = float((m * m).sum(axis=1).max(initial=0.0))
            yield pa.RecordBatch.from_arrays([pa.array([norm])], names=["norm"])

    top = base.select("v").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0] or 0.0
    bound = min(int(top * (1 + 1e-9)) + 1, LARGEST)
    left = (2 * bound).bit_length()
    state = asked.select("q", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("above"))

    while left > 0:
        before, left = left, max(0, left - STEP_BITS)

        def count(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(c) and len(q):
                for part, s in _scores(c, q, bound):
                    s = np.where(s >> before == part["prefix"].to_numpy()[:, None], s, -1)
                    s = _largest(s, k)
                    at, col = np.nonzero(s >= 0)
                    out.append(pd.DataFrame({"q": part["q"].to_numpy()[at], "bin": s[at, col] >> left}))
            if not out:
                return pd.DataFrame({"q": [], "bin": [], "n": []}).astype("int64")
            return pd.concat(out).groupby(["q", "bin"]).size().rename("n").reset_index()

        bins = meet(base, asked.join(state, "q"), n_rows, n_queries, count, "q long, bin long, n long")
        bins = bins.groupBy("q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.col("bin").desc())
        cut = (
            bins.join(state, "q")
            .withColumn("_upto", F.col("above") + F.sum("n").over(down))
            .filter(F.col("_upto") >= k)
            .withColumn("_first", F.row_number().over(down))
            .filter("_first = 1")
            .select("q", F.col("bin").alias("_bin"), (F.col("_upto") - F.col("n")).alias("_above"))
        )
        # A query with fewer than k candidates keeps the lowest bin: all of them are wanted.
        state = stored(
            state.join(cut, "q", "left").select(
                "q", F.coalesce("_bin", F.shiftleft(F.col("prefix"), before - left)).alias("prefix"),
                F.coalesce("_above", "above").alias("above"),
            )
        )

    def keep(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(c) and len(q):
            c = c.sort_values("key", kind="stable")
            ids = c["key"].to_numpy()
            for part, s in _scores(c, q, bound):
                kth = part["prefix"].to_numpy()[:, None]
                tie = (s == kth) & (s >= 0)
                at, col = np.nonzero((s > kth) | tie & (np.cumsum(tie, axis=1) <= k))
                out.append(
                    pd.DataFrame({"q": part["q"].to_numpy()[at], "query_id": part["key"].to_numpy()[at], key: ids[col], "score": s[at, col] - bound})
                )
        return pd.concat(out) if out else pd.DataFrame({"q": [], "query_id": [], key: [], "score": []}).astype("int64")

    found = meet(base, asked.join(state, "q"), n_rows, n_queries, keep, f"q long, query_id long, `{key}` long, score long")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col(key))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")

