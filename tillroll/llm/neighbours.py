"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are rotated at random and cut into groups of a few coordinates. Each curve takes one
group, shifts it, and orders all rows by their Hilbert keys; Spark range-partitions that order
and every row learns its place on each curve. A query is compared with the rows at most
`window` places before and after its own on every curve, and the finds of all curves are merged
and ranked by the distance of the original vectors.

The window follows from the data: for a bounded sample of the queries the true neighbours are found by
scanning all rows, and the window is the one in which the wanted share of them lies on some
curve. Rows that form clusters need a short window; directions without any structure need one
that holds a good part of the table, at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored
from tillroll.llm.vectors import matrix, prepared

#: Coordinates of a curve, and bits of each.
DIMENSIONS, BITS = 8, 4
#: Rows compared with queries in one task, queries expected there, rows of a range partition.
BLOCK_ROWS, BLOCK_QUERIES, RANGE_ROWS = 4096, 2048, 65_536


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of whole numbers under 2^bits, as bytes whose order is the curve's.

    Skilling's transposition: the highest bits first, coordinates are swapped or mirrored so that
    neighbouring cells stay neighbours, and the result is Gray-decoded.
    """
    x = x.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip, q = np.zeros(n, np.int64), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip[:, None]
    planes = [(x[:, i] >> (bits - 1 - j)) & 1 for j in range(bits) for i in range(d)]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def _moments(base: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all vectors; each task sends (size + 1)^2 sums."""

    def run(batches):
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([np.ones((batch.num_rows, 1)), matrix(batch.column(0).to_pylist(), np.float64)])
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "value"])

    flat = np.zeros((size + 1) ** 2)
    for r in base.select("v").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[r["at"]] = r["value"]
    m = flat.reshape(size + 1, size + 1)
    mean = m[0, 1:] / m[0, 0]
    return mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)


def _curves(size: int, curves: int, mean: np.ndarray, cov: np.ndarray, seed: int) -> list[tuple]:
    """Per curve: directions (size x group), centre, spread and shift."""
    random, out, left = np.random.default_rng(seed), [], np.zeros((size, 0))
    for _ in range(curves):
        if left.shape[1] < min(DIMENSIONS, size):
            left = np.linalg.qr(random.normal(size=(size, size)))[0]
        way, left = left[:, :DIMENSIONS], left[:, DIMENSIONS:]
        spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", way, cov, way), 1e-30))
        out.append((way, mean @ way, spread, random.uniform(0, 0.5, way.shape[1])))
    return out


def _laid(base: DataFrame, curves: list[tuple], n: int) -> DataFrame:
    """curve, place (0 to n - 1), key, v, copies: every row of `base` once on every curve."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1).to_pylist(), np.float64)
            for c, (way, centre, spread, shift) in enumerate(curves):
                z = (x @ way - centre) / spread
                # A logistic curve spreads the coordinates evenly over half the grid; the shift moves them in it.
                cell = np.floor((0.5 / (1 + np.exp(-np.clip(1.7 * z, -40, 40))) + shift) * (1 << BITS)).astype(np.int64)
                at = hilbert_keys(np.minimum(cell, (1 << BITS) - 1), BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(x), pa.int32()), pa.array([k.tobytes() for k in at], pa.binary()), *batch.columns],
                    names=["curve", "at", *order[2:], "copies"],
                )

    order = ["curve", "at", "key", "v"]
    ranges = max(8, math.ceil(n * len(curves) / RANGE_ROWS))
    rows = stored(base.mapInArrow(run, "curve int, at binary, key long, v binary, copies long"))
    rows = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # The number holds the range above bit 33 and the place in it below; written, it stays.
    rows = stored(rows.select("curve", "key", "v", "copies", F.monotonically_increasing_id().alias("_id")))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("_part", part).withColumn("_in", inside)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    # One row per range.
    return rows.join(F.broadcast(starts), "_part").select(
        "curve", (F.col("_start") + F.col("_in") - F.col("curve") * F.lit(n)).alias("place"), "key", "v", "copies"
    )


def _nearest(c: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int):
    """Rows and columns of the k nearest candidates of each query and their distances, ties by id.

    `ids` ascend. A quick product finds candidates; those within rounding of the k-th are measured anew
    by differences.
    """
    squares = (c * c).sum(axis=1)
    for at in range(0, len(q), 64):
        x = q[at : at + 64]
        d = squares[None, :] - 2 * (x @ c.T) + (x * x).sum(axis=1)[:, None]
        d[own[at : at + 64][:, None] == ids[None, :]] = np.inf
        if d.shape[1] > k:
            limit = np.partition(d, k - 1, axis=1)[:, k - 1]
        else:
            limit = np.full(len(x), np.finfo(float).max)
        slack = 1e-9 * ((x * x).sum(axis=1) + squares.max(initial=0))
        i, j = np.nonzero((d <= (limit + slack)[:, None]) & np.isfinite(d))
        exact = np.sqrt(((x[i] - c[j]) ** 2).sum(axis=1))
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(x)))
        keep = np.arange(len(i)) - first[i] < k
        yield i[keep] + at, j[keep], exact[keep]


def _window(base: DataFrame, laid: DataFrame, asked: DataFrame, k: int, share: float, sample: int) -> int:
    """The window in which `share` of the true neighbours of `sample` queries lie on some curve."""
    some = asked.orderBy(F.xxhash64("q"), "q").limit(sample).collect()
    q, own = matrix([r["v"] for r in some], np.float64), np.array([r["key"] for r in some])
    names = np.array([r["q"] for r in some])

    def scan(batches):
        for batch in batches:
            if batch.num_rows:
                ids = np.asarray(batch.column(0))
                order = np.argsort(ids, kind="stable")
                c = matrix(batch.column(1).to_pylist(), np.float64)[order]
                for i, j, d in _nearest(c, ids[order], q, own, k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[i]), pa.array(own[i]), pa.array(ids[order][j]), pa.array(d)], names=["q", "own", "key", "d"]
                    )

    best = Window.partitionBy("q").orderBy("d", "key")
    near = base.select("key", "v").mapInArrow(scan, "q long, own long, key long, d double")
    near = stored(near.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).select("q", "own", "key"))
    # At most (k + 1) * sample keys.
    wanted = near.select("key").union(near.select(F.col("own").alias("key"))).dropDuplicates()
    places = stored(laid.select("curve", "place", "key").join(F.broadcast(wanted), "key", "left_semi"))
    mine = places.select("curve", F.col("key").alias("own"), F.col("place").alias("_mine"))
    gaps = (
        near.join(places, "key").join(mine, ["curve", "own"]).groupBy("q", "key")
        .agg(F.min(F.abs(F.col("place") - F.col("_mine"))).alias("gap"))
    )
    got = sorted(r["gap"] for r in gaps.collect())
    return max(k, got[min(len(got) - 1, math.ceil(share * len(got)) - 1)] if got else k)


def nearest(
    rows: DataFrame,
    is_query,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    curves: int = 8,
    recall: float = 0.94,
    sample: int = 256,
    window: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """query_id, rank, <key>, score: the k nearest rows found for each query row, by Euclidean distance.

    Queries are the rows that meet `is_query`, a function of the key column; candidates are all
    rows of another key, and every row is on every curve. `window` is the number of places looked
    at on either side; where it is not given it is fitted to reach `recall` on `sample` queries.
    Ties go to the smaller key. Rows with a null key or vector, a vector of zeros, or null or
    non-finite components take no part; of vectors of several lengths the shorter ones end in zeros. Rows
    repeated under one key with one vector are candidates as often as they occur, and one query. A query with fewer candidates returns those there are; an empty table gives no rows.
    """
    # Copies of a row are laid out once; no list needs more than k of them.
    base = prepared(rows, key, vector, lambda x: x, zero=False).groupBy("key", "v").agg(F.count(F.lit(1)).alias("_n"))
    base = stored(base.select("key", "v", F.least("_n", F.lit(k)).alias("copies")))
    n = base.count()
    asked = stored(base.filter(is_query(F.col("key"))).select("key", "v").withColumn("q", F.monotonically_increasing_id()))
    schema = f"q long, query_id long, `{key}` long, score double, mark long, copies long"
    n_queries = asked.count()
    if not n_queries or n < 2:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    size = base.select(F.octet_length("v")).first()[0] // 8
    laid = _laid(base, _curves(size, curves, *_moments(base, size), seed), n)
    reach = window or _window(base, laid, asked, k, recall, sample)

    block = F.floor(F.col("place") / BLOCK_ROWS)
    parts = max(1, math.ceil(n_queries * (2 * reach + BLOCK_ROWS) / n / BLOCK_QUERIES))
    left = laid.withColumn("_block", block).withColumn("mark", F.xxhash64("v")).withColumn(
        "_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    )
    low = F.floor(F.greatest(F.col("place") - reach, F.lit(0)) / BLOCK_ROWS)
    high = F.floor(F.least(F.col("place") + reach, F.lit(n - 1)) / BLOCK_ROWS)
    right = (
        laid.filter(is_query(F.col("key"))).join(asked.select("q", "key", "v"), ["key", "v"])
        .withColumn("_block", F.explode(F.sequence(low, high)))
        .withColumn("_deal", F.pmod(F.xxhash64("q"), F.lit(parts)))
    )
    right = right.toDF(*right.columns)  # columns of their own: both sides come from one table

    def compare(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(c) and len(q):
            c = c.sort_values("key", kind="stable")
            m = matrix(c["v"], np.float64)
            ids, place, mark, copies = (c[x].to_numpy() for x in ("key", "place", "mark", "copies"))
            q = q.sort_values("place")
            names, own, at = (q[x].to_numpy() for x in ("q", "key", "place"))
            whole = (np.abs(at - place.min()) <= reach) & (np.abs(at - place.max()) <= reach)
            x = matrix(q["v"], np.float64)
            for i, j, d in _nearest(m, ids, x[whole], own[whole], k) if whole.any() else ():
                out.append(pd.DataFrame({"q": names[whole][i], "query_id": own[whole][i], key: ids[j], "score": d, "mark": mark[j], "copies": copies[j]}))
            for p in np.flatnonzero(~whole):
                inside = np.flatnonzero(np.abs(place - at[p]) <= reach)
                for _, j, d in _nearest(m[inside], ids[inside], x[p : p + 1], own[p : p + 1], k):
                    j = inside[j]
                    out.append(pd.DataFrame({"q": names[p], "query_id": own[p], key: ids[j], "score": d, "mark": mark[j], "copies": copies[j]}))
        whole_columns = ("q", "query_id", key, "mark", "copies")
        empty = pd.DataFrame({x: [] for x in ("q", "query_id", key, "score", "mark", "copies")}).astype(dict.fromkeys(whole_columns, "int64"))
        return pd.concat(out) if out else empty

    grid = ("curve", "_block", "_deal")
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInPandas(compare, schema).dropDuplicates()
    best = Window.partitionBy("q").orderBy("score", key)
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")
