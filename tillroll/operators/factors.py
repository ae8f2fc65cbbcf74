"""Customer and product vectors learnt from revenue, and their nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll import fixed
from tillroll.functions.columns import ellipsize, ratio
from tillroll.operators.aggregates import busiest
from tillroll.operators.learning import metric_rows, regression
from tillroll.operators.ordering import durable, global_rank
from tillroll.operators.similarity import cosine_topk


#: Customers whose vectors a task holds while it predicts, and ratings that it predicts, of each about.
CELL_KEYS, CELL_RATINGS = 500_000, 2_000_000
#: Ratings of one block of the fit, about; it is sent as many vectors at most.
BLOCK_RATINGS = 1_000_000
_CHUNK = 65_536
_CELL_BITS = 33


class Factors(NamedTuple):
    customers: DataFrame
    products: DataFrame
    metrics: DataFrame
    model: object


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """Each distinct key with a number from 0 in key order, without a driver-side list."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return global_rank(keys, [key], "_r").select(key, (F.col("_r") - 1).cast("int").alias(name))


def _predict_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ratings with the product of their two vectors; those without one of them are left out.

    A cell begins with the vectors of its customers, which are kept; each of its products follows with its vector
    and then its ratings, so that one batch of them is held at a time.
    """
    cell = None
    for batch in batches:
        places = batch["place"].to_numpy()
        cells = places >> _CELL_BITS
        for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)] if len(cells) else []):
            rows = batch.slice(lo, hi - lo)
            user, place = rows["user"].to_numpy(), places[lo:hi]
            item, rated = (place & ((1 << _CELL_BITS) - 1)) // 2 - 1, place & 1
            if cells[lo] != cell:
                cell, parts, held, last = cells[lo], [], None, None
            customers, vector = np.searchsorted(item, 0), rated == 0
            sent = rows["features"].flatten().to_numpy().reshape(vector.sum(), -1) if vector.any() else None
            if customers:
                parts.append((user[:customers], sent[:customers].copy()))
            if customers == len(item):
                continue
            if held is None and parts:
                ids, vectors = map(np.concatenate, zip(*parts, strict=True))
                order, parts = np.argsort(ids), []
                held = ids[order], order, vectors
            vector[:customers] = False
            if vector.any():
                ids, vectors = item[vector], sent[customers:]
                last = (ids, vectors) if last is None else tuple(np.concatenate([x[-1:], y]) for x, y in zip(last, (ids, vectors), strict=True))
            if held is None or last is None:
                continue
            at = np.flatnonzero(rated)
            u = np.searchsorted(held[0], user[at]).clip(max=len(held[0]) - 1)
            i = np.searchsorted(last[0], item[at]).clip(max=len(last[0]) - 1)
            kept = (held[0][u] == user[at]) & (last[0][i] == item[at])
            at, u, i = at[kept], held[1][u[kept]], i[kept]
            for k in (slice(x, x + _CHUNK) for x in range(0, len(at), _CHUNK)):
                predicted = np.einsum("ij,ij->i", held[2][u[k]], last[1][i[k]])
                known = rows.select(["part", "rating"]).take(pa.array(at[k]))
                yield pa.record_batch([*known.columns, pa.array(predicted)], names=["part", "rating", "prediction"])
            last = tuple(x[-1:].copy() for x in last)


def predicted_ratings(rated: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """part, rating, prediction of the ratings whose customer and product both have a vector.

    Ratings are dealt into a grid of customer and product blocks, and a vector goes to the cells of its row or column
    once, so that no rating carries a vector through a shuffle. A task keeps the vectors of a cell's customers only;
    products pass by in order, and what it holds does not grow with their number.
    """
    rows = max(1, math.ceil(users.count() / CELL_KEYS))
    columns = max(1, math.ceil(rated.count() / (rows * CELL_RATINGS)))

    def block(key: str, parts: int):
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def every(parts: int):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def laid(df: DataFrame, row, column, item, rated: int, user, part, rating, features) -> DataFrame:
        # One number to sort by: the cell, then its customers, then each product before its ratings.
        cell = (row * columns + column).cast("long")
        place = F.shiftleft(cell, _CELL_BITS) + (item.cast("long") + 1) * 2 + rated
        return df.select(place.alias("place"), user.alias("user"), part.alias("part"), rating.alias("rating"), features.alias("features"))

    col, none = F.col, (F.lit(0).cast("long"), F.lit(0).cast("float"))
    mine = users.withColumn("column", every(columns))
    theirs = items.withColumn("row", every(rows))
    cells = (
        laid(mine, block("id", rows), col("column"), F.lit(-1), 0, col("id"), *none, col("features"))
        .unionByName(laid(theirs, col("row"), block("id", columns), col("id"), 0, F.lit(-1), *none, col("features")))
        .unionByName(laid(rated, block("user", rows), block("item", columns), col("item"), 1, col("user"), col("part"), col("rating"), F.lit(None).cast("array<float>")))
    )
    dealt = cells.repartitionById(rows * columns, F.shiftright("place", _CELL_BITS).cast("int")).sortWithinPartitions("place")
    return dealt.mapInArrow(_predict_cells, "part long, rating float, prediction float")


def customer_product_factors(
    tx: DataFrame, rank: int = 50, iters: int = 10, reg: float = 0.1, seed: int = fixed.SEED, blocks: int = 10
) -> Factors:
    """Alternating least squares on standardised revenue per customer and product.

    `blocks` is the least number of customer blocks and of product blocks; ratings are cut into its
    square. A task is sent every vector that its block's ratings name, so the number grows with the
    ratings and a task's vectors do not. One product's ratings stay in one block, however many they are.

    Lines are reduced to (customer, product) pairs in one pass and stored; keys, scale and
    ratings all come from the pairs. One pair in five is left for the error. Every round is
    checkpointed, which deletes the vectors that the last one sent, so the disk holds one round of them.
    """
    spark = tx.sparkSession
    r = F.col("Revenue").cast("double")
    pairs = durable(
        tx.filter(F.col("Customer_ID").isNotNull())
        .groupBy("Customer_ID", "StockCode")
        .agg(F.count(r).alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"))
    )
    mean = F.sum("s") / F.sum("n")
    spread = F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0)))
    scale = pairs.agg(F.struct(mean.alias("m"), spread.alias("d"))).scalar()
    customers, products = dense_ids(pairs, "Customer_ID", "user"), dense_ids(pairs, "StockCode", "item")
    rating = F.try_divide(ratio(F.col("s"), F.col("n")) - F.col("_s.m"), F.col("_s.d"))
    rated = durable(
        pairs.withColumn("_s", scale)
        .select(
            "Customer_ID", "StockCode",
            F.coalesce(rating, F.lit(0.0)).cast("float").alias("rating"),
            F.pmod(F.xxhash64("Customer_ID", "StockCode", F.lit(seed)), F.lit(5)).alias("part"),
        )
        .join(customers, "Customer_ID")
        .join(products, "StockCode")
    )
    train = rated.filter("part > 0")
    blocks = max(blocks, math.ceil(train.count() / BLOCK_RATINGS))
    als = ALS(
        rank=rank, maxIter=iters, regParam=reg, numUserBlocks=blocks, numItemBlocks=blocks,
        userCol="user", itemCol="item", ratingCol="rating", coldStartStrategy="drop", seed=seed,
        checkpointInterval=1, finalStorageLevel="DISK_ONLY",
    )
    model = als.fit(train)
    predicted = durable(predicted_ratings(rated, model.userFactors, model.itemFactors))
    error = {
        name: regression("rmse", "rating").evaluate(predicted.filter(where))
        for name, where in (("train_rmse", "part > 0"), ("test_rmse", "part = 0"))
    }

    def named(factors: DataFrame, ids: DataFrame, number: str, key: str) -> DataFrame:
        return factors.join(ids, factors["id"] == ids[number]).select(
            key, F.col("features").alias("embedding")
        )

    return Factors(
        named(model.userFactors, customers, "user", "Customer_ID"),
        named(model.itemFactors, products, "item", "StockCode"),
        metric_rows(spark, [("als", n, v) for n, v in error.items()]),
        model,
    )


def similar(factors: DataFrame, key: str, ids: DataFrame, n: int = 5) -> DataFrame:
    """The n keys nearest to each wanted key, the key itself left out.

    The vectors get their keys once and are stored, as are the wanted ones; the search reads both several times.
    """
    kept = durable(factors)
    wanted = durable(kept.join(ids.select(key), key, "left_semi"))
    return cosine_topk(wanted, kept, n, key, key, skip_self=True)


def similar_customers(factors: DataFrame, tx: DataFrame, busy: int = 5, n: int = 5) -> DataFrame:
    """Neighbours of the busiest customers with their transaction counts."""
    hits = similar(factors, "Customer_ID", busiest(tx, "Customer_ID", busy), n)
    counts = tx.groupBy(F.col("Customer_ID").alias("vector_id")).agg(F.count(F.lit(1)).alias("transactions"))
    return hits.join(counts, "vector_id").select(
        F.col("query_id").alias("customer_id"), F.col("vector_id").alias("similar_customer"),
        "similarity", "place", "transactions",
    )


def similar_products(
    factors: DataFrame, tx: DataFrame, names: DataFrame, busy: int = 5, n: int = 5
) -> DataFrame:
    """Neighbours of the busiest products with descriptions."""
    hits = similar(factors, "StockCode", busiest(tx, "StockCode", busy), n)
    short = names.select(F.col("StockCode").alias("vector_id"), ellipsize(F.col("Description")).alias("description"))
    return hits.join(short, "vector_id").select(
        F.col("query_id").alias("product_code"), F.col("vector_id").alias("similar_product"),
        "description", "similarity", "place",
    )
