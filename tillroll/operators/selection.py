"""Exact quantiles of many columns and groups at once, by refining histograms.

Every double has a 64-bit key in the order of its value. A round counts, in each task, the leading bits of the
keys that still matter; the counts of a bin and those before it say in which bin each wanted rank lies, and
the next round looks into those bins only. Once few rows are left in them, a round takes all remaining
bits. So a quantile costs one to four scans of its column, and what is shuffled and sorted are counts
of bins, never a column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators import ordering

#: Bits of a round, and rows in open bins below which the next round is the last.
BITS, LAST_ROWS = 16, 100_000
#: Groups whose state the driver keeps; with more, values are range-sorted instead.
MAX_GROUPS = 10_000


def quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation: groups, `prob`, `value`. Nulls are left out, NaN is the largest."""
    return column_quantiles(df, [value], probs, groups).drop("column")


def quantile(df: DataFrame, value: str, prob: float) -> Column:
    """One exact quantile of a column, null if it holds no value."""
    found = quantiles(df, value, (prob,)).first()
    return F.lit(None if found is None else found["value"]).cast("double")


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """groups, `column`, `prob`, `value` for every column and group that holds a value."""
    spark, groups = df.sparkSession, list(groups)
    cells = [F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(columns)]
    slim = ordering.durable(df.select(*[F.col(f"`{g}`") for g in groups], *cells))
    counts = [F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(columns))]
    sized = slim.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(*counts)
    sizes = sized.limit(MAX_GROUPS + 1).collect()
    if len(sizes) > MAX_GROUPS:
        return _by_sorting(slim, columns, probs, groups)
    coded = slim.withColumn("_g", F.lit(0))
    if groups:
        codes = spark.createDataFrame(
            [(*r[: len(groups)], i) for i, r in enumerate(sizes)], f"{sized.select(*groups).schema.simpleString()[7:-1]}, _g int"
        )
        same = F.lit(True)
        for g in groups:
            same = same & slim[g].eqNullSafe(codes[g])
        coded = slim.join(F.broadcast(codes), same)
    coded = coded.select("_g", *[f"_v{i}" for i in range(len(columns))])
    wanted = {}
    for g, row in enumerate(sizes):
        for i in range(len(columns)):
            last = row[f"_n{i}"] - 1
            if last >= 0:
                places = [p * last for p in map(float, probs)]
                wanted[i, g] = sorted({int(np.floor(x)) for x in places} | {int(np.ceil(x)) for x in places})
    values = _select(coded, wanted, sum(row[f"_n{i}"] for row in sizes for i in range(len(columns))))
    rows = []
    for (i, g), _ in sorted(wanted.items()):
        last = sizes[g][f"_n{i}"] - 1
        for p in probs:
            place = float(p) * last
            low, high = values[i, g, int(np.floor(place))], values[i, g, int(np.ceil(place))]
            at = low if low == high else low + (high - low) * (place - np.floor(place))
            rows.append((*sizes[g][: len(groups)], columns[i], float(p), float(at)))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sized.select(*groups).schema.fields) if groups else ""
    return spark.createDataFrame(rows, f"{fields}column string, prob double, value double")


def keys_of(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of the doubles; both zeros are one value and all NaN the largest."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def value_of(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _select(coded: DataFrame, wanted: dict, rows: int) -> dict:
    """(column, group, rank) -> value, for ranks from 0."""
    # Per wanted rank: the key's leading bits so far, and its rank among the rows that share them.
    state = {(i, g, rank): (0, rank) for (i, g), ranks in wanted.items() for rank in ranks}
    depth = 0
    while depth < 64 and state:
        bits = 64 - depth if rows <= LAST_ROWS else min(BITS, 64 - depth)
        windows = sorted({(i, (g << depth) | prefix) for (i, g, _), (prefix, _) in state.items()})
        number = {w: n for n, w in enumerate(windows)}
        asked = [(number[i, (g << depth) | prefix], left) for (i, g, _), (prefix, left) in state.items()]
        found = {(r["window"], r["rank"]): r for r in _located(_counted(coded, windows, depth, bits), asked).collect()}
        # Bins in which a rank was found, for the rows that are left.
        bins = {(r["window"], r["bin"]): r["n"] for r in found.values()}
        rows = sum(bins.values())
        for at, (prefix, left) in list(state.items()):
            hit = found[number[at[0], (at[1] << depth) | prefix], left]
            low = hit["bin"] + (1 << 63) if bits == 64 else hit["bin"]
            state[at] = ((prefix << bits) | low, left - hit["before"])
        depth += bits
    return {at: value_of(prefix) for at, (prefix, _) in state.items()}


def _counted(coded: DataFrame, windows: list, depth: int, bits: int) -> DataFrame:
    """window, bin, n: how many keys of each open window have which next bits."""
    per_column: dict[int, list] = {}
    for n, (i, window) in enumerate(windows):
        per_column.setdefault(i, []).append((window, n))
    open_windows = {i: (np.array([w for w, _ in x], np.uint64), np.array([n for _, n in x])) for i, x in per_column.items()}

    def run(batches):
        held = _Counts()
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for i, (heads, numbers) in open_windows.items():
                column = batch.column(1 + i)
                there = ~column.is_null().to_numpy(zero_copy_only=False)
                keys = keys_of(column.drop_null().to_numpy(zero_copy_only=False))
                head = group[there] << np.uint64(depth)
                if depth:
                    head = head | (keys >> np.uint64(64 - depth))
                at = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
                hit = heads[at] == head
                low = keys[hit] if bits == 64 else (keys[hit] >> np.uint64(64 - depth - bits)) & np.uint64((1 << bits) - 1)
                held.add(numbers[at[hit]], low)
        if held.size:
            window, low, n = held.merged()
            signed = (low ^ np.uint64(1 << 63)).view(np.int64) if bits == 64 else low.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(window.astype(np.int32)), pa.array(signed), pa.array(n)], names=["window", "bin", "n"])

    parts = coded.mapInArrow(run, "window int, bin long, n long")
    return parts.groupBy("window", "bin").agg(F.sum("n").alias("n"))


class _Counts:
    """Counts of (window, bits) pairs of one task; pairs that occur again are joined now and then."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, window: np.ndarray, low: np.ndarray, n: np.ndarray | None = None) -> None:
        if not len(window):
            return
        order = np.lexsort((low, window))
        window, low = window[order], low[order]
        first = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (low[1:] != low[:-1])]))
        counts = np.add.reduceat(np.ones(len(window), np.int64) if n is None else n[order], first)
        self.parts.append((window[first], low[first], counts))
        self.size += len(first)
        if n is None and self.size > 1_000_000 and len(self.parts) > 1:
            self.merged()

    def merged(self):
        whole = [np.concatenate(x) for x in zip(*self.parts)]
        self.parts, self.size = [], 0
        self.add(*whole)
        return self.parts[0]


def _located(counted: DataFrame, asked: list[tuple[int, int]]) -> DataFrame:
    """window, rank, bin, n, before: the bin of each asked rank, and how many rows of its window lie before it.

    A window has at most as many bins as a round has, so its running sum is bounded.
    """
    spark = counted.sparkSession
    run = Window.partitionBy("window").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counted.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
    ranks = spark.createDataFrame(sorted(set(asked)), "window int, rank long")
    return (
        ends.join(F.broadcast(ranks), "window")
        .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("upto")))
        .select("window", "rank", "bin", "n", "before")
    )


def _by_sorting(slim: DataFrame, columns: Sequence[str], probs: Sequence[float], groups: list[str]) -> DataFrame:
    out = None
    for i, c in enumerate(columns):
        part = ordering.quantiles(slim, f"_v{i}", probs, groups).withColumn("column", F.lit(c)).select(*groups, "column", "prob", "value")
        out = part if out is None else out.unionAll(part)
    return out
