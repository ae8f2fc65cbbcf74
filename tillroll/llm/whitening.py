"""Whitening of vectors by shifted CholeskyQR.

Every vector becomes a row of longs x. One pass sums them. Then Gram passes orthogonalise the
centred rows: a pass adds up the products of the rows it sees, its Cholesky factor R makes the rows
of the next pass through triangular solves, and the first factor is shifted so that it exists for any
spread of the columns. The composed factors have the singular values and right vectors of the whole
centred table, which are the components. A last pass measures how white the result is.

No pass shuffles a row: a task sends one d x d triangle, and Spark adds these up entry by entry. The
driver holds d x d numbers, so d is meant to be at most some thousands.

Defined results. Vectors that are null or empty, hold a null or non-finite entry, or an entry without
a long x take no part. If vectors differ in length, those of the most frequent length do (of several,
the longest). Rows with a null key and repeated rows count and come back like any other. Components
without variance cannot be whitened and are left out, so equal vectors, one vector or an empty table
give no component and `transform` gives no row. `deviation` is null where it exceeds a long. Of the
table's other columns none is read, so their names are free.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored

#: x = floor(SCALE * entry) + ORIGIN
SCALE, ORIGIN = 64, 1_000_000
#: Entries as large as this have no long x.
_LARGEST = 2.0**61
#: Rows that are centred and solved at a time.
_BLOCK = 4096
#: Gram passes after the shifted one, at most. Two are enough unless columns depend on each other.
_PASSES = 4


@dataclass
class Whitening:
    """n rows of `size` entries; x - S/n is (x - floor) - rest/n; one component per column of `vectors`."""

    n: int
    size: int
    floor: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, vector: str, components: int = 32) -> Whitening | None:
    """The first components of all vectors that take part; None where there is none to be had."""
    plain = rows.select(_doubles(vector))
    sums = _sums(plain)
    if sums is None:
        return None
    n, size, floor, rest = sums
    factors, total = [], np.zeros(size)
    for k in range(1 + _PASSES):
        gram, added = _gram(plain, Centred(n, size, floor, rest, factors))
        if k == 0:
            total = added
        factor = _factor(gram, n if k == 0 else 0)
        if factor is None:
            return None
        factors.append(factor)
        if k > 1 and np.abs(gram - np.eye(size)).max() < 64 * size * np.finfo(float).eps:
            break
    whole = factors[0]
    for factor in factors[1:]:
        whole = factor @ whole
    _, spread, turned = np.linalg.svd(whole)
    kept = int((spread > spread[0] * 16 * size * np.finfo(float).eps).sum())
    vectors = turned[: min(kept, components)].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    found = Whitening(n, size, floor, rest, (spread**2 / n)[: vectors.shape[1]], vectors, float((spread**2).sum() / n), 0.0)
    white = Centred(n, size, floor, rest, [], found.projection())
    white.mean = white.projection.T @ (total / n)
    gram, _ = _gram(plain, white)
    found.identity_error = float(np.abs(gram / n - np.eye(len(gram))).max())
    return found


def transform(rows: DataFrame, key: str, vector: str, model: Whitening | None) -> DataFrame:
    """key, deviation (sum of the squares of n*x - S), whitened (an array, one number per component)."""
    schema = f"key {rows.schema[key].dataType.simpleString()}, deviation long, whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    white = Centred(model.n, model.size, model.floor, model.rest, [], model.projection())
    n, rest = model.n, model.rest

    def run(batches):
        for batch in batches:
            for at, x in _longs(batch.column(1), white.size):
                out = white(x)
                flat = pa.array(out.ravel())
                ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), _deviations(x - white.floor, n, rest), pa.ListArray.from_arrays(ends, flat)],
                    names=["key", "deviation", "whitened"],
                )

    return rows.select(F.col(key).alias("key"), _doubles(vector)).mapInArrow(run, schema)


def _doubles(vector: str):
    return F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")


class Centred:
    """Maps rows of longs to centred rows, solved by every factor so far, then projected."""

    def __init__(self, n, size, floor, rest, factors, projection=None):
        self.n, self.size, self.floor, self.rest = n, size, floor, rest
        self.factors, self.projection, self.mean = list(factors), projection, 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rows = (x - self.floor) - self.rest / self.n
        for factor in self.factors:
            solve_rows(rows, factor)
        return rows if self.projection is None else rows @ self.projection - self.mean


def solve_rows(rows: np.ndarray, factor: np.ndarray) -> None:
    """Each row y becomes the z with z R = y, for an upper triangular R."""
    for j in range(len(factor)):
        rows[:, j] = (rows[:, j] - rows[:, :j] @ factor[:j, j]) / factor[j, j]


def _longs(column, size: int | None):
    """(places, matrix of x) of the rows that take part, per length; of one length if it is given."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    starts = np.cumsum(np.concatenate([[0], lengths]))[:-1]
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    for length in np.unique(lengths[lengths > 0]) if size is None else [size]:
        for at in np.array_split(found := np.flatnonzero(lengths == length), max(1, -(-len(found) // _BLOCK))):
            values = np.floor(flat[starts[at][:, None] + np.arange(length)] * SCALE)
            fit_in = (np.abs(values) < _LARGEST).all(axis=1)
            if fit_in.any():
                yield at[fit_in], values[fit_in].astype(np.int64) + ORIGIN


def _deviations(x: np.ndarray, n: int, rest: np.ndarray) -> pa.Array:
    """Sums of the squares of n*x - rest over the entries of each row, as longs where they fit."""
    largest = n * int(np.abs(x).max()) + n
    if largest**2 * x.shape[1] < 2**63:
        return pa.array(((n * x - rest.astype(np.int64)) ** 2).sum(axis=1))
    whole = [int(s) for s in rest]
    sums = [sum((n * int(v) - s) ** 2 for v, s in zip(row, whole)) for row in x]
    return pa.array([s if s < 2**63 else None for s in sums], pa.int64())


def _sums(plain: DataFrame):
    """n, length, floor(S/n) and S - n*floor(S/n) of the vectors that take part.

    A long is summed as two halves, so that no sum of longs overflows in a task.
    """

    def run(batches):
        sums = {}
        for batch in batches:
            for _, x in _longs(batch.column(0), None):
                halves = np.stack([x >> 32, x & 0xFFFFFFFF]).sum(axis=1)
                n, so_far = sums.get(x.shape[1], (0, 0))
                sums[x.shape[1]] = (n + len(x), so_far + halves)
        for length, (n, (high, low)) in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"length": [length] * length, "entry": list(range(length)), "n": [n] * length, "high": high.tolist(), "low": low.tolist()},
                schema=pa.schema([("length", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())]),
            )

    parts = plain.mapInArrow(run, "length int, entry int, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    added = stored(parts.groupBy("length", "entry").agg(*wide))
    top = added.filter("entry = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if top is None:
        return None
    found = added.filter(F.col("length") == top["length"]).orderBy("entry").collect()
    n = int(top["n"])
    sums = [(int(r["high"]) << 32) + int(r["low"]) for r in found]
    return n, len(sums), np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], float)


def _gram(plain: DataFrame, mapped: Centred) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the products of mapped rows with themselves, and the sum of the rows."""

    def run(batches):
        gram = added = None
        for batch in batches:
            for _, x in _longs(batch.column(0), mapped.size):
                rows = mapped(x)
                gram = rows.T @ rows + (0 if gram is None else gram)
                added = rows.sum(axis=0) + (0 if added is None else added)
        if gram is not None:
            for i, row in enumerate(gram):
                yield pa.RecordBatch.from_pydict({"i": [i], "row": [row[i:].tolist() + [added[i]]]}, schema=out)

    out = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])
    parts = plain.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))
    cells = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    size = int(cells["i"].max()) + 1
    whole = np.zeros((size, size + 1))
    whole[cells["i"], cells["i"] + cells["j"]] = cells["value"]
    upper = whole[:, :size]
    return upper + np.triu(upper, 1).T, whole[:, size]


def _factor(gram: np.ndarray, rows: int) -> np.ndarray | None:
    """The upper Cholesky factor of the products; None if they are all zero.

    The first pass (`rows` given) is shifted by a bound of the rounding of the products. Later ones are shifted
    only if columns depend on each other, by as little as lets the factor exist.
    """
    size, norm = len(gram), float(np.trace(gram))
    if norm <= 0:
        return None
    unit = np.finfo(float).eps / 2
    shift = 11.0 * (size * min(rows, _BLOCK) + size * (size + 1)) * unit * norm if rows else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, size * unit * norm)
