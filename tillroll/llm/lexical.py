"""Ranked lexical search over posting lists in geometric blocks.

Documents are cut into segments. In a segment each term has its posting list, clustered into blocks of
documents with similar weighted terms; a block stores the largest value that each coordinate takes in it.
A block's summary times an item's weights is at least the score of each of its documents, so a block is
skipped only when that bound is below a score that k documents are known to reach. Lists whose largest
values together stay below it are not opened at all. Everything else is scored in full, in whole numbers.

The index is a table of segments: it holds the terms that some item of a block of items asks for, and a
summary holds the coordinates that occur together with its term in some item, since no other can matter. A hot
term is cut by segments like any other. Segments of a thousandth, then of a thirtieth of the index are searched
first, and the scores reached there are the bar for the others.

Score. A document of n terms (with repeats) has m = 100-25 + (25*n*N div L), with N documents that hold
terms and L terms in all. A term held by df of them weighs w = floor(1000*ln((2N+2)/(2df+1))), and a document
holding it tf times adds w * (10^9*tf div (1000*tf + 12*m)) for each time that the item names it.

Defined results. A null or empty text holds no term; such a document is not counted and such an item gets no
row. Only scores above 0 are listed. Equal scores go by key, nulls last; rows with repeated keys are ranked
each by itself, and so are items with repeated ids. Texts are read whole at any length. Of both tables only the
named columns are read, so other names are free.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored

#: Documents of a segment, and postings after which one is closed early.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 1 << 20
#: Segments of one task, about, when blocks are made.
TASK_SEGMENTS = 4
#: Postings of a block, about.
BLOCK = 128
#: Dimensions of the sketches by which documents are clustered.
SKETCH = 32
#: Numbers in the summaries of one segment, about; coordinates beyond share slots, whose summary is the larger one.
SUMMARY_CELLS = 16 << 20
#: Items that are searched together, and bytes of their texts.
ITEMS, ITEM_BYTES = 4096, 16 << 20
#: One segment of so many is searched in the first and in the second step.
STEPS = (1024, 32)

#: Bytes that belong to terms are kept, with A-Z lowered; all others become blanks. Bytes of non-ASCII characters are 128 and more.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

_FORWARD = "docs long, terms long, keys array<long>, lengths binary, ends binary, ids binary, tfs binary"
_INDEX = (
    "segment long, step int, keys array<long>, ends binary, ids binary, values binary, "
    "list_terms binary, list_blocks binary, block_ends binary, members binary, peaks binary"
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def search(
    docs: DataFrame, items: DataFrame, k: int, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item, rank (int, from 1), key (as long), score (long): the k best documents of every item."""
    asked = stored(
        items.select(F.col(item).alias("item"), F.coalesce(F.col(item_text).cast("binary"), F.lit(b"")).alias("text")).withColumn(
            "place", F.monotonically_increasing_id()
        )
    )
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, math.ceil(size["n"] / ITEMS), math.ceil((size["bytes"] or 0) / ITEM_BYTES))
    found = []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("place"), F.lit(blocks)) == block)
        found.append(_search_block(docs, rows, k, key, text))
    return reduce(DataFrame.unionAll, found)


def _search_block(docs: DataFrame, asked: DataFrame, k: int, key: str, text: str) -> DataFrame:
    questions = Questions([(r["place"], terms(bytes(r["text"]))) for r in asked.collect()])
    table = index(docs, questions, key, text)
    steps = sorted(r["step"] for r in table.select("step").distinct().collect())
    bars, hits = {}, []
    for step in steps:
        hits.append(stored(_best(hits_of(table.filter(F.col("step") == step), questions, bars, k), k)))
        if step != steps[-1]:
            reached = _best(reduce(DataFrame.unionAll, hits), k).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar"))
            bars = {r["place"]: r["bar"] for r in reached.filter(F.col("n") == k).collect()}
    if not hits:
        hits = [docs.sparkSession.createDataFrame([], "place long, segment long, key long, score long, rank int")]
    best = _best(reduce(DataFrame.unionAll, hits), k)
    return best.join(F.broadcast(asked.select("place", "item")), "place").select("item", "rank", "key", "score")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each item, first among those of a sixty-fourth of the segments, then among these."""
    order = (F.desc("score"), F.asc_nulls_last("key"))
    cut = Window.partitionBy("place", F.pmod(F.xxhash64("segment"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("place").orderBy(*order)
    first = hits.withColumn("rank", F.row_number().over(cut)).filter(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


class Questions:
    """A block of items: their terms as numbers, and which coordinates a term's summaries need."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        counts = [(place, Counter(words)) for place, words in items if words]
        self.places = [place for place, _ in counts]
        self.numbers = {t: i for i, t in enumerate(sorted({t for _, c in counts for t in c}))}
        self.size = len(self.numbers)
        self.width = min(self.size, max(64, SUMMARY_CELLS // max(1, self.size)))
        self.items = [
            (np.array([self.numbers[t] for t in sorted(c)], np.int64), np.array([c[t] for t in sorted(c)], np.int64)) for _, c in counts
        ]
        together = [set() for _ in range(self.size)]
        for ids, _ in self.items:
            slots = set((ids % self.width).tolist())
            for t in ids:
                together[t] |= slots
        self.slots = [np.array(sorted(s), np.int64) for s in together]


def index(docs: DataFrame, questions: Questions, key: str, text: str) -> DataFrame:
    """The stored segments, see _INDEX."""
    forward = stored(_forward(docs, questions, key, text))
    total = forward.agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms"), F.count(F.lit(1)).alias("segments")).first()
    n, length = total["docs"] or 0, total["terms"] or 0
    held = np.zeros(questions.size, np.int64)
    for r in _held(forward, questions.size).collect():
        held[r["term"]] = r["df"]
    questions.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    # Packed documents are small and their blocks much work, so files say little about the work in them.
    tasks = max(1, math.ceil(total["segments"] / TASK_SEGMENTS))
    rows = forward.withColumn("segment", F.monotonically_increasing_id()).repartition(tasks, "segment")
    place = F.xxhash64("segment")
    step = F.when(F.pmod(place, F.lit(STEPS[0])) == 0, 0).when(F.pmod(place, F.lit(STEPS[1])) == 0, 1).otherwise(2)

    def run(batches):
        sketches = np.random.default_rng(7).standard_normal((questions.size, SKETCH)).astype(np.float32)
        for batch in batches:
            for row in batch.to_pylist():
                if row["keys"]:
                    yield _row(_segment(row, questions, sketches, n, length), _INDEX)

    return stored(rows.withColumn("step", step).mapInArrow(run, _INDEX), by="step")


def _forward(docs: DataFrame, questions: Questions, key: str, text: str) -> DataFrame:
    """Packed documents: lengths of all their terms, and how often they hold each term of the questions."""
    numbers = questions.numbers

    def packed(docs, total, held):
        keys, lengths, ids, tfs = zip(*held) if held else ((), (), (), ())
        return _row(
            {
                "docs": docs, "terms": total, "keys": list(keys), "lengths": np.array(lengths, np.int64).tobytes(),
                "ends": np.cumsum([len(x) for x in ids], dtype=np.int32).tobytes(),
                "ids": b"".join(x.tobytes() for x in ids), "tfs": b"".join(x.tobytes() for x in tfs),
            },
            _FORWARD,
        )

    def run(batches):
        count = total = postings = 0
        held = []
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(raw.as_buffer().to_pybytes() if raw.is_valid else b"")
                if not words:
                    continue
                count, total = count + 1, total + len(words)
                found = Counter(map(numbers.get, words))
                found.pop(None, None)
                if found:
                    ids = np.array(sorted(found), np.int32)
                    held.append((name, len(words), ids, np.array([found[i] for i in ids.tolist()], np.int32)))
                    postings += len(ids)
                if len(held) >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                    yield packed(count, total, held)
                    count = total = postings = 0
                    held = []
        if count:
            yield packed(count, total, held)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(run, _FORWARD)


def _held(forward: DataFrame, size: int) -> DataFrame:
    """term, df: in how many documents each term of the questions is."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                df += np.bincount(np.frombuffer(ids, np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "df"])

    return forward.select("ids").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _row(row: dict, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_pylist([row], schema=pa.schema([(name, _ARROW[kind]) for name, kind in fields]))


def _segment(row: dict, questions: Questions, sketches: np.ndarray, n: int, length: int) -> dict:
    """One row of the index: forward lists with their values, and each term's blocks with their summaries."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    ends = np.frombuffer(row["ends"], np.int32).astype(np.int64)
    ids, tfs = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["tfs"], np.int32).astype(np.int64)
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(ends)), sizes)
    m = 75 + (25 * lengths * n) // length
    values = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[doc])
    near = _sketches(ids, values * questions.weights[ids], ends, sketches)
    by_term = np.lexsort((doc, ids))
    list_terms, starts = np.unique(ids[by_term], return_index=True)
    stops = np.append(starts[1:], len(by_term))
    slots, slot_of = ids % questions.width, np.full(questions.width, -1)
    list_blocks, block_sizes, members, peaks = [], [], [], []
    for t, a, b in zip(list_terms.tolist(), starts.tolist(), stops.tolist()):
        held = doc[by_term[a:b]]
        block = _clusters(near[held])
        held = held[np.argsort(block, kind="stable")]
        _, counts = np.unique(block, return_counts=True)
        wanted = questions.slots[t]
        slot_of[wanted] = np.arange(len(wanted))
        entries = _entries(held, ends, sizes)
        at = slot_of[slots[entries]]
        block_of = np.repeat(np.repeat(np.arange(len(counts)), counts), sizes[held])
        top = np.zeros((len(counts), len(wanted)), np.int32)
        seen = at >= 0
        np.maximum.at(top.ravel(), block_of[seen] * len(wanted) + at[seen], values[entries[seen]].astype(np.int32))
        slot_of[wanted] = -1
        list_blocks.append(len(counts))
        block_sizes.append(counts)
        members.append(held)
        peaks.append(top.ravel())
    return {
        "segment": row["segment"], "step": row["step"], "keys": row["keys"], "ends": ends.astype(np.int32).tobytes(), "ids": row["ids"],
        "values": values.astype(np.int32).tobytes(),
        "list_terms": list_terms.astype(np.int32).tobytes(),
        "list_blocks": np.cumsum(list_blocks, dtype=np.int32).tobytes(),
        "block_ends": np.cumsum(np.concatenate(block_sizes), dtype=np.int32).tobytes(),
        "members": np.concatenate(members).astype(np.int32).tobytes(),
        "peaks": np.concatenate(peaks).tobytes(),
    }


def _entries(held: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the forward entries of some documents, document by document."""
    out = np.repeat(ends[held] - np.cumsum(sizes[held]), sizes[held])
    return out + np.arange(len(out))


def _sketches(ids: np.ndarray, weighted: np.ndarray, ends: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Unit vectors whose products are about the cosines of the documents' weighted terms."""
    out = np.empty((len(ends), SKETCH), np.float32)
    for a in range(0, len(ends), 256):
        first, last = (ends[a - 1] if a else 0), ends[min(a + 256, len(ends)) - 1]
        rows = sketches[ids[first:last]] * weighted[first:last, None].astype(np.float32)
        out[a : a + 256] = np.add.reduceat(rows, np.concatenate([[0], ends[a : a + 255][: len(ends) - a - 1] - first]))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.float32(1e-30))


def _clusters(near: np.ndarray) -> np.ndarray:
    """The cluster of each document of a list: its nearest among evenly spaced ones of the list."""
    count = math.ceil(len(near) / BLOCK)
    if count == 1:
        return np.zeros(len(near), np.int64)
    centres = near[np.linspace(0, len(near) - 1, count).astype(int)]
    return np.unique((near @ centres.T).argmax(axis=1), return_inverse=True)[1]


def hits_of(table: DataFrame, questions: Questions, bars: dict[int, int], k: int) -> DataFrame:
    """place (of the item), segment, key, score, rank: the k best documents of each segment that may be among the k best."""
    schema = "place long, segment long, key long, score long, rank int"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment(row, questions)
                out = []
                for i, place in enumerate(questions.places):
                    found = segment.best(i, bars.get(place, 1), k)
                    out += [(place, row["segment"], segment.keys[d], score, r) for r, (score, d) in enumerate(found, 1)]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in list(zip(*out))[:4]] + [pa.array([x[4] for x in out], pa.int32())],
                        names=["place", "segment", "key", "score", "rank"],
                    )

    return table.mapInArrow(run, schema)


class Segment:
    """A row of the index, ready to be searched. `read` and `skipped` count blocks."""

    def __init__(self, row: dict, questions: Questions):
        def array(name):
            return np.frombuffer(row[name], np.int32)

        self.keys, self.questions, self.read, self.skipped = row["keys"], questions, 0, 0
        self.ends = array("ends").astype(np.int64)
        self.sizes = np.diff(self.ends, prepend=0)
        self.ids, self.values = array("ids"), array("values").astype(np.int64)
        self.members, self.block_ends = array("members"), array("block_ends").astype(np.int64)
        peaks, first, at = array("peaks"), 0, 0
        self.lists = {}
        for t, last in zip(array("list_terms").tolist(), array("list_blocks").tolist()):
            width = len(questions.slots[t])
            self.lists[t] = (first, last, peaks[at : at + (last - first) * width].reshape(last - first, width))
            first, at = last, at + (last - first) * width
        self.weights = np.zeros(questions.size, np.int64)

    def best(self, i: int, bar: int, k: int) -> list[tuple[int, int]]:
        """(score, document) of the k best that reach `bar`, best first, equal ones by key."""
        q = self.questions
        ids, repeats = q.items[i]
        weights = q.weights[ids] * repeats
        slots = ids % q.width
        lists = []
        for t, w in zip(ids.tolist(), weights.tolist()):
            if t in self.lists and w > 0:
                first, last, peaks = self.lists[t]
                tops = peaks[:, np.searchsorted(q.slots[t], slots)].astype(np.int64)
                own = int(peaks[:, np.searchsorted(q.slots[t], t % q.width)].max()) * w
                lists.append((own, t, first, tops @ weights))
        lists.sort(key=lambda x: (x[0], x[1]))
        below = np.cumsum([x[0] for x in lists])
        self.weights[ids] = weights
        seen = np.zeros(len(self.ends), bool)
        found: list[tuple[int, int]] = []
        for j in range(len(lists) - 1, -1, -1):
            if below[j] < bar:
                self.skipped += sum(len(x[3]) for x in lists[: j + 1])
                break
            _, _, first, bounds = lists[j]
            opened = np.flatnonzero(bounds >= bar) + first
            self.read, self.skipped = self.read + len(opened), self.skipped + len(bounds) - len(opened)
            if not len(opened):
                continue
            docs = np.concatenate([self.members[(self.block_ends[b - 1] if b else 0) : self.block_ends[b]] for b in opened.tolist()])
            docs = docs[~seen[docs]]
            seen[docs] = True
            scores = self._scores(docs)
            able = np.flatnonzero(scores >= bar)
            found += zip(scores[able].tolist(), docs[able].tolist())
            found.sort(key=lambda x: (-x[0], self.keys[x[1]] is None, self.keys[x[1]] or 0))
            del found[k:]
            if len(found) == k:
                bar = max(bar, found[-1][0])
        self.weights[ids] = 0
        return found

    def _scores(self, docs: np.ndarray) -> np.ndarray:
        if not len(docs):
            return np.zeros(0, np.int64)
        entries = _entries(docs, self.ends, self.sizes)
        sums = self.weights[self.ids[entries]] * self.values[entries]
        return np.add.reduceat(sums, np.cumsum(self.sizes[docs]) - self.sizes[docs])
