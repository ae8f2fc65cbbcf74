"""Scores of texts under a hierarchical Pitman-Yor language model.

One restaurant for all words (the root, over a uniform base of the known words and one unknown)
is the parent of one restaurant per context, which is any preceding word (or the start of a
document), however rare. Tables of a context are customers of the root. How many tables serve a
word in a restaurant is sampled by Gibbs sweeps: the customers
of a (context, word) pair get up and are seated anew one after the other, given the totals of
all restaurants after the sweep before. Predictive probabilities are averaged over sweeps.

How it runs: texts become packets, bounded runs of documents with a vocabulary of their own. A
packet counts its words and (context, word) pairs and asks for the words in one row per range of word
hashes, for the pairs in one row per cell: the pairs of a frequent word are dealt to all cells, those of any other
word lie in the cell of its hash. Pairs that occur once have one table for
ever; only the others take part in sweeps. Since the customers of a context or a word are its
count, a cell need only tell the ranges by how many tables its pairs fall short of that. A sweep is one
exchange: ranges send cells the root probabilities and tables of their words, cells seat their pairs
and send the shortfalls back. All that moves is packed columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored
from tillroll.llm.words import mix, word_hashes

#: Tokens of a packet (more only if one document has more) and words of a range or pairs of a cell, about.
PACKET_TOKENS, RANGE_ENTRIES = 4_000_000, 1_000_000
#: Stands for the end of a document among word hashes.
END = np.uint64(0x9D39247E33776D41)
_PACKETS = "packet long, tokens long, words long, train_tokens long, lengths binary, train binary, vocabulary binary, stream binary"


def _pack(x: np.ndarray, kind: str) -> bytes:
    """The numbers byte by byte, all lowest bytes first, compressed."""
    if not len(x):
        return bytes(8)
    planes = np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(blob[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _pack_hashes(x: np.ndarray) -> bytes:
    """Hashes in long ascending runs, by their distances."""
    return _pack(np.diff(x, prepend=np.uint64(0)), "<u8")


def _unpack_hashes(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, "<u8"), dtype=np.uint64)


def _joined(arrays: list, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _runs(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct number begins, and how often it occurs."""
    starts = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(ascending) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(ascending)))


def _rows(schema: str, columns: list) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.table({name: pa.array(list(x), kinds[kind]) for (name, kind), x in zip(fields, columns)})


def _mapped(df: DataFrame, schema: str, row_to_rows) -> DataFrame:
    """The rows that `row_to_rows` yields (tuples) for each row of `df`, given by its values."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(row_to_rows(*(batch.column(j)[i].as_py() for j in range(batch.num_columns))))
                if rows:
                    yield from _rows(schema, list(zip(*rows))).to_batches()

    return df.mapInArrow(run, schema)


def _packets(docs: DataFrame, kind: str) -> DataFrame:
    """packet, keys, sizes, and packed: tokens and training flag per document, vocabulary (frequent words first), stream of places in it."""

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            tokens = np.concatenate([x for _, _, x in held])
            lengths = np.array([len(x) for _, _, x in held], np.int64)
            train = np.array([x for _, x, _ in held], np.uint8)
            vocabulary, stream, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # small numbers for frequent words compress well
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            vocabulary, stream = vocabulary[order], rank[stream]
            sizes = ((part << 24) + number, len(stream), len(vocabulary), int(lengths[train > 0].sum()))
            blobs = (_pack(lengths, "<i8"), _pack(train, "u1"), _pack_hashes(vocabulary), _pack(stream, "<i4"))
            return pa.RecordBatch.from_arrays(
                [*(pa.array([x]) for x in sizes), *(pa.array([x], pa.binary()) for x in blobs),
                 pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays([x for x, _, _ in held]))],
                names=[*(x.split()[0] for x in _PACKETS.split(", ")), "keys"],
            )

        for batch in batches:
            for i, (train, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                words = np.append(word_hashes(text), END)
                held.append((batch.column(0).slice(i, 1), bool(train), words))
                size += len(words)
                if size >= PACKET_TOKENS:
                    yield flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, f"{_PACKETS}, keys array<{kind}>")


_BLOBS = ("lengths", "train", "vocabulary", "stream")


class _Packet:
    """A packet's columns, its words ascending. `before` is the place of the word before each token; the end stands before a document."""

    def __init__(self, lengths, train, vocabulary, stream):
        self.lengths, self.words = _unpack(lengths, "<i8"), _unpack_hashes(vocabulary)
        order = np.argsort(self.words)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.words, self.stream = self.words[order], place[_unpack(stream, "<i4")]
        self.train = np.repeat(_unpack(train, "u1"), self.lengths) > 0
        self.before = np.concatenate([[np.searchsorted(self.words, END)], self.stream[:-1]]).astype(np.int32)

    def pairs(self, plan: tuple):
        """The distinct pairs by cell, word and context (cell, word, context), and the token's pair or -1.

        `plan` has the words that have a restaurant (None: all), the words whose pairs lie in all cells, and the
        bits of a cell's number.
        """
        contexts, frequent, bits = plan
        inside = None if contexts is None else np.isin(self.words, contexts)[self.before]
        key = self.stream.astype(np.int64) * len(self.words) + self.before
        if inside is not None:
            key = key[inside]
        by = np.argsort(key)
        key = key[by]
        starts, _ = _runs(key)
        word, context = (x.astype(np.int32) for x in np.divmod(key[starts], len(self.words)))
        del key
        new = np.zeros(len(by), bool)
        new[starts] = True
        place = np.empty(len(by), np.int32)
        place[by] = np.cumsum(new, dtype=np.int32) - 1
        del by, new
        cell = _top(self.words, bits).astype(np.int32)[word]
        spread = np.isin(self.words, frequent)[word]
        cell[spread] = _top(mix(self.words[word[spread]] ^ mix(self.words[context[spread]])), bits)
        order = np.argsort(cell, kind="stable").astype(np.int32)
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        if inside is None:
            pair = at[place]
        else:
            pair = np.full(len(self.stream), -1, np.int32)
            pair[inside] = at[place]
        return cell[order], word[order], context[order], pair


def _contexts(packets: DataFrame, tokens: int, share: float) -> np.ndarray:
    """Hashes of the words with `share` of all training tokens."""

    def run(*blobs):
        p = _Packet(*blobs)
        count = np.bincount(p.stream[p.train], minlength=len(p.words))
        return zip(p.words[count > 0].view(np.int64).tolist(), count[count > 0].tolist())

    rows = _mapped(packets.select(*_BLOBS), "word long, n long", run)
    found = rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(1.0, share * tokens)).collect()
    return np.array([r["word"] for r in found], np.int64).view(np.uint64)


def _frequent(packets: DataFrame, tokens: int, share: float) -> np.ndarray:
    """Hashes of the words with `share` of all `tokens`, and maybe some with three quarters of it.

    It only says where pairs are kept; a packet's counts under a quarter of the share are left out.
    """

    def run(*blobs):
        p = _Packet(*blobs)
        count = np.bincount(p.stream, minlength=len(p.words))
        often = count >= share / 4 * len(p.stream)
        return zip(p.words[often].view(np.int64).tolist(), count[often].tolist())

    rows = _mapped(packets.select(*_BLOBS), "word long, n long", run)
    found = rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= 0.75 * share * tokens).collect()
    return np.array([r["word"] for r in found], np.int64).view(np.uint64)


#: What is sent to a range or a cell: senders of kind 0 are packets, 1 and 2 cells with words and contexts.
_WORDS = "range int, kind int, sender long, words binary, count binary"


def _asked_words(packets: DataFrame, bits: int) -> DataFrame:
    """Per packet and range: its words and their training counts."""

    def run(number, *blobs):
        p = _Packet(*blobs)
        count = np.bincount(p.stream[p.train], minlength=len(p.words))
        to = _top(p.words, bits)
        for a, n in zip(*_runs(to)):
            yield int(to[a]), 0, number, _pack_hashes(p.words[a : a + n]), _pack(count[a : a + n], "<i4")

    return _mapped(packets.select("packet", *_BLOBS), _WORDS, run)


_PAIRS = "cell int, packet long, words binary, fanout binary, contexts binary, context binary, count binary"


def _asked_pairs(packets: DataFrame, plan: tuple) -> DataFrame:
    """Per packet and cell: words and contexts, and the pairs by them with their training counts."""

    def run(number, *blobs):
        p = _Packet(*blobs)
        cell, word, context, pair = p.pairs(plan)
        count = np.bincount(pair[p.train & (pair >= 0)], minlength=len(cell))
        for a, n in zip(*_runs(cell)):
            starts, fanout = _runs(word[a : a + n])
            seen, place = np.unique(context[a : a + n], return_inverse=True)
            yield (int(cell[a]), number, _pack_hashes(p.words[word[a : a + n][starts]]), _pack(fanout, "<i4"),
                   _pack_hashes(p.words[seen]), _pack(place, "<i4"), _pack(count[a : a + n], "<i4"))

    return _mapped(packets.select("packet", *_BLOBS), _PAIRS, run)


_CELLS = (
    "cell int, once long, twice long, words binary, contexts binary, word binary, context binary, customers binary, "
    "packets binary, sizes binary, places binary"
)


def _cells(asked: DataFrame) -> DataFrame:
    """Per cell its pairs of two or more customers, and for each packet the numbers of the pairs it asked for.

    Number 0 stands for a pair without customers, 1 for any with one, 2 for the first of the others.
    """

    def run(key, group):
        group = group.sort_by("packet")
        get = {n: group.column(n).to_pylist() for n in group.column_names}
        words, contexts = ([_unpack_hashes(x) for x in get[n]] for n in ("words", "contexts"))
        fanout = _joined([_unpack(x, "<i4") for x in get["fanout"]], np.int32)
        inner = [_unpack(x, "<i4") for x in get["context"]]
        known_words, word = np.unique(np.concatenate(words), return_inverse=True)
        known_contexts, context = np.unique(np.concatenate(contexts), return_inverse=True)
        starts = np.cumsum([0, *(len(x) for x in contexts)])
        context = context[np.concatenate([x + np.int64(a) for x, a in zip(inner, starts)])]
        distinct, place = np.unique(np.repeat(word.astype(np.int64), fanout) * len(known_contexts) + context, return_inverse=True)
        count = np.bincount(place, np.concatenate([_unpack(x, "<i4") for x in get["count"]])).astype(np.int64)
        many = count > 1
        number = np.where(many, np.cumsum(many) + 1, count)
        some_words, word = np.unique(distinct[many] // len(known_contexts), return_inverse=True)
        some_contexts, context = np.unique(distinct[many] % len(known_contexts), return_inverse=True)
        return _rows(_CELLS, [[x] for x in (
            key[0].as_py(), int((count == 1).sum()), int((count == 2).sum()), _pack_hashes(known_words[some_words]),
            _pack_hashes(known_contexts[some_contexts]), _pack(word, "<i4"), _pack(context, "<i4"), _pack(count[many], "<i8"),
            _pack(np.array(get["packet"]), "<i8"), _pack(np.array([len(x) for x in inner]), "<i8"), _pack(number[place], "<i4"),
        )])

    return asked.groupBy("cell").applyInArrow(run, _CELLS)


def _cell_words(cells: DataFrame, bits: int) -> DataFrame:
    """Per cell and range: the words, and the contexts, of the cell's pairs."""

    def run(number, *blobs):
        for kind, blob in enumerate(blobs, 1):
            hashes = _unpack_hashes(blob)
            to = _top(hashes, bits)
            for a, n in zip(*_runs(to)):
                yield int(to[a]), kind, number, _pack_hashes(hashes[a : a + n]), _pack(np.zeros(0), "<i4")

    return _mapped(cells.select("cell", "words", "contexts"), _WORDS, run)


_RANGES = (
    "range int, count binary, packets binary, packet_sizes binary, packet_places binary, kinds binary, cells binary, sizes binary, places binary"
)


def _ranges(asked: DataFrame) -> DataFrame:
    """Per range the counts of its words over all packets, and for each packet and cell the places of the words it named."""

    def run(key, group):
        group = group.sort_by([("kind", "ascending"), ("sender", "ascending")])
        kind, sender = (np.asarray(group.column(n)) for n in ("kind", "sender"))
        words = [_unpack_hashes(x) for x in group.column("words").to_pylist()]
        sizes = np.array([len(x) for x in words])
        few = int((kind == 0).sum())
        distinct, place = np.unique(np.concatenate(words[:few]), return_inverse=True)
        count = np.bincount(place, np.concatenate([_unpack(x, "<i4") for x in group.column("count").to_pylist()[:few]]), len(distinct))
        named = np.searchsorted(distinct, _joined(words[few:], np.uint64))
        return _rows(_RANGES, [[x] for x in (
            key[0].as_py(), _pack(count, "<i8"), _pack(sender[:few], "<i8"), _pack(sizes[:few], "<i8"), _pack(place, "<i4"),
            _pack(kind[few:], "<i4"), _pack(sender[few:], "<i8"), _pack(sizes[few:], "<i8"), _pack(named, "<i4"),
        )])

    return asked.groupBy("range").applyInArrow(run, _RANGES)


def _seat(random, customers, base, total, strength: float, discount: float) -> np.ndarray:
    """Tables of each dish after its customers were seated one after the other.

    `base` is the parent's probability of the dish, `total` the tables of its restaurant other
    than its own. The first customer opens a table. Once a dish has n customers seated, the next
    n / 8 are seated in one draw with the chance of the first of them.
    """
    order = np.argsort(-customers, kind="stable")
    c, b, other = customers[order], base[order], total[order]
    tables, seated = (c > 0).astype(np.float64), 1
    while True:
        active = int(np.searchsorted(-c, -seated, side="left"))  # dishes with more than `seated` customers
        if not active:
            break
        step = np.minimum(max(1, seated // 8), c[:active] - seated)
        new = (strength + discount * (other[:active] + tables[:active])) * b[:active]
        old = seated - discount * tables[:active]
        tables[:active] += random.binomial(step, new / (new + old))
        seated += max(1, seated // 8)
    out = np.empty(len(c))
    out[order] = tables
    return out


#: What cells and ranges send each other, in the order in which the words were named.
_SENT = "to int, kind int, sender long, numbers binary"
_SEATS = "cell int, word_to binary, word_sizes binary, context_to binary, context_sizes binary, word binary, context binary, customers binary, tables binary, held binary"


def _seats(cells: DataFrame, bits: int) -> DataFrame:
    """Per cell its pairs with one table each, and how many of its words and contexts lie in which range."""

    def run(number, words, contexts, word, context, customers):
        links = []
        for blob in (words, contexts):
            to = _top(_unpack_hashes(blob), bits)
            starts, sizes = _runs(to)
            links += [_pack(to[starts], "<i4"), _pack(sizes, "<i4")]
        n = len(_unpack(customers, "<i8"))
        yield number, *links, word, context, customers, _pack(np.ones(n), "<i8"), _pack(np.zeros(n), "<i8")

    return _mapped(cells.select("cell", "words", "contexts", "word", "context", "customers"), _SEATS, run)


def _shortfalls(seats: DataFrame) -> DataFrame:
    """From cells to ranges: customers less tables of the cell's pairs, by word (kind 1) and by context (kind 2)."""

    def run(number, word_to, word_sizes, context_to, context_sizes, word, context, customers, tables, held):
        less = _unpack(customers, "<i8") - _unpack(tables, "<i8")
        for kind, to, sizes, place in ((1, word_to, word_sizes, word), (2, context_to, context_sizes, context)):
            sizes = _unpack(sizes, "<i4")
            sums = np.bincount(_unpack(place, "<i4"), less, int(sizes.sum()))
            ends = np.cumsum(sizes)
            for r, a, b in zip(_unpack(to, "<i4").tolist(), ends - sizes, ends):
                yield r, kind, number, _pack(sums[a:b], "<i8")

    return _mapped(seats, _SENT, run)


_STATE = (
    "range int, count binary, kinds binary, cells binary, sizes binary, places binary, root binary, root_tables binary, context_tables binary, "
    "kept array<binary>, root_sum long, tables_sum long, types long, root_once long, root_twice long"
)


def _state(ranges: DataFrame, sent: DataFrame, setup: dict, totals: dict | None, turn: int, keep: bool) -> DataFrame:
    """Per range the customers and tables of the root and the tables of the contexts after a sweep of the cells.

    `totals` are those before the sweep, None at the start, where each word of the root has one table.
    With `keep` the state is added to those that the answers are averaged over.
    """
    names = [x.split(" ")[0] for x in _STATE.split(", ")]

    def run(group: pa.Table, sent: pa.Table) -> pa.Table:
        row = {n: group.column(n)[0].as_py() for n in group.column_names}
        count, places = _unpack(row["count"], "<i8"), _unpack(row["places"], "<i4")
        kinds = np.repeat(_unpack(row["kinds"], "<i4"), _unpack(row["sizes"], "<i8"))
        sent = sent.sort_by([("kind", "ascending"), ("sender", "ascending")])
        less = _joined([_unpack(x, "<i8") for x in sent.column("numbers").to_pylist()], np.int64)
        root, context_tables = (count - np.bincount(places[kinds == k], less[kinds == k], len(count)).astype(np.int64) for k in (1, 2))
        if totals is None:
            tables = (root > 0).astype(np.int64)
        else:
            random = np.random.default_rng([setup["seed"], turn, row["range"], 1])
            other = totals["root_tables"] - _unpack(row["root_tables"], "<i8")
            tables = _seat(random, root, np.full(len(root), setup["base"]), other, setup["strength"], setup["root_discount"])
        new = [_pack(x, "<i8") for x in (root, tables, context_tables)]
        row |= dict(zip(("root", "root_tables", "context_tables"), new))
        row["kept"] = (row.get("kept") or []) + (new if keep else [])
        row |= {"root_sum": int(root.sum()), "tables_sum": int(tables.sum()), "types": int((count > 0).sum()),
                "root_once": int((root == 1).sum()), "root_twice": int((root == 2).sum())}
        return _rows(_STATE, [[row[n]] for n in names])

    return ranges.groupBy("range").cogroup(sent.groupBy("to")).applyInArrow(run, _STATE)


def _totals(state: DataFrame) -> dict:
    names = {"root_sum": "root", "tables_sum": "root_tables", "types": "types", "root_once": "root_once", "root_twice": "root_twice"}
    row = state.agg(*(F.sum(a).alias(b) for a, b in names.items())).first()
    return {n: row[n] or 0 for n in names.values()}


def _root_probability(root: np.ndarray, tables: np.ndarray, totals: dict, setup: dict) -> np.ndarray:
    s, d = setup["strength"], setup["root_discount"]
    return (root - d * tables + (s + d * totals["root_tables"]) * setup["base"]) / (s + totals["root"])


def _told(state: DataFrame, setup: dict, totals: dict) -> DataFrame:
    """From ranges to cells: root probabilities of the cell's words (kind 1), tables of its contexts (kind 2)."""

    def run(number, kinds, cells, sizes, places, root, root_tables, context_tables):
        parent = _root_probability(_unpack(root, "<i8"), _unpack(root_tables, "<i8"), totals, setup)
        tables = _unpack(context_tables, "<i8")
        places, sizes = _unpack(places, "<i4"), _unpack(sizes, "<i8")
        ends = np.cumsum(sizes)
        for kind, cell, a, b in zip(_unpack(kinds, "<i4").tolist(), _unpack(cells, "<i8").tolist(), ends - sizes, ends):
            at = places[a:b]
            yield cell, kind, number, _pack(parent[at], "<f4") if kind == 1 else _pack(tables[at], "<i8")

    return _mapped(state.select("range", "kinds", "cells", "sizes", "places", "root", "root_tables", "context_tables"), _SENT, run)


def _seated(seats: DataFrame, told: DataFrame, setup: dict, turn: int, keep: bool) -> DataFrame:
    """The cells after their pairs were seated anew; with `keep` the tables are added to `held`."""
    names = [x.split(" ")[0] for x in _SEATS.split(", ")]

    def run(group: pa.Table, told: pa.Table) -> pa.Table:
        row = {n: group.column(n)[0].as_py() for n in names}
        told = told.sort_by([("kind", "ascending"), ("sender", "ascending")])
        kinds, numbers = told.column("kind").to_pylist(), told.column("numbers").to_pylist()
        parent = _joined([_unpack(x, "<f4") for k, x in zip(kinds, numbers) if k == 1], np.float64)
        whole = _joined([_unpack(x, "<i8") for k, x in zip(kinds, numbers) if k == 2], np.int64)
        tables = _unpack(row["tables"], "<i8")
        other = whole[_unpack(row["context"], "<i4")] - tables
        random = np.random.default_rng([setup["seed"], turn, row["cell"]])
        tables = _seat(random, _unpack(row["customers"], "<i8"), parent[_unpack(row["word"], "<i4")], other, setup["strength"], setup["discount"])
        row["tables"] = _pack(tables, "<i8")
        if keep:
            row["held"] = _pack(_unpack(row["held"], "<i8") + tables.astype(np.int64), "<i8")
        return _rows(_SEATS, [[row[n]] for n in names])

    return seats.groupBy("cell").cogroup(told.groupBy("to")).applyInArrow(run, _SEATS)


#: Kind 0: counts of words, then for each kept sweep what customers and tables of the root and tables of the context lack of that.
#: Kind 1: customers of pairs, and their tables summed over the kept sweeps less one for each sweep.
_ANSWERS = "packet long, kind int, sender int, numbers array<binary>"


def _word_answers(ranges: DataFrame, state: DataFrame) -> DataFrame:
    """Per packet and range, in the order asked."""

    def run(number, count, kept, packets, sizes, places):
        count = _unpack(count, "<i8")
        # Customers and tables differ little from the count: most numbers sent are zero.
        kept = [count - _unpack(x, "<i8") for x in kept]
        places, sizes = _unpack(places, "<i4"), _unpack(sizes, "<i8")
        ends = np.cumsum(sizes)
        for packet, a, b in zip(_unpack(packets, "<i8").tolist(), ends - sizes, ends):
            at = places[a:b]
            yield packet, 0, number, [_pack(x[at], "<i8") for x in (count, *kept)]

    links = ranges.select("range", "packets", "packet_sizes", "packet_places")
    return _mapped(state.select("range", "count", "kept").join(links, "range"), _ANSWERS, run)


def _pair_answers(cells: DataFrame, seats: DataFrame, samples: int) -> DataFrame:
    """Per packet and cell, in the order asked."""

    def run(number, customers, held, packets, sizes, places):
        customers = np.concatenate([[0, 1], _unpack(customers, "<i8")])
        more = np.concatenate([[0, 0], _unpack(held, "<i8") - samples])
        places, sizes = _unpack(places, "<i4"), _unpack(sizes, "<i8")
        ends = np.cumsum(sizes)
        for packet, a, b in zip(_unpack(packets, "<i8").tolist(), ends - sizes, ends):
            yield packet, 1, number, [_pack(x[places[a:b]], "<i8") for x in (customers, more)]

    links = cells.select("cell", "packets", "sizes", "places")
    return _mapped(seats.select("cell", "customers", "held").join(links, "cell"), _ANSWERS, run)


def _log_probabilities(p: _Packet, answers: pa.Table, plan: tuple, setup: dict, history: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of the packet's words, and log10 of the probability of each token. `history` holds the kept sweeps' totals."""
    answers = answers.sort_by([("kind", "ascending"), ("sender", "ascending")])
    kinds, got = answers.column("kind").to_pylist(), answers.column("numbers").to_pylist()

    def numbers(kind: int, i: int) -> np.ndarray:
        return _joined([_unpack(x[i], "<i8") for k, x in zip(kinds, got) if k == kind], np.int64)

    count = numbers(0, 0)
    _, word, context, pair = p.pairs(plan)
    s, d = setup["strength"], setup["discount"]
    root, customers = np.zeros(len(count)), numbers(1, 0)
    value = customers - d * (numbers(1, 1) / len(history) + (customers > 0))
    del customers
    for i, totals in enumerate(history):
        parent = _root_probability(count - numbers(0, 1 + 3 * i), count - numbers(0, 2 + 3 * i), totals, setup)
        weight = s + d * (count - numbers(0, 3 + 3 * i))
        root += parent / len(history)
        value += weight[context] * parent[word] / len(history)
    value = np.log10(value / (s + count)[context])
    del word, context
    log = value[pair] if len(value) else np.zeros(len(pair))
    apart = pair < 0
    if apart.any():
        log[apart] = np.log10(root)[p.stream[apart]]
    return count, log


def score(
    docs: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    context_share: float = 0.0,
    sweeps: int = 3,
    burn: int = 1,
    strength: float = 1.0,
    seed: int = 5,
) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score per row of `docs`.

    The model learns from the rows that meet `learn`. Tokens are the words in small letters (A to Z only) and
    one end per document, so a null or empty text has one token. `base_score` sums log10 of
    (count + 0.5) / (N + 0.5 (V + 1)); `score` sums log10 of the model's probabilities, a word without training
    count being the one unknown word of the base. Every word is a context; a caller may give a `context_share` of all
    training tokens below which a word has no restaurant, tokens after it being customers of the root. Discounts are estimated from the numbers of
    pairs and words seen once and twice; `strength` is the concentration of every restaurant.
    Repeated rows count and are scored each; an empty table gives no rows. Without any training
    row the base is all there is.
    """
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("_key"), F.coalesce(learn, F.lit(False)).alias("_train"), F.col(text).alias("_text"))
    packets = stored(_packets(slim, kind))
    size = packets.agg(F.sum("train_tokens").alias("n"), F.sum("words").alias("words"), F.sum("tokens").alias("all")).first()
    tokens = size["n"] or 0
    contexts = _contexts(packets, tokens, context_share) if context_share > 0 else None
    bits = min(20, round(math.log2(max(1.0, (size["words"] or 0) / RANGE_ENTRIES))))
    # Packets ask for half as many pairs as they have tokens, about. No word fills more than an eighth of a cell.
    cell_bits = min(20, round(math.log2(max(1.0, 0.5 * (size["all"] or 0) / RANGE_ENTRIES))))
    plan = (contexts, _frequent(packets, size["all"] or 0, 1 / (8 << cell_bits)), cell_bits)
    cells = stored(_cells(_asked_pairs(packets, plan).repartition(1 << cell_bits, "cell")))
    asked = _asked_words(packets, bits).union(_cell_words(cells, bits))
    ranges = stored(_ranges(asked.repartition(1 << bits, "range")))
    seats = stored(_seats(cells, bits))

    def kept(turn):
        return turn >= burn or turn == sweeps

    pairs = cells.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    setup = {"strength": strength, "seed": seed, "discount": _discount(pairs["once"] or 0, pairs["twice"] or 0)}
    if kept(0):
        seats = seats.withColumn("held", F.col("tables"))
    start = ranges.drop("packets", "packet_sizes", "packet_places")
    state = stored(_state(start, _shortfalls(seats), setup, None, 0, kept(0)))
    totals = _totals(state)
    setup |= {"base": 1.0 / (totals["types"] + 1), "root_discount": _discount(totals["root_once"], totals["root_twice"])}
    history = [totals] if kept(0) else []
    for turn in range(sweeps):
        keep = kept(turn + 1)
        seats = stored(_seated(seats, _told(state, dict(setup), totals), dict(setup), turn, keep))
        state = stored(_state(state, _shortfalls(seats), dict(setup), totals, turn, keep))
        totals = _totals(state)
        history += [totals] if keep else []

    answers = _word_answers(ranges, state).union(_pair_answers(cells, seats, len(history)))
    half = 0.5 * (totals["types"] + 1)
    schema = f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        p = _Packet(*(group.column(n)[0].as_py() for n in _BLOBS))
        count, log = _log_probabilities(p, answers, plan, setup, history)
        starts = np.cumsum(p.lengths) - p.lengths
        sums = np.add.reduceat(log, starts)
        del log
        base = np.log10((count + 0.5) / (tokens + half))[p.stream]
        known = (count > 0)[p.stream]
        return pa.table(
            {key: group.column("keys")[0].values, "n_tokens": p.lengths, "n_known": np.add.reduceat(known, starts, dtype=np.int64),
             "train_tokens": np.full(len(starts), tokens, np.int64), "base_score": np.add.reduceat(base, starts), "score": sums}
        )

    return packets.select("packet", *_BLOBS, "keys").groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(run, schema)


def _discount(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def perplexity(scores: DataFrame) -> DataFrame:
    """tokens, perplexity and base_perplexity per token over the rows of `score`, by their column held_out."""
    return scores.groupBy("held_out").agg(
        F.sum("n_tokens").alias("tokens"),
        F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
        F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"),
    )
