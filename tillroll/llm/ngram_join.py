"""Jaccard join of word n-gram sets by prefix filters under several global orders.

If two sets are similar enough, then under any total order of all tokens their prefixes share a
token. The first order puts tokens of rare hash buckets in front, so that a passage which many
documents hold is in hardly any prefix; its prefixes are indexed and make the candidates. Two
more orders are random. A candidate has to share prefix tokens under those as well before any
text is read for it.

Documents of equal sets are one class and are compared once; the class, not the key, is what links, so
rows that share a key and differ in their texts are told apart. Inside a group of many near
copies not all pairs are made: first every member is compared with one hub per token, and linked
members become one component; only pairs of different components are compared after that.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import BROADCAST_KEYS, stored, without_keys
from tillroll.llm.components import components
from tillroll.llm.words import mix, sequence_hashes, shingles, word_hashes

#: Counters of the table that ranks tokens by frequency. It only orders tokens, so it may be coarse.
SKETCH_BITS = 20
_BLOCK = 1 << 16
#: Rows of partial counts that one task adds up.
_FAN_IN = 64
#: Prefix tokens that one task sorts at once, and those that meet in one group.
_PACKET, _RANGE = 1 << 20, 1 << 20
#: Seeds of the orders besides the first.
SEEDS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """Level of frequency (16 to a doubling) by bucket of token hashes, from all documents."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = sequence_hashes(word_hashes(text), size)
                np.add.at(total, (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        part = TaskContext.get().partitionId()
        yield _packed(part, range(len(total) // _BLOCK), total.reshape(-1, _BLOCK))

    def add(key, group):
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in group.column("counts").to_pylist())
        return pa.Table.from_batches([_packed(key[1].as_py(), [key[0].as_py()], [total])])

    schema = "part int, block int, counts binary"
    rows = stored(docs.mapInArrow(count, schema))
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // _FAN_IN)
        groups = rows.groupBy("block", F.floor(F.col("part") / _FAN_IN).cast("int").alias("whole"))
        rows = groups.applyInArrow(add, schema)
        if parts <= 1:
            break
        rows = stored(rows)
    found = np.zeros(1 << SKETCH_BITS)
    for r in rows.collect():
        found[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return np.minimum(255, 16 * np.log2(1 + found) / 3).astype(np.uint8)


def _packed(part: int, blocks, counts) -> pa.RecordBatch:
    blobs = [zlib.compress(np.ascontiguousarray(x).tobytes(), 1) for x in counts]
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * len(blobs), pa.int32()), pa.array(list(blocks), pa.int32()), pa.array(blobs, pa.binary())],
        names=["part", "block", "counts"],
    )


def _sets(docs: DataFrame, size: int, percent: int, levels: np.ndarray) -> DataFrame:
    """key, mark, n, class (hash of the set, null if empty), first (prefix of order 1), others (of the random orders).

    Sets that cannot be similar to another one have no prefix: one more or less element is more
    than the threshold allows. `others` holds 16 bits of each token, which can only let too many
    candidates through.
    """

    def run(batches):
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            n, names, first, others = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                names.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                p = prefix_length(len(s), percent)
                if len(s) * 100 < percent * (len(s) + 1):
                    first.append([])
                    others.append(b"")
                    continue
                first.append(s[np.lexsort((s, levels[(s >> shift).astype(np.int64)]))[:p]].view(np.int64))
                short = [np.sort(np.partition(mix(s ^ np.uint64(k)), p - 1)[:p] & np.uint64(0xFFFF)) for k in SEEDS]
                others.append(np.concatenate(short).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(first, pa.list_(pa.int64())), pa.array(others, pa.binary())],
                names=["key", "mark", "n", "class", "first", "others"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, mark long, n long, class binary, first array<long>, others binary")


_ROW = (("token", "<u8"), ("rep", "<i8"), ("n", "<i4"), ("at", "<i4"))


def _planes(x: np.ndarray, kind: str) -> bytes:
    """The numbers byte by byte, all lowest bytes first: equal high bytes compress well."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(blobs: list[bytes], kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).reshape(-1).view(kind) for x in blobs])


def _runs(sorted_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token begins, and how often it occurs."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_tokens[1:] != sorted_tokens[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_tokens)))


def _shared_tokens(reps: DataFrame, total: int) -> DataFrame:
    """token, rep, n, at of the prefix tokens (about `total`) of `reps` (rep, n, first) that two of them hold.

    Tasks sort packets of tokens. A token that a packet holds twice is known to be shared: its rows go on
    as they are, and its range of token values hears of it by one row of n = 0. All others go to their range,
    where packets meet. So a packet sends a range one row per token at most, however hot the token is, and
    every row is shuffled once, in packed columns.
    """
    ranges = max(1, -(-total // _RANGE))
    names = [name for name, _ in _ROW]

    def packed(parts: list, number: int) -> pa.RecordBatch:
        token, rep, n, at = (np.concatenate(x) for x in zip(*parts))
        token = mix(token.view(np.uint64))  # the first order prefers some tokens: spread them evenly
        order = np.argsort(token)
        token, rep, n, at = (x[order] for x in (token, rep, n, at))
        starts, counts = _runs(token)
        often = np.repeat(counts > 1, counts)
        sent = []
        if often.any():
            spread = mix(np.array([TaskContext.get().partitionId() << 32 | number], np.uint64))[0]
            sent.append((ranges + int(spread % np.uint64(ranges)), [x[often] for x in (token, rep, n, at)]))
        one = [token[starts], rep[starts], np.where(counts > 1, 0, n[starts]), at[starts]]
        to = (one[0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts, spans = _runs(to)
        sent += [(int(to[a]), [x[a : a + m] for x in one]) for a, m in zip(cuts, spans)]
        blobs = [pa.array([_planes(x[i], kind) for _, x in sent], pa.binary()) for i, (_, kind) in enumerate(_ROW)]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in sent], pa.int64()), *blobs], names=["to", *names])

    def pack(batches):
        parts, held, number = [], 0, 0
        for batch in batches:
            first = batch.column(2)
            many = np.asarray(first.value_lengths().fill_null(0)).astype(np.int64)
            if not many.sum():
                continue
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            parts.append([np.asarray(first.flatten()), *(np.repeat(np.asarray(batch.column(i)), many) for i in (0, 1)), at])
            held += len(at)
            if held >= _PACKET:
                yield packed(parts, number)
                parts, held, number = [], 0, number + 1
        if parts:
            yield packed(parts, number)

    def compare(key, group):
        columns = [_numbers(group.column(name).to_pylist(), kind) for name, kind in _ROW]
        if key[0].as_py() < ranges:
            order = np.argsort(columns[0])
            columns = [x[order] for x in columns]
            starts, counts = _runs(columns[0])
            marked = np.logical_or.reduceat(columns[2] == 0, starts)
            keep = np.repeat((counts > 1) | marked, counts) & (columns[2] > 0)
            columns = [x[keep] for x in columns]
        token, rep, n, at = columns
        return pa.table({"token": token.view(np.int64), "rep": rep, "n": n.astype(np.int64), "at": at})

    blobs = reps.select("rep", "n", "first").mapInArrow(pack, "to long, token binary, rep binary, n binary, at binary")
    return blobs.groupBy("to").applyInArrow(compare, "token long, rep long, n long, at int")


def _nodes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of `classes` in the pairs, marked for broadcast if there are up to BROADCAST_KEYS."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).dropDuplicates()
    wanted = stored(classes.drop("class").join(nodes, "node"))
    return F.broadcast(wanted) if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else wanted


def _sharing(pairs: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that share a prefix token under every one of the random orders."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = (np.frombuffer(z, "<u2").reshape(len(SEEDS), -1) for z in (x, y))
                keep.append(all(np.isin(p, q).any() for p, q in zip(a, b)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    wanted = _nodes(pairs, classes)
    marks = sets.select("row", "others").join(wanted.select("row", "node"), "row").select("node", "others")
    both = pairs.join(marks.withColumnsRenamed({"node": "a", "others": "x"}), "a").join(
        marks.withColumnsRenamed({"node": "b", "others": "y"}), "b"
    )
    schema = pairs.schema
    return both.select("a", "b", "x", "y").mapInArrow(run, schema)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of nodes whose sets, made anew from the whole texts, are similar enough."""

    def run(batches):
        last_key, last = None, None
        for batch in batches:
            keep = []
            for hub, x, y in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if hub != last_key:
                    last_key, last = hub, shingles(y, size)
                s = shingles(x, size)
                common = len(np.intersect1d(s, last, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(last) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # Rows alike in key and text are all fetched; any of them will do. Only where there are such, texts are sorted out.
    nodes = _nodes(pairs, classes).select("node", F.col("rep").alias("_key"), F.col("mark").alias("_mark"))
    found = docs.join(nodes, docs["key"].eqNullSafe(nodes["_key"]) & (docs["mark"] == nodes["_mark"]))
    texts = stored(found.select("node", "text"))
    again = stored(texts.groupBy("node").count().filter("count > 1").select("node"))
    if not again.isEmpty():
        single = texts.join(again, "node", "left_anti")
        texts = stored(single.union(texts.join(again, "node", "left_semi").dropDuplicates(["node"])))
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "x"}), "a").join(
        texts.withColumnsRenamed({"node": "b", "text": "y"}), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(run, pairs.schema)


def _close(x: str, y: str, percent: int):
    """Sizes and places of a shared token allow enough common tokens after it, itself included.

    Whatever two sets share, their first common token has all the others behind it in both.
    """
    nx, ny, px, py = (F.col(c) for c in (f"n{x}", f"n{y}", f"at{x}", f"at{y}"))
    return F.least(nx - px, ny - py) * (100 + percent) >= (nx + ny) * percent


def _components_of(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`index` with the component c of each rep: its own number where it has no label yet."""
    if labels is None:
        return index.withColumn("c", F.col("rep"))
    return index.join(labels, F.col("rep") == F.col("node"), "left").select(
        "token", "rep", "n", "at", F.coalesce("component", "rep").alias("c")
    )


def _open_tokens(index: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the tokens whose holders are not all of one component; only these can still bring pairs."""
    ends = _components_of(index, labels).groupBy("token").agg(F.min("c").alias("_low"), F.max("c").alias("_top"))
    return index.join(ends.filter("_low < _top").select("token"), "token", "left_semi")


def links_and_components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sets (key, mark, n, class), classes (class, row, node, rep, mark, n), labels (node, component) of `docs` (key, text, mark).

    `mark` is a hash of the text, `row` a stored row that stands for the class: the first of its rows by key and
    mark, a null key being the last. Nodes number the classes in that order, so that hubs are the smallest keys.
    """
    levels = _frequencies(docs.select("text"), size)
    sets = stored(_sets(docs.select("key", "text", "mark"), size, percent, levels).withColumn("row", F.monotonically_increasing_id()))
    by_key = F.struct(F.col("key").isNull().alias("keyless"), "key", "mark", "row", "n")
    named = sets.filter("class IS NOT NULL").groupBy("class").agg(F.min(by_key).alias("r"))
    ordered = named.select("class", "r.row", F.col("r.key").alias("rep"), "r.mark", "r.n").orderBy(F.col("rep").asc_nulls_last(), "mark")
    classes = stored(ordered.withColumn("node", F.monotonically_increasing_id()))
    reps = sets.select("row", "n", "first").join(classes.select("row", F.col("node").alias("rep")), "row")
    total = classes.agg(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0
    index = stored(_shared_tokens(reps, total))

    labels = None
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    tested = links
    step = float(np.log(100 / percent))
    narrowed = last = False
    while True:
        marked = _components_of(index, labels).withColumn("band", F.floor(F.log(F.col("n")) / step))
        # While hubs bring links: one hub for each token and band of set sizes. At last: the
        # members outside the token's first component against all members of other components.
        by = ["token"] if last else ["token", "band"]
        ends = marked.groupBy(*by).agg(F.min(F.struct("c", "rep", "n", "at")).alias("h"), F.max("c").alias("_top")).filter("h.c < _top")
        if last:
            x = marked.join(ends.select("token", F.col("h.c").alias("_c0")), "token").filter("c <> _c0")
            x = x.select("token", "_c0", *(F.col(v).alias(f"{v}x") for v in ("rep", "n", "at", "c")))
            y = marked.select("token", *(F.col(v).alias(f"{v}y") for v in ("rep", "n", "at", "c")))
            met = x.join(y, "token").filter("cx <> cy AND (cy = _c0 OR repy < repx)")
        else:
            y = ends.select(*by, *(F.col(f"h.{v}").alias(f"{v}y") for v in ("rep", "n", "at", "c")))
            x = marked.select(*by, *(F.col(v).alias(f"{v}x") for v in ("rep", "n", "at", "c")))
            met = x.join(y, by).filter("cx <> cy")
        pairs = met.filter(_close("x", "y", percent)).select(
            F.greatest("repx", "repy").alias("a"), F.least("repx", "repy").alias("b")
        ).dropDuplicates()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"))
        new = links.limit(0)
        if not pairs.isEmpty():
            new = stored(_verified(stored(_sharing(pairs, sets, classes)), docs, classes, size, percent))
        found = not new.isEmpty()
        if found:
            links = stored(links.union(new))
            labels = components(links)
        if last:
            return sets, classes, docs.sparkSession.createDataFrame([], "node long, component long") if labels is None else labels
        if found and not narrowed:  # the first links close most of the tokens that will be closed
            index, narrowed = stored(_open_tokens(index, labels)), True
        tested = tested.union(pairs)
        last = not found


def _found(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """key, mark, n, class, rep, component_id, first_mark per row of `docs`; the last three are null for an empty set.

    `component_id` and `first_mark` are the smallest key of the component and, under it, the smallest mark.
    Keys are null where no row of the class or component has one.
    """
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    sets, classes, labels = links_and_components(slim, size, percent)
    placed = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("keyless"), "rep", "mark")).alias("r"))
    ids = least.select("component", F.col("r.rep").alias("component_id"), F.col("r.mark").alias("first_mark"))
    by_class = stored(placed.select("class", "rep", "component").join(ids, "component").drop("component"))
    return sets.select("key", "mark", "n", "class").join(by_class, "class", "left")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """key, n_shingles, class_rep, component_id per row of `docs`.

    A document's set holds its distinct runs of `size` words (A to Z in small letters), or all its
    words as one run if it has fewer; `n_shingles` is the size of the set. Two documents link if
    100 * common >= percent * all; `component_id` is the smallest key that links reach, the
    document's own included. `class_rep` is the smallest key with an equal set. A document
    without words, or null, has an empty set and links with nothing, not even with its like.
    Rows that share a key link each by its own text. Rows of a null key link like all others and may hold a
    chain together; they are never the smallest, so the id of a component without keys is null. A very
    long text has its whole set. An empty table gives no rows.
    """
    return _found(docs, key, text, size, percent).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("rep", "key").alias("class_rep"),
        F.coalesce("component_id", "key").alias("component_id"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row of `docs` of each component, all its columns unchanged: of its smallest key the text of the smallest mark.

    Rows alike in key and text are one document and one of them stays, the same one in every run. Rows of
    one key with other texts stay or go by their own components. Rows without a key all stay.
    """
    found = _found(docs, key, text, size, percent).filter("key IS NOT NULL")
    stays = F.col("class").isNull() | ((F.col("key") == F.col("component_id")) & (F.col("mark") == F.col("first_mark")))
    rows = stored(found.groupBy(F.col("key").alias("_key"), F.col("mark").alias("_mark")).agg(
        F.max(stays).alias("_stays"), F.count(F.lit(1)).alias("_n")))
    gone = rows.filter("NOT _stays").select("_key", "_mark")
    again = rows.filter("_stays AND _n > 1").select("_key", "_mark")
    kept = without_keys(docs, gone, key, text=text)
    if again.isEmpty():
        return kept
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    groups = without_keys(kept, again, key, "left_semi", text).select(F.col(key).alias("_key"), F.xxhash64(text).alias("_mark"), whole.alias("_row"))
    one = groups.groupBy("_key", "_mark").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row.*")
    return without_keys(kept, again, key, text=text).unionByName(one)
