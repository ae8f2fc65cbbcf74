"""Packing by concatenate and cut.

Pass one encodes every text once and stores its ids with the number of tokens before it in its
partition. The partitions' totals, one row each, are summed into global offsets. Pass two cuts
each document at the window boundaries its global offset gives; a document that crosses
boundaries yields one record per window. No row is sorted or shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import stored
from tillroll.llm.tokens import text_groups, tokenizer_path, word_encoder

#: Rows whose texts are strings of Python at once.
_ROWS = 256
_ENCODED = "part int, before long, tokens long, wide boolean, ids binary"
_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, key: str, text: str, path: str, end_id: int) -> DataFrame:
    """One row per document: key, part, before (tokens before it in the part), tokens, ids."""

    def run(batches):
        coder = word_encoder(path)
        end = np.array([end_id], coder.dtype).tobytes()
        width, part, before = coder.dtype.itemsize, TaskContext.get().partitionId(), 0
        for batch in (x.slice(a, _ROWS) for x in batches for a in range(0, x.num_rows, _ROWS)):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in text_groups(texts):
                ids = [x + end for x in coder.encode(texts[a:b])]
                counts = np.array([len(x) // width for x in ids], np.int64)
                firsts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([part] * (b - a), pa.int32()), pa.array(firsts),
                     pa.array(counts), pa.array([width == 4] * (b - a)), pa.array(ids, pa.binary())],
                    names=["_key", "part", "before", "tokens", "wide", "ids"],
                )

    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()
    return slim.mapInArrow(run, f"_key {kind}, {_ENCODED}")


def placed(ids: DataFrame) -> DataFrame:
    """The stored rows of `encoded` with `at`, the number of tokens before the document in the whole."""
    totals = ids.groupBy("part").agg(F.sum("tokens").alias("_n"))
    # One row per partition of the first pass.
    starts = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_start"))
    return ids.join(F.broadcast(starts), "part").withColumn("at", F.col("_start") + F.col("before"))


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The documents, each ended by `end_id`, follow one another in the order of the table's
    partitions and their rows; sequence s holds tokens s * window to (s + 1) * window. Only the
    last sequence can be short. A null text counts as empty and gives its end token; repeated
    rows are packed as often as they occur; an empty table gives no rows. `with_ids` adds the
    piece's ids as an array.
    """
    at = placed(stored(encoded(docs, key, text, tokenizer or tokenizer_path(), end_id)))

    def cut(batches):
        for batch in batches:
            keys, ats, wides, blobs = (batch.column(i) for i in range(4))
            rows, out, parts = [], [], []
            for i, (first, wide, blob) in enumerate(zip(ats.to_pylist(), wides.to_pylist(), blobs.to_pylist())):
                ids = np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4")
                start = 0
                while start < len(ids):
                    offset = (first + start) % window
                    piece = ids[start : start + window - offset]
                    rows.append(i)
                    out.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), (first + start) // window, offset))
                    if with_ids:
                        parts.append(piece.astype(np.int32))
                    start += len(piece)
            if not rows:
                continue
            columns = [keys.take(pa.array(rows)), *(pa.array(c, pa.int64()) for c in zip(*out))]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, *(x.split()[0] for x in _PIECES.split(", ")), *(["ids"] if with_ids else [])]
    kind = at.schema["_key"].dataType.simpleString()
    schema = f"`{key}` {kind}, {_PIECES}" + (", ids array<int>" if with_ids else "")
    return at.select("_key", "at", "wide", "ids").mapInArrow(cut, schema)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, tokens, ids: the packed ids of `pack(..., with_ids=True)`, padded to `window`."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(ordered, lambda x: x["ids"]))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), ids.alias("ids"))
    pad = F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))
    return rows.withColumn("ids", F.concat("ids", pad))
