"""WARC archives: rows written as records, one gzip member each, and read back in sequence.

Writing. Payloads are told apart by SHA-1 and length. Of the rows with one payload, the one with the
largest key writes it as a `response`; the others write a `revisit` that names the response's record.
Spark's writers put the members into files, so a task that is lost leaves no half archive.

Reading. A file is read from its start: a member is inflated piece by piece, the record's head gives the
length of its block, and what follows is checked against it: two line ends, the end of the member, and
the digests of block and payload. Then revisits are looked up by the record that they name.

Defined results. A null payload is empty, and empty payloads are equal payloads like others. A null key is
smaller than any other and comes back as null; of repeated rows one writes the payload and the others
revisit it, naming the same key. A null or very long URL (over 32 KiB) is replaced by a `urn:`. Payloads longer
than `segment_bytes` are cut into continuation records, so that no record is large. An empty table gives an
archive without records. Only the three named columns are read, so other names are free.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import shared_folder, stored

#: Payload bytes of one record; more are continued in further records. Members stay under 16 MiB with that.
SEGMENT_BYTES = 8 << 20
#: Payload bytes of one file, about.
ARCHIVE_BYTES = 64 << 20
#: Rows of a looked-up table are broadcast up to so many bytes.
BROADCAST_BYTES = 16 << 20
#: A key of more rows than this (or a thousandth of all, if that is more) counts as hot in a lookup.
HOT_ROWS = 100_000
#: Compressed bytes that are inflated at a time, and the most that comes out at a time.
_CHUNK = 64 << 10
_URL_BYTES = 32 << 10
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "archive string, offset long, record_id string, record_type string, key string, uri string, payload_bytes long, "
    "payload_digest string, refers_to string, status string"
)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the session's part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4()}"


def write(
    pages: DataFrame,
    path: str,
    key: str,
    url: str,
    payload: str,
    least: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    segment_bytes: int = SEGMENT_BYTES,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> None:
    """Writes a record per row into gzip archives in the folder `path`, which must not exist.

    Payloads under `least` bytes are written by every row. The rows are read twice. Which of several
    rows equal in key and payload writes it depends on their place, so these must come in the same order
    both times, as those of files do.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), raw.alias("payload"),
        F.unhex(F.sha1(raw)).alias("sha1"), F.octet_length(raw).cast("long").alias("bytes"),
    ).withColumn("place", F.monotonically_increasing_id())
    slim = stored(rows.select("key", "sha1", "bytes", "place"))
    size = slim.agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")).first()
    firsts = (
        slim.filter(F.col("bytes") >= least)
        .groupBy("sha1", "bytes", "key")
        .agg(F.count(F.lit(1)).alias("same"), F.max("place").alias("place"))
        .groupBy("sha1", "bytes")
        .agg(F.sum("same").alias("n"), F.max(F.struct("key", "same", "place")).alias("first"))
        .filter("n > 1")
    )
    told = looked_up(rows, stored(firsts), ["sha1", "bytes"], broadcast_bytes, hot_rows)
    is_first = F.col("key").eqNullSafe(F.col("first.key")) & ((F.col("first.same") == 1) | (F.col("place") == F.col("first.place")))
    writes = F.col("first").isNull() | is_first
    plan = told.select(
        F.col("key").cast("string").alias("key"), "url", F.when(writes, F.col("payload")).alias("payload"), "sha1", "bytes",
        _record_id(F.col("key"), F.when(writes, F.lit(-1)).otherwise(F.col("place"))).alias("id"),
        F.when(~writes, _record_id(F.col("first.key"), F.lit(-1))).alias("refers"),
    )

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                members = _members(row, date, segment_bytes)
                if members[-1]:
                    raise ValueError("a record of 16 MiB: segment_bytes or a key is too large")
                out.append(members[:-1])
                held += len(out[-1])
                if held > 4 << 20:
                    yield _as_text(out)
                    out, held = [], 0
            if out:
                yield _as_text(out)

    # A member ends with its uncompressed size in four bytes. Below 16 MiB the last is zero, and that is the line end here.
    mean = (size["bytes"] or 0) / max(1, size["rows"]) + 1024
    plan.mapInArrow(run, "value string").write.option("lineSep", "\0").option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / mean))).text(path)
    _name_archives(pages.sparkSession, path)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives in `path`, see RECORDS; with `payloads`, also `payload` (null for revisits).

    `status` is `ok` or says what is wrong with a record. After damage that hides where the next record
    starts, the rest of the archive is one row with that status.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = RECORDS + (", payload binary" if payloads else "")
    arrow = pa.schema(
        [(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (f.split() for f in RECORDS.split(", "))]
        + ([("payload", pa.binary())] if payloads else [])
    )

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out, held = [], 0
                for record in records(content.as_buffer(), payloads):
                    out.append({"archive": name.rsplit("/", 1)[-1], **record})
                    held += 200 + len(record.get("payload") or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.mapInArrow(run, schema)


def resolved(found: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`read`'s rows with the size of the full payload and, in `refers_key`, the key of the response of a revisit.

    A revisit without its response, or with another digest than that, says so in `status`.
    """
    kept = stored(found.select("record_id", "record_type", "key", "payload_bytes", "payload_digest", "refers_to", "status"))
    asked = kept.filter("refers_to IS NOT NULL").groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    given = kept.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.struct("key", "payload_bytes", "payload_digest").alias("first")
    )
    firsts = stored(asked.join(given, "refers_to").select("refers_to", "n", "first"))
    revisit = F.col("record_type") == "revisit"
    status = (
        F.when(~revisit | (F.col("status") != "ok"), F.col("status"))
        .when(F.col("first").isNull(), "response not found")
        .when(F.col("first.payload_digest") != F.col("payload_digest"), "response differs")
        .otherwise("ok")
    )
    return looked_up(kept, firsts, ["refers_to"], broadcast_bytes, hot_rows).select(
        "key", "record_type", F.when(revisit, F.col("first.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", F.col("first.key").alias("refers_key"), status.alias("status"),
    )


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], broadcast_bytes: int, hot_rows: int) -> DataFrame:
    """`rows` left-joined with the stored `table`, one row per key, where `n` is the number of `rows` of that key.

    A small table (its bytes are added up) is broadcast. Of a larger one, the hot keys are: there are at most
    a thousand. The other rows are shuffled by key; those already answered or without a key are spread.
    """
    width = F.lit(64) + sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in _leaves(table)), F.lit(0))
    size = table.agg(F.sum(width).alias("bytes"), F.sum("n").alias("rows")).first()
    answer = [c for c in table.columns if c not in on]
    if (size["bytes"] or 0) <= broadcast_bytes:
        return rows.join(F.broadcast(table), on, "left")
    limit = max(hot_rows, size["rows"] // 1000)
    hot = table.filter(F.col("n") > limit)
    with_hot = rows.join(F.broadcast(hot), on, "left")
    known = F.col("n").isNotNull() | F.concat(*[F.col(c).cast("string") for c in on]).isNull()
    spread = F.when(known, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    cold = table.filter(F.col("n") <= limit).select(*on, F.lit(-1).cast("long").alias("_spread"), *[F.col(c).alias(f"_cold_{c}") for c in answer])
    joined = with_hot.withColumn("_spread", spread).join(cold.hint("shuffle_hash"), [*on, "_spread"], "left")
    return joined.select(*[c for c in rows.columns], *[F.coalesce(F.col(c), F.col(f"_cold_{c}")).alias(c) for c in answer])


def _leaves(table: DataFrame) -> list[str]:
    inner = {f.name: getattr(f.dataType, "names", None) for f in table.schema.fields}
    return [f"{name}.{x}" if names else name for name, names in inner.items() for x in (names or [""])]


def _record_id(key: Column, place: Column) -> Column:
    told = F.concat_ws("|", F.hex("sha1"), F.col("bytes").cast("string"), F.coalesce(key.cast("string"), F.lit("\0")), place.cast("string"))
    return F.regexp_replace(F.md5(told.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _name_archives(spark: SparkSession, path: str) -> None:
    """Gives the files their usual ending: one rename a file, which moves no bytes."""
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in system.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            system.rename(entry.getPath(), files.Path(folder, f"{name[: -len('.txt')]}.warc.gz"))


def _as_text(values: list[bytes]) -> pa.RecordBatch:
    """Bytes in a string column: the writer puts them out as they are."""
    held = pa.array(values, pa.binary())
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), len(values), held.buffers())], names=["value"])


def _digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _uri(url: str | None, key: str | None) -> str:
    if url is None:
        return f"urn:row:{quote(key or '', safe='')}"
    escaped = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
    return escaped if len(escaped) <= _URL_BYTES else f"urn:sha1:{_digest(hashlib.sha1(url.encode()).digest())}"


def _members(row: dict, date: str, segment_bytes: int) -> bytes:
    """The gzip members of one row: a record, and continuations of a long payload."""
    revisit = row["refers"] is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    payload = memoryview(row["payload"] or b"")
    cut = max(1, segment_bytes)
    pieces = [payload[i : i + cut] for i in range(0, len(payload), cut)] or [payload]
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{row['id']}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(row["url"], row["key"])),
        ("WARC-Payload-Digest", f"sha1:{_digest(row['sha1'])}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if row["key"] is not None:
        head.append(("Row-Key", quote(row["key"], safe="")))
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:uuid:{row['refers']}>")]
    if len(pieces) > 1:
        head.append(("WARC-Segment-Number", "1"))
    out = [_member(head, [http, pieces[0]])]
    for k, piece in enumerate(pieces[1:], 2):
        more = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(row['id']), str(k))}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", head[3][1]),
            ("WARC-Segment-Origin-ID", head[1][1]),
            ("WARC-Segment-Number", str(k)),
        ]
        if k == len(pieces):
            more.append(("WARC-Segment-Total-Length", str(len(http) + len(payload))))
        out.append(_member(more, [piece]))
    return b"".join(out)


def _member(head: list[tuple[str, str]], block: list) -> bytes:
    sha1 = hashlib.sha1()
    for piece in block:
        sha1.update(piece)
    head = [*head, ("WARC-Block-Digest", f"sha1:{_digest(sha1.digest())}"), ("Content-Length", str(sum(map(len, block))))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in head) + "\r\n"
    return b"".join([packer.compress(text.encode()), *map(packer.compress, block), packer.compress(b"\r\n\r\n"), packer.flush()])


class _Damaged(Exception):
    pass


class Member:
    """One gzip member of `data` from `start` on, inflated as its bytes are asked for."""

    def __init__(self, data, start: int):
        self.data, self.next, self.ready = data, start, b""
        self.inflate = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.inflate.eof:
            return False
        fed = self.inflate.unconsumed_tail
        if not fed:
            fed = self.data[self.next : self.next + _CHUNK]
            self.next += len(fed)
        try:
            got = self.inflate.decompress(fed, _CHUNK)
        except zlib.error as e:
            raise _Damaged(f"not inflated: {e}") from None
        if not len(fed) and not got and not self.inflate.eof:
            raise _Damaged("cut short")
        self.ready += got
        return True

    def line(self) -> bytes:
        while (end := self.ready.find(b"\r\n")) < 0:
            if not self._more():
                raise _Damaged("no line end")
        out, self.ready = self.ready[:end], self.ready[end + 2 :]
        return out

    def pieces(self, length: int):
        """The next `length` bytes, in pieces."""
        while length:
            if not self.ready and not self._more():
                raise _Damaged("shorter than its Content-Length")
            out, self.ready = self.ready[:length], self.ready[length:]
            length -= len(out)
            yield out

    def end(self) -> int:
        """Reads on to the end, which has to come here, and returns where the next member starts."""
        while not self.ready and self._more():
            pass
        if self.ready:
            raise _Damaged("longer than its Content-Length")
        return self.next - len(self.inflate.unused_data)


class _Payload:
    """Takes a response's block as it comes: skips the HTTP head, counts and digests the rest, keeps it if asked to."""

    def __init__(self, keep: bool):
        self.head, self.inside, self.sha1, self.bytes = b"", False, hashlib.sha1(), 0
        self.kept = [] if keep else None

    def add(self, piece: bytes) -> None:
        if not self.inside:
            self.head += piece
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return
            self.inside, piece = True, self.head[at + 4 :]
        self.sha1.update(piece)
        self.bytes += len(piece)
        if self.kept is not None:
            self.kept.append(piece)


def records(data, payloads: bool = False):
    """The records of one archive in sequence, as dicts of RECORDS without `archive`; continuations are joined."""
    data, at, waiting = memoryview(data), 0, None
    while at < len(data):
        start = at
        try:
            member = Member(data, at)
            head = _head(member)
            part = head.get("warc-type") == "continuation"
            if part and (waiting is None or head.get("warc-segment-origin-id") != waiting[0]["warc-record-id"]):
                raise _Damaged("continues no record")
            if not part:
                if waiting is not None:
                    yield _record(*waiting, "not continued")
                waiting = (head, start, _Payload(payloads))
            block = hashlib.sha1()
            for piece in member.pieces(int(head["content-length"])):
                block.update(piece)
                waiting[2].add(piece)
            if b"".join(member.pieces(4)) != b"\r\n\r\n":
                raise _Damaged("no end of record")
            at = member.end()
        except (_Damaged, KeyError, ValueError) as e:
            known = waiting or ({}, start, _Payload(False))
            yield _record(known[0], start, known[2], str(e) if isinstance(e, _Damaged) else "bad head")
            return
        claimed = head.get("warc-block-digest")
        if claimed is not None and claimed != f"sha1:{_digest(block.digest())}":
            waiting[0]["wrong"] = "block differs from its digest"
        if "warc-segment-number" not in head or "warc-segment-total-length" in head:
            yield _record(*waiting, waiting[0].get("wrong", "ok"))
            waiting = None
    if waiting is not None:
        yield _record(*waiting, "not continued")


def _head(member: Member) -> dict:
    if not member.line().startswith(b"WARC/1."):
        raise _Damaged("no WARC record")
    head = {}
    while line := member.line():
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise _Damaged("bad head")
        head[name.strip().lower()] = value.strip()
    return head


def _record(head: dict, offset: int, payload: _Payload, status: str) -> dict:
    kind, claimed = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    whole = kind != "revisit"
    if status == "ok" and whole and claimed is not None and claimed != _digest(payload.sha1.digest()):
        status = "payload differs from its digest"
    out = {
        "offset": offset,
        "record_id": _urn(head.get("warc-record-id")),
        "record_type": kind,
        "key": unquote(head["row-key"]) if "row-key" in head else None,
        "uri": head.get("warc-target-uri"),
        "payload_bytes": payload.bytes if whole else None,
        "payload_digest": _digest(payload.sha1.digest()) if whole else claimed,
        "refers_to": _urn(head.get("warc-refers-to")),
        "status": status,
    }
    if payload.kept is not None:
        out["payload"] = b"".join(payload.kept) if whole else None
    return out


def _urn(value: str | None) -> str | None:
    return None if value is None else value.strip("<>").removeprefix("urn:uuid:")
