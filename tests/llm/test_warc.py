"""WARC archives: round trips, what other tools see in them, damage, and rows against brute force."""

import base64
import gzip
import hashlib
import os
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillroll.llm import warc

PAGES = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    groups = defaultdict(list)
    for k, _, html in rows:
        groups[html or ""].append(k)
    out = []
    for text, keys in groups.items():
        first = max(keys, key=lambda k: (k is not None, k))
        small = len(text.encode()) < least
        for i, k in enumerate(sorted(keys, key=lambda k: (k is not None, k), reverse=True)):
            kind = "response" if i == 0 or small else "revisit"
            out.append((k, len(text.encode()), digest(text), kind, first if kind == "revisit" else None, "ok"))
    return sorted(out, key=str)


def back(spark, path, **more):
    found = warc.resolved(warc.read(spark, path), **more)
    return sorted(
        (
            (None if r["key"] is None else int(r["key"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
             None if r["refers_key"] is None else int(r["refers_key"]), r["status"])
            for r in found.collect()
        ),
        key=str,
    )


def archives(path):
    return [os.path.join(path.removeprefix("file:"), f) for f in sorted(os.listdir(path.removeprefix("file:"))) if f.endswith(".warc.gz")]


ODD = [
    (1, "http://a.example/x?q=1&r=%20#top", "<p>one</p>"),
    (2, None, "<p>one</p>"),
    (3, "http://a.example/\r\nEvil: 1", None),
    (4, "", ""),
    (5, "http://ü.example/é", "größe ☃ " * 50),
    (6, "http://a.example/" + "u" * 50_000, "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\n"),
    (7, "http://a.example/long", "0123456789abcdef" * 40_000),
    (8, "http://a.example/long2", "0123456789abcdef" * 40_000),
    (9, "x", "tie"), (9, "x", "tie"), (9, "y", "tie"),
    (None, "n", "tie"), (None, "n", "only null"), (None, None, "only null"), (None, None, None),
    (10, "z", "\x00\x1f\x8b\n"),
]


@pytest.fixture()
def odd(spark):
    df = spark.createDataFrame(ODD, PAGES).repartition(3)
    for name in ("key", "payload", "sha1", "bytes", "place", "n", "first", "refers"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_round_trip_of_odd_rows(spark, odd):
    path = warc.new_folder(spark)
    warc.write(odd, path, "page_id", "url", "html", segment_bytes=100_000)
    assert back(spark, path) == brute(ODD)
    # The looked-up table is shuffled, with and without hot keys.
    assert back(spark, path, broadcast_bytes=0) == brute(ODD)
    assert back(spark, path, broadcast_bytes=0, hot_rows=1) == brute(ODD)


@pytest.mark.parametrize("hot", [1, 100])
def test_shuffled_lookup_when_writing(spark, odd, hot):
    path = warc.new_folder(spark)
    warc.write(odd, path, "page_id", "url", "html", broadcast_bytes=0, hot_rows=hot)
    assert back(spark, path) == brute(ODD)


def test_small_payloads_are_all_responses(spark, odd):
    path = warc.new_folder(spark)
    warc.write(odd, path, "page_id", "url", "html", least=5)
    assert back(spark, path) == brute(ODD, 5)


def test_payloads_come_back(spark, odd):
    path = warc.new_folder(spark)
    warc.write(odd, path, "page_id", "url", "html", segment_bytes=1000)
    got = warc.read(spark, path, payloads=True).filter("record_type = 'response'").collect()
    want = {html or "" for _, _, html in ODD}
    assert sorted(bytes(r["payload"]).decode() for r in got) == sorted(want)
    urls = {r["uri"] for r in got} | {r["uri"] for r in warc.read(spark, path).collect()}
    assert "http://a.example/%0D%0AEvil:%201" in urls and any(u.startswith("urn:sha1:") for u in urls)


def test_one_member_a_record(spark, odd):
    """Any gzip tool reads the files; each member is one record with the heads the format asks for."""
    path = warc.new_folder(spark)
    warc.write(odd, path, "page_id", "url", "html")
    heads = 0
    ids = set()
    for name in archives(path):
        data = open(name, "rb").read()
        whole = gzip.decompress(data) if data else b""
        parts = []
        while data:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(data))
            assert z.eof and parts[-1].startswith(b"WARC/1.1\r\n") and parts[-1].endswith(b"\r\n\r\n")
            head = dict(x.split(b": ", 1) for x in parts[-1].split(b"\r\n\r\n")[0].split(b"\r\n")[1:])
            for field in (b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length", b"WARC-Target-URI"):
                assert field in head
            ids.add(head[b"WARC-Record-ID"])
            heads += 1
            data = z.unused_data
        assert b"".join(parts) == whole
    assert heads == len(ODD) == len(ids)


def test_empty_table(spark):
    path = warc.new_folder(spark)
    warc.write(spark.createDataFrame([], PAGES), path, "page_id", "url", "html")
    assert back(spark, path) == []


def test_one_payload_in_many_rows(spark):
    rows = [(i, f"http://h.example/{i}", "same" if i % 3 == 0 else f"own {i}") for i in range(3000)]
    path = warc.new_folder(spark)
    warc.write(spark.createDataFrame(rows, PAGES).repartition(5), path, "page_id", "url", "html", broadcast_bytes=0, hot_rows=500)
    assert back(spark, path, broadcast_bytes=0, hot_rows=500) == brute(rows)


def whole_archive(spark, rows, **more):
    path = warc.new_folder(spark)
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), path, "page_id", "url", "html", **more)
    (name,) = archives(path)
    return open(name, "rb").read()


def test_damage_is_told(spark):
    rows = [(i, "u", f"text number {i} " * 20) for i in range(4)]
    data = whole_archive(spark, rows)
    good = list(warc.records(data))
    assert [r["status"] for r in good] == ["ok"] * 4 and [r["key"] for r in good] == ["0", "1", "2", "3"]
    at = good[2]["offset"]
    assert list(warc.records(data[at:]))[0]["key"] == "2"
    cut = list(warc.records(data[: at + 40]))
    assert [r["status"] for r in cut] == ["ok", "ok", "cut short"]
    assert list(warc.records(data[:at] + b"no gzip here" + data[at:]))[2]["status"].startswith("not inflated")
    broken = bytearray(data)
    broken[good[3]["offset"] - 6] ^= 255
    assert [r["status"] for r in warc.records(bytes(broken))][:2] == ["ok", "ok"]
    assert list(warc.records(bytes(broken)))[2]["status"].startswith("not inflated")


def changed(data, old, new):
    """The first record's text changed and packed again."""
    z = zlib.decompressobj(31)
    text = z.decompress(data)
    assert old in text
    return gzip.compress(text.replace(old, new, 1), mtime=0) + z.unused_data


def test_framing_and_digests_are_checked(spark):
    data = whole_archive(spark, [(0, "u", "abc" * 10), (1, "v", "other")])

    def first(x):
        return [r["status"] for r in warc.records(x)]

    assert first(changed(data, b"abcabc", b"abcxbc")) == ["block differs from its digest", "ok"]
    block = changed(data, b"WARC-Block-Digest: sha1:", b"No-Digest: ")
    assert first(block) == ["ok", "ok"]
    assert first(changed(block, b"abcabc", b"abcxbc")) == ["payload differs from its digest", "ok"]
    assert first(changed(data, b"abcabc", b"abc")) == ["shorter than its Content-Length"]
    assert first(changed(data, b"abcabc", b"abcabcabc")) == ["no end of record"]
    assert first(changed(data, b"WARC/1.1", b"HTTP/1.1")) == ["no WARC record"]
    assert first(changed(data, b"Content-Length: 1", b"Content-Length: x")) == ["bad head"]


def test_segments(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    data = whole_archive(spark, [(0, "u", text), (1, "v", "short")], segment_bytes=300)
    got = list(warc.records(data, payloads=True))
    assert [(r["key"], r["status"], r["payload"]) for r in got] == [("0", "ok", text.encode()), ("1", "ok", b"short")]
    z = zlib.decompressobj(31)
    z.decompress(data)
    assert list(warc.records(z.unused_data))[0]["status"] == "continues no record"


def test_lost_response(spark):
    path = warc.new_folder(spark)
    warc.write(spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], PAGES), path, "page_id", "url", "html")
    rows = warc.read(spark, path)
    (lost,) = warc.resolved(rows.filter("record_type = 'revisit'")).collect()
    assert (lost["status"], lost["payload_bytes"], lost["refers_key"]) == ("response not found", None, None)
    other = rows.withColumn("payload_digest", F.when(F.col("record_type") == "response", "A").otherwise(F.col("payload_digest")))
    assert {r["status"] for r in warc.resolved(other).collect()} == {"ok", "response differs"}
