import collections
import zlib

import numpy as np
import pytest

from tillroll.llm import packing
from tillroll.llm.tokens import WordEncoder, tokenizer_path


@pytest.fixture(scope="module")
def whole():
    coder = WordEncoder(tokenizer_path())
    return lambda text: [*np.frombuffer(coder._whole([text])[0], "<u2").tolist(), 1] if text else [1]


def test_word_cache_gives_the_library_ids(whole, edge_rows, spark, sf_dir):
    coder = WordEncoder(tokenizer_path())
    texts = [x[1] or "" for x in edge_rows] + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["", " ", "\n", "a\n\nb ", " x  y\n", "it's we'll\tq", "a\x1cb. \x1c", "日本 語1½ ²", "a\r\nb", "x y  z"]
    assert [[*np.frombuffer(x, "<u2").tolist(), 1] for x in coder.encode(texts)] == [whole(x) for x in texts]


def test_pieces_make_the_documents(spark, edge_docs, edge_rows, whole):
    rows = packing.pack(edge_docs, window=64, with_ids=True).collect()
    want = collections.Counter((x[0], tuple(whole(x[1]))) for x in edge_rows)
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for s, parts in windows.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(windows)
    assert sorted(windows) == list(range(len(windows)))
    stream = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    got, held = collections.Counter(), []
    for r in stream:
        assert r["start"] == len(held)
        held += r["ids"]
        if len(held) == r["doc_tokens"]:
            got[r["doc_id"], tuple(held)] += 1
            held = []
    assert got == want and not held


def test_sequences_are_padded(edge_docs):
    pieces = packing.pack(edge_docs, window=64, with_ids=True)
    rows = packing.sequences(pieces, 64, pad_id=7).collect()
    assert {len(r["ids"]) for r in rows} == {64} and sum(r["tokens"] for r in rows) == sum(r["length"] for r in pieces.collect())


def test_packing_nothing(no_docs):
    assert packing.pack(no_docs).count() == 0


def test_added_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z", "two <|endoftext|><|endoftext|>\nwords", "<|endoftext|", "no token"]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [np.frombuffer(x, "<u2").tolist() for x in WordEncoder(tokenizer_path()).encode(texts)] == want
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: [*x, 1] for i, x in enumerate(want)}


def test_words_are_kept_once_and_for_the_next_task():
    from tokenizers import Tokenizer

    from tillroll.llm.tokens import word_encoder

    coder = word_encoder(tokenizer_path())
    texts = ["A foo, bar foo\n\nbaz  foo", "One foo bar baz bar\nqux qux, foo's"]
    whole = Tokenizer.from_file(tokenizer_path())
    for _ in range(2):
        assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert {"foo", "bar"} <= set(coder.words) and not {" foo", " bar"} & set(coder.pieces)
    assert word_encoder(tokenizer_path()) is coder


def test_words_with_signs_behind_them_keep_their_parts_only():
    """However many signs follow a word, the word is merged once and the ids are the library's."""
    coder = WordEncoder(tokenizer_path())
    signs = [",", ".", "...", "!?", "$$$", "%", "-", '")', "'s", "'", "_", "́"]
    text = "x " + " ".join(w + s for w in ("foo", "Ünïcode", "ok") for s in signs)
    odd = [text, "a\x1cb c", "a b,", "a\r\nb.", "x  y", "x ,, .foo 12, 3.5 a1."]
    merged = []
    merge = coder.merge
    coder.merge = lambda piece: merged.append(piece) or merge(piece)
    assert coder.encode(odd) == coder._whole(odd)
    assert merged.count(coder.blank + "foo") == 1
    assert "foo" in coder.words and not {"foo,", "foo...", "foo$$$"} & set(coder.words)
