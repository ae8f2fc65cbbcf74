import random

import pytest
from pyspark.sql import functions as F

from tillroll.llm import edit_counts, queries
from tillroll.llm.tokens import WordEncoder, tokenizer_path


@pytest.fixture(scope="module")
def count():
    coder = WordEncoder(tokenizer_path())
    return lambda text: len(coder._whole([text])[0]) // 2 if text else 0


def _applied(text, edits):
    for at, removed, inserted in edits:
        at = max(0, min(at, len(text)))
        text = text[:at] + inserted + text[max(at, min(at + removed, len(text))) :]
    return text


def test_random_edits_against_encoding_anew(count, monkeypatch):
    monkeypatch.setattr(edit_counts, "LEAF_CHARS", 12)
    r, letters = random.Random(5), "ab .,\n é1\t'\x1c"
    for _ in range(150):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 120)))
        leaves = edit_counts.cut_leaves(text)
        assert "".join(leaves) == text
        tree = edit_counts.Tree.build([len(x) for x in leaves] or [0], [count(x) for x in leaves] or [0])
        for _ in range(6):
            at, removed = r.randint(-2, len(text) + 3), r.choice([0, 0, 1, 2, 5, 30, 200])
            inserted = "".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 20])))
            want = _applied(text, [(at, removed, inserted)])
            text, _ = edit_counts.edit(tree, text, at, removed, inserted, count)
            assert (text, tree.tokens[1], tree.chars[1]) == (want, count(want), len(want))


def test_long_text_is_touched_in_few_places(count):
    text = " ".join(f"word{i}" for i in range(20_000))
    leaves = edit_counts.cut_leaves(text)
    tree = edit_counts.Tree.build([len(x) for x in leaves], [count(x) for x in leaves])
    after, work = edit_counts.edit(tree, text, 70_000, 5, "new words", count)
    assert work < 3 * edit_counts.LEAF_CHARS and tree.tokens[1] == count(after)


def test_edges_and_second_turn(spark, edge_docs, edge_rows, no_docs, count):
    rows = edit_counts.counted(edge_docs)
    assert rows.columns == [*(c for c in edge_docs.columns if c != "tree_chars"), "tree_chars", "tree_tokens"]
    members = "struct(3 AS at, 4 AS removed, 'xy z' AS inserted), null, struct(null AS at, null AS removed, null AS inserted)"
    edits = F.expr(f"array({members}, struct(-5 AS at, 1 AS removed, ' ' AS inserted), struct(100000000 AS at, 9 AS removed, '!' AS inserted))")
    done = edit_counts.edited(rows, edits)
    script = [(3, 4, "xy z"), (-5, 1, " "), (10**8, 9, "!")]
    want = sorted((str(x[0]), _applied(x[1] or "", script), count(x[1] or "")) for x in edge_rows)
    got = done.collect()
    assert sorted((str(r["doc_id"]), r["text"], r["tokens_before"]) for r in got) == want
    assert all(r["tokens"] == count(r["text"]) for r in got)
    again = edit_counts.edited(done.select("doc_id", "text", "tree_chars", "tree_tokens"), F.expr("array(struct(0 AS at, 2 AS removed, '' AS inserted))"))
    assert all(r["tokens"] == count(r["text"]) for r in again.collect())
    still = edit_counts.edited(rows, F.lit(None)).collect()
    assert all(r["tokens"] == r["tokens_before"] and r["recounted"] == 0 for r in still)
    assert edit_counts.edited(edit_counts.counted(no_docs), edits).count() == 0


def test_query(spark, sf_dir, count):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op9_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r["tokens_before"] == count(texts[r["doc_id"]]) for r in rows)


def test_edits_make_and_break_added_tokens(monkeypatch):
    from tokenizers import Tokenizer

    fresh, coder = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path())
    want = lambda t: len(fresh.encode(t, add_special_tokens=False).ids)
    have = lambda t: len(coder.encode([t])[0]) // 2 if t else 0
    monkeypatch.setattr(edit_counts, "LEAF_CHARS", 8)
    text = "one two <|endoftext|> three  <|endoftext|>four five<|endof|> six "
    leaves = edit_counts.cut_leaves(text)
    tree = edit_counts.Tree.build([len(x) for x in leaves], [have(x) for x in leaves])
    assert tree.tokens[1] == want(text)
    for at, removed, inserted in [(text.index("<|endof|>") + 7, 0, "text"), (10, 1, ""), (9, 0, " <"), (3, 0, "<|endoftext|>"), (0, 2, "<|endof"), (7, 1, "text|> ")]:
        text, _ = edit_counts.edit(tree, text, at, removed, inserted, have)
        assert tree.tokens[1] == want(text)
