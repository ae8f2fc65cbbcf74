"""Token counts that follow edits.

A document is cut into leaves of whole pre-tokens, and a segment tree over the leaves keeps
characters and tokens of every subtree. An edit goes down the tree by characters to the leaves it
touches. Only their text is encoded anew, together with a neighbouring leaf where the edit took away
the blank or the letter that parted the two, and the sums on the way to the root are mended.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.tokens import WordEncoder, text_groups, tokenizer_path

#: Characters of a leaf when a tree is built; edits may make it longer or shorter.
LEAF_CHARS = 512
#: No token crosses from a character that is no white space to one of these blanks.
_CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")
EDITS = "array<struct<at:long,removed:long,inserted:string>>"


def cut_leaves(text: str) -> list[str]:
    """The text in pieces of at least LEAF_CHARS characters (but for the last), cut where no token can cross."""
    out, start = [], 0
    while len(text) - start > LEAF_CHARS:
        cut = _CUT.search(text, start + LEAF_CHARS)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]] if start < len(text) else out


class Tree:
    """Sums of characters and tokens over a fixed number of leaves, as heaps: node i has children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens, self.width = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, chars: list[int], tokens: list[int]) -> Tree:
        width = 1 << max(0, len(chars) - 1).bit_length()
        c, t = ([0] * width + list(x) + [0] * (width - len(x)) for x in (chars, tokens))
        for i in range(width - 1, 0, -1):
            c[i], t[i] = c[2 * i] + c[2 * i + 1], t[2 * i] + t[2 * i + 1]
        return cls(c, t)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at `place` (the last one that holds any for the end) and where it starts."""
        i, start = 1, 0
        place = max(0, min(place, self.chars[1] - 1))
        while i < self.width:
            i *= 2
            if place - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.width
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2


def edit(tree: Tree, text: str, at: int, removed: int, inserted: str, count) -> tuple[str, int]:
    """The edited text and the characters that were encoded anew; the tree is mended in place.

    `at` and `removed` are drawn into the text. `count` gives the number of tokens of a text.
    """
    at = max(0, min(at, len(text)))
    end = max(at, min(at + removed, len(text)))
    after = text[:at] + inserted + text[end:]
    first, start = tree.leaf_at(at)
    last, last_start = tree.leaf_at(max(at, end - 1))
    stop = last_start + tree.chars[tree.width + last]
    grown = len(after) - len(text)
    # The region may start or end where a token could now cross: it takes in the neighbour.
    while start > 0 and not (_parted(after, start) and start < stop + grown):
        left, left_start = tree.leaf_at(start - 1)
        first, start = left, left_start
    while stop < len(text) and not _parted(after, stop + grown):
        last, last_start = tree.leaf_at(stop)
        stop = last_start + tree.chars[tree.width + last]
    region = after[start : stop + grown]
    for leaf in range(first + 1, last + 1):
        tree.put(leaf, 0, 0)
    tree.put(first, len(region), count(region) if region else 0)
    return after, len(region)


def _parted(text: str, place: int) -> bool:
    """Whether a leaf may begin at `place`."""
    return place == 0 or place >= len(text) or not text[place - 1].isspace() and text[place] in " \n\t\r"


def counted(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """`docs` with tree_chars and tree_tokens added (or put in place of others): the segment tree of every text.

    A null or empty text has a tree of one empty leaf. The root, element 1 of the array (from 0),
    holds the sums of the text.
    """
    docs = docs.drop("tree_chars", "tree_tokens")
    path, at, names = tokenizer or tokenizer_path(), docs.columns.index(text), [*docs.columns, "tree_chars", "tree_tokens"]

    def run(batches):
        coder = WordEncoder(path)
        width = coder.dtype.itemsize
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            for a, b in text_groups(texts):
                leaves = [cut_leaves(x) for x in texts[a:b]]
                ids = iter(coder.encode([x for some in leaves for x in some]))
                trees = [Tree.build([len(x) for x in some] or [0], [len(next(ids)) // width for _ in some] or [0]) for some in leaves]
                sums = [pa.array([getattr(t, n) for t in trees], pa.list_(pa.int32())) for n in ("chars", "tokens")]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns)), *sums], names=names)

    sums = T.ArrayType(T.IntegerType())
    fields = [*docs.schema.fields, T.StructField("tree_chars", sums), T.StructField("tree_tokens", sums)]
    return docs.mapInArrow(run, T.StructType(fields))


def edited(rows: DataFrame, edits, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """key, <text>, tokens_before, tokens, recounted, tree_chars, tree_tokens of `counted` rows after their edits.

    `edits` is a column of type EDITS; its members apply in order, each to the text the one before left.
    `at` counts characters; places outside the text are drawn in, null numbers count as 0 and a
    null insertion as empty, null or no edits change nothing. `recounted` is the number of
    characters that were encoded. The trees that come back take further edits. Repeated rows are
    edited each; an empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    slim = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text"), "tree_chars", "tree_tokens", edits.cast(EDITS).alias("_edits"))
    kind = slim.schema["_key"].dataType.simpleString()
    names = [key, text, "tokens_before", "tokens", "recounted", "tree_chars", "tree_tokens"]

    def run(batches):
        coder = WordEncoder(path)

        def count(x: str) -> int:
            return len(coder.encode([x])[0]) // coder.dtype.itemsize

        for batch in batches:
            out = []
            for body, chars, tokens, todo in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                body, tree, work = body or "", Tree(chars, tokens), 0
                before = tree.tokens[1]
                for x in todo or []:
                    if x is not None:
                        body, n = edit(tree, body, x["at"] or 0, x["removed"] or 0, x["inserted"] or "", count)
                        work += n
                out.append((body, before, tree.tokens[1], work, tree.chars, tree.tokens))
            if out:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=names)

    schema = f"`{key}` {kind}, `{text}` string, tokens_before long, tokens long, recounted long, tree_chars array<int>, tree_tokens array<int>"
    return slim.mapInArrow(run, schema)
