import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have them too.
CLASHING = ("score", "label", "key", "_key", "row", "hash", "features", "shard", "mix_size", "tree_chars", "_source", "n", "class", "part")


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, repeated rows, near copies, white space of all kinds."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a", 10),
        (2, base + " tail", "en", "b", None),
        (3, base, None, "a", 10),
        (4, None, "en", "a", 0),
        (5, "", "en", None, 0),
        (6, " \n\t ", "de", "b", 4),
        (7, "One word", "en", "b", 8),
        (8, prose(2, 60_000), "en", "a", 5),
        (9, prose(3, 300), "fr", None, 3),
        (9, prose(3, 300), "fr", None, 3),
        (None, prose(4, 50), "en", "a", 1),
        (10, "one WORD", "en", "c", 8),
        (11, "ünï côdé <|endoftext|>  x\x1cy 123abc don't", "en", "c", 8),
    ]
    return rows + [(100 + i, prose(50 + i, 40), "en", "abc"[i % 3], i) for i in range(30)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    df = spark.createDataFrame(edge_rows, DOCS).repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
