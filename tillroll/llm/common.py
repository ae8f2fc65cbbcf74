"""What the operators share: the folder for stored tables, hashes both engines have, words."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of `seeded_hash`.
HASH_BITS = 60
#: Labelled rows that a classifier learns from at most (12 bytes each when broadcast); of more, a sample by hash.
TRAINING_ROWS = 500_000
#: Up to so many keys (8 bytes each) are broadcast to pick rows; beyond it the rows are shuffled.
BROADCAST_KEYS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where it is unset, a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stored"


def stored(df: DataFrame, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """The rows written once to the shared folder and read back; with `by`, in a folder for each of its values.

    Lineage ends there, so a lost executor costs no earlier stage, and whatever an order or a
    partition number decided stays as it was written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/llm-{uuid.uuid4()}"
    df.write.option("compression", codec).parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded_hash(key: Column, seed: str) -> Column:
    """60 bits of md5 over `seed:key` as a long, the same in Spark and in other SQL engines."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def key_residue(key: Column, by: int) -> Column:
    """crc32 of the key written as text, modulo `by`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def word_count(text: Column) -> Column:
    """Number of words as a long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keep_rows(docs: DataFrame, text: str, tester) -> DataFrame:
    """The rows whose text passes, all their columns unchanged.

    `tester()` runs once per task and returns a function from a list of texts (null as empty) to
    a list of booleans.
    """
    at = docs.columns.index(text)

    def run(batches):
        passes = tester()
        for batch in batches:
            yield batch.filter(pa.array(passes([x or "" for x in batch.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def without_keys(docs: DataFrame, keys: DataFrame, key: str, how: str = "left_anti", text: str | None = None) -> DataFrame:
    """`docs` without (or, with left_semi, only) the rows whose key is in `keys`, a stored column `_key`.

    With `text`, rows are picked by the key and the hash of that column, which `keys` holds as `_mark`.
    Up to BROADCAST_KEYS keys are counted and sent to the tasks; more are joined by a shuffle.
    """
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    same = docs[key] == keys["_key"]
    if text is not None:
        same &= F.xxhash64(docs[text]) == keys["_mark"]
    return docs.join(F.broadcast(keys) if few else keys, same, how)


def training_marks(labels: DataFrame, label: str, learn: Column, key: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """_key, label (0 or 1) of the labelled rows that meet `learn`, stored and fit to be broadcast.

    Of more than `rows` of them, those whose hash is in a share of all hashes that holds about so
    many. A key with both labels appears with both.
    """
    marks = labels.filter(learn).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    marks = stored(marks.filter("label IN (0, 1) AND _key IS NOT NULL").dropDuplicates())
    found = marks.count()
    if found <= rows:
        return marks
    return stored(marks.filter(seeded_hash(F.col("_key"), "train") < int(rows / found * (1 << HASH_BITS))))
