"""What a store consists of, as numbered documents that are published whole.

Data folders are never changed once written. A store's state is one JSON document that names the
folders that count; a change writes new folders first and then publishes the next document, by a rename
that fails if that number is taken. A reader takes the highest number once and reads the folders it names,
so it sees one whole state whatever is written meanwhile, and a job that dies leaves only folders nobody names.
"""

from __future__ import annotations

import json
import uuid

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

_FOLDER, _PREFIX = "_versions", "state-"


class StoreChanged(RuntimeError):
    """Another change was published since the state this one started from."""


def _files(spark: SparkSession, path: str):
    api = spark._jvm.org.apache.hadoop.fs
    place = api.Path(path)
    return api, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The number and the document of the store's current state; 0 and {} before the first."""
    _, folder, system = _files(spark, f"{root.rstrip('/')}/{_FOLDER}")
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    numbers = [int(n[len(_PREFIX) : -len(".json")]) for n in names if n.startswith(_PREFIX)]
    return (max(numbers), document(spark, root, max(numbers))) if numbers else (0, {})


def document(spark: SparkSession, root: str, number: int) -> dict:
    """The document of one state."""
    text = spark.read.text(f"{root.rstrip('/')}/{_FOLDER}/{_PREFIX}{number:012d}.json", wholetext=True)
    return json.loads(text.first()[0])


def publish(spark: SparkSession, root: str, after: int, state: dict) -> int:
    """Publishes `state` as the one after number `after`, or raises StoreChanged and changes nothing."""
    api, fresh, system = _files(spark, f"{root.rstrip('/')}/{_FOLDER}/new-{uuid.uuid4()}")
    out = system.create(fresh, False)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    target = api.Path(f"{root.rstrip('/')}/{_FOLDER}/{_PREFIX}{after + 1:012d}.json")
    context = api.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(getattr(api, "Options$Rename"), 0)
    try:
        context.rename(system.makeQualified(fresh), system.makeQualified(target), keep)
    except Exception as error:
        system.delete(fresh, False)
        if "FileAlreadyExists" in str(error):
            raise StoreChanged(f"{root}: state {after + 1} is there already") from None
        raise
    return after + 1


def new_folder(root: str, name: str) -> str:
    """A folder of its own for data that a coming state will name."""
    return f"{root.rstrip('/')}/{name}/{uuid.uuid4()}"


def replace(
    spark: SparkSession,
    root: str,
    frames: Mapping[str, DataFrame],
    partition_by: Mapping[str, Sequence[str]] | None = None,
    after: int | None = None,
) -> int:
    """Publishes new contents of the named tables, all at once; other tables of the store stay.

    The frames may read the tables they replace. `after` is the state they were made from, the newest one
    if it is not given; if another was published since, StoreChanged is raised and nothing changes.
    """
    number, state = latest(spark, root) if after is None else (after, document(spark, root, after) if after else {})
    tables = dict(state.get("tables", {}))
    for name, df in frames.items():
        tables[name] = new_folder(root, name)
        df.write.partitionBy(*(partition_by or {}).get(name, ())).parquet(tables[name])
    return publish(spark, root, number, state | {"tables": tables})


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, DataFrame]]:
    """The number of the store's newest state and its tables; what is published later does not show in them."""
    number, state = latest(spark, root)
    return number, {name: spark.read.parquet(folder) for name, folder in state.get("tables", {}).items()}


def unnamed_folders(spark: SparkSession, root: str, named: set[str], names: list[str]) -> list[str]:
    """Data folders under `names` that are not in `named`: what dead jobs and older states left."""
    found = []
    for name in names:
        _, folder, system = _files(spark, f"{root.rstrip('/')}/{name}")
        if system.exists(folder):
            found += [f"{root.rstrip('/')}/{name}/{f.getPath().getName()}" for f in system.listStatus(folder)]
    return sorted(set(found) - named)
