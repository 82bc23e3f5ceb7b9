"""Tables in versions: an upsert rewrites the buckets it touches and becomes visible at once.

Rows lie in hash buckets of their key, each bucket in a folder of its own. A
version is a small file in the log that names the folder of every bucket; the
newest file is the table. An upsert writes the touched buckets to new folders and then
puts the next file into the log, which fails if somebody else was faster. So
whatever stops on the way leaves the old version whole, and readers never see a mixture.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depsignal.session import remove_path
from depsignal.sources.tables import materialize_once

LOG, DATA, BUCKET = "_log", "data", "__bucket"


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version that this one was about to write."""


@dataclass(frozen=True)
class Version:
    """One state of a table: the folder of each bucket that has rows, below the table's root."""

    number: int
    key: str
    buckets: int
    schema: T.StructType
    folders: dict[int, str]

    def text(self) -> str:
        folders = {str(k): v for k, v in sorted(self.folders.items())}
        return json.dumps({"key": self.key, "buckets": self.buckets, "schema": self.schema.jsonValue(), "folders": folders})


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names in a folder and when each was last changed, in milliseconds."""
    place, store = _store(spark, path)
    if not store.exists(place):
        return []
    return [(s.getPath().getName(), s.getModificationTime()) for s in store.listStatus(place)]


def _log_name(number: int) -> str:
    return f"{number:020d}.json"


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The versions that can be read, oldest first."""
    return sorted(int(n[:20]) for n, _ in _names(spark, f"{root}/{LOG}") if n.endswith(".json") and n[:20].isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The newest version, or the given one; None where there is no table."""
    found = numbers(spark, root)
    if not found or (number is not None and number not in found):
        return None
    number = found[-1] if number is None else number
    place, store = _store(spark, f"{root}/{LOG}/{_log_name(number)}")
    stream = store.open(place)
    try:
        entry = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    folders = {int(k): v for k, v in entry["folders"].items()}
    return Version(number, entry["key"], entry["buckets"], T.StructType.fromJson(entry["schema"]), folders)


def _commit(spark: SparkSession, root: str, new: Version) -> None:
    """Put the version's file into the log in one step; nothing is replaced."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    place, store = _store(spark, f"{root}/{LOG}/{_log_name(new.number)}")
    draft = hadoop.Path(f"{root}/{LOG}/.{uuid.uuid4().hex}")
    out = store.create(draft)
    try:
        out.write(bytearray(new.text().encode()))
    finally:
        out.close()
    context = hadoop.FileContext.getFileContext(store.getUri(), conf)
    no_options = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(draft, place, no_options)
    except Exception as e:
        store.delete(draft, False)
        if store.exists(place):
            raise ConcurrentCommit(f"version {new.number} of {root} is already written") from e
        raise


def create_versioned(spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = 64) -> Version:
    """An empty table. Its number of buckets stays; choose it so that a bucket is about a task's worth of rows."""
    if key not in schema.names or BUCKET in schema.names:
        raise ValueError(f"the columns must have {key} and must not have {BUCKET}")
    first = Version(0, key, buckets, schema, {})
    _commit(spark, root, first)
    return first


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows of the newest version, or of the given one."""
    found = version(spark, root, number)
    if found is None:
        raise ValueError(f"no such version at {root}")
    return _rows(spark, root, found, list(found.folders))


def _rows(spark: SparkSession, root: str, found: Version, buckets: Sequence[int]) -> DataFrame:
    paths = [f"{root}/{found.folders[b]}" for b in buckets if b in found.folders]
    if not paths:
        return spark.createDataFrame([], found.schema)
    return spark.read.schema(found.schema).parquet(*paths)


def newest_rows(new: DataFrame, key: str, order: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row per key, the newest; ``ties`` decide between equally new rows, larger values first."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in (order, *ties)])
    return new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert_version(
    spark: SparkSession, root: str, new: DataFrame, order: str, ties: Sequence[str] = (), attempts: int = 3
) -> Version:
    """Rows of ``new`` take the place of those with the same key; returns the version that holds them.

    The batch is reduced to its newest row per key and stored once. Of the
    table only the touched buckets are read and written. A null key is one key.
    If another writer commits meanwhile, the upsert starts again from there.
    """
    now = version(spark, root)
    if now is None:
        raise ValueError(f"no table at {root}")
    bucket = F.pmod(F.xxhash64(now.key), F.lit(now.buckets)).cast("int")
    batch = new.select(now.schema.names).withColumn(BUCKET, bucket)
    batch = materialize_once(newest_rows(batch, now.key, order, ties))
    # as many numbers as there are buckets
    touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())
    for attempt in range(attempts):
        if not touched:
            return now
        folder = f"{DATA}/{uuid.uuid4().hex}"
        old = _rows(spark, root, now, touched).withColumn(BUCKET, bucket)
        ids = batch.select(F.col(now.key).alias("_key"))
        kept = old.join(ids, old[now.key].eqNullSafe(ids["_key"]), "left_anti")
        rows = kept.unionByName(batch)
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{folder}")
        folders = now.folders | {b: f"{folder}/{BUCKET}={b}" for b in touched}
        after = Version(now.number + 1, now.key, now.buckets, now.schema, folders)
        try:
            _commit(spark, root, after)
            return after
        except ConcurrentCommit:
            remove_path(spark, f"{root}/{folder}")
            if attempt + 1 == attempts:
                raise
            now = version(spark, root)
    return now


def drop_versions(spark: SparkSession, root: str, keep: int = 1, grace_hours: float = 24) -> int:
    """Forget all but the ``keep`` newest versions and delete folders that none of them names; returns how many.

    Folders changed within the grace time stay: a writer may be about to commit them, or a reader at work.
    """
    found = numbers(spark, root)
    kept = found[-keep:]
    named = {f for k in kept for f in version(spark, root, k).folders.values()}
    # first the versions, so that none is left that names a deleted folder
    for number in found[: -len(kept)]:
        remove_path(spark, f"{root}/{LOG}/{_log_name(number)}")
    clock = spark._jvm.java.lang.System.currentTimeMillis()
    gone = 0
    for name, _ in _names(spark, f"{root}/{DATA}"):
        below = [(n, at) for n, at in _names(spark, f"{root}/{DATA}/{name}")]
        old = [n for n, at in below if clock - at >= grace_hours * 3_600_000]
        unused = [n for n in old if n.startswith(f"{BUCKET}=") and f"{DATA}/{name}/{n}" not in named]
        used = any(f"{DATA}/{name}/{n}" in named for n, _ in below)
        if not used and len(old) == len(below):
            remove_path(spark, f"{root}/{DATA}/{name}")
            gone += len(unused)
            continue
        for n in unused:
            remove_path(spark, f"{root}/{DATA}/{name}/{n}")
            gone += 1
    return gone

