"""Key filters beside the silver files, so that a merge reads only files that can hold an incoming key.

Every silver file has filter rows: for each hour it holds, and at most
``KEYS`` keys at a time, the range of keys and a Bloom filter of 32 bits a
key. They lie in ``_keys`` below the silver folder, which readers of the events do
not see. Equal keys share their time, which is part of the hashed key, so an incoming key is
tested against filters of its own hour only, by an equi-join with the bits
tested inside. A filter may say yes wrongly, about three times in ten
million: then a file is read in vain and the anti-join decides. A file
without a filter counts as a candidate, so a run that stopped before writing filters costs
reading, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.operators.silver import dedup_latest
from depsignal.session import path_exists
from depsignal.sources.events import append_silver, days_of, merge_insert_only
from depsignal.sources.tables import materialize_once

FOLDER = "_keys"
#: Keys in one filter at most, bits for each key, and how many of them a key sets.
KEYS, BITS, PROBES = 1 << 15, 32, 16
#: Bits of the smallest filter; in very few bits the probes of different keys would often be the same ones.
LEAST_BITS = 1 << 12
FILTERS = "file STRING, hour INT, n BIGINT, low STRING, high STRING, bits ARRAY<BIGINT>, event_date DATE"
#: The part of a file's URI that is the same in every notation.
_NAME = r"(event_date=[^/]+/[^/]+)$"


def _hashes(key: str) -> tuple[Column, Column]:
    """The first probe of a key and the odd step to the next one, small enough to be added up PROBES times."""
    low = F.lit((1 << 56) - 1)
    step = F.xxhash64(key, F.lit(2)).bitwiseAND(low).bitwiseOR(F.lit(1).cast("long"))
    return F.xxhash64(key, F.lit(1)).bitwiseAND(low), step


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, event_date, hour, key, h1, h2) to filter rows."""
    held: dict[tuple, list[pa.RecordBatch]] = {}
    sizes: dict[tuple, int] = {}

    def made(where: tuple) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held.pop(where))
        n = sizes.pop(where)
        width = max(-(-n * BITS // 64) * 64, LEAST_BITS)
        first, second = (rows[c].to_numpy().astype(np.uint64) for c in ("h1", "h2"))
        at = ((first[:, None] + second[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(width)).ravel()
        words = np.zeros(width // 64, np.uint64)
        np.bitwise_or.at(words, (at // 64).astype(np.int64), np.uint64(1) << (at % np.uint64(64)))
        keys = pa.compute.min_max(rows["key"]).as_py()
        values = [where[0]], [where[2]], [n], [keys["min"]], [keys["max"]], [words.view(np.int64)], [where[1]]
        kinds = pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.date32()
        names = ["file", "hour", "n", "low", "high", "bits", "event_date"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        place = pa.Table.from_batches([batch.select(["file", "event_date", "hour"])]).to_pylist()
        groups: dict[tuple, list[int]] = {}
        for i, row in enumerate(place):
            groups.setdefault((row["file"], row["event_date"], row["hour"]), []).append(i)
        for where, rows in groups.items():
            for at in range(0, len(rows), KEYS):
                some = rows[at : at + KEYS]
                if sizes.get(where, 0) + len(some) > KEYS:
                    yield made(where)
                held.setdefault(where, []).append(batch.take(pa.array(some)))
                sizes[where] = sizes.get(where, 0) + len(some)
        # a task reads one file after another, so what it holds stays small
        while len(held) > 1024:
            yield made(next(iter(held)))
    for where in list(held):
        yield made(where)


def key_filters(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """Filter rows of silver files, from a frame that reads them; nothing is shuffled."""
    first, second = _hashes(key)
    found = rows.select(
        F.regexp_extract(F.input_file_name(), _NAME, 1).alias("file"),
        "event_date",
        F.hour("created_at").alias("hour"),
        F.col(key).alias("key"),
        first.alias("h1"),
        second.alias("h2"),
    )
    return found.mapInArrow(_filters, FILTERS)


def _hit(bits: Column, first: Column, second: Column) -> Column:
    """Whether all bits of a key are set."""
    width = F.size(bits).cast("long") * 64
    one = F.lit(1).cast("long")

    def is_set(k: int) -> Column:
        at = F.pmod(first + second * k, width)
        word = F.get(bits, F.floor(at / 64).cast("int"))
        return F.call_function("shiftrightunsigned", word, (at % 64).cast("int")).bitwiseAND(one) == 1

    return reduce(Column.__and__, [is_set(k) for k in range(PROBES)])


def candidates(incoming: DataFrame, filters: DataFrame, key: str = "event_id") -> DataFrame:
    """The names of files that may hold a key of ``incoming``."""
    first, second = _hashes(key)
    keys = incoming.select("event_date", F.hour("created_at").alias("hour"), F.col(key).alias("_key"), first.alias("_h1"), second.alias("_h2"))
    inside = (F.col("_key") >= F.col("low")) & (F.col("_key") <= F.col("high"))
    same = (keys["event_date"] == filters["event_date"]) & (keys["hour"] == filters["hour"])
    met = keys.join(filters, same & inside & _hit(F.col("bits"), F.col("_h1"), F.col("_h2")))
    return met.select("file").distinct()


def _files(spark: SparkSession, path: str, days: list) -> list[str]:
    """The silver files of some days."""
    folders = [f"{path}/event_date={d}" for d in days]
    there = [f for f in folders if path_exists(spark, f)]
    return sorted(spark.read.schema(schemas.SILVER).option("basePath", path).parquet(*there).inputFiles()) if there else []


def _name(uri: str) -> str:
    return "/".join(uri.rsplit("/", 2)[1:])


def read_filters(spark: SparkSession, path: str) -> DataFrame:
    """All filter rows of the silver folder at ``path``; none before the first merge."""
    if not path_exists(spark, f"{path}/{FOLDER}"):
        return spark.createDataFrame([], FILTERS)
    return spark.read.schema(FILTERS).parquet(f"{path}/{FOLDER}")


def write_filters(spark: SparkSession, path: str, days: list) -> int:
    """Add filters for the files of some days that have none; returns how many files that were."""
    done = {r.file for r in read_filters(spark, path).filter(F.col("event_date").isin(days)).select("file").distinct().collect()}
    new = [f for f in _files(spark, path, days) if _name(f) not in done]
    if new:
        rows = spark.read.schema(schemas.SILVER).option("basePath", path).parquet(*new)
        # few small rows for each file
        filters = key_filters(rows).hint("rebalance", "event_date")
        filters.write.mode("append").partitionBy("event_date").parquet(f"{path}/{FOLDER}")
    return len(new)


@dataclass(frozen=True)
class Merged:
    """What a merge has done: files of the touched days, those of them that were read, and rows sent and inserted."""

    files: int
    read: int
    sent: int
    inserted: int


def merge_filtered(spark: SparkSession, path: str, incoming: DataFrame, key: str = "event_id") -> Merged:
    """Insert-only merge of a stored batch into the silver files at ``path``, reading candidate files only.

    The result is that of ``merge_into_path``. Names of files are collected, as
    Spark itself does to plan a scan; keys are not.
    """
    sent = incoming.count()
    days = days_of(incoming)
    if not days:
        return Merged(0, 0, sent, 0)
    batch = materialize_once(dedup_latest(incoming, key))
    there = _files(spark, path, days)
    filters = read_filters(spark, path).filter(F.col("event_date").isin(days))
    covered = {r.file for r in filters.select("file").distinct().collect()}
    met = {r.file for r in candidates(batch, filters, key).collect()} if covered else set()
    to_read = [f for f in there if _name(f) in met or _name(f) not in covered]
    if to_read:
        target = spark.read.schema(schemas.SILVER).option("basePath", path).parquet(*to_read)
        batch = materialize_once(merge_insert_only(target, batch, key, days, dedup=False))
    inserted = batch.count()
    if inserted:
        append_silver(batch, path)
    write_filters(spark, path, days)
    return Merged(len(there), len(to_read), sent, inserted)
