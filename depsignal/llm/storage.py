"""Shared files: results that must outlive executors, and binary files of tasks."""

import posixpath

from pyarrow import fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from depsignal.session import opened, scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder; cuts its lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Stores that tasks can open (fixed values).
STORES = ("file", "hdfs", "viewfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder URI that every executor can open; refused here if tasks could not write there."""
    path = scratch_path(spark, name)
    store = path.partition(":/")[0] if ":/" in path else "file"
    if store not in STORES:
        raise ValueError(f"tasks cannot write files to {store}: set spark.checkpoint.dir to one of {', '.join(STORES)}")
    return path


def width(spark: SparkSession) -> int:
    """Number of tasks for work that is far larger than the rows that name it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def commit_file(folder: str, name: str, content: bytes | list[bytes]) -> str:
    """Write a file completely and return its URI.

    Callers put something unique to the attempt in the name and list the
    file in a table that Spark commits, so what a lost task left is never read.
    """
    uri = posixpath.join(folder, name)
    store, path = opened(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        for part in [content] if isinstance(content, bytes) else content:
            out.write(part)
    return uri


def read_range(uri: str, offset: int, length: int) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        return f.read_at(length, offset)
