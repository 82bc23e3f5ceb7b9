"""Whole-text files: dependency manifests and Markdown reports."""

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsignal.session import opened


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("value").alias("content"),
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest file: name, lower-case suffix, path and text."""
    files = _whole_files(spark, path)
    suffix = F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1))
    return files.select("file_name", suffix.alias("suffix"), "file_path", "content")


def read_reports(spark: SparkSession, path: str, latest_only: bool = False) -> DataFrame:
    """All risk reports in no order, or the newest only, as they were written.

    A report is a file ``risk_report_*.md`` or, as Spark writes it, a file in
    a directory of that name.
    """
    name = F.regexp_extract("file_path", r"(risk_report_[^/]*\.md)", 1)
    files = _whole_files(spark, path).withColumn("file_name", name).filter("file_name != ''")
    if latest_only:
        # the names tell which report is the newest; only its text is read
        newest = files.agg(F.max("file_name")).first()[0]
        files = files.filter(F.col("file_name") == F.lit(newest))
    # the text writer ends each report with a line end of its own
    return files.select("file_name", F.regexp_replace("content", r"\n\z", "").alias("content"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One file per report, named like the report; a report of the same name is replaced.

    Tasks write the files themselves, each under a hidden name first: a commit that moves folder by folder in the
    driver takes longer than all else. Texts of one name in the same frame follow each other, in their order.
    """
    name = F.coalesce("file_name", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("name")
    texts = F.sort_array(F.collect_list(F.coalesce("content", F.lit(""))))
    named = reports.groupBy(name).agg(F.array_join(texts, "\n").alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for report, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place, hidden = f"{root}/{quote(report)}", f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(hidden, compression=None) as out:
                    out.write(f"{content}\n".encode())
                # also what Spark's own writer has left under that name
                for old in store.get_file_info([place, f"{root}/report={quote(report)}"]):
                    if old.type == fs.FileType.Directory:
                        store.delete_dir(old.path)
                    elif old.is_file and store.type_name == "hdfs":
                        store.delete_file(old.path)
                store.move(hidden, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    named.mapInArrow(write, "n long").agg(F.sum("n")).collect()
