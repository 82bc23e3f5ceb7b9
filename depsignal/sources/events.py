"""Bronze and silver event tables: reading, writing, insert-only merge."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.functions import names
from depsignal.operators.silver import dedup_latest, event_time
from depsignal.session import remove_path


def read_events(spark: SparkSession, paths) -> DataFrame:
    """Gzipped JSON lines with the explicit bronze schema; bad lines are kept as text.

    A gzip file is one task, so parallelism comes from the number of hour
    files; nothing is shuffled here.
    """
    return (
        spark.read.schema(schemas.BRONZE_READ)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(paths)
    )


def _with_payload(flag: Column) -> Column:
    # Spark refuses a scan that needs the corrupt column only, so the predicate
    # also reads a data column; the marker keeps the added test always true.
    return flag & (F.concat_ws("|", F.lit("x"), F.col("type")) != "")


def split_corrupt(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Well-formed events without the corrupt column, and the bad lines."""
    corrupt = F.col(schemas.CORRUPT)
    clean = raw.filter(_with_payload(corrupt.isNull())).drop(schemas.CORRUPT)
    bad = raw.filter(_with_payload(corrupt.isNotNull())).select(schemas.CORRUPT)
    return clean, bad


def corrupt_sample(bad: DataFrame, n: int = 5) -> DataFrame:
    """A few bad lines to look at."""
    return bad.limit(n)


def select_days(events: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows of the inclusive day range when both ends are given, else everything.

    ``event_date`` is the partition column, so this prunes directories.
    """
    if not (start and end):
        return events
    day = F.col("event_date")
    return events.filter((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))


BRONZE_LAYOUT = ("org_name", "repo_name", "date", "hour")


def write_bronze(raw: DataFrame, path: str, layout=BRONZE_LAYOUT) -> None:
    """Gzipped JSON lines below org / repository / date / hour.

    A directory that the rows touch is replaced, so loading an hour again
    leaves it as it was. Rows must therefore hold each of their hours whole.

    The rebalance hint lets adaptive execution split a hot directory over
    several writers and merge tiny ones. A long tail of quiet repositories
    makes many small files: give a coarser ``layout`` there, since org and
    repository also stay inside each line.
    """
    at = event_time("created_at")
    keyed = raw.select(
        "*",
        names.org_of(F.col("repo.name")).alias("org_name"),
        names.name_of(F.col("repo.name")).alias("repo_name"),
        F.to_date(at).alias("date"),
        F.hour(at).alias("hour"),
    )
    (
        keyed.select(*raw.columns, *layout)
        .hint("rebalance", *layout)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*layout)
        .option("compression", "gzip")
        .json(path)
    )


def create_silver(
    spark: SparkSession, name: str, path: str | None = None, recreate: bool = False
) -> DataFrame:
    """The typed silver table, partitioned by event_date.

    ``recreate`` drops an earlier table with its rows, also those below ``path``.
    """
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            remove_path(spark, path)
    location = f"LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schemas.SILVER}) "
        f"USING PARQUET PARTITIONED BY (event_date) {location}"
    )
    return spark.table(name)


def days_of(events: DataFrame) -> list:
    """The different event dates: as many values as days, used to prune the target of a merge."""
    rows = events.select("event_date").filter("event_date IS NOT NULL").distinct().collect()
    return sorted(r["event_date"] for r in rows)


def merge_insert_only(
    target: DataFrame,
    incoming: DataFrame,
    key: str = "event_id",
    days: list | None = None,
    dedup: bool = True,
) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``target``; existing rows never change.

    Equal event ids share their event_date, because the timestamp is part of
    the hashed key. So ``days``, the dates of the batch, prune the target to
    the touched partitions without losing matches: one late event costs one
    more day, not all days between. Copies inside the batch are removed first,
    which also keeps a hot id from skewing the join.
    """
    if dedup:
        incoming = dedup_latest(incoming, key)
    if days is None:
        return incoming.join(target.select(key), key, "left_anti")
    # joined by the key alone, the batch stays as the removal of copies has dealt and sorted it
    touched = target.filter(F.col("event_date").isin(days))
    return incoming.join(touched.select(key), key, "left_anti").select(incoming.columns)


def append_silver(rows: DataFrame, path: str) -> None:
    """Append silver rows, one directory per day, hot days split over writers."""
    (
        rows.select(*schemas.SILVER_COLUMNS)
        .hint("rebalance", "event_date")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def merge_into_path(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """Insert-only merge of a materialised batch into the silver files at ``path``."""
    days = days_of(incoming)
    if not days:
        return
    target = spark.read.schema(schemas.SILVER).parquet(path)
    append_silver(merge_insert_only(target, incoming, days=days), path)


def merge_stats(before: DataFrame, incoming: DataFrame, after: DataFrame) -> DataFrame:
    """Rows before, sent, after, added and skipped as duplicates."""
    counts = None
    for label, frame in (("before", before), ("incoming", incoming), ("after", after)):
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("side"), "n")
        counts = one if counts is None else counts.unionByName(one)

    def side(label):
        return F.sum(F.when(F.col("side") == label, F.col("n")).otherwise(0))

    return counts.agg(
        side("before").alias("rows_before"),
        side("incoming").alias("rows_incoming"),
        side("after").alias("rows_after"),
    ).select(
        "*",
        (F.col("rows_after") - F.col("rows_before")).alias("rows_added"),
        (F.col("rows_incoming") - (F.col("rows_after") - F.col("rows_before"))).alias(
            "rows_duplicate"
        ),
    )
