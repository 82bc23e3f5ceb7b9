"""Incremental ingestion of new event files with Structured Streaming.

Each micro-batch is merged or counted by itself, and running one again changes
nothing, so no event is ever too late. ``stream_insert_once`` also keeps state,
whose watermark follows the arrival of events and so drops none either. Only
``tumbling_hours`` follows the events' own time: it closes hours.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from depsignal import schemas
from depsignal.operators.ingest import hour_counts, hour_stats_of, repo_hour_counts
from depsignal.operators.silver import TIES, bronze_to_silver, event_time
from depsignal.session import remove_path, scratch_path
from depsignal.sources.events import merge_into_path, split_corrupt
from depsignal.sources.filters import merge_filtered
from depsignal.sources.tables import materialize_once


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream over the event files below ``path``, bad lines as text; the checkpoint remembers finished files."""
    reader = (
        spark.readStream.schema(schemas.BRONZE_READ)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def stream_events(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The well-formed events of ``stream_lines``."""
    clean, _ = split_corrupt(stream_lines(spark, path, max_files))
    return clean


def run_available(
    stream: DataFrame, sink: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process every file that is new since the last run and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def stream_insert_only(
    bronze: DataFrame, target: str, checkpoint: str, ingested_at: Column | None = None
) -> StreamingQuery:
    """Insert each event once into the silver files at ``target``, however late it comes.

    The insert-only merge drops copies within the batch and against the days
    it touches, also of a batch that is repeated after a failure.
    """
    silver = bronze_to_silver(bronze, ingested_at)

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = scratch_path(spark, "micro-batch")
        merge_into_path(spark, target, materialize_once(batch, path))
        remove_path(spark, path)

    return (
        silver.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


COPY = ("event_id", *TIES)


def drop_known_copies(silver: DataFrame, keep: str = "1 hour", arrived: Column | None = None) -> DataFrame:
    """A stream of silver events without copies that came before, within ``keep`` of the first one.

    Rows are copies when also the columns agree in which deliveries of an event
    can differ, so the merge behind chooses as if all had come to it. The state
    holds the keys of the last ``keep`` of arrivals. The watermark follows the time of
    arrival, the micro-batch's own unless told otherwise, which never runs
    backwards: an event may be years late and still goes on.
    """
    at = F.current_timestamp() if arrived is None else arrived
    return silver.withColumn("_arrived", at).withWatermark("_arrived", keep).dropDuplicatesWithinWatermark(list(COPY)).drop("_arrived")


def stream_insert_once(
    bronze: DataFrame,
    target: str,
    checkpoint: str,
    keep: str = "1 hour",
    ingested_at: Column | None = None,
    arrived: Column | None = None,
    merged: list | None = None,
) -> StreamingQuery:
    """``stream_insert_only`` behind a memory of recent events.

    A copy of an event that came within ``keep`` ends in the state and costs no
    look at the target; a later copy is found by the merge, which reads only files
    whose key filter does not exclude it. ``merged`` receives what each merge has done.
    """
    fresh = drop_known_copies(bronze_to_silver(bronze, ingested_at), keep, arrived)

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = scratch_path(spark, "micro-batch")
        done = merge_filtered(spark, target, materialize_once(batch, path))
        if merged is not None:
            merged.append(done)
        remove_path(spark, path)

    return (
        fresh.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


COUNTS = "date DATE, hour INT, repo STRING, n BIGINT, part BIGINT"


def stream_hour_counts(bronze: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keep the events of each hour and repository, one folder of partial counts per event file below ``store``.

    A file that is counted again, by a repeated batch or by a stream that lost
    its progress, replaces its own folder only. ``stored_hour_stats`` adds the parts up.
    """
    named = bronze.withColumn("part", F.xxhash64(F.input_file_name()))

    def count(batch: DataFrame, _: int) -> None:
        part = repo_hour_counts(batch, "part")
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(store)

    return (
        named.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stored_hour_stats(spark: SparkSession, store: str, projects: DataFrame) -> DataFrame:
    """Events read and matched, and repositories matched, of every hour counted so far."""
    parts = spark.read.schema(COUNTS).parquet(store)
    return hour_stats_of(hour_counts(parts), projects)


def tumbling_hours(bronze: DataFrame, delay: str = "2 hours") -> DataFrame:
    """A stream of closed hours: one row for each hour and repository, once no event of it is waited for any more.

    An hour closes when the watermark, the newest event's time less ``delay``, has passed its end.
    Events that come later are left out here; ``stream_hour_counts`` has them.
    """
    timed = bronze.select(event_time("created_at").alias("at"), F.col("repo.name").alias("repo")).filter("at IS NOT NULL")
    hours = timed.withWatermark("at", delay).groupBy(F.window("at", "1 hour").alias("w"), "repo").agg(F.count(F.lit(1)).alias("n"))
    return hours.select(F.to_date("w.start").alias("date"), F.hour("w.start").alias("hour"), "repo", "n")


def stream_tumbling_hours(bronze: DataFrame, sink: str, checkpoint: str, delay: str = "2 hours") -> StreamingQuery:
    """Append closed hours to ``sink``; the state holds open hours only."""
    return run_available(tumbling_hours(bronze, delay), sink, checkpoint)
