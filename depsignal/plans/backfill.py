"""Hourly backfill: which hours are missing, load them, remember them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsignal.operators.ingest import hour_spine, ingest_hour_stats, missing_hours
from depsignal.operators.silver import event_time, filter_watchlist
from depsignal.session import path_exists
from depsignal.sources.events import BRONZE_LAYOUT, write_bronze
from depsignal.sources.tables import materialize_once

MARKERS = "events BIGINT, date DATE, hour INT"
NOT_LANDED = "no events landed"


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Hours that are done; none before the first run."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], MARKERS)
    return spark.read.schema(MARKERS).parquet(path)


def write_markers(hours: DataFrame, path: str) -> None:
    """Mark hours as done. A marker that is written again replaces itself."""
    (
        hours.select(F.col("events_downloaded").alias("events"), "date", "hour")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date", "hour")
        .parquet(path)
    )


def backfill(
    spark: SparkSession,
    window: DataFrame,
    landed: DataFrame,
    projects: DataFrame,
    target: str,
    markers: str,
    layout=BRONZE_LAYOUT,
) -> DataFrame:
    """Load the hours of the window that have no marker; returns the outcome of every hour.

    ``landed`` are the events of the files that lie ready. The watched ones go
    below ``target``, hour by hour replaced, and then the hours are marked, so a
    run that ends in between is simply repeated. An hour without any event is
    an error and stays unmarked. Hours are few; only they are joined here.
    """
    spine = hour_spine(window)
    todo = materialize_once(missing_hours(spine, read_markers(spark, markers)))
    at = event_time("created_at")
    keyed = landed.withColumns({"_date": F.to_date(at), "_hour": F.hour(at)})
    wanted = todo.select(F.col("date").alias("_date"), F.col("hour").alias("_hour"))
    events = keyed.join(wanted, ["_date", "_hour"], "left_semi").select(landed.columns)
    stats = materialize_once(ingest_hour_stats(events, projects))
    write_bronze(filter_watchlist(events, projects), target, layout)
    write_markers(stats, markers)
    pending = todo.withColumn("_todo", F.lit(True))
    skipped = F.col("_todo").isNull()
    return (
        spine.join(pending, ["date", "hour"], "left")
        .join(stats, ["date", "hour"], "left")
        .select(
            "date",
            "hour",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events_downloaded", "events_filtered", "projects_with_events")],
            skipped.alias("skipped"),
            F.when(~skipped & F.col("events_downloaded").isNull(), NOT_LANDED).alias("error"),
        )
    )
