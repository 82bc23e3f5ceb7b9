"""Bookkeeping of hourly ingestion."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depsignal.operators.silver import event_time


def backfill_window(spark: SparkSession, days: int, end: str | None = None) -> DataFrame:
    """First and last day of an inclusive window that ends yesterday by default."""
    last = F.lit(end).cast("date") if end else F.date_sub(F.current_date(), 1)
    return spark.range(1).select(F.date_sub(last, days - 1).alias("start"), last.alias("end"))


def hour_spine(window: DataFrame) -> DataFrame:
    """Every (date, hour) from ``start`` to ``end``, oldest first."""
    days = window.select(
        F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("date")
    )
    return days.select(
        "date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour")
    ).orderBy("date", "hour")


def missing_hours(spine: DataFrame, done: DataFrame) -> DataFrame:
    """Hours without a completion marker."""
    return spine.join(done.select("date", "hour"), ["date", "hour"], "left_anti")


def ingest_hour_stats(raw: DataFrame, projects: DataFrame) -> DataFrame:
    """Per hour: events read, events matched, repositories matched.

    Events are counted per hour and repository before the watch-list is
    joined, so a hot repository is one row per hour in the join.
    """
    return hour_stats_of(repo_hour_counts(raw), projects)


def repo_hour_counts(raw: DataFrame, *by: str) -> DataFrame:
    """Events of each hour and repository, and of further columns."""
    at = event_time("created_at")
    hour = [F.to_date(at).alias("date"), F.hour(at).alias("hour"), F.col("repo.name").alias("repo")]
    return raw.groupBy(*hour, *by).agg(F.count(F.lit(1)).alias("n"))


def hour_counts(parts: DataFrame) -> DataFrame:
    """Partial counts of hours and repositories, added up."""
    return parts.groupBy("date", "hour", "repo").agg(F.sum("n").alias("n"))


def hour_stats_of(counts: DataFrame, projects: DataFrame) -> DataFrame:
    """The statistics of hours from the counts of their repositories."""
    per_repo = counts.withColumnRenamed("repo", "_repo")
    watched = projects.select(
        F.concat_ws("/", "org", "repo").alias("_repo"), F.lit(True).alias("_hit")
    ).distinct()
    return (
        per_repo.join(watched, "_repo", "left")
        .groupBy("date", "hour")
        .agg(
            F.sum("n").alias("events_downloaded"),
            F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0)).alias("events_filtered"),
            F.count_if(F.col("_hit")).alias("projects_with_events"),
        )
    )


def backfill_summary(hours: DataFrame) -> DataFrame:
    """Outcome of a backfill: counts, sums over succeeded hours, success rate."""
    skipped = F.col("skipped")
    ok = ~skipped & F.col("error").isNull()

    def total(c):
        return F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0))

    actionable = F.col("hours_attempted") - F.col("hours_skipped")
    return hours.agg(
        F.count(F.lit(1)).alias("hours_attempted"),
        F.count_if(ok).alias("hours_succeeded"),
        F.count_if(skipped).alias("hours_skipped"),
        F.count_if(~skipped & F.col("error").isNotNull()).alias("hours_failed"),
        total("events_downloaded").alias("total_events_downloaded"),
        total("events_filtered").alias("total_events_filtered"),
        total("projects_with_events").alias("total_files_written"),
    ).select(
        "*",
        F.coalesce(
            F.col("hours_succeeded") / F.nullif(actionable, F.lit(0)), F.lit(1.0)
        ).alias("success_rate"),
    )
