"""Score history as intervals: snapshots in a row in which a repository's score stays the same are one run.

A snapshot is compared with the run that each repository is in on its date, and
rows are written for repositories whose score changed, came or went only:
the newest run of a repository has no end, so it goes on by itself.
Runs lie in a versioned table, so a snapshot rewrites only buckets with changes.

Snapshots are placed by their date, not by their order of arrival: a late one is put
between its neighbours, and one that is recorded again replaces itself. A run is known by its
repository and first date; one that a late snapshot took away stays as a mark (``gone``).
The dates are recorded before the runs: what a failure leaves is mended by recording the snapshot again.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depsignal.sources.tables import materialize_once
from depsignal.sources.versions import create_versioned, read_version, upsert_version

RUNS = (
    T.StructType()
    .add("run", T.StringType())
    .add("repo_full_name", T.StringType())
    .add("first", T.DateType())
    .add("last", T.DateType())
    .add("health_score", T.DoubleType())
    .add("gone", T.BooleanType())
    .add("changed", T.LongType())
)
DAYS = T.StructType().add("snapshot_date", T.DateType()).add("changed", T.LongType())


def start_history(spark: SparkSession, root: str, buckets: int = 16) -> None:
    """Empty tables of runs and of snapshot dates."""
    create_versioned(spark, f"{root}/runs", RUNS, "run", buckets)
    create_versioned(spark, f"{root}/days", DAYS, "snapshot_date", 1)


def snapshot_days(spark: SparkSession, root: str) -> list[datetime.date]:
    """The dates of all snapshots, a small list."""
    return sorted(r.snapshot_date for r in read_version(spark, f"{root}/days").collect())


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """(repo_full_name, first, last, health_score); the last date is NULL while a run goes on."""
    return read_version(spark, f"{root}/runs").filter("NOT gone").drop("run", "gone", "changed")


def record_snapshot(spark: SparkSession, root: str, scores: DataFrame, day: datetime.date) -> int:
    """Put the scores of a date into the history; returns how many run rows were written.

    ``scores`` has one row per repository; repositories that it lacks have no score on that date.
    """
    others = [d for d in snapshot_days(spark, root) if d != day]
    before = max((d for d in others if d < day), default=None)
    after = min((d for d in others if d > day), default=None)
    at, p, n = (F.lit(d).cast("date") for d in (day, before, after))
    runs = read_runs(spark, root).withColumnRenamed("repo_full_name", "repo")
    # the run that holds the date, or else one that ends at the snapshot before
    holds = (F.col("first") <= at) & (F.col("last").isNull() | (F.col("last") >= at))
    near = runs.filter(holds | F.coalesce(F.col("last") == p, F.lit(False)))
    best = Window.partitionBy("repo").orderBy(F.desc("first"))
    near = near.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n").withColumnRenamed("health_score", "old")
    new = scores.select(F.col("repo_full_name").alias("name"), F.col("health_score").alias("score"), F.lit(True).alias("here"))
    both = near.join(new, F.col("repo") == F.col("name"), "full").withColumns(
        {"repo": F.coalesce("repo", "name"), "here": F.coalesce("here", F.lit(False)), "held": F.coalesce(holds, F.lit(False))}
    )
    same = F.col("here") & F.col("first").isNotNull() & F.col("old").eqNullSafe(F.col("score"))
    none = F.lit(None).cast("date")

    def run(first, last, score, gone=False):
        return F.struct(first.alias("first"), last.alias("last"), score.alias("health_score"), F.lit(gone).alias("gone"))

    end = F.when(n.isNull(), none).otherwise(at)
    own = F.when(F.col("here"), run(at, end, F.col("score")))
    # a run that began on this very date and whose score is gone
    void = F.when(F.col("held") & ~F.col("here") & (F.col("first") == at), run(at, at, F.col("old"), True))
    left = F.when(F.col("held") & (F.col("first") < at), run(F.col("first"), p, F.col("old")))
    goes_on = F.col("held") & n.isNotNull() & (F.col("last").isNull() | (F.col("last") > at))
    right = F.when(goes_on, run(n, F.col("last"), F.col("old")))
    longer = F.when(same & ~F.col("held"), run(F.col("first"), end, F.col("old")))
    parts = F.when(same & F.col("held"), F.array().cast("array<struct<first:date,last:date,health_score:double,gone:boolean>>"))
    parts = parts.when(same, F.array(longer)).otherwise(F.array(own, void, left, right))
    rows = both.select(F.col("repo").alias("repo_full_name"), F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("r"))
    rows = rows.select(F.concat_ws("|", "repo_full_name", "r.first").alias("run"), "repo_full_name", "r.*")
    now = len(others) + 1
    stamp = spark.createDataFrame([(day, now)], DAYS)
    rows = materialize_once(rows.withColumn("changed", F.lit(now).cast("bigint")))
    upsert_version(spark, f"{root}/days", stamp, "changed")
    upsert_version(spark, f"{root}/runs", rows.select(RUNS.names), "changed")
    return rows.count()


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """Every repository on every snapshot that has it, with the change against its snapshot before.

    The score before is looked up once per run: inside a run it is the run's own.
    """
    days = snapshot_days(spark, root)
    order = Window.partitionBy("repo_full_name").orderBy("first")
    runs = read_runs(spark, root).withColumn("_before", F.lag("health_score").over(order))
    every = F.array(*[F.lit(d) for d in days]) if days else F.array().cast("array<date>")
    inside = F.filter(every, lambda d: (d >= F.col("first")) & (F.col("last").isNull() | (d <= F.col("last"))))
    rows = runs.withColumn("snapshot_date", F.explode(inside))
    previous = F.when(F.col("snapshot_date") == F.col("first"), F.col("_before")).otherwise(F.col("health_score"))
    return rows.select(
        "snapshot_date",
        "repo_full_name",
        "health_score",
        previous.alias("prev_health_score"),
        F.round(F.col("health_score") - previous, 2).alias("health_trend"),
    )
