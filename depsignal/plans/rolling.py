"""Scores of the last days: a state that takes a day in and lets the oldest day go.

The state of a day has the totals of each repository and of each repository
and actor over the window that ends with it. The next state adds one day of the stored
roll-up and subtracts the day that leaves, so a step reads two days and the state,
whatever the length of the window. Counts and sums can be taken back;
first and last dates come from the list of days with events, which the window bounds.

Each state is a folder named by its day and marked when it is complete. A day that was
changed afterwards makes the states from it on stale: ``forget_from`` drops
them, and ``roll`` begins anew from the newest state that is left, or from the roll-up of the whole window.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depsignal.operators.metrics import REPO, health_from_totals
from depsignal.operators.scoring import health_scores
from depsignal.plans.gold import DAILY
from depsignal.session import path_exists, remove_path

COUNTERS = ("pushes", "commits", "issues_opened", "issues_closed", "prs_opened", "prs_closed")
NAMES = (*REPO, "org_name", "repo_name")
MARGIN = datetime.timedelta(days=1)


def _folder(root: str, day: datetime.date) -> str:
    return f"{root}/day={day}"


def _days(spark: SparkSession, store: str, first: datetime.date, last: datetime.date) -> DataFrame:
    daily = spark.read.schema(DAILY).parquet(store)
    return daily.filter(F.col("event_date").between(F.lit(first), F.lit(last)))


def _repos(daily: DataFrame) -> DataFrame:
    """Totals of each repository, with the number and list of its days."""
    days = daily.groupBy(*NAMES, "event_date").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    return days.groupBy(*NAMES).agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.count_if(F.col("pushes") > 0).alias("push_days"),
        F.count_if(F.col("prs_opened") + F.col("prs_closed") > 0).alias("pr_days"),
        F.sort_array(F.collect_list("event_date")).alias("days"),
    )


def _actors(daily: DataFrame) -> DataFrame:
    pushed = daily.filter("pushes > 0")
    return pushed.groupBy(*NAMES, "actor_login").agg(F.sum("pushes").alias("pushes"), F.sum("commits").alias("commits"))


def _signed(old: DataFrame | None, new: DataFrame, gone: DataFrame | None, numbers: list[str]) -> DataFrame:
    """The rows of the state, of the day that comes and, with negative numbers, of the day that goes."""
    rows = new.withColumn("_gone", F.lit(False))
    if old is not None:
        rows = rows.unionByName(old.withColumn("_gone", F.lit(False)))
    if gone is not None:
        rows = rows.unionByName(gone.withColumns({c: -F.col(c) for c in numbers}).withColumn("_gone", F.lit(True)))
    return rows


def step(
    repos: DataFrame | None, actors: DataFrame | None, comes: DataFrame, goes: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """The next state from the last one and the roll-ups of the day that comes and of the day that goes."""
    numbers = [*COUNTERS, "push_days", "pr_days"]
    rows = _signed(repos, _repos(comes), None if goes is None else _repos(goes), numbers)
    # at most three rows of a repository meet: the state, the new day, the old day
    listed = lambda flag: F.flatten(F.collect_list(F.when(F.col("_gone") == flag, F.col("days"))))
    summed = rows.groupBy(*NAMES).agg(*[F.sum(c).alias(c) for c in numbers], listed(False).alias("_in"), listed(True).alias("_out"))
    next_repos = summed.withColumn("days", F.sort_array(F.array_except("_in", "_out"))).filter("size(days) > 0").drop("_in", "_out")
    rows = _signed(actors, _actors(comes), None if goes is None else _actors(goes), ["pushes", "commits"])
    totals = rows.groupBy(*NAMES, "actor_login").agg(F.sum("pushes").alias("pushes"), F.sum("commits").alias("commits"))
    return next_repos, totals.filter("pushes > 0")


def _write(spark: SparkSession, root: str, day: datetime.date, repos: DataFrame, actors: DataFrame) -> None:
    folder = _folder(root, day)
    repos.write.mode("overwrite").parquet(f"{folder}/repos")
    actors.write.mode("overwrite").parquet(f"{folder}/actors")
    # a state counts once it has this mark
    spark.createDataFrame([(str(day),)], "day STRING").write.mode("overwrite").parquet(f"{folder}/done")


def _read(spark: SparkSession, root: str, day: datetime.date) -> tuple[DataFrame, DataFrame] | None:
    folder = _folder(root, day)
    if not path_exists(spark, f"{folder}/done/_SUCCESS"):
        return None
    return spark.read.parquet(f"{folder}/repos"), spark.read.parquet(f"{folder}/actors")


def roll(spark: SparkSession, store: str, root: str, day: datetime.date, window: int = 90) -> str:
    """Make the state of a day, from the day before where that is there; returns how: 'there', 'step' or 'whole'."""
    if _read(spark, root, day) is not None:
        return "there"
    last = _read(spark, root, day - MARGIN)
    if last is None:
        daily = _days(spark, store, day - (window - 1) * MARGIN, day)
        repos, actors = step(None, None, daily, None)
    else:
        out = day - window * MARGIN
        repos, actors = step(*last, _days(spark, store, day, day), _days(spark, store, out, out))
    _write(spark, root, day, repos, actors)
    return "whole" if last is None else "step"


def forget_from(spark: SparkSession, root: str, day: datetime.date, until: datetime.date) -> None:
    """Drop the states that hold a day which has changed."""
    while day <= until:
        remove_path(spark, _folder(root, day))
        day += MARGIN


def rolling_scores(
    spark: SparkSession, root: str, day: datetime.date, card: DataFrame, computed_at: Column | None = None
) -> DataFrame:
    """Scores over the window that ends with the day, from its state alone."""
    state = _read(spark, root, day)
    if state is None:
        raise ValueError(f"no state of {day} at {root}")
    repos, actors = state
    totals = repos.select(
        *NAMES,
        F.size("days").cast("bigint").alias("data_days_available"),
        F.array_min("days").alias("first_event_date"),
        F.array_max("days").alias("last_event_date"),
        F.col("pushes").alias("push_event_count"),
        F.col("commits").alias("total_commits"),
        F.col("push_days").alias("active_days"),
        *COUNTERS[2:],
        "pr_days",
    )
    pushed = actors.select(*NAMES, "actor_login", F.col("commits").alias("actor_commits"))
    return health_scores(health_from_totals(totals, pushed, card, computed_at=computed_at))
