"""Silver to gold: the chain of models behind the score table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depsignal.operators.metrics import (
    commit_activity,
    contributor_diversity,
    daily_activity,
    health_from_daily,
    issue_health,
    pr_health,
    project_health,
)
from depsignal.operators.scorecard import governance, security
from depsignal.operators.scoring import health_scores
from depsignal.operators.silver import dedup_latest
from depsignal.sources.tables import build_models, materialize_once


def score_table(
    silver: DataFrame, card: DataFrame, stage=materialize_once, computed_at: Column | None = None
) -> DataFrame:
    """Silver events and scorecards to scores, reading the events once.

    The daily roll-up is stored, because two branches need it.
    """
    health = project_health(dedup_latest(silver), card, stage=stage, computed_at=computed_at)
    return health_scores(health)


DAILY = """repo_full_name STRING, org_name STRING, repo_name STRING, actor_login STRING, pushes BIGINT,
    commits BIGINT, issues_opened BIGINT, issues_closed BIGINT, prs_opened BIGINT, prs_closed BIGINT, event_date DATE"""


def refresh_daily(silver: DataFrame, store: str, days: list) -> None:
    """Recompute the roll-up of the given days in the stored table at ``store``; other days stay.

    Copies of an event share its date, so a day can be deduplicated by itself
    and only the touched directories of silver are read.
    """
    if not days:
        return
    touched = silver.filter(F.col("event_date").isin(days))
    (
        daily_activity(dedup_latest(touched))
        .hint("rebalance", "event_date")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(store)
    )


def scores_from_daily(
    spark: SparkSession, store: str, card: DataFrame, computed_at: Column | None = None
) -> DataFrame:
    """Scores from the stored roll-up, without a look at the events."""
    daily = spark.read.schema(DAILY).parquet(store)
    return health_scores(health_from_daily(daily, card, computed_at=computed_at))


def build_gold(
    spark: SparkSession, silver: DataFrame, card: DataFrame, root: str, select=None
) -> list[str]:
    """Build all nine models, or the selected ones, below ``root``.

    The daily roll-up is staged as a file so that the two gold tables do not
    expand the deduplication again.
    """
    events = dedup_latest(silver)

    def gold_health(s: SparkSession) -> DataFrame:
        return health_from_daily(materialize_once(daily_activity(s.table("stg_events"))), card)

    models = [
        ("stg_events", lambda s: events),
        ("int_commit_activity", lambda s: commit_activity(s.table("stg_events"))),
        ("int_issue_health", lambda s: issue_health(s.table("stg_events"))),
        ("int_pr_health", lambda s: pr_health(s.table("stg_events"))),
        ("int_contributor_diversity", lambda s: contributor_diversity(s.table("stg_events"))),
        ("int_governance", lambda s: governance(card)),
        ("int_security", lambda s: security(card)),
        ("gold_project_health", gold_health),
        ("gold_health_scores", lambda s: health_scores(s.table("gold_project_health"))),
    ]
    return build_models(spark, models, select, root)
