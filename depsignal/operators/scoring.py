"""Score table and recommendations."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsignal.functions import scores
from depsignal.operators.metrics import REPO


def health_scores(
    health: DataFrame, by: Sequence[str] = REPO, computed_at: Column | None = None
) -> DataFrame:
    """Signal scores and the weighted composite, one row per health row.

    Unless told otherwise the scores carry the health row's own time.
    """
    if computed_at is None:
        computed_at = F.col("computed_at") if "computed_at" in health.columns else F.current_timestamp()
    signals = health.select(
        *by,
        "org_name",
        "repo_name",
        "data_days_available",
        "first_event_date",
        "last_event_date",
        F.col("commits_per_week").isNotNull().alias("has_push_data"),
        scores.log_rate_score(F.col("commits_per_week")).alias("commit_score"),
        scores.issue_score(F.col("issue_resolution_rate")).alias("issue_score"),
        scores.log_rate_score(F.col("prs_closed_per_week")).alias("pr_score"),
        scores.contributor_score(F.col("contributor_count")).alias("contributor_score"),
        scores.bus_factor_score(F.col("bus_factor_risk")).alias("bus_factor_score"),
        F.round(F.coalesce("governance_score", F.lit(scores.NEUTRAL)), 2).alias(
            "governance_score"
        ),
        F.round(F.coalesce("security_score", F.lit(scores.NEUTRAL)), 2).alias("security_score"),
        F.coalesce("vuln_data_available", F.lit(False)).alias("vuln_data_available"),
        computed_at.alias("computed_at"),
    )
    return signals.select(
        *by,
        "org_name",
        "repo_name",
        scores.composite_score().alias("health_score"),
        F.lit(None).cast("double").alias("health_trend"),
        F.lit(None).cast("double").alias("prev_health_score"),
        "data_days_available",
        "first_event_date",
        "last_event_date",
        "commit_score",
        "issue_score",
        "pr_score",
        "contributor_score",
        "bus_factor_score",
        "governance_score",
        "security_score",
        "vuln_data_available",
        "has_push_data",
        "computed_at",
    )


def health_trend(snapshots: DataFrame, order: str = "snapshot_date") -> DataFrame:
    """Change of the score against the previous snapshot; NULL for the first."""
    previous = F.lag("health_score").over(Window.partitionBy("repo_full_name").orderBy(order))
    return snapshots.withColumn("prev_health_score", previous).withColumn(
        "health_trend", F.round(F.col("health_score") - F.col("prev_health_score"), 2)
    )


def recommend(
    scored: DataFrame,
    score: str = "health_score",
    replace: float = 0.65,
    upgrade: float = 0.50,
) -> DataFrame:
    """Add risk_score (4 decimals) and action."""
    c = F.col(score)
    return scored.withColumn("risk_score", F.round(scores.risk_score(c), 4)).withColumn(
        "action", scores.risk_action(c, replace, upgrade)
    )


def with_scores(records: DataFrame, health: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach score columns per repository; unscored repositories get NULL."""
    return records.join(health.select("repo_full_name", *columns), "repo_full_name", "left")
