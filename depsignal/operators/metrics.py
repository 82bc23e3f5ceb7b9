"""Event metrics per repository.

Every function takes deduplicated silver events. ``by`` names the grouping key
and defaults to the repository; add a snapshot column to score several periods
in one pass.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsignal.operators.scorecard import governance_and_security

REPO = ("repo_full_name",)
_NAMES = ("org_name", "repo_name")


def _keys(by: Sequence[str]) -> list[str]:
    return [*by, *_NAMES]


def _is(kind: str, *actions: str) -> Column:
    match = F.col("event_type") == kind
    if actions:
        match = match & F.col("payload_action").isin(*actions)
    return F.coalesce(match, F.lit(False))


def _commits() -> Column:
    """A push without a commit list counts as one commit."""
    return F.coalesce(F.col("payload_commits"), F.lit(1)).cast("bigint")


def _per_week(total: Column, days: Column) -> Column:
    return F.round(total.cast("double") / F.nullif(days, F.lit(0)) * F.lit(7.0), 2)


def _issue_rate(opened: Column, closed: Column) -> Column:
    """Closed over opened, where opened counts at most three times closed."""
    capped = F.nullif(F.least(opened, closed * 3), F.lit(0))
    return F.when(opened == 0, None).when(closed == 0, 0.0).otherwise(
        F.round(closed.cast("double") / capped, 4)
    )


def _merge_rate(opened: Column, closed: Column) -> Column:
    return F.round(closed.cast("double") / F.nullif(opened, F.lit(0)), 4)


def commit_activity(events: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Pushes, commits, distinct committers, distinct push days, commits per week.

    Events are first rolled up by repository, actor and day, so the two distinct
    counts expand that roll-up and not the events.
    """
    rolled = (
        events.filter(_is("PushEvent"))
        .groupBy(*_keys(by), "actor_login", "event_date")
        .agg(F.count(F.lit(1)).alias("pushes"), F.sum(_commits()).alias("commits"))
    )
    return (
        rolled.groupBy(*_keys(by))
        .agg(
            F.sum("pushes").alias("push_event_count"),
            F.sum("commits").alias("total_commits"),
            F.count_distinct("actor_login").alias("active_committers"),
            F.count_distinct("event_date").alias("active_days"),
        )
        .withColumn("commits_per_week", _per_week(F.col("total_commits"), F.col("active_days")))
    )


def issue_health(events: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Issues opened and closed, and the resolution rate."""
    action = F.col("payload_action")
    return (
        events.filter(_is("IssuesEvent", "opened", "closed"))
        .groupBy(*_keys(by))
        .agg(
            F.count_if(action == "opened").alias("issues_opened"),
            F.count_if(action == "closed").alias("issues_closed"),
        )
        .withColumn(
            "issue_resolution_rate", _issue_rate(F.col("issues_opened"), F.col("issues_closed"))
        )
    )


def pr_health(events: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Pull requests opened and closed, weekly throughput, closed-to-opened rate."""
    action = F.col("payload_action")
    return (
        events.filter(_is("PullRequestEvent", "opened", "closed"))
        .groupBy(*_keys(by))
        .agg(
            F.count_if(action == "opened").alias("prs_opened"),
            F.count_if(action == "closed").alias("prs_closed"),
            F.count_distinct("event_date").alias("active_days"),
        )
        .withColumn("prs_closed_per_week", _per_week(F.col("prs_closed"), F.col("active_days")))
        .withColumn("pr_merge_rate", _merge_rate(F.col("prs_opened"), F.col("prs_closed")))
    )


def actor_totals(events: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Commits per repository and actor; unknown actors form one group."""
    return (
        events.filter(_is("PushEvent"))
        .groupBy(*_keys(by), "actor_login")
        .agg(F.sum(_commits()).alias("actor_commits"))
    )


def top_n_sum(actors: DataFrame, n: int = 3, by: Sequence[str] = REPO) -> DataFrame:
    """Commits of the n busiest actors; ties do not change the sum.

    The rank filter is applied per task before the shuffle, so a repository
    with very many actors sends n rows per task.
    """
    w = Window.partitionBy(*by).orderBy(F.col("actor_commits").desc())
    return (
        actors.select(*by, "actor_commits")
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= n)
        .groupBy(*by)
        .agg(F.sum("actor_commits").alias(f"top{n}_commits"))
    )


def with_top_n(totals: DataFrame, top: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Repository totals with the commits of the busiest actors beside them."""
    return totals.join(top, list(by), "left")


def contributor_diversity(events: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Distinct contributors and the share of commits made by the top three."""
    return _diversity(actor_totals(events, by), by)


def _diversity(actors: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = actors.groupBy(*_keys(by)).agg(
        F.sum("actor_commits").alias("total_commits"),
        F.count("actor_login").alias("contributor_count"),
    )
    share = F.col("top3_commits").cast("double") / F.nullif(F.col("total_commits"), F.lit(0))
    return with_top_n(totals, top_n_sum(actors, 3, by), by).withColumn(
        "bus_factor_risk", F.round(share, 4)
    )


def repo_span(events: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Days with any event, first and last day, for every repository."""
    return events.groupBy(*_keys(by)).agg(
        F.count_distinct("event_date").alias("data_days_available"),
        F.min("event_date").alias("first_event_date"),
        F.max("event_date").alias("last_event_date"),
    )


def daily_activity(events: DataFrame, by: Sequence[str] = REPO) -> DataFrame:
    """Roll-up to repository, actor and day: all gold metrics derive from it.

    Partial aggregation shrinks the events before the only shuffle. Stored by
    day it can also be extended one day at a time instead of recomputed.
    """

    def count(kind, *actions):
        return F.count_if(_is(kind, *actions))

    return events.groupBy(*_keys(by), "actor_login", "event_date").agg(
        count("PushEvent").alias("pushes"),
        F.sum(F.when(_is("PushEvent"), _commits()).otherwise(0)).alias("commits"),
        count("IssuesEvent", "opened").alias("issues_opened"),
        count("IssuesEvent", "closed").alias("issues_closed"),
        count("PullRequestEvent", "opened").alias("prs_opened"),
        count("PullRequestEvent", "closed").alias("prs_closed"),
    )


def health_from_daily(
    daily: DataFrame,
    scorecard: DataFrame,
    by: Sequence[str] = REPO,
    computed_at: Column | None = None,
) -> DataFrame:
    """The wide health table from the daily roll-up, with the time of its computation.

    Two branches read the roll-up: one per day, for counts and distinct days,
    one per actor, for contributors and the top three. Counts default to 0,
    rates stay NULL without data.
    """
    counters = ["pushes", "commits", "issues_opened", "issues_closed", "prs_opened", "prs_closed"]
    days = daily.groupBy(*_keys(by), "event_date").agg(*[F.sum(c).alias(c) for c in counters])
    prs = F.col("prs_opened") + F.col("prs_closed")
    repos = days.groupBy(*_keys(by)).agg(
        F.count(F.lit(1)).alias("data_days_available"),
        F.min("event_date").alias("first_event_date"),
        F.max("event_date").alias("last_event_date"),
        F.sum("pushes").alias("push_event_count"),
        F.sum("commits").alias("total_commits"),
        F.count_if(F.col("pushes") > 0).alias("active_days"),
        *[F.sum(c).alias(c) for c in counters[2:]],
        F.count_if(prs > 0).alias("pr_days"),
    )
    actors = (
        daily.filter("pushes > 0")
        .groupBy(*_keys(by), "actor_login")
        .agg(F.sum("commits").alias("actor_commits"))
    )
    return health_from_totals(repos, actors, scorecard, by, computed_at)


def health_from_totals(
    repos: DataFrame,
    actors: DataFrame,
    scorecard: DataFrame,
    by: Sequence[str] = REPO,
    computed_at: Column | None = None,
) -> DataFrame:
    """The wide health table from totals per repository and commits per repository and actor."""
    diversity = _diversity(actors, by).select(*by, "contributor_count", "bus_factor_risk")
    return (
        repos.join(diversity, list(by), "left")
        .join(governance_and_security(scorecard), "repo_full_name", "left")
        .select(
            *_keys(by),
            "data_days_available",
            "first_event_date",
            "last_event_date",
            "push_event_count",
            "total_commits",
            F.coalesce("contributor_count", F.lit(0)).alias("active_committers"),
            "active_days",
            _per_week(F.col("total_commits"), F.col("active_days")).alias("commits_per_week"),
            "issues_opened",
            "issues_closed",
            _issue_rate(F.col("issues_opened"), F.col("issues_closed")).alias(
                "issue_resolution_rate"
            ),
            "prs_opened",
            "prs_closed",
            _per_week(F.col("prs_closed"), F.col("pr_days")).alias("prs_closed_per_week"),
            _merge_rate(F.col("prs_opened"), F.col("prs_closed")).alias("pr_merge_rate"),
            "contributor_count",
            "bus_factor_risk",
            "governance_score",
            "is_maintained",
            "has_license",
            "is_branch_protected",
            "requires_code_review",
            "has_security_policy",
            "security_score",
            "vuln_count",
            "vuln_data_available",
            "has_dep_update_tool",
            (F.current_timestamp() if computed_at is None else computed_at).alias("computed_at"),
        )
    )


def project_health(
    events: DataFrame,
    scorecard: DataFrame,
    by: Sequence[str] = REPO,
    stage=None,
    computed_at: Column | None = None,
) -> DataFrame:
    """One wide row per repository with any event.

    ``stage`` stores the roll-up once (see ``materialize_once``); without it
    both branches derive it again, which is right for small inputs only.
    """
    daily = daily_activity(events, by)
    return health_from_daily(stage(daily) if stage else daily, scorecard, by, computed_at)


def event_type_counts(bronze: DataFrame, column: str = "type") -> DataFrame:
    return bronze.groupBy(column).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"))


def repo_event_summary(events: DataFrame, n: int = 20) -> DataFrame:
    """The n busiest repositories; the name breaks ties."""
    return (
        events.groupBy("repo_full_name")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_distinct("event_type").alias("event_types"),
            F.min("event_date").alias("earliest_date"),
            F.max("event_date").alias("latest_date"),
        )
        .orderBy(F.desc("total_events"), "repo_full_name")
        .limit(n)
    )


def coverage_by_type(events: DataFrame, repos: DataFrame) -> DataFrame:
    """Events and actors per repository and type for the given repositories."""
    return (
        events.join(repos.select("repo_full_name"), "repo_full_name", "left_semi")
        .groupBy("repo_full_name", "event_type")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_distinct("actor_login").alias("distinct_actors"),
            F.min("event_date").alias("earliest"),
            F.max("event_date").alias("latest"),
        )
    )


def push_verdict(coverage: DataFrame, repos: DataFrame) -> DataFrame:
    """Whether each wanted repository has any push event."""
    has_push = coverage.groupBy("repo_full_name").agg(
        F.bool_or(F.col("event_type") == "PushEvent").alias("has_push")
    )
    return (
        repos.select("repo_full_name")
        .distinct()
        .join(has_push, "repo_full_name", "left")
        .select("repo_full_name", F.coalesce("has_push", F.lit(False)).alias("has_push"))
    )


def action_breakdown(events: DataFrame, repo: str | None = None) -> DataFrame:
    """Issue and pull-request events by type and action; a NULL action is its own group."""
    rows = events.filter(F.col("event_type").isin("PullRequestEvent", "IssuesEvent"))
    if repo is not None:
        rows = rows.filter(F.col("repo_full_name") == repo)
    return rows.groupBy("event_type", "payload_action").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("event_date").alias("earliest"),
        F.max("event_date").alias("latest"),
    )
