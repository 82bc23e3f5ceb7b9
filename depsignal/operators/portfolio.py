"""Questions asked of the score table: filters, rankings, summaries."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.functions import names, scores
from depsignal.functions.numeric import exact_mean, percent


def score_range(
    df: DataFrame,
    lo: float | None = None,
    hi: float | None = None,
    default: float | None = 6.0,
    inclusive_hi: bool = False,
    ascending: bool = True,
) -> DataFrame:
    """Scores in [lo, hi), or [lo, hi] when inclusive, ordered by score.

    Without bounds ``default`` is the upper bound; pass None to keep all rows.
    """
    score = F.col("health_score")
    if lo is None and hi is None:
        hi, inclusive_hi = default, False
    rows = df
    if lo is not None:
        rows = rows.filter(score >= lo)
    if hi is not None:
        rows = rows.filter(score <= hi if inclusive_hi else score < hi)
    return rows.orderBy(score.asc() if ascending else score.desc(), "repo_full_name")


def flagged(
    df: DataFrame, lo: float | None = None, hi: float | None = None, limit: int | None = None
) -> DataFrame:
    """Repositories to look into, weakest first; a positive limit caps the report."""
    rows = score_range(df.filter(F.col("health_score").isNotNull()), lo, hi)
    return rows.limit(limit) if limit and limit > 0 else rows


def search_scores(
    df: DataFrame,
    text: str | None = None,
    org: str | None = None,
    band: str | None = None,
    min_score: float = 0.0,
    lo: float = 5.0,
    hi: float = 7.0,
) -> DataFrame:
    """Literal case-insensitive name search combined with org, band and minimum score."""
    rows = df
    if text and text.strip():
        rows = rows.filter(F.contains(F.lower("repo_full_name"), F.lower(F.lit(text.strip()))))
    if org:
        rows = rows.filter(F.coalesce("org_name", names.org_of(F.col("repo_full_name"))) == org)
    if band:
        rows = rows.filter(scores.band(F.col("health_score"), lo, hi) == band)
    return rows.filter(F.col("health_score") >= min_score)


def lookup_repos(df: DataFrame, repos: list[str]) -> DataFrame:
    """The named repositories, ordered by name."""
    return df.filter(F.col("repo_full_name").isin(repos)).orderBy("repo_full_name")


def lookup_repo(df: DataFrame, repo: str) -> DataFrame:
    """At most one row for one full name."""
    return df.filter(F.col("repo_full_name") == repo).limit(1)


def missing_repos(wanted: DataFrame, df: DataFrame) -> DataFrame:
    """Wanted repositories without a score."""
    return wanted.select("repo_full_name").join(df, "repo_full_name", "left_anti").distinct()


def coverage_join(health: DataFrame, scored: DataFrame) -> DataFrame:
    """Raw metrics beside the scores made from them."""
    return health.select(
        "repo_full_name", "commits_per_week", "contributor_count", "bus_factor_risk"
    ).join(
        scored.select(
            "repo_full_name",
            "commit_score",
            "contributor_score",
            "bus_factor_score",
            "health_score",
        ),
        "repo_full_name",
    )


def _bands(lo: float, hi: float) -> list[Column]:
    s = F.col("health_score")
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(s < lo).alias("critical"),
        F.count_if((s >= lo) & (s < hi)).alias("warning"),
        F.count_if(s >= hi).alias("healthy"),
    ]


def score_summary(df: DataFrame, lo: float = 5.0, hi: float = 7.0) -> DataFrame:
    """Counts per band, mean score and time of the last run, in one pass."""
    return df.agg(
        *_bands(lo, hi),
        F.coalesce(exact_mean(F.col("health_score")), F.lit(0.0)).alias("avg_score"),
        F.max("computed_at").alias("last_run"),
    )


def score_bands(df: DataFrame, lo: float = 4.0, hi: float = 7.0) -> DataFrame:
    """Counts per band and their share of all scores."""
    total = F.col("total")
    return df.agg(*_bands(lo, hi)).select(
        "*",
        *[percent(F.col(c), total).alias(f"{c}_pct") for c in ("critical", "warning", "healthy")],
    )


def average_signals(df: DataFrame) -> DataFrame:
    """Mean of each signal, one row per signal."""
    wide = df.agg(*[exact_mean(F.col(c)).alias(c) for c in schemas.SIGNALS])
    return wide.unpivot([], schemas.SIGNALS, "signal", "average")


def governance_coverage(card: DataFrame) -> DataFrame:
    """Repositories per flag that is true, of all scorecards."""
    flags = [
        "is_maintained",
        "has_license",
        "is_branch_protected",
        "requires_code_review",
        "has_security_policy",
        "has_dep_update_tool",
    ]
    wide = card.agg(
        F.count("repo_full_name").alias("total"), *[F.count_if(F.col(c)).alias(c) for c in flags]
    )
    return wide.unpivot(["total"], flags, "flag", "repos").select(
        "flag", "repos", "total", percent(F.col("repos"), F.col("total")).alias("pct")
    )


def vuln_distribution(card: DataFrame) -> DataFrame:
    """Repositories per vulnerability bucket."""
    n, known = F.col("vuln_count"), F.col("vuln_data_available")
    buckets = {
        "unknown": ~known | n.isNull(),
        "zero": known & (n == 0),
        "one_to_five": known & n.between(1, 5),
        "six_to_ten": known & n.between(6, 10),
        "over_ten": known & (n > 10),
    }
    wide = card.agg(
        F.count("repo_full_name").alias("total"),
        *[F.count_if(c).alias(name) for name, c in buckets.items()],
    )
    return wide.unpivot(["total"], list(buckets), "bucket", "repos").select(
        "bucket", "repos", "total", percent(F.col("repos"), F.col("total")).alias("pct")
    )


def push_coverage(health: DataFrame, scored: DataFrame) -> DataFrame:
    """How many scores rest on real push data, with the mean scores of each group."""
    joined = health.select("repo_full_name", "commits_per_week", "contributor_count").join(
        scored, "repo_full_name"
    )
    groups = joined.groupBy(
        F.when(F.col("commits_per_week").isNull(), "no_push_events")
        .otherwise("has_push_events")
        .alias("push_coverage"),
        F.when(F.col("contributor_count").isNull(), "no_contributor_data")
        .otherwise("has_contributor_data")
        .alias("contrib_coverage"),
    ).agg(
        F.count(F.lit(1)).alias("project_count"),
        exact_mean(F.col("commit_score")).alias("avg_commit_score"),
        exact_mean(F.col("contributor_score")).alias("avg_contributor_score"),
        exact_mean(F.col("health_score")).alias("avg_health_score"),
    )
    # at most four groups are left, so the total over them needs one tiny window
    total = F.sum("project_count").over(Window.partitionBy())
    return groups.withColumn("pct", percent(F.col("project_count"), total))


def fallback_sample(health: DataFrame, scored: DataFrame, n: int = 20) -> DataFrame:
    """Best scored repositories among those without push or contributor data."""
    gaps = health.filter(
        F.col("commits_per_week").isNull() | F.col("contributor_count").isNull()
    ).select("repo_full_name", "commits_per_week", "contributor_count")
    return (
        gaps.join(
            scored.select("repo_full_name", "commit_score", "contributor_score", "health_score"),
            "repo_full_name",
        )
        .orderBy(F.desc("health_score"), "repo_full_name")
        .limit(n)
    )


def most_at_risk(df: DataFrame, n: int = 5, score: str = "health_score") -> DataFrame:
    return df.orderBy(F.col(score).asc_nulls_last(), "repo_full_name").limit(n)


def healthiest(df: DataFrame, n: int = 5, score: str = "health_score") -> DataFrame:
    return df.orderBy(F.col(score).desc_nulls_last(), "repo_full_name").limit(n)


def score_history(snapshots: DataFrame, repo: str) -> DataFrame:
    """Snapshots of one repository, oldest first."""
    return snapshots.filter(F.col("repo_full_name") == repo).orderBy("last_event_date")


def distinct_repos(df: DataFrame) -> DataFrame:
    return df.select("repo_full_name").distinct().orderBy("repo_full_name")


def paginate(df: DataFrame, page: int, size: int = 25) -> DataFrame:
    """One page, weakest score first, in a stable order."""
    ordered = df.orderBy(F.col("health_score").asc_nulls_last(), "repo_full_name")
    return ordered.offset((page - 1) * size).limit(size)


def page_after(df: DataFrame, score: float | None, repo: str | None, size: int = 25) -> DataFrame:
    """The page that follows a row of the last one, in the order of ``paginate``; the first page without a row.

    What lies before is filtered out, so each task keeps ``size`` rows however deep the page is.
    """
    rank, name = F.col("health_score"), F.col("repo_full_name")
    if repo is None:
        rest = F.lit(True)
    elif score is None:
        rest = rank.isNull() & (name > repo)
    else:
        rest = (rank > score) | ((rank == score) & (name > repo)) | rank.isNull()
    return df.filter(rest).orderBy(rank.asc_nulls_last(), "repo_full_name").limit(size)


def page_count(rows: int, size: int = 25) -> int:
    return max(1, math.ceil(rows / size))


def page_info(df: DataFrame, size: int = 25) -> DataFrame:
    """Row count and number of pages."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("rows") / size)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", pages.alias("pages"))


def top_items_per_repo(items: DataFrame, n: int, pull_requests: bool = False) -> DataFrame:
    """The n most recently updated open items per repository, newest first.

    The rank is cut before items are gathered, so a list never exceeds n.
    """
    w = Window.partitionBy("repo_full_name").orderBy(F.desc("updated_at"), F.desc("number"))
    wanted = F.col("is_pull_request") if pull_requests else ~F.col("is_pull_request")
    fields = [c for c in items.columns if c not in ("repo_full_name", "is_pull_request")]
    return (
        items.filter(wanted & (F.col("state") == "open"))
        .withColumn("_n", F.row_number().over(w))
        .filter(F.col("_n") <= n)
        .groupBy("repo_full_name")
        .agg(F.sort_array(F.collect_list(F.struct("_n", *fields))).alias("_items"))
        .select(
            "repo_full_name",
            F.transform(
                "_items", lambda x: F.struct(*[x.getField(c).alias(c) for c in fields])
            ).alias("items"),
        )
    )
