"""The watch-list: union, lookup, onboarding, validation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECT_COLUMNS = ["org", "repo", "category", "description"]


def full_name() -> Column:
    return F.concat_ws("/", "org", "repo")


def all_projects(*lists: DataFrame) -> DataFrame:
    """Concatenation of the category lists; duplicates stay."""
    union = lists[0]
    for one in lists[1:]:
        union = union.unionByName(one)
    return union


def project_set(projects: DataFrame) -> DataFrame:
    return projects.select(full_name().alias("repo_full_name")).distinct()


def projects_by_category(projects: DataFrame, category: str) -> DataFrame:
    return projects.filter(F.col("category") == category)


def category_counts(projects: DataFrame) -> DataFrame:
    return projects.groupBy("category").agg(F.count(F.lit(1)).alias("projects")).orderBy("category")


def new_projects(resolved: DataFrame, watchlist: DataFrame, order: list[str]) -> DataFrame:
    """Flag each resolved project: added for the first new occurrence, else present.

    ``order`` holds the columns that define the input order.
    """
    known = project_set(watchlist).withColumn("_known", F.lit(True))
    marked = resolved.withColumn("repo_full_name", full_name()).join(
        known, "repo_full_name", "left"
    )
    firsts = (
        resolved.withColumn("repo_full_name", full_name())
        .groupBy("repo_full_name")
        .agg(F.min(F.struct(*order)).alias("_first"))
    )
    is_first = F.struct(*order) == F.col("_first")
    return (
        marked.join(firsts, "repo_full_name")
        .withColumn("added", F.col("_known").isNull() & is_first)
        .drop("_known", "_first")
    )


def remove_project(projects: DataFrame, repo: str) -> DataFrame:
    """Drop one discovered entry; curated lists stay untouched."""
    return projects.filter(~((F.col("category") == "discovered") & (full_name() == repo)))


def was_discovered(projects: DataFrame, repo: str) -> DataFrame:
    """One row that tells whether the entry is there to be removed."""
    hit = (F.col("category") == "discovered") & (full_name() == repo)
    return projects.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("found"))


def validate_projects(projects: DataFrame, lists: DataFrame, minimum: int = 800) -> DataFrame:
    """Number of failures per structural rule.

    ``projects`` carries the name of its list in ``list_name``; ``lists`` gives
    the category each list must hold. A NULL value is a missing key.
    """
    missing = F.exists(F.array(*PROJECT_COLUMNS), lambda x: x.isNull())
    empty = F.exists(F.array(*PROJECT_COLUMNS), lambda x: F.coalesce(F.trim(x) == "", F.lit(False)))
    per_list = projects.groupBy("list_name").agg(F.count(F.lit(1)).alias("n"))
    expected = lists.join(per_list, "list_name", "left")
    checked = projects.join(lists, "list_name", "left")
    wrong = ~F.col("category").eqNullSafe(F.col("expected_category"))
    rows = checked.agg(
        F.count_if(missing).alias("missing_key"),
        F.count_if(empty).alias("blank_value"),
        F.count_if(wrong).alias("category_mismatch"),
    )
    names = (
        projects.groupBy(
            F.concat(F.coalesce("org", F.lit("")), F.lit("/"), F.coalesce("repo", F.lit(""))).alias(
                "_name"
            )
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("_total"),
        )
        .select("duplicate", F.when(F.col("_total") < minimum, 1).otherwise(0).alias("too_few"))
    )
    lists_empty = expected.agg(F.count_if(F.col("n").isNull()).alias("empty_list"))

    def long(df, *columns):
        return df.select(*[F.col(c).cast("bigint").alias(c) for c in columns]).unpivot(
            [], list(columns), "rule", "failures"
        )

    return (
        long(rows, "missing_key", "blank_value", "category_mismatch")
        .unionByName(long(names, "duplicate", "too_few"))
        .unionByName(long(lists_empty, "empty_list"))
    )
