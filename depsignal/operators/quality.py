"""Data tests. Each result lists failing rows; no rows or zero counts mean passed."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsignal.schemas import EVENT_TYPES


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs per column, counted in one pass."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "failures")


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys seen more than once; NULL is not tested."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def check_accepted(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Values outside the accepted set, with their counts; NULL is not tested."""
    return (
        df.filter(~F.col(column).isin(*values))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("failures"))
    )


def check_range(df: DataFrame, columns: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Values outside [lo, hi] per column, counted in one pass."""
    wide = df.agg(*[F.count_if(~F.col(c).between(lo, hi)).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "failures")


# The declared tests as (table, test, columns).
SCORE_RANGE = (
    "health_score",
    "commit_score",
    "issue_score",
    "pr_score",
    "contributor_score",
    "bus_factor_score",
)
DECLARED = (
    ("silver", "not_null", ("event_id", "event_type", "repo_full_name", "event_date")),
    ("staged", "not_null", ("event_id", "event_type", "repo_full_name", "event_date")),
    ("staged", "unique", ("event_id",)),
    ("staged", "accepted_values", ("event_type",)),
    ("health", "not_null", ("repo_full_name", "data_days_available")),
    ("health", "unique", ("repo_full_name",)),
    ("scores", "not_null", ("repo_full_name", "health_score", "data_days_available")),
    ("scores", "unique", ("repo_full_name",)),
    ("scores", "accepted_range", SCORE_RANGE),
)


def declared_tests(tables: dict[str, DataFrame]) -> DataFrame:
    """Failures of all 23 declared tests on the tables silver, staged, health and scores.

    One pass per table and kind of test; only counts leave a pass.
    """

    def failures(df, test, columns):
        if test == "not_null":
            return check_not_null(df, columns)
        if test == "accepted_range":
            return check_range(df, columns, 0, 10)
        (column,) = columns
        bad = (
            check_unique(df, column).select(F.lit(1).alias("n"))
            if test == "unique"
            else check_accepted(df, column, EVENT_TYPES).select(F.col("failures").alias("n"))
        )
        return bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failures")).select(
            F.lit(column).alias("column"), "failures"
        )

    results = [
        failures(tables[table], test, columns).select(
            F.lit(table).alias("table_name"), F.lit(test).alias("test"), "column", "failures"
        )
        for table, test, columns in DECLARED
    ]
    return reduce(DataFrame.unionByName, results)
