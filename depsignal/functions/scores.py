"""Scoring rules as column expressions. A missing signal scores a neutral 5.0."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 5.0

# Weights of the composite score.
WEIGHTS = (
    ("commit_score", 0.20),
    ("issue_score", 0.15),
    ("pr_score", 0.15),
    ("contributor_score", 0.15),
    ("bus_factor_score", 0.00),
    ("governance_score", 0.20),
    ("security_score", 0.15),
)

# Governance points, 12 in total.
GOVERNANCE_POINTS = (
    ("is_maintained", 4),
    ("has_license", 2),
    ("is_branch_protected", 2),
    ("requires_code_review", 2),
    ("has_security_policy", 2),
)


def _scored(signal: Column, score: Column) -> Column:
    return F.round(F.when(signal.isNull(), F.lit(NEUTRAL)).otherwise(score), 2)


def log_rate_score(rate: Column) -> Column:
    """Logarithmic scale for weekly rates; ten per week reaches the cap."""
    scaled = F.log10(F.lit(1.0) + rate * F.lit(50.0)) / F.log10(F.lit(501.0)) * F.lit(10.0)
    return _scored(rate, F.least(scaled, F.lit(10.0)))


def issue_score(rate: Column) -> Column:
    return _scored(rate, F.least(rate, F.lit(1.0)) * F.lit(10.0))


def contributor_score(count: Column) -> Column:
    share = F.least(count.cast("double") / F.lit(20.0), F.lit(1.0))
    return _scored(count, share * F.lit(10.0))


def bus_factor_score(risk: Column) -> Column:
    return _scored(risk, (F.lit(1.0) - risk) * F.lit(10.0))


def governance_score() -> Column:
    """Points for the flags that are true; NULL flags earn nothing."""
    points = reduce(
        add, [F.when(F.col(c), F.lit(n)).otherwise(F.lit(0)) for c, n in GOVERNANCE_POINTS]
    )
    return F.round(points / F.lit(12.0) * F.lit(10.0), 2)


def vuln_score() -> Column:
    """Neutral when the count is missing or flagged unavailable.

    An unknown flag (NULL) with a count present is scored by the count.
    """
    unknown = ~F.col("vuln_data_available") | F.col("vuln_count").isNull()
    counted = F.greatest(F.lit(0.0), F.lit(10.0) - F.col("vuln_count").cast("double") * F.lit(2.0))
    return F.round(F.when(unknown, F.lit(NEUTRAL)).otherwise(counted), 2)


def dep_update_score() -> Column:
    return F.when(F.col("has_dep_update_tool"), F.lit(10.0)).otherwise(F.lit(0.0))


def security_score() -> Column:
    return F.round(vuln_score() * F.lit(0.6) + dep_update_score() * F.lit(0.4), 2)


def composite_score() -> Column:
    return F.round(reduce(add, [F.col(c) * F.lit(w) for c, w in WEIGHTS]), 2)


def risk_score(score: Column) -> Column:
    """Distance from full health in [0, 1], unrounded; 0.5 without a usable score."""
    number = score.try_cast("double")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(10.0), number))
    return F.when(number.isNull(), F.lit(0.5)).otherwise((F.lit(10.0) - clamped) / F.lit(10.0))


def risk_action(score: Column, replace: float = 0.65, upgrade: float = 0.50) -> Column:
    """REPLACE, UPGRADE or MONITOR, decided on the unrounded risk."""
    risk = risk_score(score)
    return (
        F.when(score.try_cast("double").isNull(), "MONITOR")
        .when(risk >= replace, "REPLACE")
        .when(risk >= upgrade, "UPGRADE")
        .otherwise("MONITOR")
    )


def band(score: Column, lo: float = 5.0, hi: float = 7.0) -> Column:
    return (
        F.when(score.isNull(), "N/A")
        .when(score >= hi, "Healthy")
        .when(score >= lo, "Warning")
        .otherwise("Critical")
    )


def is_maintained(pushed_at: Column, as_of: Column) -> Column:
    """Pushed less than 90 days before ``as_of``; NULL when the text is no timestamp."""
    pushed = F.try_to_timestamp(pushed_at)
    return pushed > as_of.cast("timestamp") - F.expr("INTERVAL 90 DAYS")
