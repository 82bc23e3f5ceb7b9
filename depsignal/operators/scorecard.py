"""Scorecard flags from hosting-API payloads, and the two scores derived from them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsignal.functions import scores

# Language to package ecosystem.
LANGUAGE_ECOSYSTEM = (
    ("Python", "PyPI"),
    ("JavaScript", "npm"),
    ("TypeScript", "npm"),
    ("Go", "Go"),
    ("Rust", "crates.io"),
    ("Java", "Maven"),
    ("Ruby", "RubyGems"),
    ("PHP", "Packagist"),
    ("C#", "NuGet"),
    ("Kotlin", "Maven"),
    ("Scala", "Maven"),
)

# Files that show a dependency updater or a security policy.
UPDATER_FILES = (
    ".github/dependabot.yml",
    ".github/dependabot.yaml",
    "renovate.json",
    ".renovaterc",
    ".renovaterc.json",
)
POLICY_FILES = ("SECURITY.md", ".github/SECURITY.md", "docs/SECURITY.md")

_BRANCH = (
    "protected BOOLEAN, protection STRUCT<"
    "required_pull_request_reviews: STRING, "
    "required_status_checks: STRUCT<enforcement_level: STRING>>"
)
_META = "language STRING, pushed_at STRING, license STRING"


def language_ecosystem(repos: DataFrame) -> DataFrame:
    """Add the ecosystem of ``language``; unmapped languages give NULL.

    The lookup has eleven fixed rows, so broadcasting it is safe.
    """
    lookup = repos.sparkSession.createDataFrame(
        LANGUAGE_ECOSYSTEM, "language STRING, ecosystem STRING"
    )
    return repos.join(F.broadcast(lookup), "language", "left")


def governance(card: DataFrame) -> DataFrame:
    return card.select(
        "repo_full_name",
        "is_maintained",
        "has_license",
        "is_branch_protected",
        "requires_code_review",
        "has_security_policy",
        scores.governance_score().alias("governance_score"),
    )


def security(card: DataFrame) -> DataFrame:
    return card.select(
        "repo_full_name",
        "vuln_count",
        "vuln_data_available",
        "has_dep_update_tool",
        scores.vuln_score().alias("vuln_score"),
        scores.dep_update_score().alias("dep_update_score"),
        scores.security_score().alias("security_score"),
    )


def governance_and_security(card: DataFrame) -> DataFrame:
    """Both scores in one projection, so the scorecard is read and joined once."""
    return card.select(
        "repo_full_name",
        scores.governance_score().alias("governance_score"),
        "is_maintained",
        "has_license",
        "is_branch_protected",
        "requires_code_review",
        "has_security_policy",
        scores.security_score().alias("security_score"),
        "vuln_count",
        "vuln_data_available",
        "has_dep_update_tool",
    )


def scorecard(
    meta: DataFrame, branches: DataFrame, files: DataFrame, vulns: DataFrame, as_of: Column
) -> DataFrame:
    """Flags per repository.

    ``meta`` and ``branches`` hold one JSON ``body`` per repository, ``files``
    one row per existing path, ``vulns`` one row per known vulnerability with
    its package name (the repository's own name) and ecosystem. Files and
    vulnerabilities are counted per key before they are joined. Review counts
    as required only on protected branches. Without a known ecosystem the
    vulnerability count is NULL and flagged unavailable.
    """
    info = language_ecosystem(
        meta.select("repo_full_name", F.from_json("body", _META).alias("m")).select(
            "repo_full_name",
            F.col("m.language").alias("language"),
            scores.is_maintained(F.col("m.pushed_at"), as_of).alias("is_maintained"),
            F.col("m.license").isNotNull().alias("has_license"),
            F.substring_index("repo_full_name", "/", -1).alias("package"),
        )
    )
    protected = F.coalesce(F.col("b.protected"), F.lit(False))
    level = F.col("b.protection.required_status_checks.enforcement_level")
    review = F.col("b.protection.required_pull_request_reviews").isNotNull() | F.coalesce(
        level.isin("non_admins", "everyone"), F.lit(False)
    )
    guard = branches.select("repo_full_name", F.from_json("body", _BRANCH).alias("b")).select(
        "repo_full_name",
        protected.alias("is_branch_protected"),
        (protected & review).alias("requires_code_review"),
    )
    present = files.groupBy("repo_full_name").agg(
        F.bool_or(F.col("path").isin(*UPDATER_FILES)).alias("has_dep_update_tool"),
        F.bool_or(F.col("path").isin(*POLICY_FILES)).alias("has_security_policy"),
    )
    known = vulns.groupBy("package", "ecosystem").agg(F.count(F.lit(1)).alias("n"))

    def flag(name):
        return F.coalesce(F.col(name), F.lit(False)).alias(name)

    available = F.col("ecosystem").isNotNull()
    return (
        info.join(guard, "repo_full_name", "left")
        .join(present, "repo_full_name", "left")
        .join(known, ["package", "ecosystem"], "left")
        .select(
            "repo_full_name",
            "is_maintained",
            "has_license",
            flag("is_branch_protected"),
            flag("requires_code_review"),
            flag("has_security_policy"),
            F.when(available, F.coalesce("n", F.lit(0))).cast("int").alias("vuln_count"),
            available.alias("vuln_data_available"),
            flag("has_dep_update_tool"),
            "language",
        )
    )
