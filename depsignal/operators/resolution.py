"""Packages to repositories, and what that means for the watch-list."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depsignal.functions.names import github_slug, go_module_slug
from depsignal.operators.watchlist import project_set
from depsignal.sources.tables import materialize_once

# Packages whose registry entry is known to mislead.
KNOWN = (
    ("pinecone", "pinecone-io/pinecone-python-client"),
    ("pandas", "pandas-dev/pandas"),
    ("numpy", "numpy/numpy"),
    ("scipy", "scipy/scipy"),
    ("matplotlib", "matplotlib/matplotlib"),
    ("sqlalchemy", "sqlalchemy/sqlalchemy"),
    ("fastapi", "tiangolo/fastapi"),
    ("celery", "celery/celery"),
    ("redis", "redis/redis-py"),
    ("httpx", "encode/httpx"),
    ("pytest", "pytest-dev/pytest"),
    ("openai", "openai/openai-python"),
)

# The ecosystems whose packages can be resolved.
ECOSYSTEMS = ("python", "node", "java", "go", "rust")

# Project URL keys in order of trust.
PROJECT_URL_KEYS = ("Source", "Source Code", "Homepage", "Repository", "Code")


def _hit(slug: Column, source: str, confidence: str) -> Column:
    return F.when(
        slug.isNotNull(),
        F.struct(
            slug.alias("full_name"),
            F.lit(source).alias("source"),
            F.lit(confidence).alias("confidence"),
        ),
    )


_HIT = "struct<full_name:string,source:string,confidence:string>"


def _registry_hit(registry: DataFrame) -> DataFrame:
    """Best repository per registry entry, by the rules of its ecosystem.

    The URLs are parsed in a projection of their own, so that each is parsed
    once however often the rules below mention it.
    """
    eco = F.col("ecosystem")
    urls = [github_slug(F.col("project_urls")[k]) for k in PROJECT_URL_KEYS]
    search = F.lit(None).cast("string")
    if "search_hit" in registry.columns:
        search = F.when(F.col("search_hit").contains("/"), F.col("search_hit"))
    parsed = registry.select(
        "ecosystem",
        "name",
        F.coalesce(*urls).alias("_urls"),
        github_slug(F.col("repository")).alias("_repository"),
        github_slug(F.col("home_page")).alias("_home"),
        search.alias("_found"),
    )
    urls, home, repository = F.col("_urls"), F.col("_home"), F.col("_repository")
    hit = (
        F.when(
            eco == "python", F.coalesce(_hit(urls, "pypi", "high"), _hit(home, "pypi", "medium"))
        )
        .when(
            eco == "node", F.coalesce(_hit(repository, "npm", "high"), _hit(home, "npm", "medium"))
        )
        .when(
            eco == "rust",
            F.coalesce(_hit(repository, "crates", "high"), _hit(home, "crates", "high")),
        )
    )
    # a package of an ecosystem outside the five is never searched for
    found = F.when(eco.isin(*ECOSYSTEMS), _hit(F.col("_found"), "github_search", "low"))
    return parsed.select(
        "ecosystem",
        "name",
        hit.cast(_HIT).alias("_registry"),
        found.cast(_HIT).alias("_search"),
    )


def resolve_distinct(packages: DataFrame, cache: DataFrame, registry: DataFrame) -> DataFrame:
    """Resolve distinct (ecosystem, name) pairs.

    A cache entry wins even when it says "not found"; then the fixed mapping,
    the registry (or the module path for Go), and last a search hit.
    """
    spark = packages.sparkSession
    known = spark.createDataFrame(KNOWN, "_key STRING, _known STRING")
    cached = cache.select(
        "ecosystem",
        "name",
        F.lit(True).alias("_cached"),
        F.when(
            F.col("org").isNotNull(),
            F.struct(F.concat_ws("/", "org", "repo").alias("full_name"), "source", "confidence"),
        ).alias("_cache"),
    )
    go = _hit(F.col("_module"), "go_module", "high")
    best = F.when(F.col("_cached"), F.col("_cache")).otherwise(
        F.coalesce(_hit(F.col("_known"), "known_mapping", "high"), "_registry", go, "_search")
    )
    module = F.when(F.col("ecosystem") == "go", go_module_slug(F.col("name")))
    return (
        packages.withColumn("_module", module)
        .join(cached, ["ecosystem", "name"], "left")
        .join(F.broadcast(known), F.lower("name") == F.col("_key"), "left")  # twelve fixed rows
        .join(_registry_hit(registry), ["ecosystem", "name"], "left")
        .select(*packages.columns, best.alias("_best"))
        .select(
            *packages.columns,
            F.col("_best.full_name").alias("full_name"),
            F.substring_index("_best.full_name", "/", 1).alias("org"),
            F.expr("substring(_best.full_name, instr(_best.full_name, '/') + 1)").alias("repo"),
            F.col("_best.source").alias("source"),
            F.col("_best.confidence").alias("confidence"),
        )
    )


def resolve_packages(
    deps: DataFrame,
    cache: DataFrame,
    registry: DataFrame,
    watchlist: DataFrame,
    order: list[str],
    stage=materialize_once,
) -> DataFrame:
    """One row per distinct package with its outcome.

    Status is ``unresolved``, ``monitored``, ``repeated`` (an earlier package
    already stands for the repository) or ``resolved``. Packages are reduced
    to distinct ones with their count and first position before any join, so
    a package named in a third of all manifests costs one row. The resolved
    packages are stored once, because the first one per repository is looked
    up among them; packages without a repository stay out of that join, as
    their NULL keys would all meet in one task.
    """
    packages = deps.groupBy("ecosystem", "name").agg(
        F.count(F.lit(1)).alias("occurrences"), F.min(F.struct(*order)).alias("first")
    )
    found = stage(resolve_distinct(packages, cache, registry))
    hits = found.filter(F.col("full_name").isNotNull())
    place = F.struct("first", "ecosystem", "name")
    firsts = hits.groupBy("full_name").agg(F.min(place).alias("_lead"))
    watched = project_set(watchlist).select(
        F.col("repo_full_name").alias("full_name"), F.lit(True).alias("_watched")
    )
    status = (
        F.when(F.col("_watched"), "monitored")
        .when(place == F.col("_lead"), "resolved")
        .otherwise("repeated")
    )
    known = (
        hits.join(firsts, "full_name")
        .join(watched, "full_name", "left")
        .select(*found.columns, status.alias("status"))
    )
    missed = found.filter(F.col("full_name").isNull())
    return known.unionByName(missed.withColumn("status", F.lit("unresolved")))


def discovered_projects(resolved: DataFrame) -> DataFrame:
    """Watch-list rows for newly resolved repositories."""
    return resolved.filter(F.col("status") == "resolved").select(
        "org",
        "repo",
        F.lit("discovered").alias("category"),
        F.format_string(
            "Discovered from manifest (%s package: %s)", F.col("ecosystem"), F.col("name")
        ).alias("description"),
    )


def classify_dependencies(
    deps: DataFrame, resolved: DataFrame, scores: DataFrame
) -> DataFrame:
    """Every dependency sorted into ready, added or unresolved.

    Monitored repositories appear once per dependency, with their score or
    NULL; an added repository appears once; unresolved packages once per
    dependency.
    """
    health = scores.select(F.col("repo_full_name").alias("full_name"), "health_score")
    none = F.lit(None).cast("double")

    def outcome(status, label):
        return resolved.filter(F.col("status") == status).select(
            F.lit(label).alias("outcome"), "ecosystem", "name", "full_name", "confidence"
        )

    # only monitored repositories are looked up among the scores
    ready = outcome("monitored", "ready").withColumn("confidence", F.lit(None).cast("string"))
    ready = ready.join(health, "full_name", "left")
    missed = outcome("unresolved", "unresolved").withColumn("health_score", none)
    per_package = ready.unionByName(missed)
    each = deps.select("ecosystem", "name").join(per_package, ["ecosystem", "name"])
    return each.unionByName(outcome("resolved", "added").withColumn("health_score", none))


def updated_cache(cache: DataFrame, resolved: DataFrame) -> DataFrame:
    """The cache with an entry for each package resolved just now; one not found gets a negative entry.

    Entries that are there already stay as they are.
    """
    fresh = (
        resolved.join(cache.select("ecosystem", "name"), ["ecosystem", "name"], "left_anti")
        .select(
            "ecosystem",
            "name",
            F.substring_index("full_name", "/", 1).alias("org"),
            F.when(F.col("full_name").isNotNull(), F.expr("substring(full_name, instr(full_name, '/') + 1)")).alias("repo"),
            "source",
            "confidence",
        )
        .distinct()
    )
    return cache.select(fresh.columns).unionByName(fresh)


def resolution_summary(resolved: DataFrame) -> DataFrame:
    """Counts of dependencies by outcome and the share of new repositories."""

    def deps(*status):
        return F.coalesce(
            F.sum(F.when(F.col("status").isin(*status), F.col("occurrences"))), F.lit(0)
        )

    return resolved.agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("parsed"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        deps("unresolved").alias("unresolved"),
    ).select(
        "*",
        (F.col("parsed") - F.col("resolved") - F.col("unresolved")).alias("already_monitored"),
        F.coalesce(
            F.bround(F.col("resolved") / F.nullif(F.col("parsed"), F.lit(0)) * 100, 0), F.lit(0.0)
        ).alias("resolved_pct"),
    )
