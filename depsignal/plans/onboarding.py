"""Dependency manifests to watch-list changes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsignal.operators.manifests import parse_manifests
from depsignal.operators.resolution import classify_dependencies, resolve_packages
from depsignal.sources.tables import materialize_once


def onboard(
    files: DataFrame, cache: DataFrame, registry: DataFrame, watchlist: DataFrame, scores: DataFrame
) -> DataFrame:
    """Manifest texts to ready, added and unresolved dependencies, and unsupported files.

    Parsed dependencies and resolved packages are each stored once, since
    several steps read them.
    """
    parsed = materialize_once(parse_manifests(files))
    deps = parsed.filter(F.col("error").isNull())
    order = ["file_name", "pos"]
    resolved = materialize_once(resolve_packages(deps, cache, registry, watchlist, order))
    # a file that gave no dependencies is reported under its own name
    unsupported = parsed.filter(F.col("error").isNotNull()).select(
        F.lit("unsupported").alias("outcome"), F.col("file_name").alias("name")
    )
    return classify_dependencies(deps, resolved, scores).unionByName(unsupported.distinct(), allowMissingColumns=True)
