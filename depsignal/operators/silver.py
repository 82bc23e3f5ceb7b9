"""Bronze events to typed, deduplicated silver events."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.functions import names

_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def event_time(created_at) -> Column:
    """Parsed event time; NULL for malformed text. The written clock time is kept."""
    return F.try_to_timestamp(created_at, F.lit(_TIMESTAMP))


def filter_event_types(bronze: DataFrame, types=schemas.EVENT_TYPES) -> DataFrame:
    return bronze.filter(F.col("type").isin(*types))


def filter_watchlist(bronze: DataFrame, projects: DataFrame) -> DataFrame:
    """Events of watched repositories; events without a repository are dropped.

    No broadcast hint: the list is a table, so its measured size decides.
    """
    watched = projects.select(F.concat_ws("/", "org", "repo").alias("_repo"))
    return bronze.join(watched, F.col("repo.name") == F.col("_repo"), "left_semi")


def to_silver(bronze: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Flatten nested events into the 13 silver columns.

    The key hashes the raw timestamp text; the text is parsed once, in a
    projection of its own. A missing commit array gives NULL, an empty one 0.
    ``ingested_at`` may refer to ``event_time``.
    """
    actor, repo, commits = F.col("actor.login"), F.col("repo.name"), F.col("payload.commits")
    key = names.event_key(F.col("type"), actor, repo, F.col("created_at"))
    timed = bronze.withColumn("event_time", event_time("created_at"))
    return timed.select(
        key.alias("event_id"),
        F.col("type").alias("event_type"),
        actor.alias("actor_login"),
        F.col("actor.id").cast("bigint").alias("actor_id"),
        repo.alias("repo_full_name"),
        F.col("repo.id").cast("bigint").alias("repo_id"),
        F.col("event_time").alias("created_at"),
        F.to_date("event_time").alias("event_date"),
        F.col("payload.action").alias("payload_action"),
        F.when(commits.isNotNull(), F.size(commits)).alias("payload_commits"),
        names.org_of(repo).alias("org_name"),
        names.name_of(repo).alias("repo_name"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
    )


def require_keys(silver: DataFrame) -> DataFrame:
    return silver.dropna(subset=["event_id", "repo_full_name", "event_date"])


# Columns in which copies of one event can differ: all others are part of the
# hashed key or follow from it.
TIES = ("actor_id", "payload_action", "payload_commits", "repo_id")


def dedup_latest(
    silver: DataFrame, key: str = "event_id", order: str = "ingested_at", ties=TIES
) -> DataFrame:
    """One row per key, the newest one; ``ties`` decide between equally new rows.

    The rank filter becomes a group limit before the shuffle, so even a key
    with very many copies sends one row per task. Ordering by few columns lets
    the optimizer drop every column that the caller does not read.
    """
    w = Window.partitionBy(key).orderBy(
        F.col(order).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in ties]
    )
    return silver.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def staged_events(silver: DataFrame, types=None) -> DataFrame:
    """Deduplicated events, of all types or of the given ones.

    A filter on the type does not pass the window by itself. Applying it first
    is safe, because the type is part of the key, and shuffles less.
    """
    rows = silver.filter(F.col("event_type").isin(*types)) if types else silver
    return dedup_latest(rows)


def bronze_to_silver(bronze: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Type filter, projection and key check in one narrow stage.

    The event key cannot be NULL, so the check names only the other two
    columns: testing the key as well would hash every event twice.
    """
    kept = filter_event_types(bronze).filter(F.col("repo.name").isNotNull())
    return to_silver(kept, ingested_at).dropna(subset=["event_date"])
