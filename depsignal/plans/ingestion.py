"""Event files to silver."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.operators.silver import bronze_to_silver, filter_watchlist
from depsignal.sources.events import (
    append_silver,
    days_of,
    merge_insert_only,
    merge_into_path,
    read_events,
    split_corrupt,
)
from depsignal.sources.tables import materialize_once


def load_silver(
    spark: SparkSession,
    paths,
    target: str,
    projects: DataFrame | None = None,
    ingested_at: Column | None = None,
) -> DataFrame:
    """Read event files, keep watched repositories, insert new events below ``target``.

    Everything up to the merge is one narrow stage apart from the watch-list
    join. The batch is stored once: its day span and its rows are both needed.
    Running the same files again inserts nothing.
    """
    clean, _ = split_corrupt(read_events(spark, paths))
    if projects is not None:
        clean = filter_watchlist(clean, projects)
    batch = materialize_once(bronze_to_silver(clean, ingested_at))
    merge_into_path(spark, target, batch)
    return batch


def load_silver_counted(
    spark: SparkSession,
    paths,
    target: str,
    projects: DataFrame | None = None,
    ingested_at: Column | None = None,
) -> dict[str, int]:
    """``load_silver`` with its counters: raw, corrupt, kept, sent, inserted and duplicate.

    Lines are observed as they are read for the batch. What is sent and what is
    inserted is stored before it goes on, and its files know their row numbers.
    """
    lines = Observation()
    raw = read_events(spark, paths)
    numbers = (F.count(F.lit(1)).alias("raw"), F.count_if(F.col(schemas.CORRUPT).isNotNull()).alias("corrupt"))
    clean, _ = split_corrupt(raw.observe(lines, *numbers))
    batch = materialize_once(clean)
    if projects is not None:
        clean = filter_watchlist(batch, projects)
    else:
        clean = batch
    silver = materialize_once(bronze_to_silver(clean, ingested_at))
    stored = spark.read.schema(schemas.SILVER).parquet(target)
    fresh = materialize_once(merge_insert_only(stored, silver, days=days_of(silver)))
    append_silver(fresh, target)
    sent, inserted, read = silver.count(), fresh.count(), lines.get
    return {
        "raw": read["raw"],
        "corrupt": read["corrupt"],
        "kept": read["raw"] - read["corrupt"],
        "sent": sent,
        "inserted": inserted,
        "duplicate": sent - inserted,
    }


def start_silver(empty: DataFrame, target: str) -> None:
    """Create an empty silver folder, so that a first merge finds a table."""
    append_silver(empty.limit(0), target)
