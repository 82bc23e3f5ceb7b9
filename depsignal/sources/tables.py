"""Tables derived once and stored: staging, models, overwrites, upserts, exports."""

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depsignal import schemas
from depsignal.session import scratch_path


def materialize_once(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a frame once and read it back, so that several readers share one run.

    The files live in the shared scratch folder: losing an executor costs no
    recomputation, and every reader prunes the columns it does not need.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "staged")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def overwrite_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a table by the rows without an error; refuse when none is left."""
    spark = df.sparkSession
    rows = df
    if "error" in df.columns:
        rows = df.filter(F.col("error").isNull()).drop("error")
    staged = materialize_once(rows)
    if staged.isEmpty():
        raise ValueError(f"no rows to write to {name}")
    writer = staged.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return spark.table(name)


def build_model(spark: SparkSession, name: str, df: DataFrame, path: str | None = None) -> DataFrame:
    """Register a model: gold models become stored tables, all others views."""
    if name.startswith("gold_"):
        writer = df.write.mode("overwrite").format("parquet")
        if path:
            writer = writer.option("path", path)
        writer.saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
    return spark.table(name)


def build_models(
    spark: SparkSession,
    models: Iterable[tuple[str, Callable[[SparkSession], DataFrame]]],
    select: Iterable[str] | None = None,
    root: str | None = None,
) -> list[str]:
    """Build models in the given order, or only the selected ones; returns what was built."""
    chosen = None if select is None else set(select)
    built = []
    for name, make in models:
        if chosen is not None and name not in chosen:
            continue
        build_model(spark, name, make(spark), f"{root}/{name}" if root else None)
        built.append(name)
    if not built:
        raise ValueError("no model matches the selection")
    return built


def export_csv(scores: DataFrame, path: str) -> None:
    """The eight download columns with a header."""
    scores.select(*schemas.EXPORT_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def upsert_by_id(
    target: DataFrame, new: DataFrame, key: str, order: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Target rows with the same id give way to the newest incoming row.

    ``ties`` decide between equally new rows, larger values first; without them
    the caller vouches that ``order`` is unique for each id.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in (order, *ties)])
    newest = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    kept = target.join(newest.select(key), key, "left_anti")
    return kept.unionByName(newest)


def upsert_table(
    spark: SparkSession, name: str, new: DataFrame, key: str, order: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Upsert into the stored table ``name``, which is created if it is missing.

    The new state is written to a folder of its own; then the catalog's entry
    is changed to it in one step, so a failure on the way leaves the old table
    whole. The old folder stays for readers. ``versions`` rewrites touched parts only.
    """
    fresh = scratch_path(spark, name)
    known = spark.catalog.tableExists(name)
    old = spark.table(name) if known else new.limit(0)
    upsert_by_id(old, new, key, order, ties).write.parquet(fresh)
    if known:
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{fresh}'")
        spark.catalog.refreshTable(name)
    else:
        spark.catalog.createTable(name, path=fresh, source="parquet")
    return spark.table(name)
