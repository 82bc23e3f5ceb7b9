"""Exact vector search over assessment embeddings."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels a search may be restricted to.
LABELS = ("REPLACE", "UPGRADE", "MONITOR")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(embedding: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with a constant vector that is normalised once."""
    length = sum(x * x for x in query) ** 0.5
    unit = F.array(*[F.lit(float(x) / length) for x in query])
    return _dot(embedding, unit) / F.nullif(F.sqrt(_dot(embedding, embedding)), F.lit(0.0))


def cosine_topk(
    vectors: DataFrame,
    query: Sequence[float] | None,
    k: int = 5,
    label=None,
    label_column: str = "recommendation",
    accepted: Sequence = LABELS,
    key: str = "vec_id",
) -> DataFrame:
    """The k most similar vectors, best first; ties follow the id.

    The label filter runs before any arithmetic. Each task keeps its own k
    best rows, so only k rows per task travel. Without a query there are no
    rows; an unknown label is an error. A zero vector sorts last.
    """
    if label is not None and label not in accepted:
        raise ValueError(f"unknown label {label!r}, expected one of {list(accepted)}")
    rows = vectors if label is None else vectors.filter(F.col(label_column) == label)
    if not query or not any(query):
        return rows.limit(0).withColumn("similarity", F.lit(0.0))
    return (
        rows.withColumn("_s", cosine(F.col("embedding"), query))
        .orderBy(F.desc_nulls_last("_s"), key)
        .limit(k)
        .withColumn("similarity", F.round("_s", 4))
        .drop("_s")
    )


def index_stats(vectors: DataFrame, namespace: str = "namespace") -> DataFrame:
    """Vectors per namespace beside the total."""
    return (
        vectors.rollup(namespace)
        .agg(F.count(F.lit(1)).alias("vectors"), F.grouping(namespace).alias("_all"))
        .select(
            F.when(F.col("_all") == 1, "all")
            .otherwise(F.col(namespace).cast("string"))
            .alias("namespace"),
            "vectors",
        )
    )
