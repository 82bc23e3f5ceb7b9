"""Search of many query vectors: inverted lists over trained centroids, exact scores, partial top-k merged.

Vectors are stored with length 1 in the list of their nearest centroid. A
query looks into the lists whose centroids are nearest to it (``probes``), or into
all of them, which is the exact scan. The work is cut into cells: a part of
a list against a part of the queries that look into it. Both parts are bounded, so a
list or a query set of any size is many cells. A cell multiplies two small matrices
and keeps the k best of each query, and the kept rows of all cells are ranked once
more. Scores are cosines in double arithmetic; ties follow the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from depsignal.sources.tables import materialize_once

#: Vectors that centroids are trained on at most.
SAMPLE = 200_000
#: Vectors and queries of a cell.
CELL_VECTORS, CELL_QUERIES = 4096, 1024


@dataclass(frozen=True)
class Index:
    """Stored lists at ``path``, their sizes, and the centroids, a row for each list."""

    path: str
    key: str
    label: str
    centroids: np.ndarray
    sizes: dict[int, int]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


def unit(column: str) -> Column:
    """A vector with length 1, in double precision; NULL for a zero vector, one with a NULL or NaN, and no vector."""
    wide = F.transform(column, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((length > 0) & (length < float("inf")), F.transform(wide, lambda x: x / length))


def train_centroids(vectors: DataFrame, lists: int, column: str = "embedding", key: str = "vec_id", seed: int = 7) -> np.ndarray:
    """Centroids by k-means of a bounded sample of the directions."""
    sample = vectors.select(key, unit(column).alias("u")).filter("u IS NOT NULL").orderBy(F.xxhash64(key), key).limit(SAMPLE)
    sample = materialize_once(sample)
    found = KMeans(k=lists, seed=seed, maxIter=15, distanceMeasure="cosine", initMode="k-means||")
    model = found.fit(sample.select(array_to_vector("u").alias("features")))
    centers = np.array(model.clusterCenters())
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _nearest(rows: DataFrame, centroids: np.ndarray, count: int, kept: str) -> DataFrame:
    """The ``count`` nearest lists of each row's unit vector ``u``, nearest first; ``kept`` describes the other columns."""
    lists, width = centroids.shape
    count = min(count, lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _matrix(batch.column("u"), width) @ centroids.T
            best = np.argsort(-scores, axis=1, kind="stable")[:, :count].astype(np.int32)
            ends = np.arange(len(best) + 1, dtype=np.int32) * count
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "lists"])

    return rows.mapInArrow(run, f"{kept}, u array<double>, lists array<int>")


def build_index(
    vectors: DataFrame, path: str, lists: int, key: str = "vec_id", column: str = "embedding", label: str = "label"
) -> Index:
    """Store every vector that has a direction in the list of its nearest centroid, a folder for each list.

    Centroids are trained on at most SAMPLE vectors; all vectors are stored.
    """
    centroids = train_centroids(vectors, lists, column, key)
    kind, other = vectors.schema[key].dataType.simpleString(), vectors.schema[label].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), unit(column).alias("u")).filter("u IS NOT NULL")
    placed = _nearest(rows, centroids, 1, f"id {kind}, label {other}").select("id", "label", "u", F.col("lists")[0].alias("list"))
    placed.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(path)
    stored = vectors.sparkSession.read.parquet(path)
    # as many rows as lists
    sizes = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}
    return Index(path, key, label, centroids, sizes)


def _cells(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best of a part of a list for each of the queries of a cell."""
    vectors, ids = left["u"], left["id"].to_numpy()
    width = len(vectors[0])
    order = np.argsort(ids, kind="stable")
    matrix, ids = _matrix(vectors, width)[order], ids[order]
    scores = _matrix(right["u"], width) @ matrix.T
    # equal scores keep the order of ids
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    count = best.shape[1]
    queries = right["query"].take(pa.array(np.repeat(np.arange(len(right)), count)))
    return pa.table({"query": queries, "id": pa.array(ids[best.ravel()]), "score": np.take_along_axis(scores, best, 1).ravel()})


def search(
    index: Index,
    queries: DataFrame,
    k: int = 10,
    probes: int | None = None,
    label=None,
    query_key: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """(query, id, similarity, place): the k most similar vectors of every query.

    ``probes`` lists are looked into, all of them without it. ``label`` restricts the vectors
    before any arithmetic. Queries without a direction have no rows.
    """
    spark = queries.sparkSession
    lists, kind = len(index.centroids), queries.schema[query_key].dataType
    rows = queries.select(F.col(query_key).alias("query"), unit(column).alias("u")).filter("u IS NOT NULL")
    asked = _nearest(rows, index.centroids, probes or lists, f"query {kind.simpleString()}")
    asked = materialize_once(asked.select("query", "u", F.explode("lists").alias("list")))
    # as many rows as lists
    wanted = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    busy = [(i, -(-index.sizes[i] // CELL_VECTORS), -(-n // CELL_QUERIES)) for i, n in wanted.items() if i in index.sizes]
    if not busy:
        nothing = T.StructType([T.StructField("query", kind), index.rows(spark).schema["id"]])
        return spark.createDataFrame([], nothing.add("similarity", T.DoubleType()).add("place", T.IntegerType()))
    # at most one row for each list
    parts = F.broadcast(spark.createDataFrame(busy, "list INT, vector_parts INT, query_parts INT"))
    stored = index.rows(spark)
    if label is not None:
        stored = stored.filter(F.col("label") == label)
    stored = stored.filter(F.col("list").isin([b[0] for b in busy]))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = stored.join(parts, "list").select("list", part("id", "vector_parts").alias("vp"), every("query_parts").alias("qp"), "id", "u")
    asked = asked.join(parts, "list").select("list", every("vector_parts").alias("vp"), part("query", "query_parts").alias("qp"), "query", "u")
    cell = ["list", "vp", "qp"]
    shape = T.StructType([T.StructField("query", kind), T.StructField("id", stored.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    none = to_arrow_schema(shape).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cells(left, right, k) if len(left) and len(right) else none

    found = vectors.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(run, shape)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    return ranked.select("query", "id", F.round("score", 4).alias("similarity"), "place")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact answers that were found."""
    hits = exact.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    share = hits.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    return 1.0 if share is None else float(share)


def fewest_probes(
    index: Index, queries: DataFrame, k: int = 10, target: float = 0.95, query_key: str = "vec_id", column: str = "embedding", sample: int = 500
) -> int:
    """The least power of two of lists that gives the target recall, measured on a bounded sample of queries; all lists if none does."""
    some = materialize_once(queries.select(query_key, column).orderBy(F.xxhash64(query_key), query_key).limit(sample))
    exact = materialize_once(search(index, some, k, None, None, query_key, column))
    lists, probes = len(index.centroids), 1
    while probes < lists:
        if recall(search(index, some, k, probes, None, query_key, column), exact) >= target:
            return probes
        probes *= 2
    return lists

