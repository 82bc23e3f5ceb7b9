"""Connected components by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsignal.llm.storage import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _linked(pairs: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours, moved to the smallest of them; ``larger`` takes the neighbours above the node."""
    least = pairs.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    joined = pairs.join(least, "a")
    if larger:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of the edge list (a, b); the root is the component's smallest node.

    Nodes are longs. Only neighbour minima are aggregated, so a hub is
    pre-aggregated by task and its join is one that Spark can split. Each round
    is written to the shared folder; the driver sees two numbers a round.
    """
    current = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(current)
    for _ in range(limit):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        grown = _linked(both, True)
        current = written(_linked(grown.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "edges")
        before, mark = mark, _mark(current)
        if mark == before:
            roots = current.select(F.col("b").alias("node")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root"))
            )
    raise RuntimeError(f"components did not settle in {limit} rounds")
