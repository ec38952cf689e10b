"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; a component is its smallest node.

    Randomised contraction: in each round a node joins whichever of itself and its neighbours has the smallest
    hash, with new hashes each round, and the edges are renamed. At least a quarter of the nodes is expected to go in
    a round, so rows of all rounds together grow with the edges, also on long chains. Then
    the names are followed back. Each round is written; the driver sees whether edges are left.
    """
    left = stored(_undirected(edges, "a", "b"), "edges")
    joined: list[DataFrame] = []
    while not left.isEmpty():
        near = left.union(left.select("b", "a")).groupBy("a").agg(F.min(_drawn("b", len(joined))).alias("near"))
        into = F.least(_drawn("a", len(joined)), "near")["node"]
        joined.append(stored(near.select(F.col("a").alias("node"), into.alias("into")), "joined"))
        ends = [joined[-1].select(F.col("node").alias(c), F.col("into").alias(f"{c}_into")) for c in ("a", "b")]
        left = stored(_undirected(left.join(ends[0], "a").join(ends[1], "b"), "a_into", "b_into"), "edges")
    names = left.select(F.col("a").alias("node"), F.col("b").alias("name"))
    for step in reversed(joined):
        names = step.join(names.withColumnRenamed("node", "into"), "into", "left").select("node", F.coalesce("name", "into").alias("name"))
    names = stored(names, "names")
    least = names.groupBy("name").agg(F.min("node").alias("component"))
    return stored(names.join(least, "name").select("node", "component"), "labels")


def _undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def _drawn(node: str, seed: int):
    return F.struct(F.xxhash64(F.lit(seed), node).alias("hash"), F.col(node).alias("node"))
