"""Connected components of a large graph by contraction.

Every round each node picks the member of its closed neighbourhood that comes first in a random order
(a hash of the node), picked nodes become the nodes of the next round and edges inside a pick go. The
number of nodes falls by a constant factor a round in expectation, whatever the shape of the graph.
Picks are aggregated map-side, so a node of high degree is no hot spot, and the joins are plain
sort-merge joins, whose skewed partitions Spark splits. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import cut, n_rows


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: the same non-null type, a <> b)."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    where = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    first = True
    while n_rows(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("up"))
        picks = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a"))["up"].alias("up")))
        if first:
            where, first = picks.withColumnRenamed("up", "root"), False
        else:
            where = cut(where.join(picks.select(F.col("node").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = edges.join(picks.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(picks.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        edges = cut(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return where
