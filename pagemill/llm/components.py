"""Connected components by repeated contraction, with joins and aggregates only.

Every round maps each node to the least node of its neighbourhood (itself included) and
contracts the edges along that map; the maps of all rounds, applied one after the other,
give each node its component.  Node ids have to be in random order (hashes), for then a
round removes a constant share of the nodes that still have edges, on long chains too, and
the number of rounds is logarithmic.  Each round is a table in the shared folder; a hub's
edges are combined before they are shuffled, and joined from tables that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` has columns a and b; returns (node, component) for every node with an edge to another.

    Loops, repeated edges and either direction are fine; rows with a null end are no edges.
    """
    def proper(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left = scratch.table(proper(edges))
    maps: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        down = scratch.table(ends.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low")))
        maps.append(down)
        a = down.select(F.col("node").alias("a"), F.col("low").alias("low_a"))
        b = down.select(F.col("node").alias("b"), F.col("low").alias("low_b"))
        following = scratch.table(proper(left.join(a, "a").join(b, "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))))
        scratch.drop(left)
        left = following
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].withColumnRenamed("low", "component")
    for later in maps[1:]:
        step = later.select(F.col("node").alias("component"), "low")
        out = scratch.table(out.join(step, "component", "left").select("node", F.coalesce("low", "component").alias("component")))
    return out
