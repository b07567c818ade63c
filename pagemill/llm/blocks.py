"""Links inside groups of any size, found in blocks of bounded size.

``members`` says which node is in which group and carries what is needed to compare two
nodes.  All pairs of a group count, yet no task sees a whole group and no list of pairs
is made:

1. each group is dealt into blocks by a hash; a block links its own members and returns a
   spanning forest, one edge for each member at most;
2. the components of these edges are taken; in a group of several blocks, only members
   outside the group's largest component can still lack a link, and they are compared with
   every block of it, blocks of them with blocks of all.

In groups of near copies almost all members are in one component after the first step, so
the second is small.  The edges of both steps connect whatever some pair of a group connects.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import connected_components
from pagemill.llm.scratch import Scratch


def whole_groups(batches, keys: int):
    """Tables that hold whole runs of equal values in the first ``keys`` columns of a sorted input."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        if table.num_rows == 0:
            continue
        new = np.flatnonzero(changes(table, keys))
        cut = int(new[-1]) if len(new) else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def changes(table, keys: int) -> np.ndarray:
    """True at each row that begins a new run."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for k in range(keys):
        column = table.column(k).to_numpy()
        out[1:] |= column[1:] != column[:-1]
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is connected to by the links i-j."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _edges(nodes, a: np.ndarray, b: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"a": nodes.take(pa.array(a)), "b": nodes.take(pa.array(b))})


def linked_in_blocks(members: DataFrame, limit: int, inside: Callable, across: Callable, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes with a link.

    ``members``: grp (long or binary), node (binary), weight (long), payload (binary).  A
    block holds members of about ``limit`` weight.  ``inside(payloads, begins)`` gets a list
    of payloads in runs that begin at ``begins`` and returns link arrays (i, j) of rows of
    one run; ``across(payloads, left, right, roots)`` those between rows of left and right
    with different roots.
    """
    totals = members.groupBy("grp").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).where("n >= 2")
    totals = scratch.table(totals.select("grp", F.ceil(F.col("total") / limit).cast("int").alias("nb")))
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    dealt = members.join(totals, "grp").withColumn("block", own)

    def diagonal(batches):
        for table in whole_groups(batches, 2):
            nodes = table.column("node").combine_chunks()
            begins = np.flatnonzero(changes(table, 2))
            i, j = inside(table.column("payload").to_pylist(), begins)
            label = forest(table.num_rows, i, j)
            b = np.flatnonzero(label != np.arange(table.num_rows))
            yield _edges(nodes, label[b], b)

    def blocks(frame: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
        keyed = frame.withColumn("k", F.xxhash64(*keys)).select("k", *(F.col(c).cast("long") for c in keys[1:]), *rest)
        return keyed.repartition("k", *keys[1:]).sortWithinPartitions("k", *keys[1:])

    edges = scratch.table(blocks(dealt, ["grp", "block"], ["node", "payload"]).mapInArrow(diagonal, "a binary, b binary").distinct())
    large = totals.where("nb > 1")
    if large.isEmpty():
        return connected_components(edges, scratch)
    roots = scratch.table(connected_components(edges, scratch))
    rooted = members.join(large, "grp").join(roots, "node", "left").select("grp", "nb", "node", "weight", "payload", F.coalesce("component", "node").alias("root"))
    rooted = scratch.table(rooted)
    per_root = rooted.groupBy("grp", "root").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    most = per_root.groupBy("grp").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("w").alias("w"), F.sum(F.lit(1)).alias("kinds")).where("kinds > 1")
    main = scratch.table(most.select("grp", F.col("most.root").alias("main")))
    sided = rooted.join(main, "grp").withColumn("minor", F.col("root") != F.col("main"))
    minors = scratch.table(sided.where("minor").groupBy("grp").agg(F.ceil(F.sum("weight") / limit).cast("int").alias("mb")))
    sided = sided.join(minors, "grp")
    all_sides = sided.select("grp", own.alias("i"), F.explode(F.expr("sequence(0, mb - 1)")).alias("m"), "node", "payload", "root", F.lit(0).alias("side"))
    minor_sides = sided.where("minor").select("grp", F.explode(F.expr("sequence(0, nb - 1)")).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("mb")).cast("int").alias("m"), "node", "payload", "root", F.lit(1).alias("side"))

    def off_diagonal(batches):
        for table in whole_groups(batches, 3):
            begins = np.append(np.flatnonzero(changes(table, 3)), table.num_rows)
            for x, y in zip(begins[:-1], begins[1:], strict=True):
                part = table.slice(x, y - x)
                side, root = part.column("side").to_numpy(), part.column("root").to_pandas().to_numpy()
                codes = np.unique(root, return_inverse=True)[1]
                i, j = across(part.column("payload").to_pylist(), np.flatnonzero(side == 1), np.flatnonzero(side == 0), codes)
                label = forest(part.num_rows, i, j)
                b = np.flatnonzero(label != np.arange(part.num_rows))
                yield _edges(part.column("node").combine_chunks(), label[b], b)

    crossed = blocks(all_sides.union(minor_sides), ["grp", "i", "m"], ["node", "payload", "root", "side"]).mapInArrow(off_diagonal, "a binary, b binary").distinct()
    both = scratch.table(edges.union(scratch.table(crossed)))
    scratch.drop(rooted)
    out = connected_components(both, scratch)
    return out

