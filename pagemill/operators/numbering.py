"""Running numbers over a whole table, without a window over all of it.

Rows are dealt into ranges of the order and sorted there; a range's rows get their places
in it, and the counts of the ranges before.  Only one count for each range reaches the
driver.  The ranges are written, so that numbers don't depend on a second sort.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.scratch import Scratch


def numbered(frame: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """``frame`` with ``name``, a long: first, first + 1, ... in the order of ``order``; equal rows in some order."""
    scratch = Scratch(frame.sparkSession, "numbers")
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    held = scratch.table(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = sorted((r._range, r.n, r.least) for r in held.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("least")).collect())
    before = [0, *accumulate(n for _, n, _ in counts)]
    starts = frame.sparkSession.createDataFrame([(r, b + first - least) for (r, _, least), b in zip(counts, before, strict=False)], "_range int, _start long")
    # one row for each range
    return held.join(F.broadcast(starts), "_range").withColumn(name, F.col("_at") + F.col("_start")).drop("_range", "_at", "_start")
