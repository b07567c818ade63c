"""Tables between the steps of an operator (see ``pagemill.sources.scratch``).

Rows of these operators hold whole texts, so the batches that go to Python are bounded by
bytes as well as by rows, unless the session says otherwise.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from pagemill.sources import scratch
from pagemill.sources.scratch import bound_batches, shared_folder

__all__ = ["Scratch", "bound_batches", "shared_folder"]

class Scratch(scratch.Scratch):
    def __init__(self, spark: SparkSession, name: str) -> None:
        super().__init__(spark, name)
        bound_batches(spark)
