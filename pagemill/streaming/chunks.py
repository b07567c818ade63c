"""Chunking of a stream of raw records: the window chunkers keep no state, so they apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.windows import naive_fixed_length, sliding_window
from pagemill.schemas import RAW


def chunk_stream(records: DataFrame, strategy: str = "sliding_window", **parameters) -> DataFrame:
    """Chunks of the records of a stream."""
    return {"naive_fixed_length": naive_fixed_length, "sliding_window": sliding_window}[strategy](records, **parameters)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, strategy: str = "sliding_window", **parameters) -> StreamingQuery:
    """Follows a folder of raw records in JSON lines, appends chunks as parquet, exactly once."""
    records = spark.readStream.schema(RAW).json(source)
    out = chunk_stream(records, strategy, **parameters).writeStream.format("parquet")
    return out.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
