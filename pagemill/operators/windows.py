"""Chunks of fixed length and sliding windows over raw text, by closed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import evidence_ids, strip, truthy


def window_spans(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of (chunk_index, char_start, char_end) in code points; none for an empty text.

    Starts are multiples of size - overlap; the last window is the first that reaches the end.
    """
    if size <= 0:
        raise ValueError("a window holds one character at least")
    if overlap < 0:
        raise ValueError("windows cannot overlap by less than nothing")
    if overlap >= size:
        raise ValueError("an overlap of the whole window leaves no step to the next")
    step, n = size - overlap, F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i + 1).alias("chunk_index"), (i * step).alias("char_start"), F.least(i * step + size, n).alias("char_end")))
    return F.when(n > 0, spans)


def raw_metadata(records: DataFrame) -> list[Column]:
    """The metadata that every chunk of a raw record keeps."""
    at = lambda name: F.col(f"metadata.{name}").alias(name)
    return [F.coalesce(truthy(F.col("metadata.lco")), F.col("id")).alias("lco"), at("title"), at("source_doc"), at("source_pages")]


def as_chunks(frame: DataFrame, strategy: str, chunk_id: Column, metadata: list[str], body: Column) -> DataFrame:
    """The common shape: id, strategy, metadata, content."""
    return frame.select(F.concat(F.lit(f"{strategy}::"), chunk_id).alias("id"), F.lit(strategy).alias("strategy"), F.struct(*metadata).alias("metadata"), F.struct(body.alias("body")).alias("content"))


def _windows(records: DataFrame, strategy: str, kind: str, size: int, overlap: int | None) -> DataFrame:
    text = strip(F.coalesce("raw_text", F.lit("")))
    cut = records.select("id", *raw_metadata(records), text.alias("text")).withColumn("span", F.explode(window_spans(F.col("text"), size, overlap or 0)))
    body = strip(F.substring("text", F.col("span.char_start") + 1, F.col("span.char_end") - F.col("span.char_start")))
    cut = cut.select("*", body.alias("body"), "span.*").withColumns({"parent_id": F.col("id"), "chunk_type": F.lit(kind), "evidence_ids": evidence_ids(F.col("lco"), F.col("body"))})
    names = ["lco", "title", "source_doc", "source_pages", "parent_id", "chunk_type", "chunk_index", "char_start", "char_end"]
    if overlap is not None:
        cut, names = cut.withColumn("overlap", F.lit(overlap)), [*names, "overlap"]
    return as_chunks(cut, strategy, F.concat_ws("#", "id", "chunk_index"), [*names, "evidence_ids"], F.col("body"))


def naive_fixed_length(records: DataFrame, *, chunk_size: int = 900) -> DataFrame:
    return _windows(records, "naive_fixed_length", "fixed_length", chunk_size, None)


def sliding_window(records: DataFrame, *, chunk_size: int = 900, overlap: int = 200) -> DataFrame:
    return _windows(records, "sliding_window", "sliding_window", chunk_size, overlap)
