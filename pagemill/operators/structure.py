"""Chunks that follow the parsed structure, and line-level pilots of both ideas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import strip, truthy
from pagemill.functions.vectors import Encoder, cosine
from pagemill.operators.semantic import semantic
from pagemill.operators.windows import naive_fixed_length, sliding_window


def _structured(records: DataFrame, strategy: str, kind: str, evidence) -> DataFrame:
    metadata = F.col("metadata").withField("chunk_type", F.coalesce(truthy(F.col("metadata.chunk_type")), F.lit(kind))).withField("evidence_ids", evidence)
    body = strip(F.coalesce("content.body", F.lit("")))
    return records.select(F.concat(F.lit(f"{strategy}::"), "id").alias("id"), F.lit(strategy).alias("strategy"), metadata.alias("metadata"), F.struct(body.alias("body")).alias("content"))


def action_logic(records: DataFrame) -> DataFrame:
    """A chunk for each action record; its evidence is itself."""
    return _structured(records, "action_logic", "action_logic", F.array("id"))


def condition_aware(records: DataFrame) -> DataFrame:
    """A chunk for each condition record; its evidence are its actions, else itself."""
    own = F.coalesce("metadata.evidence_ids", F.array().cast("array<string>"))
    return _structured(records, "condition_aware", "condition", F.when(F.size(own) > 0, own).otherwise(F.array("id")))


#: Strategy -> (chunker, the table that it reads, its parameters).
STRATEGIES: dict[str, tuple[Callable[..., DataFrame], str, dict]] = {
    "naive_fixed_length": (naive_fixed_length, "raw", {"chunk_size": 900}),
    "sliding_window": (sliding_window, "raw", {"chunk_size": 900, "overlap": 200}),
    "semantic": (semantic, "raw", {"min_chars": 450, "target_chars": 900, "max_chars": 1200, "context_window_words": 45, "boundary_step_words": 3}),
    "action_logic": (action_logic, "hierarchical_source", {}),
    "condition_aware": (condition_aware, "condition_chunks", {}),
}


def common_columns(chunks: DataFrame) -> DataFrame:
    """Chunks of any strategy with the columns that an index keeps."""
    at = lambda name: F.col(f"metadata.{name}").alias(name)
    return chunks.select("id", "strategy", at("lco"), at("chunk_type"), at("evidence_ids"), F.col("content.body").alias("body"))


def text_lines(records: DataFrame, text: str) -> DataFrame:
    """(id, line_no, line): stripped lines that are not blank."""
    rows = records.select("id", F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return rows.withColumn("line", strip(F.col("line"))).where("line <> ''")


def structure_islands(lines: DataFrame, header: str = r"^CONDITION [A-Z]:") -> DataFrame:
    """Adds ``chunk``: a new one at each header but the first line's."""
    order = W.partitionBy("id").orderBy("line_no")
    opens = F.col("line").rlike(header) & (F.row_number().over(order) > 1)
    return lines.withColumn("_o", opens.cast("int")).withColumn("chunk", F.sum("_o").over(order)).drop("_o")


def distance_islands(lines: DataFrame, encoder: Encoder | None = None, percentile: float = 0.75) -> DataFrame:
    """Adds distance to the line before, threshold and ``chunk``; a cut where the distance is strictly above.

    Without an encoder the lines bring a column ``vector``.  The threshold is the percentile
    of a record's distances, interpolated.
    """
    order = W.partitionBy("id").orderBy("line_no")
    if encoder is not None:
        lines = lines.withColumn("vector", encoder(F.col("line")))
    apart = lines.withColumn("distance", F.round(1 - cosine(F.lag("vector").over(order), F.col("vector")), 9))
    limits = apart.groupBy("id").agg(F.round(F.percentile("distance", percentile), 9).alias("threshold"))
    marked = apart.join(limits, "id").withColumn("_o", F.coalesce((F.col("distance") > F.col("threshold")).cast("int"), F.lit(0)))
    return marked.withColumn("chunk", F.sum("_o").over(order)).drop("_o")


def located_together(chunked: DataFrame, targets: list[tuple[str, str]]) -> DataFrame:
    """(id, letter, together): whether the first lines of all of a letter's targets are in one chunk.

    ``targets``: letters with a regular expression for one line each; an unfound target counts as elsewhere.
    """
    listed = [F.struct(F.lit(letter).alias("letter"), F.lit(pattern).alias("pattern")) for letter, pattern in targets]
    letters = chunked.select("id").distinct().select("id", F.inline(F.array(*listed)))
    hit = letters.join(chunked.select(F.col("id").alias("_id"), "line", "chunk"), (F.col("id") == F.col("_id")) & F.expr("line rlike pattern"), "left")
    first = hit.groupBy("id", "letter", "pattern").agg(F.min("chunk").alias("chunk"))
    return first.groupBy("id", "letter").agg(((F.countDistinct(F.coalesce("chunk", F.lit(-1))) == 1) & (F.min(F.coalesce("chunk", F.lit(-1))) >= 0)).alias("together"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Number and mean size of each strategy's chunks."""
    return chunks.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.avg(F.length("body")).alias("mean_chars"))
