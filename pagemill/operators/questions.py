"""Questions made from action records, to try the wiring of retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import truthy
from pagemill.operators.numbering import numbered


def smoke_questions(records: DataFrame, order: str, limit: int | None = 40) -> DataFrame:
    """Per record an action question, then one for its completion time, numbered together.

    ``order`` names the column that orders the records; questions miss what they would ask
    with.  A limit, as it is a sample for people to read, takes the first ones; without one
all are numbered, range by range.
    """
    lco, label, given = (truthy(F.col(c)) for c in ("metadata.lco", "metadata.action_label", "content.condition_text"))
    action = F.when(given.isNotNull(), F.concat(F.lit("For LCO "), lco, F.lit(", what is Required Action "), label, F.lit(" when the condition is: "), given))
    time = F.when(truthy(F.col("content.completion_time")).isNotNull(), F.concat(F.lit("For LCO "), lco, F.lit(", what is the Completion Time for Required Action "), label, F.lit("?")))
    asked = F.array(F.struct(F.lit("action").alias("kind"), F.lit("condition_action_mapping").alias("type"), action.alias("question")), F.struct(F.lit("ct").alias("kind"), F.lit("extractive").alias("type"), time.alias("question")))
    rows = records.where("metadata.action_label is not null").select(F.col("id").alias("record"), F.col(order).alias("o"), F.posexplode(asked).alias("k", "q")).where("q.question is not null")
    if limit is None:
        counted = numbered(rows, ["o", "record", "k"], "n")
    else:
        few = rows.orderBy("o", "record", "k").limit(limit).agg(F.array_sort(F.collect_list(F.struct("o", "record", "k", "q"))).alias("few"))
        counted = few.select(F.posexplode("few").alias("n", "row")).select((F.col("n") + 1).alias("n"), "row.*")
    ids = F.array("record")
    return counted.select(F.concat(F.lit("smoke_"), F.col("q.kind"), F.lit("_"), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(3), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("id"), F.col("q.type").alias("type"), F.col("q.question").alias("question"), ids.alias("gold_evidence_ids"), ids.alias("evidence_ids"), ids.alias("evidence_units"), F.array().cast("array<array<string>>").alias("evidence_keywords"), F.lit(True).alias("answerable"), F.lit("auto_smoke").alias("source"))
