"""Retrieval quality: first hits, recall over evidence groups, and what hits rest on.

Runs are exploded to ranked results, evidence to keyword groups or ids; hits are joined
rows, and all metrics of all k come from one aggregate over each group's first rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import match_text, strip, truthy

K_VALUES = (1, 3, 5)
DIAGNOSTIC_TOP_K = 5


def keyword_groups(column: str) -> Column:
    """Groups without blank keywords, without empty groups."""
    filled = F.transform(F.coalesce(column, F.array().cast("array<array<string>>")), lambda g: F.filter(g, lambda k: strip(F.coalesce(k, F.lit(""))) != ""))
    return F.filter(filled, lambda g: F.size(g) > 0)


def filled_ids(column: Column) -> Column:
    return F.filter(F.coalesce(column, F.array().cast("array<string>")), lambda x: strip(F.coalesce(x, F.lit(""))) != "")


def last_questions(questions: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each id: of repeated ids the last by ``order``.  Null ids are dropped."""
    rows = questions.where("id is not null")
    if order is None:
        return rows.dropDuplicates(["id"])
    names = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select("id", *(F.col(f"r.{c}").alias(c) for c in names if c != order))


def ranked_results(runs: DataFrame) -> DataFrame:
    """A row for each result: ``rank`` is its own or its place, ``own_rank`` its own or 0."""
    rows = runs.select("qa_id", "strategy", F.posexplode("results").alias("pos", "r"))
    own = F.coalesce("r.rank", F.lit(0))
    ids = F.array_union(filled_ids(F.col("r.evidence_ids")), filled_ids(F.array("r.chunk_id")))
    return rows.select("qa_id", "strategy", F.when(own != 0, own).otherwise(F.col("pos") + 1).alias("rank"), own.alias("own_rank"), match_text(F.coalesce("r.body", F.lit(""))).alias("body"), ids.alias("ids"))


def _evidence(questions: DataFrame, by: str) -> DataFrame:
    """(qa_id, units, unit): each keyword group, or each distinct id, of a question."""
    kind = {"keywords": keyword_groups("evidence_keywords"), "ids": F.array_distinct(filled_ids(F.col("evidence_ids")))}[by]
    return questions.select(F.col("id").alias("qa_id"), kind.alias("units"))


def _hits(by: str) -> Column:
    if by == "ids":
        return F.array_contains("ids", F.col("unit"))
    return (F.col("body") != "") & F.forall("unit", lambda k: F.contains(F.col("body"), match_text(k)))


def detail_rows(questions: DataFrame, runs: DataFrame, k_values: tuple[int, ...] = K_VALUES, by: str = "keywords") -> DataFrame:
    """Metrics of each run whose question is known; ``questions`` has one row for each id."""
    known = questions.select(F.col("id").alias("qa_id"), truthy(F.col("type")).alias("qa_type"))
    units = _evidence(questions, by)
    spread = units.select("qa_id", F.posexplode("units").alias("unit_no", "unit"))
    hits = ranked_results(runs).join(spread, "qa_id").where(_hits(by))
    per_unit = hits.groupBy("qa_id", "strategy", "unit_no").agg(F.min("rank").alias("first"), F.min("own_rank").alias("first_own"))
    counts = [F.count_if(F.col("first") <= k).alias(f"_n{k}") for k in k_values]
    per_run = per_unit.groupBy("qa_id", "strategy").agg(F.min("first_own").alias("first_hit_rank"), F.max("first").alias("_last"), F.count("*").alias("_matched"), *counts)
    out = runs.select("qa_id", "strategy").join(known, "qa_id").join(units.select("qa_id", F.size("units").alias("unit_count")), "qa_id").join(per_run, ["qa_id", "strategy"], "left")
    n, first = F.col("unit_count"), F.col("first_hit_rank")
    full = F.when((n > 0) & (F.col("_matched") == n), F.col("_last"))
    share = lambda k: F.coalesce(F.col(f"_n{k}") / F.nullif(n, F.lit(0)), F.lit(0.0))
    inverse = lambda r: F.coalesce(1.0 / F.nullif(r, F.lit(0)), F.lit(0.0))
    return out.select(
        "qa_id", "qa_type", "strategy", "first_hit_rank", *(F.coalesce(first <= k, F.lit(False)).alias(f"hit_{k}") for k in k_values), inverse(first).alias("rr"), "unit_count",
        *(share(k).alias(f"recall_{k}") for k in k_values), *((F.coalesce(F.col(f"_n{k}") == n, F.lit(False)) & (n > 0)).alias(f"set_recall_{k}") for k in k_values),
        full.alias("set_recall_rank"), inverse(full).alias("set_recall_rr"),
    )


def summary(details: DataFrame, k_values: tuple[int, ...] = K_VALUES) -> DataFrame:
    """Means by strategy (qa_type ALL) and by strategy and type."""
    mean = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    typed = details.withColumn("qa_type", F.coalesce("qa_type", F.lit("unknown")))
    sets = typed.groupingSets([["strategy"], ["strategy", "qa_type"]], "strategy", "qa_type")
    out = sets.agg(F.grouping("qa_type").alias("_all"), F.count("*").alias("n"), F.avg("rr").alias("mrr"), F.avg("set_recall_rr").alias("set_recall_mrr"), *(mean(f"{m}_{k}") for m in ("hit", "recall", "set_recall") for k in k_values))
    return out.withColumn("qa_type", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("qa_type"))).drop("_all")


def diagnostics(questions: DataFrame, runs: DataFrame, top: int = DIAGNOSTIC_TOP_K) -> DataFrame:
    """Keyword hits among the first results: genuine if the chunk also carries an evidence unit."""
    typed = questions.select(F.col("id").alias("qa_id"), F.coalesce(truthy(F.col("type")), F.lit("unknown")).alias("qa_type"), filled_ids(F.col("evidence_units")).alias("wanted"))
    known = runs.select("qa_id", "strategy").join(typed, "qa_id")
    spread = _evidence(questions, "keywords").select("qa_id", F.explode("units").alias("unit"))
    hits = ranked_results(runs).where(F.col("rank") <= top).join(spread, "qa_id").where(_hits("keywords")).join(typed.select("qa_id", "wanted"), "qa_id")
    judged = hits.groupBy("qa_id", "strategy").agg(F.count("*").alias("h"), F.count_if(F.arrays_overlap("ids", "wanted")).alias("g"))
    rows = known.join(judged, ["qa_id", "strategy"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sets = rows.groupingSets([["strategy"], ["strategy", "qa_type"]], "strategy", "qa_type").agg(F.grouping("qa_type").alias("_all"), total("h").alias("n_hits"), total("g").alias("genuine"))
    return sets.select("strategy", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("qa_type")).alias("qa_type"), "n_hits", "genuine", (F.col("n_hits") - F.col("genuine")).alias("coincidental"), F.coalesce(F.col("genuine") / F.nullif("n_hits", F.lit(0)), F.lit(0.0)).alias("genuine_rate"))
