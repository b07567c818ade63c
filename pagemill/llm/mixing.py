"""Mixing of sources to target weights by repetition rates.

The mix takes ``share`` times the words of all documents.  Each source aims at its part by
weight, but at no more than ``cap`` times its own words; what a capped source leaves goes
to the others by weight, until none is above its cap.  That is water filling: the targets
are min(cap * size, level * weight).  The level rises from total / weights, a few sums over
the sources for each step, until the sources below their cap no longer change.

A source's rate is target / size.  Each of its documents is taken floor(rate) times, and
once more when a uniform number hashed from ``seed``, id and text lies below the fraction;
rows equal in both are numbered, and the number is hashed too, so that they draw apart.

Sources are aggregated before anything is shuffled, and there may be as many as documents:
they are numbered in order by a range partitioning, and summed where they are.  Their
table is written and read back, so that the join with the documents is a broadcast join
only where that table is small, and one that Spark splits where a source is hot.  Only
rows that are repeated are shuffled to be numbered, by the file that they were read from,
so no task numbers more than a file's rows of one kind.

Defined results: a null source is a source, the last; a null or wordless text has size 0;
a source without words has target 0 and its documents are not taken; of rows equal in id
and text the same number is taken in every run; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.scratch import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SEED = 1.5, 2.0, "mix-1"
_NEW = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted(sizes: DataFrame, weights: tuple[float, ...], scratch: Scratch) -> DataFrame:
    """Adds each source's weight: ``weights`` repeat over the sources in code point order, null last."""
    ranged = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = scratch.table(ranged)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    # a row for each partition, however many sources there are
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) + F.col("before") - 1
    return ranged.join(F.broadcast(before), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))).drop("part", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float, scratch: Scratch) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    sources = weighted(sizes, weights, scratch).withColumn("ceiling", cap * F.col("source_size"))
    sources = scratch.table(sources.withColumn("fill", F.col("ceiling") / F.col("weight")))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("fill") < level
        held, open_ = sources.agg(F.sum(F.when(capped, F.col("ceiling"))), F.sum(F.when(~capped, F.col("weight")))).first()
        following = (total - (held or 0.0)) / open_ if open_ else float("inf")
        if following <= level:
            break
        level = following
    # the greatest level that its sources admit, as sums of whole numbers are exact
    return sources.select("source", "source_size", F.least("ceiling", level * F.col("weight")).alias("target"))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def numbered_repeats(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows that are alone in their keys, the others), with ``_no`` counting from 0 within equal keys."""
    often = scratch.table(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    if often.isEmpty():
        return rows.withColumn("_no", F.lit(0).cast("long")), rows.limit(0).withColumn("_no", F.lit(0).cast("long"))
    often = often.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    alone = rows.join(often, same, "left_anti").withColumn("_no", F.lit(0).cast("long"))
    held = scratch.table(rows.join(often, same, "left_semi"))
    filed = held.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    counts = filed.groupBy("_file", *keys).agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_file").alias("_f"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.sum("_n").over(W.partitionBy(*keys).orderBy("_file")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_file", *keys).orderBy("_row")) - 1
    joined = filed.withColumn("_no", inside).join(before, [F.col("_file") == F.col("_f"), *same])
    return alone, joined.withColumn("_no", F.col("_no") + F.col("_before")).select(*rows.columns, "_no")


def mix(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``documents`` with size, source_size, target, copies and taken; columns of those names are replaced."""
    documents = documents.drop(*_NEW)
    scratch = Scratch(documents.sparkSession, "mix")
    sized = documents.withColumns({"size": word_count(F.col(text_column)), "_text": F.md5(text_column)})
    sizes = sized.groupBy(F.col(source_column).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = scratch.table(source_targets(scratch.table(sizes), weights, share, cap, scratch)).withColumnRenamed("source", "_source")
    alone, repeated = numbered_repeats(sized.withColumn("_id", F.col(id_column)), ["_id", "_text"], scratch)
    joined = alone.unionByName(repeated).join(targets, F.col(source_column).eqNullSafe(F.col("_source")), "left")
    rate = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    draw = uniform(seed, F.col("_id"), F.col("_text"), F.col("_no"))
    copies = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select(*documents.columns, *_NEW)


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as ``copies`` says, with ``copy`` counting from 0."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Contract query over all ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5(text) AS digest, row_number() OVER (PARTITION BY doc_id, text) - 1 AS no, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size AS ceiling, 2.0::DOUBLE * source_size / weight AS fill, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
l AS (SELECT *, (total - coalesce(sum(ceiling) OVER b, 0)) / (weights - coalesce(sum(weight) OVER b, 0)) AS lev FROM f
  WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(ceiling, coalesce(weight * max(CASE WHEN lev <= fill THEN lev END) OVER (), ceiling)) AS target FROM l),
r AS (SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate,
  CAST('0x' || substr(md5(concat_ws(':', '{SEED}', coalesce(doc_id::VARCHAR, 'null'), coalesce(digest, 'null'), no)), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""
