"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
``documents``; columns beyond those are left out.

Defined results of the stages: texts without letters, null ones included, are rejected by
the first.  In the second rows are told apart by id and text, so that rows without an id
or with a repeated one take part: of a component the row of the least id stays (a null id
comes last), of equal ids the one of the least text hash, of equal rows one.  Repeated
passages go from every row that holds them; a text that is left empty stays as an empty
row, which the mix takes without words and the packing leaves out.  Equal ids draw apart
in the mix by their texts.  An empty table gives empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.language import fit_and_identify
from pagemill.llm.minhash import near_duplicates
from pagemill.llm.mixing import emit, mix
from pagemill.llm.packing import pack_words
from pagemill.llm.scratch import Scratch
from pagemill.llm.sieve import sifted, without_ids
from pagemill.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the models recognise (operator 9); rejected ones go."""
    return fit_and_identify(docs.select(COLUMNS)).where("not rejected").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (operator 7, five-word shingles)."""
    scratch = Scratch(spark, "stage")
    # nulls compare as least: the flag puts rows without an id last
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("row"), "text").alias("h2"))
    keyed = docs.select(*COLUMNS, row.alias("row"))
    judged = scratch.table(near_duplicates(keyed.select("row", "text"), id_column="row").select("row", "kept"))
    rows = scratch.table(judged.groupBy("row").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    stays = without_ids(keyed, rows.where("not kept").select("row"), "row")
    repeated = scratch.table(rows.where("kept and n > 1").select("row"))
    if repeated.isEmpty():
        return stays.select(COLUMNS)
    again, once = sifted(stays, repeated.select(F.xxhash64("row").alias("k")), F.xxhash64("row"))
    return once.unionByName(again.dropDuplicates(["row"])).select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once (operator 10)."""
    return remove_repeats(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask (operator 3)."""
    return emit(mix(docs.select(COLUMNS))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences, with their text (operator 2)."""
    return pack_words(docs.select("doc_id", "text"), with_text=True)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language models, MinHash and best-fit packing are beyond SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
