"""The six stages as jobs over tables, and a runner for a contiguous part of them.

corpus: words -> pages, raw, sections, hierarchical_source, condition_chunks
chunks: those -> one table of chunks for each strategy
index: chunks -> chunks with vectors
retrieve: questions -> ranked runs
prompts: runs -> prompts
evaluate: runs -> details, summary and diagnostics

Each folder of the configuration holds versions (``sources.versions``).  A stage reads the
versions that are current when it begins, writes all its tables aside and makes them
current together when the last one is there; if it fails, what was there stays whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.functions.vectors import TextEncoder, hashing
from pagemill.operators import evaluation, retrieval, sections
from pagemill.operators.pages import parse_pages
from pagemill.operators.structure import STRATEGIES, chunk_statistics, common_columns
from pagemill.schemas import QUESTIONS, WORDS
from pagemill.sources.tables import load_index, page_words, read_jsonl, save_index, write_csv
from pagemill.sources.versions import Snapshot, Tables


def tables(spark: SparkSession, config: Config, kind: str) -> Tables:
    """The versions of the processed, chunks or output folder."""
    return Tables(spark, config.folder(kind))


def current(spark: SparkSession, config: Config, kind: str) -> Snapshot:
    return tables(spark, config, kind).current()


def corpus(spark: SparkSession, config: Config, words: DataFrame | None = None) -> None:
    words = spark.read.schema(WORDS).parquet(config.place(config.raw["words_path"])) if words is None else words
    overrides = None
    if config.overrides:
        rows = [(lco, *(float(o[k]) if k in o else None for k in ("col1_max", "col2_max", "header_margin"))) for lco, o in config.overrides.items()]
        overrides = spark.createDataFrame(rows, "lco string, col1_max double, col2_max double, header_margin double")
    with tables(spark, config, "processed").draft() as out:
        parsed = out.write("pages", parse_pages(page_words(words, config.page_ranges), config.layout, overrides))
        pages = sections.by_section(parsed.withColumn("page_ord", F.struct("source_doc", "page_no")))
        merged = out.write("sections", sections.merge_sections(pages))
        blocks = out.write("blocks", sections.condition_blocks(sections.section_items(pages), sections.condition_texts(pages)))
        out.write("raw", sections.raw_records(merged))
        out.write("hierarchical", sections.hierarchical_records(merged, blocks))
        out.write("hierarchical_source", sections.action_records(merged, blocks))
        out.write("condition_chunks", sections.condition_records(merged, blocks))
        out.write("label_gaps", sections.label_gaps(blocks))


def chunks(spark: SparkSession, config: Config, strategy: str = "all", encoder: TextEncoder | None = None) -> None:
    source_tables = current(spark, config, "processed")
    with tables(spark, config, "chunks").draft() as out:
        for name in config.strategies(strategy):
            chunker, source, _ = STRATEGIES[name]
            parameters = config.parameters(name)
            if name == "semantic":
                parameters = {"model_name": config.model_name, **parameters, "encoder": encoder or hashing()}
                parameters.pop("batch_size", None)
            out.write(name, chunker(source_tables.table(source), **parameters))


def index(spark: SparkSession, config: Config, strategy: str = "all", encoder: TextEncoder | None = None) -> None:
    held = current(spark, config, "chunks")
    every = [common_columns(held.table(name)) for name in config.strategies(strategy)]
    built = retrieval.build_index(reduce(DataFrame.unionByName, every), encoder or hashing())
    save_index(built, retrieval.index_metadata(built, config.model_name), config.table("output", "index"))
    with tables(spark, config, "output").draft() as out:
        out.put("chunk_statistics", lambda place: write_csv(chunk_statistics(load_index(spark, config.table("output", "index"))[0]), place))


def questions(spark: SparkSession, config: Config) -> DataFrame:
    """Of repeated ids the last in file order."""
    rows = read_jsonl(spark, config.table("qa", config.raw.get("qa_file", "qa.jsonl")), QUESTIONS, line="_line")
    return evaluation.last_questions(rows, "_line")


def retrieve(spark: SparkSession, config: Config, strategy: str = "all", encoder: TextEncoder | None = None) -> None:
    found, _ = load_index(spark, config.table("output", "index"), config.strategies(strategy))
    with tables(spark, config, "output").draft() as out:
        out.write("runs", retrieval.retrieve(questions(spark, config), found, encoder or hashing(), max(config.k_values)))


def prompts(spark: SparkSession, config: Config, context_k: int = 5) -> None:
    runs = current(spark, config, "output").table("runs")
    with tables(spark, config, "output").draft() as out:
        out.write("rag_inputs", retrieval.prompts(runs, context_k))


def evaluate(spark: SparkSession, config: Config) -> None:
    asked, runs = questions(spark, config), current(spark, config, "output").table("runs")
    with tables(spark, config, "output").draft() as out:
        details = out.write("eval/details", evaluation.detail_rows(asked, runs, config.k_values))
        out.put("eval/summary", lambda place: write_csv(evaluation.summary(details, config.k_values), place))
        out.put("eval/diagnostics", lambda place: write_csv(evaluation.diagnostics(asked, runs), place))


STAGES = {"corpus": corpus, "chunks": chunks, "index": index, "retrieve": retrieve, "prompts": prompts, "evaluate": evaluate}


def selected_stages(first: str, last: str) -> list[str]:
    names = list(STAGES)
    a, b = names.index(first), names.index(last)
    if a > b:
        raise ValueError(f"{first} comes after {last}")
    return names[a : b + 1]


def run(spark: SparkSession, config: Config, first: str = "corpus", last: str = "evaluate", strategy: str = "all") -> None:
    """Runs stages in order; the first failure ends the run and leaves earlier versions current."""
    for name in selected_stages(first, last):
        options = {"strategy": strategy} if name in ("chunks", "index", "retrieve") else {}
        STAGES[name](spark, config, **options)
