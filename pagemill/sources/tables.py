"""Reading and writing of the stages' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.sources.scratch import Scratch
from pagemill.sources.versions import Tables


def read_jsonl(spark: SparkSession, path: str, schema: str, line: str | None = None) -> DataFrame:
    """A row for each line that is not blank; a line that is not JSON fails the job, naming file and line text.

    ``line`` names a column for (file, number of the line in it), which failures then name
    too.  Lines stay in the splits they are read in: they are written once, so that their
    places are fixed, and a line's number is its place in its split plus the lines of the
    file's splits before, which are one count each.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    place = F.concat("file", F.lit(": "))
    if line:
        scratch = Scratch(spark, "lines")
        lines = scratch.table(lines)
        splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        splits = scratch.table(splits.select("file", "block", (before + 1 - F.col("least")).alias("shift")))
        lines = lines.join(splits, ["file", "block"]).withColumn("no", F.col("at") + F.col("shift"))
        place = F.concat("file", F.lit(", line "), "no", F.lit(": "))
    parsed = lines.where("trim(value) <> ''").withColumn("r", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    failed = F.raise_error(F.concat(F.lit("not JSON in "), place, F.substring("value", 1, 200)))
    checked = parsed.select(*([F.struct("file", "no").alias("_at")] if line else []), F.when(F.col("r._bad").isNotNull(), failed.cast(parsed.schema["r"].dataType)).otherwise(F.col("r")).alias("r"))
    return checked.select(*([F.col("_at").alias(line)] if line else []), "r.*").drop("_bad")


def write_jsonl(frame: DataFrame, path: str) -> None:
    """Nulls are written; an earlier table goes."""
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


#: Rows of a report that goes into one file, at most.
REPORT_ROWS = 100_000


def _report(frame: DataFrame) -> DataFrame:
    """``frame`` as it is, if it is small enough for one file; it is counted first, not gathered."""
    if frame.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows are a table and not a report: write them as parquet or JSON lines")
    return frame


def write_json(frame: DataFrame, path: str) -> None:
    """A summary as one indented document, a list of its rows; more than ``REPORT_ROWS`` are refused."""
    frame = _report(frame)
    rows = F.to_json(F.collect_list(F.struct("*")), {"pretty": "true", "ignoreNullFields": "false"})
    frame.agg(rows.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """A report (a row for each strategy and type) as one file with a header; more than ``REPORT_ROWS`` rows are refused."""
    _report(frame).coalesce(1).write.mode("overwrite").csv(path, header=True)


def save_index(index: DataFrame, metadata: DataFrame, path: str) -> None:
    """Chunks with vectors, partitioned by strategy, and a table that describes them, which become current together."""
    with Tables(index.sparkSession, path).draft() as out:
        out.write("chunks", index, ("strategy",))
        out.write("meta", metadata)


def load_index(spark: SparkSession, path: str, strategies: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables of one version, whatever is published later; only the folders of the wanted strategies are read."""
    version = Tables(spark, path).current()
    chunks, meta = version.table("chunks"), version.table("meta")
    if strategies is not None:
        chunks, meta = (x.where(F.col("strategy").isin(strategies)) for x in (chunks, meta))
    return chunks, meta


def page_words(words: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Words of the pages in any of the inclusive ranges; all if there are none.  Reaches the scan."""
    if not ranges:
        return words
    wanted = F.lit(False)
    for first, last in ranges:
        wanted = wanted | F.col("page_no").between(first, last)
    return words.where(wanted)


def pages_without_words(words: DataFrame) -> DataFrame:
    """(source_doc, page_no) of pages that hold no word: those of scanned pages, for example."""
    return words.groupBy("source_doc", "page_no").agg(F.count("text").alias("n")).where("n = 0").drop("n")


def pdf_words(spark: SparkSession, paths: list[str], ranges: list[tuple[int, int]] = ()) -> DataFrame:
    """Words of PDF files, a file at a time on the workers; needs pdfplumber there.

    Only pages in any of the inclusive ranges are laid out, all if there are none.  A page
    without words gives one row with a null text, which ``pages_without_words`` reports.
    """
    from pagemill.schemas import WORDS

    def extract(batches):
        import io

        import pandas as pd
        import pdfplumber

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as document:
                    for number, page in enumerate(document.pages, 1):
                        if ranges and not any(a <= number <= b for a, b in ranges):
                            continue
                        rows = [(path, number, float(page.height), k, w["text"], float(w["x0"]), float(w["x1"]), float(w["top"]), float(w["bottom"])) for k, w in enumerate(page.extract_words())]
                        rows = rows or [(path, number, float(page.height), 0, None, 0.0, 0.0, 0.0, 0.0)]
                        yield pd.DataFrame(rows, columns=["source_doc", "page_no", "page_height", "word_ord", "text", "x0", "x1", "top", "bottom"])

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(extract, WORDS)
