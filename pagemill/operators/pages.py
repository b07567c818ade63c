"""Pages of positioned words to page records: statement, conditions, actions and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import ACTION_LABEL, CONNECTOR, TIME_START, clean_text, extract_note, is_optional, normalize_raw, once, references, strip, strip_note, truthy
from pagemill.operators.layout import printed_pages, whole_pages
from pagemill.sources.scratch import Scratch, bound_batches, session_setting

LAYOUT = {"col1_max": 220.0, "col2_max": 410.0, "header_margin": 95.0}


def statement_and_applicability(narrative: Column) -> Column:
    """Struct (statement, applicability) of a joined narrative; null where absent."""
    def said(split: Column) -> Column:
        applicability = F.when(F.size(split) > 1, strip(F.regexp_replace(strip(split[1]), "^:+", "")))
        from_id = lambda statement: once(F.regexp_extract(statement, r"(?s)(LCO\s+\d+\.\d+\.\d+\s+.*)", 1), lambda x: F.when(x != "", strip(x)).otherwise(truthy(statement)))
        return F.struct(once(strip(split[0]), from_id).alias("statement"), applicability.alias("applicability"))

    text = strip(F.split(clean_text(narrative), r"\bACTIONS\b", 2)[0])
    return once(F.split(text, "(?i)APPLICABILITY", 2), said)


def starts_completion_time(row: Column) -> Column:
    return row.rlike(TIME_START)


def time_blocks(rows: Column) -> Column:
    """Rows of times (strings in order) as blocks; a start opens one unless the row before is a bare AND or OR."""
    row = lambda i: F.get(rows, i - 1)
    starts = lambda i: (i == 1) | F.coalesce(starts_completion_time(row(i)) & ~F.upper(row(i - 1)).isin("AND", "OR"), F.lit(False))
    begins = F.filter(F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.size(rows))).otherwise(F.array().cast("array<int>")), starts)
    cut = lambda begins: F.transform(begins, lambda b, k: F.array_join(F.slice(rows, b, F.coalesce(F.get(begins, k + 1), F.size(rows) + 1) - b), " "))
    return once(begins, cut)


def completion_time_blocks(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, block, ct): the ``time_blocks`` of each key's rows, numbered from 1."""
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_rows")).select(*keys, F.col("_rows.t").alias("_rows"))
    joined = listed.select(*keys, F.posexplode(time_blocks(F.col("_rows"))).alias("block", "ct"))
    return joined.select(*keys, (F.col("block") + 1).alias("block"), clean_text(F.col("ct")).alias("ct")).where("ct <> ''")


def band_items(steps: Column, rows: Column) -> Column:
    """The actions and connectors of a band in order; rows are its times, if they stand in lines of their own.

    An action's time is its block of rows if there are as many of them, all blocks if it is
    the only action, else what stood beside it.
    """
    none = F.lit(None).cast("string")
    cleaned = F.filter(F.transform(rows, clean_text), lambda r: r != "")
    blocks = F.filter(F.transform(once(cleaned, time_blocks), clean_text), lambda b: b != "")

    def action(s: Column, k: Column, n: Column, blocks: Column) -> Column:
        ct = F.when(F.size(blocks) == n, F.get(blocks, k)).when((n == 1) & (F.size(blocks) > 0), clean_text(F.array_join(blocks, " "))).otherwise(clean_text(F.coalesce(s["ct"], F.lit(""))))
        cleaned = lambda cleaned: once(F.regexp_replace(cleaned, r"^[A-Z]\.\d+(?:\.\d+)?\s*", ""), lambda body: F.struct(
            s["b"].alias("b"), F.lit("action").alias("type"), s["first"].alias("label"), extract_note(body).alias("note"), strip_note(body).alias("text"), ct.alias("ct"), is_optional(s["act"]).alias("optional"), references(cleaned).alias("refs")))
        return once(clean_text(s["act"]), cleaned)

    connector = lambda s: F.struct(s["b"].alias("b"), F.lit("connector").alias("type"), none.alias("label"), none.alias("note"), s["first"].alias("text"), none.alias("ct"), F.lit(None).cast("boolean").alias("optional"), F.array().cast("array<string>").alias("refs"))
    actions = F.filter(steps, lambda s: s["first"].rlike(ACTION_LABEL))
    connectors = F.transform(F.filter(steps, lambda s: s["first"].rlike(CONNECTOR)), connector)
    listed = lambda found, blocks: F.sort_array(F.concat(F.transform(found, lambda s, k: action(s, k, F.size(found), blocks)), connectors))
    return once(blocks, lambda blocks: once(actions, lambda found: listed(found, blocks)))


def parse_pages(words: DataFrame, layout: dict = LAYOUT, overrides: DataFrame | None = None) -> DataFrame:
    """One page record for each page with words; ``words`` are rows of words or of stretches of them (see ``whole_pages``).

    One shuffle gathers a page's words in its row; its regions, bands and texts are found by
    one pass over that row (``printed_pages``) and written once, and no step after it shuffles
    or sorts words again.  Words without a page number or a place are left out.
    """
    bound_batches(words.sparkSession)  # a row holds a page
    # words that come in the order of their pages are gathered without another sort
    with session_setting(words.sparkSession, "spark.sql.execution.replaceHashWithSortAgg", "true"):
        # written: its reading is a step of its own over a plain column
        whole = Scratch(words.sparkSession, "pages").table(printed_pages(whole_pages(words), layout, overrides))

    titles = F.filter("bands", lambda t: F.col("anchored") & t["cond"].rlike(r"^[A-Z]\."))
    band = lambda t: once(clean_text(t["cond"]), lambda cleaned: F.struct(
        F.substring(t["cond"], 1, 1).alias("letter"), F.regexp_replace(cleaned, r"^[A-Z]\.\s*", "").alias("text"), is_optional(t["cond"]).alias("optional"), cleaned.rlike(r"\bAND\b|\bOR\b").alias("compound")))
    pieces = F.transform(F.array_compact(F.flatten(F.transform("bands", lambda t: F.array(t["cond"], t["act"], t["time"])))), normalize_raw)
    # what stands before the statement is left out of the plain text
    plain = F.concat(F.array(F.coalesce(normalize_raw(F.coalesce("trimmed", "narrative")), F.lit(""))), pieces)
    fields = ("type", "label", "note", "text", "ct", "optional", "refs")
    items = F.transform(F.flatten(F.transform("bands", lambda t: band_items(t["steps"], t["lines"]))), lambda i: F.struct(*(i[f].alias(f) for f in fields)))
    whole = whole.withColumn("said", statement_and_applicability(F.col("narrative")))
    return whole.select(
        "lco", "title", F.col("said.statement").alias("lco_stmt"), "said.applicability", F.transform(titles, band).alias("cond_bands"), items.alias("act_items"),
        truthy(normalize_raw(F.array_join(F.filter(plain, lambda p: p != ""), " "))).alias("raw_text"), "page_no", truthy(F.col("source_doc")).alias("source_doc"))
