"""Sections from page records: connectors, condition blocks, logic sentences, records and chunks.

Page records of one id are merged whatever lies between them.  Items keep their order as
rows (page order, place on the page); what depends on earlier items comes from windows
over a section.

``whole_sections`` gathers each section's pages in one row by one aggregate; items, connectors,
condition blocks and records are then expressions over that row, without a further sort, join
or window.  Where the steps are wanted as tables, ``by_section`` deals the pages into buckets by id
once.  All steps group, order and join by the id, so nothing is shuffled after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import SPACES, extract_note, label_set, once, one_connector, or_none, parse_label, sentence, strip, strip_note, truthy
from pagemill.sources.scratch import Scratch

_ENTRY = ("ord", "type", "label", "text", "ct", "note", "optional", "refs", "group", "alt", "connector", "block")
_BLOCK = ("id", "label", "gid", "text", "optional", "compound", "items", "actions")


def by_section(pages: DataFrame, buckets: int | None = None) -> DataFrame:
    """Pages that have an id, written in buckets of it."""
    return Scratch(pages.sparkSession, "sections").bucketed(pages.where("lco is not null"), "lco", buckets=buckets)


def merge_sections(pages: DataFrame) -> DataFrame:
    """One row for each id: first non-empty title, statement, applicability and document; pages and texts in order."""
    first = lambda c: F.min_by(c, F.when(truthy(F.col(c)).isNotNull(), F.col("page_ord"))).alias(c)
    ordered = F.array_sort(F.collect_list(F.struct("page_ord", "page_no", "raw_text")))
    merged = pages.where("lco is not null").groupBy("lco").agg(F.min("page_ord").alias("section_ord"), first("title"), first("lco_stmt"), first("applicability"), first("source_doc"), ordered.alias("p"))
    texts = F.filter("p.raw_text", lambda t: truthy(t).isNotNull())
    return merged.select("lco", "section_ord", "title", "lco_stmt", "applicability", "source_doc", F.col("p.page_no").alias("source_pages"), truthy(strip(F.array_join(texts, " "))).alias("raw_text"))


def section_items(pages: DataFrame) -> DataFrame:
    """Items of all pages as rows (lco, ord, ...), in order."""
    rows = pages.where("lco is not null").select("lco", "page_ord", F.posexplode("act_items").alias("pos", "item"))
    return rows.select("lco", F.struct("page_ord", "pos").alias("at"), "item.*").withColumn("ord", F.row_number().over(W.partitionBy("lco").orderBy("at"))).drop("at")


def attach_connectors(items: DataFrame) -> DataFrame:
    """Adds condition, group, alt, ``connector`` and ``block``.

    A connector right before an action is its own, if the action before that has the same
    condition.  ``block`` is the condition of the last action; null before the first.
    """
    order = W.partitionBy("lco").orderBy("ord")
    parsed = items.withColumn("p", F.when(F.col("type") == "action", parse_label(F.col("label")))).select("*", "p.*").drop("p")
    pending = F.when(F.lag("type").over(order) == "connector", F.lag("text").over(order))
    earlier = F.last("condition", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    current = F.last("condition", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    linked = parsed.withColumns({"_pending": pending, "_earlier": earlier, "block": current})
    return linked.withColumn("connector", F.when(F.col("condition") == F.col("_earlier"), truthy(F.col("_pending")))).drop("_pending", "_earlier")


def condition_texts(pages: DataFrame) -> DataFrame:
    """(lco, letter, ...): of several bands with one letter the last."""
    rows = pages.where("lco is not null").select("lco", "page_ord", F.posexplode("cond_bands").alias("pos", "band"))
    last = rows.groupBy("lco", F.col("band.letter").alias("letter")).agg(F.max_by("band", F.struct("page_ord", "pos")).alias("band"))
    return last.select("lco", "letter", F.col("band.text").alias("condition_text"), F.col("band.optional").alias("condition_optional"), F.col("band.compound").alias("compound"))


def condition_blocks(items: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each section and condition with actions: id, letter, text, its items and its actions."""
    kept = attach_connectors(items).where("block is not null")
    entry = F.struct(*_ENTRY)
    blocks = kept.groupBy("lco", "block").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(entry)).alias("items"))
    blocks = blocks.withColumn("id", F.row_number().over(W.partitionBy("lco").orderBy("first")))
    # by letter, so that the join needs nothing but the id
    said = F.struct("condition_text", "condition_optional", "compound")
    listed = texts.groupBy("lco").agg(F.map_from_entries(F.collect_list(F.struct("letter", said.alias("said")))).alias("_said"))
    blocks = blocks.join(listed, "lco", "left").withColumn("_own", F.try_element_at("_said", "block"))
    blocks = blocks.withColumns({"text": F.coalesce("_own.condition_text", F.lit("")), "optional": F.coalesce("_own.condition_optional", F.lit(False)), "compound": F.coalesce("_own.compound", F.lit(False))})
    return blocks.select("lco", F.col("block").alias("label"), "id", F.concat_ws("/", "lco", "block").alias("gid"), "text", "optional", "compound", "items", _actions(F.col("items")).alias("actions"))


def _actions(items: Column) -> Column:
    """The actions of a condition's items, numbered from 1."""
    acts = F.filter(items, lambda i: i["type"] == "action")
    return F.transform(acts, lambda a, k: F.struct((k + 1).alias("id"), F.concat("lco", F.lit("/"), a["label"]).alias("gid"), a["label"].alias("label"), a["group"].alias("group"), a["alt"].alias("alt"), a["connector"].alias("connector"), a["optional"].alias("optional"), a["text"].alias("text"), truthy(a["ct"]).alias("completion_time"), a["note"].alias("note"), a["refs"].alias("refs")))


def whole_sections(pages: DataFrame) -> DataFrame:
    """``merge_sections`` with each section's condition blocks as an array ``blocks``, by one aggregate.

    What stands in the row of a section is found from its pages in order; the work on a
    section grows with its items times its letters, 26 at most.
    """
    kept = F.struct("page_ord", "page_no", "title", "lco_stmt", "applicability", "source_doc", "raw_text", "cond_bands", "act_items")
    gathered = pages.where("lco is not null").groupBy("lco").agg(F.sort_array(F.collect_list(kept)).alias("p"))
    first = lambda c: F.get(F.filter(f"p.{c}", lambda x: x != ""), F.lit(0)).alias(c)
    flat = lambda c: F.flatten(F.filter(f"p.{c}", lambda x: x.isNotNull()))
    raw = truthy(strip(F.array_join(F.filter("p.raw_text", lambda x: x != ""), " ")))
    parse = lambda i: F.when(i["type"] == "action", parse_label(i["label"]))
    none = {"text": F.lit(""), "optional": F.lit(False), "compound": F.lit(False)}

    def linked(items: Column, parsed: Column, letters: Column) -> Column:
        def upto(k: Column) -> Column:
            """The condition of the last action before place k; far ones are looked for if both items before it have none."""
            near = (F.when(k > n, F.get(letters, k - n - 1)) for n in (0, 1))
            return F.coalesce(*near, F.when(k > 2, F.try_element_at(F.filter(F.slice(letters, 1, k - 2), lambda c: c.isNotNull()), F.lit(-1))))

        def entry(i: Column, k: Column) -> Column:
            own, before = F.get(parsed, k), F.get(items, k - 1)
            by = F.when((k > 0) & (before["type"] == "connector"), F.when(own["condition"] == upto(k), truthy(before["text"])))
            found = {"ord": k + 1, "group": own["group"], "alt": own["alt"], "connector": by, "block": upto(k + 1)}
            return F.struct(*((found[c] if c in found else i[c]).alias(c) for c in _ENTRY))

        return F.transform(items, entry)

    def block(label: Column, k: Column, entries: Column, bands: Column) -> Column:
        told = F.try_element_at(F.filter(bands, lambda b: b["letter"] == label), F.lit(-1))
        own = F.struct(told.alias("said"), F.filter(entries, lambda i: i["block"] == label).alias("items"))
        of = lambda o: {"id": k + 1, "label": label, "gid": F.concat_ws("/", "lco", label), "items": o["items"], "actions": _actions(o["items"]), **{c: F.coalesce(o["said"][c], none[c]) for c in none}}
        return once(own, lambda o: F.struct(*(of(o)[c].alias(c) for c in _BLOCK)))

    def blocks(items: Column, parsed: Column, letters: Column) -> Column:
        begun = F.array_distinct(F.filter(letters, lambda c: c.isNotNull()))
        held = F.struct(linked(items, parsed, letters).alias("entries"), flat("cond_bands").alias("bands"))
        return once(held, lambda h: F.transform(begun, lambda label, k: block(label, k, h["entries"], h["bands"])))

    each = once(flat("act_items"), lambda i: once(F.transform(i, parse), lambda p: once(F.transform(p, lambda x: x["condition"]), lambda c: blocks(i, p, c))))
    return gathered.select("lco", F.col("p")[0]["page_ord"].alias("section_ord"), *map(first, ("title", "lco_stmt", "applicability", "source_doc")), F.col("p.page_no").alias("source_pages"), raw.alias("raw_text"), each.alias("blocks"))


def section_blocks(sections: DataFrame) -> DataFrame:
    """The condition blocks of ``whole_sections`` as rows."""
    # outer, as the filter that inline implies would find all blocks a second time
    return sections.select("lco", F.inline_outer("blocks")).where("id is not null")


def _nested(sections: DataFrame, blocks: DataFrame | None) -> DataFrame:
    """Sections with their blocks as an array: their own column, or gathered from a table of blocks."""
    if blocks is None:
        return sections
    kind = T.ArrayType(T.StructType([blocks.schema[c] for c in _BLOCK]))
    listed = blocks.groupBy("lco").agg(F.array_sort(F.collect_list(F.struct(*_BLOCK))).alias("blocks"))
    return sections.join(listed, "lco", "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(kind)))


def _groups(actions: Column) -> Column:
    """The groups of a condition's actions in order of appearance: their labels as a set, and what stands before their first."""
    def group(g: Column) -> Column:
        members = F.filter(actions, lambda a: a["group"].eqNullSafe(g))
        return once(members, lambda m: F.struct(g.alias("group"), label_set(F.transform(m, lambda a: a["label"])).alias("names"), truthy(F.get(m, F.lit(0))["connector"]).alias("by"), m.alias("members")))

    return F.transform(F.array_distinct(F.transform(actions, lambda a: a["group"])), group)


def logic_sentence(groups: Column, action: Column) -> Column:
    """How an action is joined to its siblings, and the groups of its condition (``_groups``) to one another; null if alone."""
    place = F.array_position(F.transform(groups, lambda g: g["group"]), action["group"]) - 1
    mine = F.get(F.filter(groups, lambda g: g["group"].eqNullSafe(action["group"])), F.lit(0))["members"]

    def within(m: Column) -> Column:
        siblings = F.transform(F.filter(m, lambda a: a["id"] != action["id"]), lambda a: a["label"])
        by = one_connector(F.transform(F.slice(m, 2, F.greatest(F.size(m), F.lit(1))), lambda a: a["connector"]))
        named = F.when(F.size(siblings) == 1, F.get(siblings, F.lit(0))).otherwise(label_set(siblings))
        return F.when(F.size(m) > 1, F.concat(action["label"], F.lit(" is joined with "), named, F.lit(" by "), by))

    def boundaries(at: Column) -> Column:
        def boundary(g: Column, k: Column) -> Column:
            left = F.get(groups, k - 1)["names"]
            near, far = F.when(at == k, g["names"]).otherwise(left), F.when(at == k, left).otherwise(g["names"])
            clause = F.when((k > 0) & g["by"].isNotNull(), F.concat(F.lit("the group "), near, F.lit(" is joined with "), far, F.lit(" by "), g["by"]))
            return F.struct(F.least(F.abs(at - k + 1), F.abs(at - k)).alias("d"), k.alias("k"), clause.alias("clause"))

        return F.sort_array(F.filter(F.transform(groups, boundary), lambda b: b["clause"].isNotNull()))

    edges = F.when(F.size(groups) > 1, F.transform(once(place, boundaries), lambda b: b["clause"])).otherwise(F.array().cast("array<string>"))
    clauses = F.concat(F.filter(F.array(once(mine, within)), lambda c: c.isNotNull()), edges)
    return once(clauses, lambda c: F.when(F.size(c) > 0, F.concat(F.lit("Logic: "), F.array_join(c, "; "), F.lit("."))))


def _heading() -> tuple[Column, Column]:
    return (
        sentence(strip(F.concat(F.lit("LCO "), F.col("lco"), F.lit(" "), F.coalesce("title", F.lit(""))))),
        sentence(strip(F.concat(F.lit("Applicability: "), or_none(F.col("applicability"))))),
    )


def _condition(label: Column, text: Column) -> Column:
    return sentence(strip(F.concat(F.lit("Condition "), label, F.lit(": "), text)))


def _see(refs: Column) -> Column:
    return F.transform(F.coalesce(refs, F.array().cast("array<string>")), lambda r: F.concat(F.lit("See "), r, F.lit(".")))


def _actions_text() -> Column:
    """A nested section as indented lines."""
    def line(i: Column) -> Column:
        note = F.when(truthy(i["note"]).isNotNull(), F.concat(F.lit("(NOTE: "), i["note"], F.lit(") "))).otherwise("")
        time = F.when(truthy(i["ct"]).isNotNull(), F.concat(F.lit("  [CT] "), i["ct"])).otherwise("")
        return F.when(i["type"] == "connector", F.concat(F.lit("  "), i["text"])).otherwise(F.concat(F.lit("  "), i["label"], F.lit(" "), note, i["text"], time))

    lines = F.flatten(F.transform("blocks", lambda b: F.concat(F.array(F.concat(F.lit("CONDITION "), b["label"], F.lit(": "), b["text"])), F.transform(b["items"], line), F.array(F.lit("")))))
    head = F.filter(F.array(truthy(F.col("title")), truthy(F.col("lco_stmt")), F.concat(F.lit("APPLICABILITY: "), truthy(F.col("applicability")))), lambda x: x.isNotNull())
    return F.rtrim(F.array_join(F.concat(head, F.array(F.lit("")), lines), "\n"), F.lit(SPACES))


def actions_text(blocks: DataFrame | None, sections: DataFrame) -> DataFrame:
    """(lco, actions_text): the section as indented lines."""
    return _nested(sections, blocks).select("lco", _actions_text().alias("actions_text"))


def hierarchical_records(sections: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One record for each section with its condition blocks nested."""
    shown = ("id", "gid", "label", "text", "optional", "compound", "actions")
    condition_blocks = F.transform("blocks", lambda b: F.struct(*(b[c].alias(c) for c in shown))).alias("condition_blocks")
    return _nested(sections, blocks).select(F.col("lco").alias("id"), F.struct("lco", "title", "applicability", "source_doc", "source_pages").alias("metadata"), F.struct(F.col("lco_stmt").alias("lco_statement"), "raw_text", _actions_text().alias("actions_text"), condition_blocks).alias("content"))


def _units(sections: DataFrame, units: Column) -> DataFrame:
    """A row for each of a nested section's units, ``u``, and one with a null ``u`` for its statement, if it has one."""
    lco, applicability = _heading()
    rows = sections.withColumns({"_units": units, "_lco": lco, "_applicability": applicability})
    kind = rows.schema["_units"].dataType
    marked = lambda stated, u: F.struct(F.lit(stated).alias("stated"), u.alias("u"))
    statement = F.array(marked(True, F.lit(None).cast(kind.elementType)))
    every = F.transform("_units", lambda u: marked(False, u))
    every = F.when(truthy(F.col("lco_stmt")).isNotNull(), F.concat(every, statement)).otherwise(every)
    # outer, as the filter that explode implies would find all units a second time
    return rows.withColumn("_row", F.explode_outer(every)).where("_row is not null").withColumns({"u": F.col("_row.u"), "_stated": F.col("_row.stated")})


def _either(stated: Column, unit: Column) -> Column:
    return F.when(F.col("_stated"), stated).otherwise(unit)


def action_records(sections: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One record for each action, and one for each section's statement, with a sentence body."""
    none = F.lit(None).cast("string")

    def acts(b: Column) -> Column:
        unit = lambda a, logic: F.struct(b["id"].alias("condition_id"), b["label"].alias("condition_label"), b["text"].alias("condition_text"), a.alias("a"), logic.alias("logic"))
        several = once(_groups(b["actions"]), lambda g: F.transform(b["actions"], lambda a: unit(a, logic_sentence(g, a))))
        return F.when(F.size(b["actions"]) > 1, several).otherwise(F.transform(b["actions"], lambda a: unit(a, none)))

    rows = _units(_nested(sections, blocks), F.flatten(F.transform("blocks", acts)))
    u, a = F.col("u"), F.col("u.a")
    note = F.when(truthy(a["note"]).isNotNull(), F.concat(F.lit(" Note: "), a["note"], F.lit("."))).otherwise("")
    refs = F.array_join(F.transform(_see(a["refs"]), lambda r: F.concat(F.lit(" "), r)), "")
    act = F.concat(F.lit("Required Action "), a["label"], F.lit(": "), a["text"], note, F.lit(" Completion Time: "), or_none(a["completion_time"]), F.lit("."), refs)
    body = strip(F.concat_ws(" ", "_lco", "_applicability", _condition(u["condition_label"], u["condition_text"]), act))
    noted = extract_note(F.col("lco_stmt"))
    said = strip(F.concat(strip_note(F.col("lco_stmt")), F.when(truthy(noted).isNotNull(), F.concat(F.lit(" Note: "), noted, F.lit("."))).otherwise("")))
    stated = strip(F.concat_ws(" ", "_lco", "_applicability", truthy(said)))
    source, kind = F.col("lco").alias("source_hierarchical_id"), F.when(F.col("_stated"), "lco_statement").alias("chunk_type")
    metadata = F.struct(source, "lco", "title", "applicability", u["condition_id"].alias("condition_id"), u["condition_label"].alias("condition_label"), a["id"].alias("action_id"), a["label"].alias("action_label"), a["connector"].alias("connector"), a["optional"].alias("optional"), kind, "source_doc", "source_pages")
    content = F.struct(u["condition_text"].alias("condition_text"), a["text"].alias("action_text"), a["completion_time"].alias("completion_time"), _either(noted, a["note"]).alias("note"), _either(F.array().cast("array<string>"), a["refs"]).alias("refs"), u["logic"].alias("logic"), _either(stated, F.concat_ws(" ", body, u["logic"])).alias("body"))
    return rows.select(_either(F.concat("lco", F.lit("/LCO")), a["gid"]).alias("id"), metadata.alias("metadata"), content.alias("content"))


def condition_records(sections: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One record for each condition, and one for each statement, with a body of lines."""
    def lines(a: Column) -> Column:
        head = strip(F.concat(F.when(a["optional"], "[Optional] ").otherwise(""), a["label"], F.lit(" "), a["text"]))
        details = F.array(head, F.concat(F.lit("NOTE: "), truthy(a["note"])), F.concat(F.lit("Completion Time: "), truthy(a["completion_time"])))
        link = F.when(truthy(a["connector"]).isNotNull(), F.array(F.lit(""), a["connector"], F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(link, F.filter(details, lambda x: x.isNotNull()), _see(a["refs"]))

    rows, u = _units(_nested(sections, blocks), F.col("blocks")), F.col("u")
    every = F.concat(F.array(F.col("_lco"), F.col("_applicability"), F.lit(""), _condition(u["label"], u["text"]), F.lit(""), F.lit("Required Actions:")), F.flatten(F.transform(u["actions"], lines)))
    said = F.filter(F.array(F.col("_lco"), F.col("_applicability"), sentence(strip_note(F.col("lco_stmt"))), F.concat(F.lit("NOTE: "), truthy(extract_note(F.col("lco_stmt"))))), lambda x: truthy(x).isNotNull())
    gid, kind = F.concat(F.col("lco"), F.lit("/LCO")), rows.schema["u"].dataType["actions"].dataType
    metadata = F.struct(F.col("lco").alias("source_hierarchical_id"), "lco", "title", "applicability", u["id"].alias("condition_id"), u["label"].alias("condition_label"), F.when(F.col("_stated"), "lco_statement").otherwise("condition").alias("chunk_type"), _either(F.array(gid), u["actions"]["gid"]).alias("evidence_ids"), "source_doc", "source_pages")
    content = F.struct(u["text"].alias("condition_text"), _either(F.array().cast(kind), u["actions"]).alias("actions"), strip(F.array_join(_either(said, every), "\n")).alias("body"))
    return rows.select(_either(gid, u["gid"]).alias("id"), metadata.alias("metadata"), content.alias("content"))


def raw_records(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("lco").alias("id"), F.struct("lco", "title", "applicability", "source_doc", "source_pages").alias("metadata"), "raw_text")


def label_gaps(blocks: DataFrame) -> DataFrame:
    """Conditions whose letters do not run A, B, C, ... in their section."""
    expected = F.char(F.lit(64) + F.col("id"))
    return blocks.where(F.col("label") != expected).select("lco", "id", "label", expected.alias("expected"))
