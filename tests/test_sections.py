"""Layout, page parsing and section assembly on hand-made pages."""

import random

from pyspark.sql import functions as F

from pagemill.operators import layout, pages, sections
from pagemill.operators.questions import smoke_questions
from pagemill.schemas import PAGES, WORDS


def word(text, x0, top, height=10.0, width=None):
    return {"text": text, "x0": float(x0), "x1": float(x0 + (width or 6 * len(text))), "top": float(top), "bottom": top + height, "word_ord": 0}


def test_reading_order():
    words = [word("b", 50, 10), word("a", 10, 12), word("next", 10, 40)]
    assert layout.reading_order(words) == "a b next"
    assert layout.reading_order([word("T", 10, 10, 10, 6), word("avg", 17, 15, 8)]) == "T_avg"
    assert layout.reading_order([]) == ""


def page(rows, number=1, height=800.0):
    return [("doc", number, height, k, t, float(x), float(x + 6 * len(t)), float(y), float(y + 10)) for k, (t, x, y) in enumerate(rows)]


HEAD = [("Pressure", 60, 40), ("3.4.5", 200, 40), ("3.4.5", 60, 100), ("Pressure", 100, 100), ("LCO", 60, 115), ("3.4.5", 100, 115), ("Two", 160, 115), ("loops.", 200, 115), ("APPLICABILITY:", 60, 130), ("MODE", 160, 130), ("1.", 200, 130), ("ACTIONS", 60, 145), ("CONDITION", 60, 200), ("COMPLETION", 420, 200), ("TIME", 500, 200)]
BODY = [
    ("A.", 60, 220), ("Loop", 80, 220), ("out", 120, 220), ("A.1", 240, 220), ("Restore.", 280, 220), ("1", 420, 220), ("hour", 440, 220),
    ("AND", 240, 240), ("[", 240, 260), ("A.2", 250, 260), ("Verify", 290, 260), ("----NOTE----", 240, 280), ("B.2", 240, 300), ("applies", 280, 300), ("----", 240, 320), ("SR", 240, 340), ("3.4.5.1", 270, 340), ("]", 330, 340), ("8", 420, 260), ("hours", 440, 260),
    ("B.", 60, 400), ("Time", 80, 400), ("over", 120, 400), ("B.1", 240, 400), ("Be", 280, 400), ("in", 300, 400), ("MODE", 320, 400), ("3.", 360, 400), ("OR", 420, 420), ("6", 420, 400), ("hours", 440, 400), ("12", 420, 440), ("hours", 440, 440),
    ("SURVEILLANCE", 60, 500), ("REQUIREMENTS", 160, 500), ("lost", 60, 520), ("Rev.", 60, 700),
]
CONTINUED = [("Pressure", 60, 40), ("3.4.5", 200, 40), ("CONDITION", 60, 100), ("COMPLETION", 420, 100), ("B.2", 240, 130), ("Be", 280, 130), ("cold.", 300, 130), ("36", 420, 130), ("hours", 440, 130)]


def parsed(spark, overrides=None):
    words = spark.createDataFrame(page(HEAD + BODY) + page(CONTINUED, 2), WORDS)
    return {r.page_no: r for r in pages.parse_pages(words, overrides=overrides).collect()}


def test_pages(spark):
    rows = parsed(spark)
    first, second = rows[1], rows[2]
    assert (first.lco, first.title, first.lco_stmt, first.applicability) == ("3.4.5", "Pressure", "LCO 3.4.5 Two loops.", "MODE 1.")
    assert [tuple(b) for b in first.cond_bands] == [("A", "Loop out", False, False), ("B", "Time over", False, False)]
    kinds = [(i.type, i.label or i.text, i.ct, i.optional, i.note) for i in first.act_items]
    assert kinds == [("action", "A.1", "1 hour", False, None), ("connector", "AND", None, None, None), ("action", "A.2", "8 hours", True, "B.2 applies"), ("action", "B.1", "6 hours OR 12 hours", False, None)]
    assert first.act_items[2].refs == ["SR 3.4.5.1"]
    assert first.raw_text.startswith("LCO 3.4.5 Two loops. APPLICABILITY: MODE 1. ACTIONS A. Loop out A.1 Restore. AND A.2")
    assert "lost" not in first.raw_text
    assert [(i.label, i.text, i.ct) for i in second.act_items] == [("B.2", "Be cold.", "36 hours")]
    assert second.cond_bands == []


def test_layout_overrides(spark):
    own = spark.createDataFrame([("3.4.5", 70.0)], "lco string, col1_max double")
    assert parsed(spark, own)[1].cond_bands[0].text == ""


def test_pages_are_records_without_joins_or_windows(spark):
    """Before, headings, regions, bands and texts took a join, a window or an aggregate each, over words written once more."""
    words = spark.createDataFrame(page(HEAD + BODY) + page(CONTINUED, 2) + page(CONTINUED, 3, None), WORDS)
    own = spark.createDataFrame([("3.4.5", 70.0)], "lco string, col1_max double")
    for got in (pages.parse_pages(words), pages.parse_pages(words, overrides=own)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not any(step in plan for step in ("Join", "Window", "Generate", "Exchange hashpartitioning"))
    rows = {r.page_no: r for r in pages.parse_pages(words).collect()}
    assert rows[3].act_items == rows[2].act_items and len(rows) == 3  # a page without a height was lost


def test_boxes_equal_the_reading_order_of_their_words(spark):
    rng = random.Random(4)
    placed = [[{**word(rng.choice(["a", "bb", "", "[", "avg", "x y"]), rng.randrange(0, 60), rng.choice([10, 10.5, 13, 22, 22.5, 47])), "word_ord": i, "kind": 0, "col": rng.randrange(3)} for i in range(rng.choice([0, 1, 9, 40]))] for _ in range(60)]
    for w in (w for p in placed for w in p):
        w["line"], w["kind"] = float(round(w["top"])), layout.KINDS.index("bracket" if w["text"] == "[" else "blank" if not w["text"] else "word")
    some = lambda: {"lo": rng.choice([float("-inf"), 10.0, 13.0]), "hi": rng.choice([float("inf"), 10.5, 30.0]), "line": rng.choice([None, None, 10.0, 22.0]), "col": rng.randrange(3), "lines": rng.random() < 0.5, "first": rng.random() < 0.5}
    boxes = [[some() for _ in range(rng.choice([0, 1, 6]))] for _ in placed]
    kind = "array<struct<top:double,x0:double,word_ord:int,x1:double,bottom:double,text:string,kind:int,line:double,col:int>>"
    frame = spark.createDataFrame([(k, p, b) for k, (p, b) in enumerate(zip(placed, boxes, strict=True))], f"k int, words {kind}, boxes array<struct<lo:double,hi:double,line:double,col:int,lines:boolean,first:boolean>>")
    for r in frame.select("k", layout.join_boxes("words", "boxes").alias("found")).collect():
        for b, found in zip(boxes[r.k], r.found, strict=True):
            held = [w for w in placed[r.k] if b["lo"] <= w["top"] < b["hi"] and w["col"] == b["col"] and b["line"] in (None, w["line"])]
            more = sorted((w["line"], w["x0"], w["word_ord"], w["text"]) for w in held if w["text"] not in ("", "["))
            assert found.joined == (layout.reading_order(held) if held else None)
            assert found.lines == ([layout.reading_order([w for w in held if w["line"] == x]) for x in sorted({w["line"] for w in held})] if b["lines"] else [])
            assert found.first == (more[0][3] if more and b["first"] else None)


def test_completion_time_blocks(spark):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate(["1 hour", "OR", "8 hours", "Immediately"])], "key string, o int, row string")
    assert [r.ct for r in pages.completion_time_blocks(rows, ["key"], "o", "row").orderBy("block").collect()] == ["1 hour OR 8 hours", "Immediately"]


def item(kind, name, **more):
    action = kind == "action"
    return (kind, name if action else None, more.get("note"), more.get("text", "do") if action else name, more.get("ct", "") if action else None, more.get("optional", False) if action else None, more.get("refs", []))


def assembled(spark, *records):
    frame = spark.createDataFrame(list(records), PAGES).withColumn("page_ord", F.col("page_no"))
    blocks = sections.condition_blocks(sections.section_items(frame), sections.condition_texts(frame))
    return frame, sections.merge_sections(frame), blocks


def record(number, items, bands=(), lco="L", stmt=None, applicability=None, title="T"):
    return (lco, title, stmt, applicability, [(*b, False, False) for b in bands], items, f"raw {number}", number, "doc")


SEQUENCE = [item("connector", "OR"), item("action", "A.1"), item("connector", "AND"), item("action", "A.2.1"), item("connector", "OR"), item("action", "A.2.2"), item("connector", "OR"), item("action", "B.1")]


def test_connectors_and_logic(spark):
    frame, merged, blocks = assembled(spark, record(1, SEQUENCE, [("A", "old"), ("A", "text")]))
    linked = sections.attach_connectors(sections.section_items(frame)).where("type = 'action'").orderBy("ord").collect()
    assert [(r.label, r.connector) for r in linked] == [("A.1", None), ("A.2.1", "AND"), ("A.2.2", "OR"), ("B.1", None)]
    assert {r.label: r.text for r in blocks.collect()} == {"A": "text", "B": ""}
    bodies = {r.id: r.content for r in sections.action_records(merged, blocks).collect()}
    assert bodies["L/A.1"].logic == "Logic: the group {A.1} is joined with {A.2.1, A.2.2} by AND."
    assert bodies["L/A.2.1"].logic == "Logic: A.2.1 is joined with A.2.2 by OR; the group {A.2.1, A.2.2} is joined with {A.1} by AND."
    assert bodies["L/B.1"].logic is None
    assert bodies["L/B.1"].body == "LCO L T. Applicability: None. Condition B:. Required Action B.1: do Completion Time: None."
    assert sections.label_gaps(blocks).count() == 0


def test_merged_section_and_bodies(spark):
    items = [item("action", "A.1", ct="1 hour", note="n", refs=["SR 1.1.1.1"], optional=True)]
    _, merged, blocks = assembled(spark, record(2, [], stmt="LCO L (NOTE: m) run", applicability="MODE 1"), record(1, items, [("A", "bad")], title=None), record(3, [], lco=None))
    row = merged.collect()
    assert len(row) == 1
    assert (row[0].title, row[0].lco_stmt, row[0].source_pages, row[0].raw_text) == ("T", "LCO L (NOTE: m) run", [1, 2], "raw 1 raw 2")
    conditions = {r.id: r for r in sections.condition_records(merged, blocks).collect()}
    assert conditions["L/A"].content.body == "LCO L T.\nApplicability: MODE 1.\n\nCondition A: bad.\n\nRequired Actions:\n[Optional] A.1 do\nNOTE: n\nCompletion Time: 1 hour\nSee SR 1.1.1.1."
    assert conditions["L/LCO"].content.body == "LCO L T.\nApplicability: MODE 1.\nLCO L run.\nNOTE: m"
    assert conditions["L/A"].metadata.evidence_ids == ["L/A.1"]
    actions = {r.id: r for r in sections.action_records(merged, blocks).collect()}
    assert actions["L/A.1"].content.body == "LCO L T. Applicability: MODE 1. Condition A: bad. Required Action A.1: do Note: n. Completion Time: 1 hour. See SR 1.1.1.1."
    assert actions["L/LCO"].content.body == "LCO L T. Applicability: MODE 1. LCO L run Note: m."
    outline = sections.hierarchical_records(merged, blocks).first().content
    assert outline.actions_text == "T\nLCO L (NOTE: m) run\nAPPLICABILITY: MODE 1\n\nCONDITION A: bad\n  A.1 (NOTE: n) do  [CT] 1 hour"
    asked = smoke_questions(sections.action_records(merged, blocks), "id", 40).collect()
    assert [(q.id, q.question) for q in asked] == [("smoke_action_001", "For LCO L, what is Required Action A.1 when the condition is: bad"), ("smoke_ct_002", "For LCO L, what is the Completion Time for Required Action A.1?")]


def test_one_shuffle_by_section(spark):
    """Pages are dealt once; the plans of the records hold no shuffle, and give the rows of pages that were not dealt."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    pages_ = spark.createDataFrame([r for k in range(40) for r in (record(1, SEQUENCE, [("A", "old"), ("A", "text")], lco=f"L{k}", stmt="LCO run"), record(2, [item("action", "B.2")], [("B", "more")], lco=f"L{k}"))] + [record(3, [], lco=None)], PAGES).withColumn("page_ord", F.col("page_no"))

    def records(p):
        merged, blocks = sections.merge_sections(p), sections.condition_blocks(sections.section_items(p), sections.condition_texts(p))
        return [sections.action_records(merged, blocks), sections.condition_records(merged, blocks), sections.hierarchical_records(merged, blocks)]

    try:
        for k, v in zip(kept, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        dealt = sections.by_section(pages_, buckets=5)
        for got, want in zip(records(dealt), records(pages_), strict=True):
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def plain_order(words):
    """Reading order word by word."""
    rows = []
    for w in sorted(words, key=lambda w: (w["top"], w["x0"], w["word_ord"])):
        middle = (w["top"] + w["bottom"]) / 2
        for box, row in rows:
            if abs(middle - (box[0] + box[1]) / 2) <= 0.7 * max(1.0, box[1] - box[0]):
                row.append(w)
                box[:] = min(box[0], w["top"]), max(box[1], w["bottom"])
                break
        else:
            rows.append(([w["top"], w["bottom"]], [w]))
    out = []
    for _, row in sorted(rows, key=lambda r: r[0][0]):
        before = None
        for w in sorted(row, key=lambda w: w["x0"]):
            tall, own = (max(1.0, before["bottom"] - before["top"]) if before else 0), max(1.0, w["bottom"] - w["top"])
            sub = before and 0 < len(w["text"]) <= 5 and 0 < len(before["text"]) <= 3 and -1.0 <= w["x0"] - before["x1"] <= 4.0 and own <= 1.15 * tall and (w["top"] + w["bottom"] - before["top"] - before["bottom"]) / 2 > 0.10 * tall
            if sub:
                out[-1] += "_" + w["text"]
            else:
                out.append(w["text"])
            before = w
    return " ".join(out)


def test_reading_order_of_many_regions_equals_word_by_word(spark):
    rng = random.Random(6)
    regions = []
    for k in range(400):
        n = rng.choice([0, 1, 2, 5, 12, 40, 150])
        line = lambda: rng.choice([10, 10.5, 13, 15, 22, 30, 47, 60]) + rng.choice([0, 0, 0, 1, 40, 90])
        words = [word(rng.choice(["a", "bb", "", "avg", "long word", "😀", "é"]), rng.choice([rng.randrange(0, 300), 10, 17]), line(), float(rng.choice([4, 6, 8, 10, 10, 10, 25])), rng.choice([None, 6])) for _ in range(n)]
        regions.append([{**w, "word_ord": i if k % 2 else 0} for i, w in enumerate(words)])
    kind = "array<struct<top:double,x0:double,word_ord:int,x1:double,bottom:double,text:string>>"
    frame = spark.createDataFrame([(k, r) for k, r in enumerate([*regions, None])], f"k int, words {kind}").repartition(3)
    got = {r.k: r.t for r in frame.select("k", layout.join_words("words").alias("t")).collect()}
    assert got == {k: plain_order(r) if r else "" for k, r in enumerate(regions)} | {400: None} or got == {k: plain_order(r) for k, r in enumerate([*regions, []])}


def test_bands_by_merging_equal_a_range_join(spark):
    rng = random.Random(2)
    words = spark.createDataFrame([("d" if k % 3 else "", k % 7, float(rng.randrange(40)), f"w{k}") for k in range(500)] + [(None, None, 3.0, "x"), ("d", 1, None, "y")], "source_doc string, page_no int, top double, text string")
    spans, at = [], {}
    for doc in ("d", ""):
        for page_no in range(6):
            tops = sorted(rng.sample(range(40), 4))
            at[doc, page_no] = [(float(a), float(b - (rng.random() < 0.3))) for a, b in zip(tops, [*tops[1:], 38], strict=True)]
            spans += [(doc, page_no, a, b, f"{a}") for a, b in at[doc, page_no]]
    bands = spark.createDataFrame(spans, "source_doc string, page_no int, band_top double, band_bottom double, name string")
    got = layout.in_bands(words, bands)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((w.text, a, f"{a}") for w in words.collect() for a, b in at.get((w.source_doc, w.page_no), []) if w.top is not None and a <= w.top < b)
    assert sorted((r.text, r.band_top, r.name) for r in got.collect()) == want


def test_whole_sections_equal_the_steps_with_one_shuffle_and_nothing_else(spark):
    """Before, the records of a section took joins, windows and a sort for each of them."""
    rng = random.Random(8)
    one = lambda: item("connector", rng.choice(["AND", "OR", ""])) if rng.random() < 0.4 else item("action", rng.choice(["A.1", "A.2.1", "A.2.2", "B.1", "C.3", "none", "B.1.2"]), note=rng.choice([None, "", "n"]), ct=rng.choice(["", "1 hour"]), refs=rng.choice([[], ["SR 1.1.1.1"]]))
    band = lambda: (rng.choice("ABCD"), rng.choice(["bad", "", "worse"]))
    rows = [record(n, rng.choice([None, [one() for _ in range(rng.randrange(9))]]) if rng.random() < 0.9 else [], [band() for _ in range(rng.randrange(3))], lco=f"L{k}", stmt=rng.choice([None, "", "LCO (NOTE: m) run"]), title=rng.choice([None, "", "T"])) for k in range(60) for n in range(1, 1 + rng.randrange(1, 5))]
    frame = spark.createDataFrame([*rows, record(1, [], lco=None), record(1, [item("connector", "OR")] * 5 + [item("action", "A.1")] + [item("connector", "OR")] * 4 + [item("action", "A.2")], lco="run")], PAGES).withColumn("page_ord", F.col("page_no"))
    merged, blocks = sections.merge_sections(frame), sections.condition_blocks(sections.section_items(frame), sections.condition_texts(frame))
    whole = sections.whole_sections(frame)
    same = lambda got, want: sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert same(whole.drop("blocks"), merged)
    assert same(sections.section_blocks(whole), blocks)
    for records in (sections.action_records, sections.condition_records, sections.hierarchical_records):
        got = records(whole)
        assert same(got, records(merged, blocks))
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert not any(step in plan for step in ("Join", "Window", "Union")) and plan.count("Scan") == 1


def test_page_bands_merge_heights_and_not_words(spark):
    """Before, the merge of words and bands sorted every word of a page."""
    from pagemill.jobs.queries import page_bands

    plan = page_bands(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [page_no") >= 2 and plan.index("Window") < plan.rindex("count(")


def test_pages_from_stretches_of_words_equal_pages_from_words(spark):
    """Before, pages were gathered from single words only, which sorted every word of a page twice."""
    rng = random.Random(9)
    shuffled = lambda rows: rng.sample(rows, len(rows))
    odd = [("A.1", 240, 415), ("[", 240, 417), ("SURVEILLANCE", 60, 455), ("FREQUENCY", 160, 455), ("", 90, 221), ("LCO", 60, 131)]
    rows = [w for n in range(40) for w in shuffled(page(HEAD + rng.sample(BODY + odd, rng.randrange(len(BODY))), n, rng.choice([None, 800.0, 450.0])))]
    rows += [("doc", 90, None, 0, "lost", None, 1.0, 1.0, 2.0), ("doc", 91, None, 0, "lost", 1.0, 1.0, float("nan"), 2.0)]
    words = spark.createDataFrame(rows, WORDS)
    stretches = words.groupBy("source_doc", "page_no", "page_height", (F.col("word_ord") % 3).alias("part")).agg(F.collect_list(F.struct(*layout.WORD)).alias("words"))
    own = spark.createDataFrame([("3.4.5", 70.0, 120.0)], "lco string, col1_max double, header_margin double")
    for overrides in (None, own):
        want = {r.page_no: r for r in pages.parse_pages(words, overrides=overrides).collect()}
        assert len(want) == 40 and {r.page_no: r for r in pages.parse_pages(stretches, overrides=overrides).collect()} == want


def test_words_of_an_order_are_gathered_by_one_shuffle(spark):
    """Before, parsed_pages shuffled and sorted its items and then every word of theirs."""
    from pagemill.jobs.queries import _stretches
    from pagemill.sources.scratch import session_setting

    with session_setting(spark, "spark.sql.execution.replaceHashWithSortAgg", "true"):
        plan = layout.whole_pages(_stretches(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan
    assert "SortAggregate" in plan and "ObjectHashAggregate" not in plan and plan.count("Sort [") == 1
    assert spark.conf.get("spark.sql.execution.replaceHashWithSortAgg", None) is None


def test_plain_texts_skip_the_rules_of_scaffolds(spark):
    """Before, every text went through all of them."""
    from pagemill.functions import text

    odd = ["", "plain text: 1_b, 2-3.", " a", "a ", "a  b", "a\tb", "a\xa0b", "é", "[a]", "a]", "--", "---", "a --- b", "----NOTE---- x ---- y", "---NOTE---", "----REVIEWER'S NOTE---- x ---- y", "a\n", "\x1c", "a\\^b`", "~", "\x7f", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string")
    got = rows.select("t", text.clean_text(F.col("t")).alias("c"), text.normalize_raw(F.col("t")).alias("r"), text._unscaffolded(F.col("t"), r"(NOTE: $1)").alias("c2"), text._unscaffolded(F.col("t"), " $1 ").alias("r2"), text._is_plain(F.col("t")).alias("plain")).collect()
    assert all((r.c, r.r) == (r.c2, r.r2) for r in got)
    assert {r.t for r in got if r.plain} == {"", "plain text: 1_b, 2-3.", "--", "a\\^b`", "~"}
