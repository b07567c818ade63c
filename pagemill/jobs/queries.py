"""Registered queries over the given tables, with SQL that must give the same rows.

Structured inputs that the tables do not hold are derived from them by Spark: the line
items of an order become the pages of a section, the items of its action table, or the
positioned words of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import text
from pagemill.functions.vectors import hashing
from pagemill.operators import evaluation, layout, pages, questions, retrieval, sections, semantic, structure, table_functions, windows
from pagemill.sources.scratch import Scratch

_SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACES}]+|[{_SPACES}]+$', '', 'g')"


def _sql_collapse(x: str) -> str:
    return _sql_strip(f"regexp_replace({x}, '[{_SPACES}]+', ' ', 'g')")


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- chunks of raw text


def _raw(spark, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    metadata = F.struct(none.alias("lco"), F.col("source").alias("title"), F.lit("documents").alias("source_doc"), F.array().cast("array<int>").alias("source_pages"))
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), metadata.alias("metadata"), F.col("text").alias("raw_text"))


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", *(F.col(f"metadata.{c}").alias(c) for c in ("chunk_index", "char_start", "char_end")), F.md5("content.body").alias("body_md5"))


def fixed_chunks(spark, sf_dir):
    return _chunk_rows(windows.naive_fixed_length(_raw(spark, sf_dir)))


def sliding_chunks(spark, sf_dir):
    return _chunk_rows(windows.sliding_window(_raw(spark, sf_dir)))


def _sql_windows(strategy: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT '{strategy}::' || doc_id || '#' || (i + 1) AS id, CAST(i + 1 AS INTEGER) AS chunk_index, CAST(i * {step} AS INTEGER) AS char_start,
      CAST(least(i * {step} + {size}, length(t)) AS INTEGER) AS char_end, {_sql_strip(f"substring(t, i * {step} + 1, {size})")} AS body
    FROM (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - {size}) / {step}.0)) AS BIGINT) + 1)) AS i
      FROM (SELECT doc_id, {_sql_strip("text")} AS t FROM documents) WHERE length(t) > 0)"""


_FIXED, _SLIDING = _sql_windows("naive_fixed_length", 900, 0), _sql_windows("sliding_window", 900, 200)
_TABLE_FUNCTION = f"SELECT split_part(split_part(id, '::', 2), '#', 1) AS id, chunk_index, char_start, char_end, md5(body) AS body_md5 FROM ({_SLIDING})"
_ROWS = "SELECT id, chunk_index, char_start, char_end, md5(body) AS body_md5 FROM ({})"


def table_function_chunks(spark, sf_dir):
    """The sliding window as a table function in SQL."""
    table_functions.register(spark)
    return spark.sql("SELECT id, chunk_index, char_start, char_end, md5(body) AS body_md5 FROM sliding_window(TABLE(SELECT doc_id AS id, text FROM {docs}), 900, 200)", docs=_read(spark, sf_dir, "documents"))


def chunk_statistics(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    both = [structure.common_columns(c) for c in (windows.naive_fixed_length(raw), windows.sliding_window(raw))]
    return structure.chunk_statistics(both[0].unionByName(both[1])).withColumn("mean_chars", F.round("mean_chars", 6))


_CHUNK_STATISTICS = f"""SELECT split_part(id, '::', 1) AS strategy, count(*) AS n_chunks, round(avg(length(body)), 6) AS mean_chars
FROM ({_FIXED} UNION ALL {_SLIDING}) GROUP BY 1"""


def semantic_chunks(spark, sf_dir):
    chunks = semantic.semantic(_raw(spark, sf_dir), encoder=hashing(), model_name="hashing-64")
    return chunks.select("id", *(F.col(f"metadata.{c}").alias(c) for c in ("char_start", "char_end", "word_start", "word_end", "selected_boundary_similarity")), F.md5("content.body").alias("body_md5"))


# boundaries are scored by word counts in 64 buckets; every word's next cut is a table that a recursion walks
_SEMANTIC = f"""WITH RECURSIVE d AS (SELECT doc_id, {_sql_strip("text")} AS t FROM documents),
k AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^{_SPACES}]+')) AS tok, unnest(list_slice(regexp_split_to_array(t, '[^{_SPACES}]+'), 1, len(regexp_extract_all(t, '[^{_SPACES}]+')))) AS gap, unnest(range(0, len(regexp_extract_all(t, '[^{_SPACES}]+')))) AS i FROM d WHERE t <> ''),
e AS (SELECT doc_id, i, tok, sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM k),
w AS (SELECT doc_id, i, CAST(('0x' || substr(md5(tok), 1, 7)) AS BIGINT) % 64 AS h, e - length(tok) AS s, e, count(*) OVER (PARTITION BY doc_id) AS n, max(e) OVER (PARTITION BY doc_id) AS last, i // 45 AS part FROM e),
c AS (SELECT doc_id, i, s, CAST(s AS BIGINT) // 1200 AS place, unnest([i // 45 - 1, i // 45, i // 45 + 1]) AS part FROM w WHERE i >= 1 AND ((i - 1) % 3 = 0 OR i = n - 1)),
x AS (SELECT c.doc_id, c.i, c.s, c.place, CASE WHEN w.i < c.i THEN 0 ELSE 1 END AS side, h, count(*) AS n FROM c JOIN w ON w.doc_id = c.doc_id AND w.part = c.part AND w.i >= c.i - 45 AND w.i < c.i + 45 GROUP BY ALL),
m AS (SELECT doc_id, i, s, place, sqrt(sum(n * n) FILTER (side = 0)) * sqrt(sum(n * n) FILTER (side = 1)) AS norms FROM x GROUP BY ALL),
o AS (SELECT a.doc_id, a.i, sum(a.n * b.n) AS dot FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.i = b.i AND a.h = b.h WHERE a.side = 0 AND b.side = 1 GROUP BY ALL),
v AS (SELECT doc_id, i, s, place, round(coalesce(dot, 0) / norms, 9) AS v FROM m LEFT JOIN o USING (doc_id, i)),
best AS (SELECT a.doc_id, a.i AS a, first(v.i ORDER BY v.s >= a.s + 900 DESC, v.v, v.i) AS b, first(v.v ORDER BY v.s >= a.s + 900 DESC, v.v, v.i) AS v FROM (SELECT doc_id, i, s, unnest([CAST(s AS BIGINT) // 1200, CAST(s AS BIGINT) // 1200 + 1]) AS place FROM w) a
  JOIN v ON v.doc_id = a.doc_id AND v.place = a.place AND v.i > a.i AND v.s BETWEEN a.s + 450 AND a.s + 1200 GROUP BY a.doc_id, a.i),
past AS (SELECT a.doc_id, a.i AS a, f.i AS b FROM w a ASOF JOIN w f ON a.doc_id = f.doc_id AND a.s + 1200 <= f.s),
following AS (SELECT w.doc_id, w.i AS a, w.s, CASE WHEN last - s <= 1200 THEN n ELSE coalesce(best.b, past.b, n) END AS b, CASE WHEN last - s > 1200 THEN v END AS v FROM w LEFT JOIN best ON best.doc_id = w.doc_id AND best.a = w.i LEFT JOIN past ON past.doc_id = w.doc_id AND past.a = w.i),
walk AS (SELECT * FROM following WHERE a = 0 UNION ALL SELECT f.* FROM walk JOIN following f ON f.doc_id = walk.doc_id AND f.a = walk.b)
SELECT 'semantic::' || y.doc_id || '#' || row_number() OVER (PARTITION BY y.doc_id ORDER BY a) AS id, CAST(y.s AS INTEGER) AS char_start, CAST(z.e AS INTEGER) AS char_end, CAST(a AS INTEGER) AS word_start, CAST(b AS INTEGER) AS word_end, v AS selected_boundary_similarity,
  md5({_sql_strip("substring(t, CAST(y.s AS BIGINT) + 1, CAST(z.e - y.s AS BIGINT))")}) AS body_md5 FROM walk y JOIN w z ON z.doc_id = y.doc_id AND z.i = y.b - 1 JOIN d ON d.doc_id = y.doc_id"""


# ---- text rules


def cleaned_texts(spark, sf_dir):
    """Every line break becomes a note header, and the text is bracketed."""
    marked = F.concat(F.lit("["), F.replace("text", F.lit("\n"), F.lit(" ----NOTE---- ")), F.lit("]"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", marked.alias("t")).withColumn("c", text.clean_text(F.col("t")))
    return rows.select("doc_id", F.md5("c").alias("cleaned"), F.md5(text.normalize_raw(F.col("t"))).alias("plain"), F.md5(text.extract_note(F.col("c"))).alias("note"), F.md5(text.strip_note(F.col("c"))).alias("rest"), text.is_optional(F.col("t")).alias("optional"), F.md5(text.sentence(F.col("c"))).alias("sentence"))


def _sql_scaffold(note: str) -> str:
    gap = f"[{_SPACES}]"
    head = f"-{{3,}}{gap}*NOTES?{gap}*-{{3,}}"
    x = f"regexp_replace(t, '-{{3,}}{gap}*REVIEWER[''’]S{gap}+NOTES?{gap}*-{{3,}}.*?-{{3,}}', ' ', 'gis')"
    x = f"regexp_replace({x}, '{head}{gap}*(.*?){gap}*-{{3,}}', '{note}', 'gis')"
    return _sql_collapse(f"translate(regexp_replace(regexp_replace({x}, '{head}', ' ', 'gi'), '-{{3,}}', ' ', 'g'), '[]', '')")


_CLEANED = f"""WITH m AS (SELECT doc_id, '[' || replace(text, chr(10), ' ----NOTE---- ') || ']' AS t FROM documents),
c AS (SELECT doc_id, t, {_sql_scaffold("(NOTE: \\1)")} AS c, {_sql_scaffold(" \\1 ")} AS p FROM m)
SELECT doc_id, md5(c) AS cleaned, md5(p) AS plain, md5(CASE WHEN regexp_matches(c, '\\(NOTE:\\s*.*?\\)') THEN {_sql_strip("regexp_extract(c, '\\(NOTE:\\s*(.*?)\\)', 1)")} END) AS note,
  md5({_sql_strip("regexp_replace(c, '\\(NOTE:.*?\\)\\s*', '', 'g')")}) AS rest, regexp_matches(t, '[\\[\\]]') AS optional,
  md5(CASE WHEN c = '' THEN '' WHEN regexp_matches(c, '[.?!]$') THEN c ELSE c || '.' END) AS sentence FROM c"""


def word_offsets(spark, sf_dir):
    """Words of each document with the sums of where they begin and end."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", semantic.word_spans("text").alias("w"))
    total = lambda k: F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x[k])
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), total("s").alias("begins"), total("e").alias("ends"))


_WORD_OFFSETS = f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{_SPACES}]+')) AS tok, unnest(list_slice(regexp_split_to_array(text, '[^{_SPACES}]+'), 1, len(regexp_extract_all(text, '[^{_SPACES}]+')))) AS gap,
  unnest(range(1, len(regexp_extract_all(text, '[^{_SPACES}]+')) + 1)) AS i FROM documents),
p AS (SELECT doc_id, sum(length(gap) + length(tok)) OVER (PARTITION BY doc_id ORDER BY i) AS e, length(tok) AS n FROM w)
SELECT d.doc_id, CAST(count(e) AS BIGINT) AS n_words, CAST(coalesce(sum(e - n), 0) AS BIGINT) AS begins, CAST(coalesce(sum(e), 0) AS BIGINT) AS ends FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id"""


def match_texts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.match_text(F.col("text"))).alias("matched"))


_MATCHED = f"SELECT doc_id, md5({_sql_collapse('lower(text)')}) AS matched FROM documents"

# ---- line items as sections

_PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
_LETTER, _LABEL = "chr(CAST(65 + l_suppkey % 3 AS INTEGER))", "chr(CAST(65 + l_suppkey % 3 AS INTEGER)) || '.' || (l_linenumber % 3 + 1) || '.' || (l_partkey % 3 + 1)"
_SQL_PLACE = ", ".join(_PLACE)


def _items(spark, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", *_PLACE, "l_returnflag", "l_linestatus")
    label = F.concat(F.char(65 + F.col("l_suppkey") % 3), F.lit("."), F.col("l_linenumber") % 3 + 1, F.lit("."), F.col("l_partkey") % 3 + 1)
    return lines.withColumns({"lco": F.col("l_orderkey").cast("string"), "letter": F.char(65 + F.col("l_suppkey") % 3), "label": label, "page_ord": F.struct(*_PLACE)})


def _pages(spark, sf_dir: str) -> DataFrame:
    """A page for each line item: an action, a connector before it or not, and its condition's band."""
    i, none = _items(spark, sf_dir), F.lit(None).cast("string")
    by = F.when(F.col("l_returnflag") == "A", "AND").when(F.col("l_returnflag") == "N", "OR")
    part = F.col("l_partkey")
    entry = lambda **c: F.struct(*(c.get(k, none).alias(k) for k in ("type", "label", "note", "text", "ct")), c.get("optional", F.lit(None).cast("boolean")).alias("optional"), c.get("refs", F.array().cast("array<string>")).alias("refs"))
    action = entry(type=F.lit("action"), label=F.col("label"), note=F.when(part % 5 == 0, F.concat(F.lit("see part "), part)), text=F.concat(F.lit("Restore part "), part), ct=F.when(part % 4 == 0, "").otherwise(F.concat(F.col("l_quantity").cast("int"), F.lit(" hours"))), optional=part % 7 == 0, refs=F.when(part % 3 == 0, F.array(F.concat(F.lit("SR 3.0.1."), F.col("l_linenumber")))).otherwise(F.array().cast("array<string>")))
    both = F.filter(F.array(F.when(by.isNotNull(), entry(type=F.lit("connector"), text=by)), action), lambda x: x.isNotNull())
    band = F.struct(F.col("letter").alias("letter"), F.concat(F.lit("Supplier "), F.col("l_suppkey"), F.lit(" is late")).alias("text"), (part % 2 == 0).alias("optional"), (part % 3 == 0).alias("compound"))
    return i.select(
        "lco", F.when(F.col("l_linenumber") > 1, F.concat(F.lit("Order "), F.col("lco"))).alias("title"), F.when(F.col("l_linenumber") == 2, F.concat(F.lit("LCO statement (NOTE: first) of "), part)).alias("lco_stmt"),
        F.when(F.col("l_linenumber") == 3, F.concat(F.lit("MODE "), part % 6)).alias("applicability"), F.array(band).alias("cond_bands"), both.alias("act_items"), F.concat(F.lit("part "), part).alias("raw_text"), F.col("l_linenumber").alias("page_no"), F.lit("orders").alias("source_doc"), "page_ord")


def _sections(spark, sf_dir: str) -> DataFrame:
    return sections.whole_sections(_pages(spark, sf_dir))


def _blocks(spark, sf_dir: str) -> DataFrame:
    return sections.section_blocks(_sections(spark, sf_dir))


def section_merge(spark, sf_dir):
    rows = sections.merge_sections(_pages(spark, sf_dir))
    return rows.select("lco", "title", "lco_stmt", "applicability", "source_doc", F.size("source_pages").alias("n_pages"), F.md5("raw_text").alias("raw_md5"))


_SECTIONS = f"""SELECT CAST(l_orderkey AS VARCHAR) AS lco, CASE WHEN max(l_linenumber) > 1 THEN 'Order ' || l_orderkey END AS title,
  first('LCO statement (NOTE: first) of ' || l_partkey ORDER BY {_SQL_PLACE}) FILTER (l_linenumber = 2) AS lco_stmt, first('MODE ' || (l_partkey % 6) ORDER BY {_SQL_PLACE}) FILTER (l_linenumber = 3) AS applicability,
  'orders' AS source_doc, CAST(count(*) AS INTEGER) AS n_pages, md5(string_agg('part ' || l_partkey, ' ' ORDER BY {_SQL_PLACE})) AS raw_md5 FROM lineitem GROUP BY l_orderkey"""


def connector_attach(spark, sf_dir):
    rows = sections.attach_connectors(sections.section_items(_pages(spark, sf_dir)))
    return rows.where("type = 'action'").select("lco", "ord", "label", "connector", "block", "group", "alt")


_LINES = f"""SELECT *, {_LETTER} AS letter, {_LABEL} AS label, CASE l_returnflag WHEN 'A' THEN 'AND' WHEN 'N' THEN 'OR' END AS lnk, row_number() OVER o AS k,
  lag({_LETTER}) OVER o AS before, sum(CASE WHEN l_returnflag IN ('A', 'N') THEN 2 ELSE 1 END) OVER o AS ord FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY {_SQL_PLACE})"""
_CONNECTORS = f"""SELECT CAST(l_orderkey AS VARCHAR) AS lco, CAST(ord AS INTEGER) AS ord, label, CASE WHEN letter = before THEN lnk END AS connector, letter AS block,
  CAST(l_linenumber % 3 + 1 AS INTEGER) AS "group", CAST(l_partkey % 3 + 1 AS INTEGER) AS alt FROM ({_LINES})"""


def condition_blocks(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    return rows.select("lco", "id", "label", "text", "optional", "compound", F.size("actions").alias("n_actions"), F.array_join("actions.label", " ").alias("labels"))


_BLOCKS = f"""SELECT CAST(l_orderkey AS VARCHAR) AS lco, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY min(k)) AS INTEGER) AS id, letter AS label, 'Supplier ' || last(l_suppkey ORDER BY k) || ' is late' AS text,
  last(l_partkey ORDER BY k) % 2 = 0 AS optional, last(l_partkey ORDER BY k) % 3 = 0 AS compound, CAST(count(*) AS INTEGER) AS n_actions, string_agg(label, ' ' ORDER BY k) AS labels FROM ({_LINES}) GROUP BY l_orderkey, letter"""


def section_outline(spark, sf_dir):
    return sections.actions_text(None, _sections(spark, sf_dir)).select("lco", F.md5("actions_text").alias("outline"))


_HEADED = f"""h AS (SELECT lco, title, lco_stmt, applicability, 'LCO ' || lco || coalesce(' ' || title, '') || '.' AS head, 'Applicability: ' || coalesce(applicability, 'None') || '.' AS app FROM ({_SECTIONS})),
a AS (SELECT CAST(l_orderkey AS VARCHAR) AS lco, k, letter, label, lnk, CASE WHEN letter = before THEN lnk END AS connector, l_linenumber, l_partkey % 7 = 0 AS optional, 'Restore part ' || l_partkey AS said, CASE WHEN l_partkey % 5 = 0 THEN 'see part ' || l_partkey END AS note,
  CASE WHEN l_partkey % 4 <> 0 THEN CAST(l_quantity AS INTEGER) || ' hours' END AS ct, CASE WHEN l_partkey % 3 = 0 THEN 'SR 3.0.1.' || l_linenumber END AS ref FROM ({_LINES})),
b AS (SELECT lco, label AS letter, id, text FROM ({_BLOCKS}))"""


def condition_records(spark, sf_dir):
    rows = sections.condition_records(_sections(spark, sf_dir))
    return rows.select("id", "metadata.chunk_type", F.array_join("metadata.evidence_ids", " ").alias("evidence"), F.md5("content.body").alias("body_md5"))


_CONDITIONS = f"""WITH {_HEADED}, l AS (SELECT lco, letter, k, lco || '/' || label AS gid, coalesce(chr(10) || connector || chr(10) || chr(10), '') || CASE WHEN optional THEN '[Optional] ' ELSE '' END || label || ' ' || said || coalesce(chr(10) || 'NOTE: ' || note, '')
    || coalesce(chr(10) || 'Completion Time: ' || ct, '') || coalesce(chr(10) || 'See ' || ref || '.', '') AS lines FROM a),
g AS (SELECT lco, letter, string_agg(lines, chr(10) ORDER BY k) AS body, string_agg(gid, ' ' ORDER BY k) AS evidence FROM l GROUP BY lco, letter)
SELECT lco || '/' || letter AS id, 'condition' AS chunk_type, evidence, md5(head || chr(10) || app || chr(10) || chr(10) || 'Condition ' || letter || ': ' || text || '.' || chr(10) || chr(10) || 'Required Actions:' || chr(10) || g.body) AS body_md5
FROM g JOIN b USING (lco, letter) JOIN h USING (lco)
UNION ALL SELECT lco || '/LCO', 'lco_statement', lco || '/LCO', md5(head || chr(10) || app || chr(10) || regexp_replace(lco_stmt, '\\(NOTE:.*?\\)\\s*', '') || '.' || chr(10) || 'NOTE: first') FROM h WHERE lco_stmt IS NOT NULL"""


def action_records(spark, sf_dir):
    rows = sections.action_records(_sections(spark, sf_dir))
    return rows.select("id", "metadata.condition_id", "metadata.action_id", "metadata.connector", "content.logic", F.md5("content.body").alias("body_md5"))


_ACTIONS = f"""WITH {_HEADED}, n AS (SELECT a.*, l_linenumber % 3 AS g, row_number() OVER (PARTITION BY lco, letter ORDER BY k) AS aid FROM a),
names AS (SELECT lco, letter, g, string_agg(label, ', ' ORDER BY f) AS names FROM (SELECT lco, letter, g, label, min(aid) AS f FROM n GROUP BY ALL) GROUP BY ALL),
m AS (SELECT lco, letter, g, min(aid) AS f, arg_min(coalesce(connector, ''), aid) AS edge FROM n GROUP BY ALL),
o AS (SELECT m.*, '{{' || names || '}}' AS names, row_number() OVER (PARTITION BY lco, letter ORDER BY f) AS p FROM m JOIN names USING (lco, letter, g)),
e AS (SELECT r.lco, r.letter, r.p, l.names AS ln, r.names AS rn, r.edge FROM o r JOIN o l ON r.lco = l.lco AND r.letter = l.letter AND l.p = r.p - 1 WHERE r.edge <> ''),
sib AS (SELECT lco, letter, aid, CASE WHEN sum(c) = 1 THEN min(label) ELSE '{{' || string_agg(label, ', ' ORDER BY f) || '}}' END AS sib FROM (SELECT x.lco, x.letter, x.aid, y.label, min(y.aid) AS f, count(*) AS c
  FROM n x JOIN n y ON x.lco = y.lco AND x.letter = y.letter AND x.g = y.g AND x.aid <> y.aid GROUP BY ALL) GROUP BY ALL),
w AS (SELECT lco, letter, g, string_agg(connector, '/' ORDER BY q) AS within FROM (SELECT n.lco, n.letter, n.g, connector, min(aid) AS q FROM n JOIN m ON n.lco = m.lco AND n.letter = m.letter AND n.g = m.g WHERE aid > m.f AND connector IS NOT NULL GROUP BY ALL) GROUP BY ALL),
c AS (SELECT n.lco, n.letter, n.aid, string_agg('the group ' || CASE WHEN o.p = e.p THEN rn || ' is joined with ' || ln ELSE ln || ' is joined with ' || rn END || ' by ' || e.edge, '; ' ORDER BY least(abs(o.p - e.p + 1), abs(o.p - e.p)), e.p) AS clauses
  FROM n JOIN o ON n.lco = o.lco AND n.letter = o.letter AND n.g = o.g JOIN e ON e.lco = n.lco AND e.letter = n.letter GROUP BY ALL),
l AS (SELECT n.*, CASE WHEN coalesce(label || ' is joined with ' || sib || ' by ' || within, clauses) IS NOT NULL THEN 'Logic: ' || concat_ws('; ', label || ' is joined with ' || sib || ' by ' || within, clauses) || '.' END AS logic
  FROM n LEFT JOIN sib USING (lco, letter, aid) LEFT JOIN w USING (lco, letter, g) LEFT JOIN c USING (lco, letter, aid))
SELECT lco || '/' || label AS id, b.id AS condition_id, CAST(aid AS INTEGER) AS action_id, connector, logic, md5(concat_ws(' ', head, app, 'Condition ' || letter || ': ' || b.text || '.',
  'Required Action ' || label || ': ' || said || coalesce(' Note: ' || note || '.', '') || ' Completion Time: ' || coalesce(ct, 'None') || '.' || coalesce(' See ' || ref || '.', ''), logic)) AS body_md5 FROM l JOIN b USING (lco, letter) JOIN h USING (lco)
UNION ALL SELECT lco || '/LCO', NULL, NULL, NULL, NULL, md5(concat_ws(' ', head, app, regexp_replace(lco_stmt, '\\(NOTE:.*?\\)\\s*', '') || ' Note: first.')) FROM h WHERE lco_stmt IS NOT NULL"""
_OUTLINE = f"""WITH {_HEADED}, i AS (SELECT lco, letter AS block, k, 1 AS w, '  ' || label || ' ' || coalesce('(NOTE: ' || note || ') ', '') || said || coalesce('  [CT] ' || ct, '') AS line FROM a
  UNION ALL SELECT CAST(l_orderkey AS VARCHAR), before, k, 0, '  ' || lnk FROM ({_LINES}) WHERE k > 1 AND lnk IS NOT NULL),
j AS (SELECT lco, block, string_agg(line, chr(10) ORDER BY k, w) AS items FROM i GROUP BY lco, block),
t AS (SELECT lco, string_agg('CONDITION ' || block || ': ' || text || chr(10) || items, chr(10) || chr(10) ORDER BY id) AS body FROM j JOIN b USING (lco) WHERE j.block = b.letter GROUP BY lco)
SELECT lco, md5(concat_ws(chr(10), title, lco_stmt, 'APPLICABILITY: ' || applicability, '', body)) AS outline FROM h JOIN t USING (lco)"""


def condition_aware_chunks(spark, sf_dir):
    rows = structure.condition_aware(sections.condition_records(_sections(spark, sf_dir)))
    return rows.select("id", "strategy", "metadata.chunk_type", F.array_join("metadata.evidence_ids", " ").alias("evidence"), F.md5("content.body").alias("body_md5"))


def action_logic_chunks(spark, sf_dir):
    rows = structure.action_logic(sections.action_records(_sections(spark, sf_dir)))
    return rows.select("id", "strategy", "metadata.chunk_type", F.array_join("metadata.evidence_ids", " ").alias("evidence"), F.md5("content.body").alias("body_md5"))


_CONDITION_CHUNKS = f"SELECT 'condition_aware::' || id AS id, 'condition_aware' AS strategy, chunk_type, evidence, body_md5 FROM ({_CONDITIONS})"
_ACTION_CHUNKS = f"SELECT 'action_logic::' || id AS id, 'action_logic' AS strategy, CASE WHEN condition_id IS NULL THEN 'lco_statement' ELSE 'action_logic' END AS chunk_type, id AS evidence, body_md5 FROM ({_ACTIONS})"


def label_gaps(spark, sf_dir):
    """Conditions of each order whose letters do not run A, B, C."""
    return sections.label_gaps(_blocks(spark, sf_dir))


_GAPS = f"SELECT lco, id, label, chr(64 + id) AS expected FROM ({_BLOCKS}) WHERE label <> chr(64 + id)"


def hierarchical_records(spark, sf_dir):
    rows = sections.hierarchical_records(_sections(spark, sf_dir))
    block = lambda b: F.concat_ws("|", b["gid"], b["label"], b["text"], b["optional"].cast("string"), b["compound"].cast("string"), F.array_join(b["actions"]["gid"], ","))
    return rows.select("id", "metadata.title", F.size("content.condition_blocks").alias("n_conditions"), F.md5("content.lco_statement").alias("statement"), F.md5("content.raw_text").alias("raw"), F.md5("content.actions_text").alias("outline"), F.md5(F.array_join(F.transform("content.condition_blocks", block), ";")).alias("blocks"))


_HIERARCHICAL = f"""SELECT h.lco AS id, h.title, CAST(n AS INTEGER) AS n_conditions, md5(h.lco_stmt) AS statement, h.raw_md5 AS raw, outline, md5(blocks) AS blocks FROM ({_SECTIONS}) h JOIN ({_OUTLINE}) o ON o.lco = h.lco
JOIN (SELECT lco, count(*) AS n, string_agg(lco || '/' || label || '|' || label || '|' || text || '|' || CAST(optional AS VARCHAR) || '|' || CAST(compound AS VARCHAR) || '|' || lco || '/' || replace(labels, ' ', ',' || lco || '/'), ';' ORDER BY id) AS blocks FROM ({_BLOCKS}) GROUP BY lco) b ON b.lco = h.lco"""


def smoke_questions(spark, sf_dir):
    """The feature is a sample of the first questions."""
    rows = sections.action_records(_sections(spark, sf_dir))
    key = F.struct(F.col("metadata.lco").cast("long"), "metadata.condition_id", "metadata.action_id")
    return questions.smoke_questions(rows.withColumn("o", key), "o").select("id", "type", "question", F.array_join("evidence_ids", " ").alias("evidence"))


_SMOKE = f"""WITH {_HEADED}, n AS (SELECT a.*, b.id AS cid, b.text, row_number() OVER (PARTITION BY a.lco, a.letter ORDER BY k) AS aid FROM a JOIN b USING (lco, letter)),
q AS (SELECT lco, cid, aid, 0 AS w, 'action' AS kind, 'condition_action_mapping' AS type, 'For LCO ' || lco || ', what is Required Action ' || label || ' when the condition is: ' || text AS question, lco || '/' || label AS evidence FROM n
  UNION ALL SELECT lco, cid, aid, 1, 'ct', 'extractive', 'For LCO ' || lco || ', what is the Completion Time for Required Action ' || label || '?', lco || '/' || label FROM n WHERE ct IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY CAST(lco AS BIGINT), cid, aid, w) AS i FROM q)
SELECT 'smoke_' || kind || '_' || lpad(CAST(i AS VARCHAR), 3, '0') AS id, type, question, evidence FROM r WHERE i <= 40"""


def evidence_from_text(spark, sf_dir):
    """Labels printed in the text of each order, as ids."""
    listed = F.array_join(F.array_sort(F.collect_list(F.struct("page_ord", "label")))["label"], " and ")
    texts = _items(spark, sf_dir).groupBy("lco").agg(F.concat(F.lit("LCO says "), listed).alias("t"))
    return texts.select("lco", F.explode(text.evidence_ids(F.col("lco"), F.col("t"))).alias("evidence_id"))


_EVIDENCE = f"SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS lco, l_orderkey || '/' || unnest([{_LABEL}, 'LCO']) AS evidence_id FROM lineitem"


def printed_references(spark, sf_dir):
    """Line items as bracketed text with references: what stands in front of the brackets' text, and the references."""
    part = F.col("l_partkey")
    more = F.when(part % 2 == 0, F.concat(F.lit(" and SR\t1.0.2."), part % 7)).otherwise("")
    said = F.concat(F.repeat(F.lit("["), (F.col("l_linenumber") % 3).cast("int")), F.lit(" "), "label", F.lit(" see SR 3."), part % 9, F.lit("."), "l_linenumber", F.lit("."), F.col("l_suppkey") % 20, F.lit(".9"), more, F.lit(" or SR 4.5 ]"))
    rows = _items(spark, sf_dir).select("lco", "l_linenumber", said.alias("t"))
    return rows.select("lco", "l_linenumber", text.strip_bracket(F.col("t")).alias("bare"), F.array_join(text.references(F.col("t")), "; ").alias("refs"), text.is_optional(F.col("t")).alias("optional"))


_PRINTED = f"""SELECT CAST(l_orderkey AS VARCHAR) AS lco, l_linenumber, {_LABEL} || ' see ' || one || CASE WHEN two IS NULL THEN '' ELSE ' and ' || two END || ' or SR 4.5 ]' AS bare, concat_ws('; ', one[:-3], two) AS refs, true AS optional
FROM (SELECT *, 'SR 3.' || l_partkey % 9 || '.' || l_linenumber || '.' || l_suppkey % 20 || '.9' AS one, CASE WHEN l_partkey % 2 = 0 THEN 'SR' || chr(9) || '1.0.2.' || l_partkey % 7 END AS two FROM lineitem)"""


def label_parts(spark, sf_dir):
    """Labels taken apart, and what two neighbours suggest."""
    i = _items(spark, sf_dir).withColumn("p", text.parse_label(F.col("label")))
    before = F.lag("p").over(W.partitionBy("lco").orderBy(*_PLACE))
    return i.withColumn("suggested", text.connector_between(before, F.col("p"))).groupBy("p.condition", "p.group", "p.alt", "suggested").agg(F.count("*").alias("n"))


_LABEL_PARTS = f"""SELECT letter AS condition, CAST(l_linenumber % 3 + 1 AS INTEGER) AS "group", CAST(l_partkey % 3 + 1 AS INTEGER) AS alt,
  CASE WHEN letter = before THEN CASE WHEN l_linenumber % 3 = bg THEN 'OR' ELSE 'AND' END END AS suggested, count(*) AS n
FROM (SELECT *, lag(l_linenumber % 3) OVER (PARTITION BY l_orderkey ORDER BY {_SQL_PLACE}) AS bg FROM ({_LINES})) GROUP BY ALL"""


def completion_times(spark, sf_dir):
    """Rows of each order as completion-time cells."""
    said = F.when(F.col("l_returnflag") == "A", "OR").when(F.col("l_returnflag") == "N", F.concat(F.col("l_quantity").cast("int"), F.lit(" hours"))).otherwise("after [repair]")
    rows = _items(spark, sf_dir).withColumn("row", text.clean_text(said))
    return pages.completion_time_blocks(rows, ["lco"], "page_ord", "row").select("lco", F.col("block").cast("long").alias("block"), "ct")


_TIMES = f"""WITH r AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'OR' WHEN 'N' THEN CAST(l_quantity AS INTEGER) || ' hours' ELSE 'after repair' END AS row FROM ({_LINES})),
s AS (SELECT *, CASE WHEN l_returnflag = 'N' AND k > 1 AND lag(row) OVER (PARTITION BY l_orderkey ORDER BY k) <> 'OR' THEN 1 ELSE 0 END AS opens FROM r),
b AS (SELECT *, sum(opens) OVER (PARTITION BY l_orderkey ORDER BY k) + 1 AS block FROM s)
SELECT CAST(l_orderkey AS VARCHAR) AS lco, CAST(block AS BIGINT) AS block, string_agg(row, ' ' ORDER BY k) AS ct FROM b GROUP BY 1, 2"""


# ---- line items as positioned words


def _stretches(spark, sf_dir: str, plain: bool = False) -> DataFrame:
    """Each order as a page: a heading, a statement, a table header and a row for each line item, which holds the item's words.

    Unless ``plain``, the applicability has a subscript; every fifth page ends in a
    section that is left out; every seventh has a note with a label in it after its rows;
    every eleventh has no condition on it, as if the table went on from the page before.
    """
    # items are numbered, and gathered by whoever reads them, where one shuffle by page brings them in order;
    # the document is no literal, as the planner does not see rows to be in the order of literals
    place = W.partitionBy(*layout.PAGE).orderBy(*_PLACE)
    keys = {"page_no": F.col("l_orderkey").cast("int"), "source_doc": F.when(F.col("l_orderkey").isNotNull(), "orders").otherwise("")}
    i = _items(spark, sf_dir).withColumns(keys).withColumns({"k": F.row_number().over(place), "last": F.lead("page_no").over(place).isNull()})
    y, page = F.lit(220.0) + 20 * F.col("k"), F.col("l_orderkey")

    none = F.array().cast("array<struct<top:double,x0:double,word_ord:int,x1:double,bottom:double,text:string>>")
    given = lambda holds, words: F.when(holds, words).otherwise(none)

    def word(pos: int, t, x, y) -> Column:
        t, top = (t if isinstance(t, Column) else F.lit(t)).cast("string"), (y if isinstance(y, Column) else F.lit(y)).cast("double")
        return F.struct(top.alias("top"), F.lit(float(x)).alias("x0"), (F.col("k") * 100 + pos).alias("word_ord"), (F.lit(float(x)) + 6 * F.length(t)).alias("x1"), (top + 10).alias("bottom"), t.alias("text"))

    words = lambda begin, *placed: F.array(*(word(begin + n, *p) for n, p in enumerate(placed)))
    known = lambda pos, t, x: given(t.isNotNull(), words(pos, (t, x, y)))
    section = F.concat(F.lit("3.4."), page % 90 + 10)
    head = [("Order", 60, 40), ("table", 120, 40), (section, 200, 40), ("LCO", 60, 110), (section, 100, 110), ("holds", 160, 110), ("APPLICABILITY:", 60, 130), ("MODE", 160, 130), ("1", 200, 130), ("ACTIONS", 60, 150), ("CONDITION", 60, 200), ("COMPLETION", 420, 200), ("TIME", 500, 200), ("Rev.", 60, 2000)]
    extra = []
    if not plain:
        head.append(("b", 207, 133))
        out = words(30, ("SURVEILLANCE", 60, 1800), ("REQUIREMENTS", 160, 1800), ("Z.9", 240, 1820), ("check", 290, 1820))
        note = words(40, ("----NOTE----", 240, y + 20), ("Q.1", 240, y + 30), ("------", 240, y + 40))
        extra = [given(page % 5 == 0, out), given((page % 7 == 0) & F.col("last"), note)]
    opens = (F.col("k") % 3 == 1) & (F.lit(plain) | (page % 11 != 0))
    row = [
        given(opens, F.concat(known(20, F.concat("letter", F.lit(".")), 60), words(21, ("late", 90, y)))), given(F.col("l_returnflag") == "A", words(22, ("AND", 240, y - 8))),
        known(23, F.concat("letter", F.lit("."), "l_linenumber"), 240), words(24, ("Restore", 290, y)), known(25, F.col("l_partkey"), 340), known(26, F.col("l_quantity").cast("int"), 420), words(27, ("hours", 460, y)),
    ]
    return i.select("source_doc", "page_no", F.lit(2100.0).alias("page_height"), F.concat(given(F.col("k") == 1, words(0, *head)), *row, *extra).alias("words"))


def _placed(spark, sf_dir: str, plain: bool = False) -> DataFrame:
    """The words of ``_stretches`` one by one."""
    words = _stretches(spark, sf_dir, plain).select("source_doc", "page_no", "page_height", F.explode("words").alias("w"))
    return words.select("source_doc", "page_no", "page_height", *(f"w.{c}" for c in ("word_ord", "text", "x0", "x1", "top", "bottom")))


def parsed_pages(spark, sf_dir):
    """Pages of section 3.4.20 have a layout of their own, in which quantities are in the action column."""
    overrides = spark.createDataFrame([("3.4.20", 440.0)], "lco string, col2_max double")
    rows = pages.parse_pages(_stretches(spark, sf_dir), overrides=overrides)
    return rows.select("page_no", "lco", "title", "lco_stmt", "applicability", F.size("cond_bands").alias("n_conditions"), F.size("act_items").alias("n_items"), F.array_join(F.transform("act_items", lambda i: F.coalesce(i["label"], i["text"])), " ").alias("labels"), F.array_join(F.transform("act_items", lambda i: F.coalesce(i["ct"], F.lit("-"))), "; ").alias("times"), F.array_join(F.transform("act_items", lambda i: F.coalesce(i["note"], F.lit("-"))), "; ").alias("notes"), F.md5("raw_text").alias("raw_md5"))


_PARSED = f"""WITH a AS (SELECT l_orderkey, k, letter, letter || '.' || l_linenumber AS label, l_partkey, CAST(l_quantity AS INTEGER) AS q, l_orderkey % 90 = 10 AS wide, l_orderkey % 11 = 0 AS bare, l_returnflag = 'A' AS linked, CASE WHEN l_orderkey % 11 = 0 THEN 0 ELSE (k - 1) // 3 END AS band,
  CASE WHEN l_orderkey % 7 = 0 AND k = max(k) OVER (PARTITION BY l_orderkey) THEN 'Q.1' END AS note FROM ({_LINES})),
i AS (SELECT l_orderkey, k, 1 AS w, label, CASE WHEN wide THEN 'hours' ELSE q || ' hours' END AS ct, note, concat_ws(' ', label, 'Restore', l_partkey, CASE WHEN wide THEN q END, note) AS words, band FROM a UNION ALL SELECT l_orderkey, k, 0, 'AND', '-', NULL, 'AND', CASE WHEN bare THEN 0 ELSE (k - 2) // 3 END FROM a WHERE linked AND (bare OR k > 1)),
acts AS (SELECT l_orderkey, band, string_agg(words, ' ' ORDER BY k, w) AS acts FROM i GROUP BY 1, 2),
cells AS (SELECT l_orderkey, band, max(letter) FILTER (NOT bare AND k % 3 = 1) || '. late' AS cond, string_agg(CASE WHEN wide THEN 'hours' ELSE q || ' hours' END, ' ' ORDER BY k) AS times, any_value(wide) AS wide, count(*) AS n FROM a GROUP BY 1, 2),
raws AS (SELECT l_orderkey, CAST(count(cond) AS INTEGER) AS n_conditions, string_agg(concat_ws(' ', cond, acts, times), ' ' ORDER BY band) AS raw FROM cells JOIN acts USING (l_orderkey, band) GROUP BY 1),
items AS (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_items, string_agg(label, ' ' ORDER BY k, w) AS labels, string_agg(ct, '; ' ORDER BY k, w) AS times, string_agg(coalesce(note, '-'), '; ' ORDER BY k, w) AS notes FROM i GROUP BY 1)
SELECT CAST(l_orderkey AS INTEGER) AS page_no, '3.4.' || (l_orderkey % 90 + 10) AS lco, 'Order table' AS title, 'LCO 3.4.' || (l_orderkey % 90 + 10) || ' holds' AS lco_stmt, 'MODE 1_b' AS applicability, n_conditions, n_items, labels, times, notes,
  md5('LCO 3.4.' || (l_orderkey % 90 + 10) || ' holds APPLICABILITY: MODE 1_b ACTIONS ' || raw) AS raw_md5 FROM raws JOIN items USING (l_orderkey)"""


def page_bands(spark, sf_dir):
    """Condition bands of each page and the words in them by column."""
    words = _placed(spark, sf_dir, plain=True).withColumn("col", layout.column_of(F.col("x0"), F.lit(220), F.lit(410))).withColumn("end", F.lit(2000.0)).where("top > 200")
    spans = layout.bands(layout.condition_anchors(words), "end")
    columns = ("COND", "ACT", "TIME")
    # words at one height share their band: they are counted before the merge, which sorts heights and not words
    heights = words.groupBy(*layout.PAGE, "top").agg(*(F.count_if(F.col("col") == c).alias(c.lower()) for c in columns))
    return layout.in_bands(heights, spans).groupBy("page_no", "band_top", "band_bottom").agg(*(F.sum(c.lower()).alias(c.lower()) for c in columns))


_BANDS = f"""WITH a AS (SELECT l_orderkey, 220.0 + 20 * k AS top, k, l_returnflag FROM ({_LINES})),
t AS (SELECT l_orderkey, top AS band_top, coalesce(lead(top) OVER (PARTITION BY l_orderkey ORDER BY top), 2000.0) AS band_bottom FROM a WHERE k % 3 = 1),
w AS (SELECT l_orderkey, top, unnest(CASE WHEN k % 3 = 1 THEN ['cond', 'cond'] ELSE [] END || ['act', 'act', 'act', 'time', 'time']) AS c FROM a UNION ALL SELECT l_orderkey, top - 8, 'act' FROM a WHERE l_returnflag = 'A')
SELECT CAST(l_orderkey AS INTEGER) AS page_no, CAST(band_top AS DOUBLE) AS band_top, CAST(band_bottom AS DOUBLE) AS band_bottom, count(*) FILTER (c = 'cond') AS cond, count(*) FILTER (c = 'act') AS act, count(*) FILTER (c = 'time') AS time
FROM w JOIN t USING (l_orderkey) WHERE top >= band_top AND top < band_bottom GROUP BY 1, 2, 3"""


def note_spans(spark, sf_dir):
    """Line items as note headers, dash runs and plain words."""
    mark = F.when(F.col("l_returnflag") == "A", "----NOTE----").when(F.col("l_returnflag") == "R", "------").otherwise("word")
    words = _items(spark, sf_dir).select(F.lit("orders").alias("source_doc"), F.col("l_orderkey").alias("page_no"), mark.alias("text"), F.row_number().over(W.partitionBy("lco").orderBy(*_PLACE)).cast("double").alias("top"), F.lit(1.0).alias("x0"), F.lit(0).alias("word_ord"))
    return layout.note_spans(words).select("page_no", "open", "close")


_NOTES = f"""WITH m AS (SELECT l_orderkey, k, l_returnflag AS f, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM ({_LINES}))
SELECT l_orderkey AS page_no, CAST(min(k) FILTER (f = 'A') AS DOUBLE) AS open, CAST(max(k) FILTER (f = 'R') AS DOUBLE) AS close FROM m GROUP BY l_orderkey, i HAVING open IS NOT NULL AND close IS NOT NULL"""

# ---- pilots


def pilot_structure(spark, sf_dir):
    lines = structure.text_lines(_raw(spark, sf_dir), "raw_text")
    return structure.structure_islands(lines, r"^[A-M]").groupBy("id", "chunk").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


_PILOT_STRUCTURE = f"""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(i - 1 AS INTEGER) AS line_no, {_sql_strip("ls[i]")} AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS k FROM l WHERE line <> ''),
c AS (SELECT *, sum(CASE WHEN k > 1 AND regexp_matches(line, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS chunk FROM f)
SELECT id, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_lines, min(line_no) AS first_line FROM c GROUP BY id, chunk"""


_TARGETS = [("A", "^[A-M]"), ("A", "ing [a-m]"), ("B", "@"), ("B", "^[N-Z]"), ("C", "the"), ("D", "no such line")]


def pilot_colocation(spark, sf_dir):
    """Whether the first lines of each letter's targets are in one chunk of the structure pilot."""
    lines = structure.text_lines(_raw(spark, sf_dir), "raw_text")
    return structure.located_together(structure.structure_islands(lines, r"^[A-M]"), _TARGETS)


_COLOCATION = f"""{_PILOT_STRUCTURE.rpartition("SELECT id")[0]}, g(letter, pattern) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TARGETS)}),
h AS (SELECT i.id, letter, pattern, min(chunk) FILTER (regexp_matches(line, pattern)) AS first FROM (SELECT DISTINCT id FROM c) i CROSS JOIN g JOIN c ON c.id = i.id GROUP BY ALL)
SELECT id, letter, count(DISTINCT coalesce(first, -1)) = 1 AND min(coalesce(first, -1)) >= 0 AS together FROM h GROUP BY ALL"""


def pilot_distance(spark, sf_dir):
    """Runs of 50 vectors as the lines of a text."""
    lines = _read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("id"), F.col("vec_id").alias("line_no"), F.col("embedding").alias("vector"))
    return structure.distance_islands(lines).select("id", "line_no", F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"), F.col("chunk").cast("long").alias("chunk"))


_PILOT_DISTANCE = """WITH v AS (SELECT vec_id // 50 AS id, vec_id AS line_no, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT *, lag(v) OVER (PARTITION BY id ORDER BY line_no) AS u FROM v),
d AS (SELECT id, line_no, round(1 - list_inner_product(u, v) / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(v, v))), 9) AS distance FROM n),
t AS (SELECT id, round(quantile_cont(distance, 0.75), 9) AS threshold FROM d GROUP BY id)
SELECT id, line_no, round(distance, 6) AS distance, round(threshold, 6) AS threshold, CAST(sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS BIGINT) AS chunk FROM d JOIN t USING (id)"""

# ---- retrieval and evaluation


def _nearest(spark, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return retrieval.top_k(asked, vectors, 5, "query_id", "vec_id")


def dense_topk(spark, sf_dir):
    """The five nearest of all vectors for each vector whose id is divisible by 20."""
    return _nearest(spark, sf_dir).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_NEAREST = """SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 5"""


def label_agreement(spark, sf_dir):
    labels = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    both = _nearest(spark, sf_dir).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return both.groupBy("wanted").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("wanted")).cast("double")), 6).alias("agreement"))


_AGREEMENT = f"SELECT q.label AS wanted, count(*) AS n, round(avg(CASE WHEN v.label = q.label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM ({_NEAREST}) t JOIN embeddings q ON q.vec_id = t.query_id JOIN embeddings v ON v.vec_id = t.vec_id GROUP BY q.label"


def _questions(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions; their two ends are the evidence."""
    part = lambda a: F.array(F.substring("text", a, 40))
    ends = F.array(part(1), F.array(F.substring(F.col("text"), F.greatest(F.lit(1), F.length("text") - 39), F.lit(40))))
    unit = F.array(F.concat(F.lit("naive_fixed_length::"), "item_id", F.lit("#1")))
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("t"), F.col("item_id") % 3).alias("type"), F.col("text").alias("question"), ends.alias("evidence_keywords"), unit.alias("evidence_units"), unit.alias("evidence_ids"))


def _runs(spark, sf_dir: str) -> DataFrame:
    chunks = structure.common_columns(windows.naive_fixed_length(_raw(spark, sf_dir)))
    index = Scratch(spark, "index").table(retrieval.build_index(chunks, hashing()))
    return retrieval.retrieve(_questions(spark, sf_dir), index, hashing(), 5)


def retrieval_runs(spark, sf_dir):
    return _runs(spark, sf_dir).select("qa_id", "strategy", F.inline("results")).select("qa_id", "strategy", "rank", F.round("score", 6).alias("score"), "chunk_id")


def rag_prompts(spark, sf_dir):
    return retrieval.prompts(_runs(spark, sf_dir)).select("qa_id", "strategy", F.size("contexts").alias("n_contexts"), F.md5("prompt").alias("prompt_md5"))


def eval_details(spark, sf_dir):
    rows = evaluation.detail_rows(_questions(spark, sf_dir), _runs(spark, sf_dir))
    return rows.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in rows.dtypes))


def eval_details_without_ranks(spark, sf_dir):
    """Every second result has lost its rank: its place counts for recalls, and 0 as the rank of a first hit."""
    runs = _runs(spark, sf_dir).withColumn("results", F.transform("results", lambda r: r.withField("rank", F.when(r["rank"] % 2 == 1, r["rank"]))))
    rows = evaluation.detail_rows(_questions(spark, sf_dir), runs)
    return rows.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in rows.dtypes))


def eval_details_by_ids(spark, sf_dir):
    rows = evaluation.detail_rows(_questions(spark, sf_dir), _runs(spark, sf_dir), by="ids")
    return rows.select("qa_id", "first_hit_rank", "hit_1", "hit_5", "unit_count", "recall_5", "set_recall_5", "set_recall_rank")


def eval_summary(spark, sf_dir):
    rows = evaluation.summary(evaluation.detail_rows(_questions(spark, sf_dir), _runs(spark, sf_dir)))
    return rows.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in rows.dtypes))


def eval_diagnostics(spark, sf_dir):
    rows = evaluation.diagnostics(_questions(spark, sf_dir), _runs(spark, sf_dir))
    return rows.withColumn("genuine_rate", F.round("genuine_rate", 6))


def _sql_vector(source: str, name: str) -> str:
    return f"""{name}_n AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 7)) AS BIGINT) % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT id, unnest(regexp_extract_all(body, '[^{_SPACES}]+')) AS w FROM {source}) GROUP BY 1, 2),
{name} AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM {name}_n)"""


_RUNS = f"""c AS (SELECT id, body FROM ({_FIXED})), q AS (SELECT CAST(item_id AS VARCHAR) AS id, text AS body, item_id FROM benchmark),
{_sql_vector("c", "cv")}, {_sql_vector("q", "qv")},
p AS (SELECT q.id AS qa_id, c.id AS chunk_id FROM q, c), dots AS (SELECT qv.id AS qa_id, cv.id AS chunk_id, sum(qv.x * cv.x) AS s FROM qv JOIN cv USING (b) GROUP BY 1, 2),
ranked AS (SELECT qa_id, chunk_id, round(coalesce(s, 0), 9) AS score, row_number() OVER (PARTITION BY qa_id ORDER BY round(coalesce(s, 0), 9) DESC, chunk_id) AS rank FROM p LEFT JOIN dots USING (qa_id, chunk_id)),
r AS (SELECT qa_id, chunk_id, score, CAST(rank AS INTEGER) AS rank, {_sql_collapse('lower(c.body)')} AS body, c.body AS raw FROM ranked JOIN c ON c.id = chunk_id WHERE rank <= 5),
u AS (SELECT id AS qa_id, 't' || (item_id % 3) AS qa_type, 'naive_fixed_length::' || item_id || '#1' AS unit, unnest([substr(body, 1, 40), substr(body, greatest(1, length(body) - 39), 40)]) AS kw, unnest([0, 1]) AS no FROM q),
h AS (SELECT u.qa_id, u.no, min(rank) AS first FROM u JOIN r ON u.qa_id = r.qa_id WHERE trim(kw) <> '' AND contains(r.body, {_sql_collapse('lower(kw)')}) GROUP BY 1, 2),
n AS (SELECT qa_id, any_value(qa_type) AS qa_type, count(*) FILTER (trim(kw) <> '') AS unit_count FROM u GROUP BY 1),
g AS (SELECT qa_id, min(first) AS f, max(first) AS l, count(*) AS m, count(*) FILTER (first <= 1) AS n1, count(*) FILTER (first <= 3) AS n3, count(*) FILTER (first <= 5) AS n5 FROM h GROUP BY 1),
d AS (SELECT qa_id, qa_type, 'naive_fixed_length' AS strategy, f AS first_hit_rank, coalesce(f <= 1, false) AS hit_1, coalesce(f <= 3, false) AS hit_3, coalesce(f <= 5, false) AS hit_5, coalesce(1.0::DOUBLE / f, 0) AS rr, CAST(unit_count AS INTEGER) AS unit_count,
  coalesce(n1 / unit_count, 0) AS recall_1, coalesce(n3 / unit_count, 0) AS recall_3, coalesce(n5 / unit_count, 0) AS recall_5, coalesce(n1 = unit_count, false) AS set_recall_1, coalesce(n3 = unit_count, false) AS set_recall_3, coalesce(n5 = unit_count, false) AS set_recall_5,
  CASE WHEN m = unit_count THEN l END AS set_recall_rank, coalesce(1.0::DOUBLE / CASE WHEN m = unit_count THEN l END, 0) AS set_recall_rr FROM n LEFT JOIN g USING (qa_id))"""
_MEANS = ", ".join(f"round(avg({m}_{k}::DOUBLE), 6) AS {m}_{k}" for m in ("hit", "recall", "set_recall") for k in (1, 3, 5))
_DETAILS = f"WITH {_RUNS} SELECT * REPLACE (round(rr, 6) AS rr, round(set_recall_rr, 6) AS set_recall_rr, round(recall_1, 6) AS recall_1, round(recall_3, 6) AS recall_3, round(recall_5, 6) AS recall_5) FROM d"
_UNRANKED = _DETAILS.replace("min(rank) AS first", "min(rank) AS first, min(CASE WHEN rank % 2 = 1 THEN rank ELSE 0 END) AS own").replace("min(first) AS f,", "min(own) AS f,").replace("1.0::DOUBLE / f,", "1.0::DOUBLE / nullif(f, 0),")
_SUMMARY = f"WITH {_RUNS} SELECT strategy, CASE WHEN grouping(qa_type) = 1 THEN 'ALL' ELSE qa_type END AS qa_type, count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(set_recall_rr), 6) AS set_recall_mrr, {_MEANS} FROM d GROUP BY GROUPING SETS ((strategy), (strategy, qa_type))"
_DIAGNOSTICS = f"""WITH {_RUNS}, k AS (SELECT u.qa_id, count(*) AS h, count(*) FILTER (r.chunk_id = unit) AS gen FROM u JOIN r ON u.qa_id = r.qa_id WHERE trim(kw) <> '' AND contains(r.body, {_sql_collapse('lower(kw)')}) GROUP BY 1)
SELECT strategy, CASE WHEN grouping(qa_type) = 1 THEN 'ALL' ELSE qa_type END AS qa_type, CAST(coalesce(sum(h), 0) AS BIGINT) AS n_hits, CAST(coalesce(sum(gen), 0) AS BIGINT) AS genuine, CAST(coalesce(sum(h), 0) - coalesce(sum(gen), 0) AS BIGINT) AS coincidental,
  round(coalesce(sum(gen) / nullif(sum(h), 0), 0), 6) AS genuine_rate FROM d LEFT JOIN k USING (qa_id) GROUP BY GROUPING SETS ((strategy), (strategy, qa_type))"""
_IDS = f"""WITH {_RUNS}, i AS (SELECT DISTINCT u.qa_id, rank FROM u JOIN r ON u.qa_id = r.qa_id AND r.chunk_id = unit)
SELECT n.qa_id, rank AS first_hit_rank, coalesce(rank <= 1, false) AS hit_1, coalesce(rank <= 5, false) AS hit_5, 1 AS unit_count, CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS recall_5, coalesce(rank <= 5, false) AS set_recall_5, rank AS set_recall_rank FROM n LEFT JOIN i USING (qa_id)"""
_PROMPTS = f"""WITH {_RUNS}, x AS (SELECT qa_id, count(*) AS n, string_agg('[' || rank || '] ' || raw, chr(10) || chr(10) ORDER BY rank) AS ctx FROM r GROUP BY 1)
SELECT q.id AS qa_id, 'naive_fixed_length' AS strategy, CAST(coalesce(n, 0) AS INTEGER) AS n_contexts, md5('Use nothing but the context below to answer. Say so if the context does not hold the answer.' || chr(10) || chr(10) || 'Question:' || chr(10) || q.body || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(ctx, '') || chr(10) || chr(10) || 'Answer:') AS prompt_md5 FROM q LEFT JOIN x ON q.id = x.qa_id"""
_RETRIEVED = f"WITH {_RUNS} SELECT qa_id, 'naive_fixed_length' AS strategy, rank, round(score, 6) AS score, chunk_id FROM r"

QUERIES = {f.__name__: f for f in (
    fixed_chunks, sliding_chunks, table_function_chunks, chunk_statistics, semantic_chunks, condition_aware_chunks, action_logic_chunks, label_gaps, hierarchical_records, pilot_colocation, cleaned_texts, word_offsets, match_texts, section_merge, connector_attach, condition_blocks, section_outline,
    condition_records, action_records, smoke_questions, evidence_from_text, printed_references, label_parts, completion_times, parsed_pages, page_bands, note_spans, pilot_structure, pilot_distance,
    dense_topk, label_agreement, retrieval_runs, rag_prompts, eval_details, eval_details_without_ranks, eval_details_by_ids, eval_summary, eval_diagnostics,
)}

ORACLES = {
    "semantic_chunks": _SEMANTIC, "condition_aware_chunks": _CONDITION_CHUNKS, "action_logic_chunks": _ACTION_CHUNKS, "label_gaps": _GAPS, "hierarchical_records": _HIERARCHICAL, "pilot_colocation": _COLOCATION,
    "table_function_chunks": _TABLE_FUNCTION, "fixed_chunks": _ROWS.format(_FIXED), "sliding_chunks": _ROWS.format(_SLIDING), "chunk_statistics": _CHUNK_STATISTICS, "cleaned_texts": _CLEANED, "word_offsets": _WORD_OFFSETS, "match_texts": _MATCHED,
    "section_merge": _SECTIONS, "connector_attach": _CONNECTORS, "condition_blocks": _BLOCKS, "condition_records": _CONDITIONS, "action_records": _ACTIONS, "section_outline": _OUTLINE, "smoke_questions": _SMOKE, "evidence_from_text": _EVIDENCE, "printed_references": _PRINTED, "label_parts": _LABEL_PARTS,
    "completion_times": _TIMES, "parsed_pages": _PARSED, "page_bands": _BANDS, "note_spans": _NOTES, "pilot_structure": _PILOT_STRUCTURE, "pilot_distance": _PILOT_DISTANCE, "dense_topk": f"SELECT query_id, vec_id, rank, round(score, 6) AS score FROM ({_NEAREST})",
    "label_agreement": _AGREEMENT, "retrieval_runs": _RETRIEVED, "rag_prompts": _PROMPTS, "eval_details": _DETAILS, "eval_details_without_ranks": _UNRANKED, "eval_details_by_ids": _IDS, "eval_summary": _SUMMARY, "eval_diagnostics": _DIAGNOSTICS,
}
