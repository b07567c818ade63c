"""URL filters: allow and block rules, carried to aliases by redirect and canonical links.

A rule has a host, which stands for its subdomains too, and the beginning of a path.  The
longest rule that fits decides a url.  Urls that redirect to one another or name one
another as canonical form an equivalence class: the connected components of those links.
A url that no rule fits is blocked when a rule blocks any member of its class, and allowed
otherwise; a url that a rule allows stays allowed whatever its class holds.

Links are compared in a normal form: the reference is resolved against the page's url (or
its ``base``), scheme and host are folded, default ports and fragments go, and dot segments
are taken out.  Everything is column expressions.

Rules reach the plan as a literal (a rule list is configuration, bounded by ``MAX_RULES``);
links and components stay distributed.  Pages meet the blocked aliases in one left join of
narrow rows, in which adaptive execution can split a hot url; urls without a normal form
carry keys of their own there.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and is allowed; a url whose scheme is no RFC 3986 scheme has no aliases; repeated urls
get equal verdicts; links to urls outside the table still connect those inside it; of
several canonical links, refreshes or bases of a page the first counts; links in comments
and scripts do not, nor does a tag that the text ends within; quotes delimit a value only
after ``=`` and where they are closed; tags of any length are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import connected_components
from pagemill.llm.scratch import Scratch

MAX_RULES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Patterns of HTML and of RFC 3986, in a form that Java and RE2 read alike.
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
# A tag ends at the first > outside of a quoted value, or with the text; possessive, so that no length of tag needs a stack, and no beginning is tried twice.
_TAG = r"""(?is)<(?:link|meta|base)[\s/](?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+(?:>|\z)"""
_ATTRIBUTE = r"""(?is)[^\s"'>/=<]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
_NAME, _VALUE = r"(?s)^([^\s=]+)", r"""(?s)^[^\s=]+\s*=\s*(?:"([^"]*)"|'([^']*)'|(.*))$"""
_REFRESH = r"(?is)^\s*[0-9.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(.*)$"
_QUOTED = r"""(?s)^(?:"([^"]*)|'([^']*)|(.*))"""
_ENTITY = r"(?s)&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);|&|[^&]+"
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"
_HAS_AUTHORITY = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(rest, _UPPER, _LOWER), path


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest (host, path) rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _folded(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def unescaped(name: str) -> Column:
    """A column with its numeric and the five XML entities decoded; others stay."""
    code = r"coalesce(try_cast(regexp_extract(e, r'^&#([0-9]{1,7});$', 1) AS INT), try_cast(conv(regexp_extract(e, r'^&#[xX]([0-9A-Fa-f]{1,6});$', 1), 16, 10) AS INT))"
    sound = f"{code} BETWEEN 1 AND 1114111 AND NOT {code} BETWEEN 55296 AND 57343"
    named = " ".join(f"""WHEN "{k}" THEN r{'"' if v == "'" else "'"}{v}{'"' if v == "'" else "'"}""" for k, v in _NAMED.items())
    each = f"e -> CASE e {named} ELSE CASE WHEN {sound} THEN decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') ELSE e END END"
    return F.expr(f"IF(contains({name}, '&'), array_join(transform(regexp_extract_all({name}, r'{_ENTITY}', 0), {each}), ''), {name})")


def with_normal(frame: DataFrame, name: str, reference: str, base: str) -> DataFrame:
    """Adds ``name``: column ``reference`` as a url in normal form, relative to ``base`` (absolute); null if neither gives a host.

    In steps, so that no expression holds another one many times over.
    """
    columns = [*(c for c in frame.columns if c != name), name]
    trimmed = lambda x: rf"regexp_replace(translate({x}, '\t\n\r', ''), r'^[\x00-\x20]+|[\x00-\x20]+$', '')"
    steps = (
        {"_r": trimmed(reference), "_b": trimmed(base)},
        {**{f"_{x}{k}": f"regexp_extract(_{x}, r'{_PARTS}', {k})" for x in "rb" for k in (1, 2, 3, 4)}, "_hosted": f"_r rlike r'{_HAS_AUTHORITY}'"},
        {"_whole": "_hosted or _r1 <> ''", "_folder": "regexp_extract(_b3, r'(?s)^(.*/)', 1)", "_scheme": _folded("if(_r1 <> '', _r1, _b1)")},
        {
            "_host": _folded("if(_whole, _r2, _b2)"), "_path": "CASE WHEN _whole OR startswith(_r3, '/') THEN _r3 WHEN _r3 = '' THEN _b3 ELSE concat(if(_folder = '', '/', _folder), _r3) END",
            "_query": "if(_whole OR _r3 <> '' OR _r4 <> '', _r4, _b4)",
        },
        {"_host": "CASE _scheme WHEN 'http' THEN regexp_replace(_host, ':(?:80)?$', '') WHEN 'https' THEN regexp_replace(_host, ':(?:443)?$', '') ELSE _host END", "_segments": "split(if(startswith(_path, '/'), substring(_path, 2), _path), '/')"},
        # without . and .. segments
        {"_path": "aggregate(_segments, '', (made, s) -> CASE s WHEN '.' THEN made WHEN '..' THEN regexp_replace(made, '/[^/]*$', '') ELSE concat(made, '/', s) END) || if(element_at(_segments, -1) in ('.', '..'), '/', '')"},
        {name: "if(_scheme <> '' and _host <> '', concat(_scheme, '://', _host, _path, _query), null)"},
    )
    for step in steps:
        frame = frame.withColumns({k: F.expr(v) for k, v in step.items()})
    return frame.select(columns)


def html_links(pages: DataFrame, url_column: str, html_column: str) -> DataFrame:
    """(a, b): each page's url and the url that its canonical link or refresh redirect names, in normal form."""
    seen = F.regexp_replace(html_column, _UNSEEN, " ")
    tags = pages.where(f"{url_column} like '%://%' and ({html_column} ilike '%canonical%' or {html_column} ilike '%refresh%')")
    tags = tags.select(F.col(url_column).alias("url"), F.filter(F.regexp_extract_all(seen, F.lit(_TAG), 0), lambda t: t.endswith(">")).alias("tags"))

    kinds = F.transform("tags", lambda t: F.struct(F.translate(F.regexp_extract(t, r"^<([A-Za-z]+)", 1), _UPPER, _LOWER).alias("tag"), F.regexp_extract_all(F.regexp_replace(t, r"^<[A-Za-z]+", ""), F.lit(_ATTRIBUTE), 0).alias("held")))

    def attribute(held: Column, name: str) -> Column:
        """The first attribute of that name, not yet decoded; empty without one."""
        own = F.get(F.filter(held, lambda a: F.translate(F.regexp_extract(a, _NAME, 1), _UPPER, _LOWER) == name), 0)
        return F.coalesce(F.regexp_replace(F.regexp_replace(own, r"(?s)^[^\s=]+(?:\s*=\s*)?", ""), r"""(?s)^"([^"]*)"$|^'([^']*)'$""", "$1$2"), F.lit(""))

    tags = tags.select("url", kinds.alias("kinds")).select("url", F.transform("kinds", lambda k: F.struct(k["tag"].alias("tag"), *(attribute(k["held"], n).alias(c) for c, n in (("rel", "rel"), ("href", "href"), ("equiv", "http-equiv"), ("content", "content"))))).alias("tags"))
    first = lambda test, field: F.expr(f"coalesce(get(filter(tags, t -> {test}), 0).{field}, '')")
    canonical = first(f"t.tag = 'link' AND array_contains(split({_folded('t.rel')}, '[ \\\\t\\\\n\\\\f\\\\r]+'), 'canonical')", "href")
    chosen = tags.select("url", canonical.alias("canonical"), first("t.tag = 'base' AND t.href <> ''", "href").alias("own"), first(f"t.tag = 'meta' AND {_folded('t.equiv')} = 'refresh'", "content").alias("content"))
    chosen = chosen.withColumns({c: unescaped(c) for c in ("canonical", "own", "content")}).withColumn("after", F.regexp_extract("content", _REFRESH, 1))
    found = chosen.select("url", "own", "canonical", F.concat(*(F.regexp_extract("after", _QUOTED, k) for k in (1, 2, 3))).alias("target"))
    found = with_normal(with_normal(found, "base", "own", "url"), "a", "url", "url")
    found = found.select("a", F.expr("coalesce(if(own <> '', base, null), url)").alias("base"), F.explode(F.array("canonical", "target")).alias("link")).where("link <> ''")
    return with_normal(found, "b", "link", "base").select("a", "b").where("a is not null and b is not null")


def _node(url: Column) -> Column:
    """128 bits of a url in normal form: a component's id has to be in random order."""
    return F.unhex(F.md5(url))


def judge(pages: DataFrame, links: DataFrame, rules: list[tuple[str, str, str]], url_column: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``links`` has urls a and b that are one resource, absolute."""
    scratch = Scratch(pages.sparkSession, "urls")
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(url_column))
    judged = pages.withColumns({"host": host, "path": path})
    judged = judged.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("_best.rule"), "_own": F.col("_best.verdict")}).drop("_best")
    links = with_normal(with_normal(links.select("a", "b"), "a", "a", "a"), "b", "b", "b")
    links = scratch.table(links.where("a is not null and b is not null").distinct())
    components = connected_components(links.select(_node(F.col("a")).alias("a"), _node(F.col("b")).alias("b")), scratch)
    ends = links.select(F.col("a").alias("u")).union(links.select("b")).distinct()
    end_host, end_path = host_and_path(F.col("u"))
    rated = ends.select(_node(F.col("u")).alias("node"), (best_rule(end_host, end_path, rules)["verdict"] == "block").alias("hit")).where("hit")
    blocked = components.join(rated, "node").select("component").distinct()
    aliases = scratch.table(components.join(blocked, "component").select(F.col("node").alias("_node")).withColumn("_blocked", F.lit(True)))
    # a null key would gather all such rows in one task
    key = F.coalesce(_node(F.col("_normal")), F.unhex(F.md5(F.concat(F.lit("none "), F.xxhash64(*pages.columns).cast("string")))))
    judged = with_normal(judged, "_normal", url_column, url_column)
    out = judged.withColumn("_node", key).join(aliases, "_node", "left")
    return out.withColumn("verdict", F.coalesce("_own", F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))).select(*pages.columns, "host", "path", "rule", "verdict")


#: The rules of the contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    """Contract query over all ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = Scratch(spark, "links").table(html_links(pages, "url", "html"))
    return judge(pages.select("page_id", "url"), links, RULES).select("page_id", "host", "path", "rule", "verdict")


# The same in the SQL's own words: RE2 has no possessive forms and needs none.
_SQL_TAG = r"""(?is)<(?:link|meta|base)[\s/](?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*?(?:>|\z)"""
_SQL_ATTRIBUTE = r"""(?is)[^\s"'=<>/]+\s*=\s*"[^"]*"|[^\s"'=<>/]+\s*=\s*'[^']*'|[^\s"'=<>/]+\s*=\s*[^\s"'=<>`]+|[^\s"'=<>/]+"""
_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))


def _case(column: str, value) -> str:
    whens = " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN {value(v, h, p)}" for v, h, p in _ORDERED)
    return f"CASE {whens} ELSE NULL END AS {column}"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_fold(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def _sql_split(x: str, pattern: str) -> str:
    return f"concat({', '.join(f'regexp_extract({x}, {_quoted(pattern)}, {k})' for k in (1, 2, 3))})"


def _sql_attribute(tag: str, name: str) -> str:
    listed = f"regexp_extract_all(regexp_replace({tag}, '^<[A-Za-z]+', ''), {_quoted(_SQL_ATTRIBUTE)})"
    own = f"list_filter({listed}, lambda a: {_sql_fold(f'regexp_extract(a, {_quoted(_NAME)}, 1)')} = '{name}')[1]"
    code = "coalesce(try_cast(regexp_extract(e, '^&#([0-9]{1,7});$', 1) AS INTEGER), try_cast('0x' || nullif(regexp_extract(e, '^&#[xX]([0-9A-Fa-f]{1,6});$', 1), '') AS INTEGER))"
    named = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in _NAMED.items())
    sound = f"{code} BETWEEN 1 AND 1114111 AND NOT {code} BETWEEN 55296 AND 57343"
    return f"coalesce(array_to_string(list_transform(regexp_extract_all({_sql_split(own, _VALUE)}, {_quoted(_ENTITY)}), lambda e: CASE e {named} ELSE CASE WHEN {sound} THEN chr({code}) ELSE e END END), ''), '')"


def _sql_normal(source: str, reference: str, base: str, kept: str) -> str:
    """A subquery of ``source`` with ``kept`` and ``normal``: the reference relative to the base."""
    trimmed = lambda x: f"regexp_replace(regexp_replace({x}, '[\\t\\n\\r]', '', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
    part = lambda x, k: f"regexp_extract({x}, {_quoted(_PARTS)}, {k})"
    return f"""(SELECT {kept}, CASE WHEN sch <> '' AND aut <> '' THEN sch || '://' || aut || list_reduce(list_prepend('', string_split(path[2:], '/')), lambda m, s: CASE s WHEN '.' THEN m WHEN '..' THEN regexp_replace(m, '/[^/]*$', '') ELSE m || '/' || s END)
      || CASE WHEN string_split(path[2:], '/')[-1] IN ('.', '..') THEN '/' ELSE '' END || query END AS normal
    FROM (SELECT *, CASE sch WHEN 'http' THEN regexp_replace(auth, ':(?:80)?$', '') WHEN 'https' THEN regexp_replace(auth, ':(?:443)?$', '') ELSE auth END AS aut, CASE WHEN starts_with(p0, '/') THEN p0 ELSE '/' || p0 END AS path
    FROM (SELECT *, {_sql_fold(f"CASE WHEN own THEN {part('ref', 1)} ELSE {part('bas', 1)} END")} AS sch, {_sql_fold(f"CASE WHEN hosted OR own THEN {part('ref', 2)} ELSE {part('bas', 2)} END")} AS auth,
      CASE WHEN hosted OR own OR starts_with(given, '/') THEN given WHEN given = '' THEN {part('bas', 3)} ELSE coalesce(nullif(regexp_extract({part('bas', 3)}, '(?s)^(.*/)', 1), ''), '/') || given END AS p0,
      CASE WHEN hosted OR own OR given <> '' OR {part('ref', 4)} <> '' THEN {part('ref', 4)} ELSE {part('bas', 4)} END AS query
    FROM (SELECT *, {part('ref', 1)} <> '' AS own, regexp_matches(ref, {_quoted(_HAS_AUTHORITY)}) AS hosted, {part('ref', 3)} AS given FROM (SELECT *, {trimmed(reference)} AS ref, {trimmed(base)} AS bas FROM {source})))))"""


def _sql_tag(name: str, test: str) -> str:
    return f"list_filter(tags, lambda t: {_sql_fold('''regexp_extract(t, '^<([A-Za-z]+)', 1)''')} = '{name}' AND {test})[1]"


#: Links are followed with a recursive reachability query: exact, for small tables.
OP1_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, normal AS u FROM {_sql_normal("pages", "url", "url", "page_id, url, html")}),
t AS (SELECT url, u, list_filter(regexp_extract_all(regexp_replace(html, {_quoted(_UNSEEN)}, ' ', 'g'), {_quoted(_SQL_TAG)}), lambda t: ends_with(t, '>')) AS tags FROM p WHERE url LIKE '%://%'),
a AS (SELECT url, u, {_sql_attribute(_sql_tag("link", f"list_contains(regexp_split_to_array({_sql_fold(_sql_attribute('t', 'rel'))}, '[ \t\n\f\r\x0b]+'), 'canonical')"), "href")} AS canonical,
  regexp_extract({_sql_attribute(_sql_tag("meta", f"{_sql_fold(_sql_attribute('t', 'http-equiv'))} = 'refresh'"), "content")}, {_quoted(_REFRESH)}, 1) AS after, {_sql_attribute(_sql_tag("base", f"{_sql_attribute('t', 'href')} <> ''"), "href")} AS base FROM t),
f AS (SELECT u, coalesce(CASE WHEN base <> '' THEN normal END, url) AS base, unnest([canonical, {_sql_split("after", _QUOTED)}]) AS link FROM {_sql_normal("a", "base", "url", "u, url, base, canonical, after")}),
e AS (SELECT u AS a, normal AS b FROM {_sql_normal("(SELECT * FROM f WHERE link <> '')", "link", "base", "u")} WHERE u IS NOT NULL AND normal IS NOT NULL),
b2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, a AS b FROM b2 UNION SELECT r.a, b2.b FROM r JOIN b2 ON r.b = b2.a),
split AS (SELECT page_id, u, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM p),
v AS (SELECT *, {_case("rule", lambda v, h, p: f"'{h}{p}'")}, {_case("own", lambda v, h, p: f"'{v}'")} FROM split),
w AS (SELECT a AS u, translate(regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(b, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM r),
k AS (SELECT DISTINCT u FROM (SELECT u, {_case("own", lambda v, h, p: f"'{v}'")} FROM w) WHERE own = 'block')
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN k.u IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM v LEFT JOIN k ON v.u = k.u
"""
