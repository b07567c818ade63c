"""Secrets in texts: rules as regular expressions, found through a trigram inverted index.

Each rule's expression yields a Boolean query over the trigrams that a match must hold
(``trigrams``).  The texts of a task are indexed segment by segment, each of bounded bytes:
postings of all trigrams that some rule asks for, which the rules' queries intersect and
unite.  Only nominated texts meet a rule's expression; a rule without a mandatory trigram,
such as a run of hexadecimal digits, scans every text.  Segments lie where Spark has read
their rows, so index, queries and verification are one narrow pass: nothing is shuffled,
no group of rows matters, and a lost task is simply done again.  The vocabulary is bounded
by the rules, whatever the input.

A rule may ask for a least length of one of its groups.  Shorter matches are dropped after
the scan: they still cover their characters, so no match begins inside them.

Defined results: one row for each row of the input, equal and null ids included; a null
text is an empty one and has no spans; spans are in code points, the end left out, in the
order of their starts, then of the rules; spans of one rule don't overlap, those of
different rules may; whole texts of any length are read; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.scratch import bound_batches
from pagemill.llm.trigrams import Segment, Vocabulary, asked, trigram_query
from pagemill.llm.words import sliced

SEGMENT_BYTES = 2_000_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    flags: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags | re.ASCII)

    def query(self):
        return trigram_query(self.pattern, self.flags)


#: The contract's three kinds.  A run of 16 digits or more is the same whether shorter ones are dropped after the scan or never matched.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Published formats of tokens and keys.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{20,}|hooks\.slack\.com/services/[A-Z0-9]+/[A-Z0-9]+/[A-Za-z0-9]+"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{20,}"),
    Rule("package_index", r"npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("credentials", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%!$*+=-]{6,64}@[A-Za-z0-9]"),
)
RULES = BASE + MORE

_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def spans_of(text: str, rule: Rule, expression: re.Pattern) -> list[tuple[int, int]]:
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, spans) of every row."""
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("rules need kinds of their own")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias(id_column), F.col(text_column).alias("text"))

    def found(batches):
        import pyarrow as pa

        expressions, wanted = [r.compiled() for r in rules], [r.query() for r in rules]
        vocabulary = Vocabulary(set().union(*map(asked, wanted)))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for a, b, texts in sliced(batch.column("text"), SEGMENT_BYTES):
                index, spans, held = Segment(texts, vocabulary), [[] for _ in texts], {}
                for k, (rule, expression, query) in enumerate(zip(rules, expressions, wanted, strict=True)):
                    for row in index.candidates(query).tolist():
                        text = held.get(row)
                        if text is None:
                            text = held[row] = (texts[row] or b"").decode()
                        spans[row] += [(start, k, end) for start, end in spans_of(text, rule, expression)]
                listed = [[{"kind": rules[k].kind, "start": start, "end": end} for start, k, end in sorted(own)] for own in spans]
                yield pa.RecordBatch.from_arrays([batch.column(id_column).slice(a, b - a), pa.array(listed, kind)], names=[id_column, "spans"])

    return rows.mapInArrow(found, T.StructType([rows.schema[id_column], T.StructField("spans", _SPANS)]))


def op12_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query over all ``documents``."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _sql() -> str:
    """Spans from the lengths of what lies between matches, and of the matches."""
    words = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
    patterns = [RULES[0].pattern.replace("password|passwd|secret|token|api_?key", words), *(r.pattern for r in RULES[1:])]
    quoted = [p.replace("'", "''") for p in patterns]
    kinds = [
        f"SELECT doc_id, n, {k} AS k, '{r.kind}' AS kind, string_split_regex(t, '{q}') AS gaps, regexp_extract_all(t, '{q}') AS hits, regexp_extract_all(t, '{q}', {r.group}) AS part, {r.least} AS least FROM d WHERE regexp_matches(t, '{q}')"
        for k, (r, q) in enumerate(zip(RULES, quoted, strict=True))
    ]
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
found AS ({" UNION ALL ".join(kinds)}),
placed AS (
  SELECT n, k, kind, least, length(hits[i]) AS size, length(part[i]) AS own,
    coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)),
spans AS (SELECT n, k, kind, s, kind || ':' || s::BIGINT || ':' || (s + size)::BIGINT AS span FROM placed WHERE own >= least),
summed AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < {len(BASE)}), '') AS base, string_agg(span, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN summed USING (n)
"""


OP12_SQL = _sql()
