"""Delta-maintained token totals by source, language and tokenizer version.

A store is a folder.  A batch of signed changes (inserted rows +1, deleted rows -1, a
revision as both) is summed by group and written to its own folder ``batches/<id>``, which
appears by a rename when it is complete.  Committing an id that is there already changes
nothing, so a batch may be retried after any failure.  Totals are the sums over all
batches: additive, whatever the order.

``compact`` sums the newest base and the batches that it lists at one moment into a new
base, a folder ``bases/<number>`` that holds the sums and the ids of exactly those batches
and appears by one rename.  A batch committed meanwhile is not among them and is read
beside the base; of two compactions at once one is published and the other leaves nothing.
Both need a file system with an atomic rename (HDFS or a local one, not an object store).

Groups are pre-aggregated before any shuffle, so a hot source costs a row for each task.

Defined results: null sources and languages are groups; a null or empty text has no
tokens and counts as a document; a group whose documents are all deleted stays with zeros
unless ``drop_empty``; an empty batch is committed as an empty one; equal rows count as
often as they occur.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.mixing import word_count
from pagemill.llm.scratch import Scratch

GROUPS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long, characters long"
#: A public byte-level vocabulary (ranks file), and the split into pieces that belongs to it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs without white space beyond this are encoded in parts, as the time of a merge grows with its square.
LONGEST = 1000

Counter = Callable[[Column], Column]


def parts(text: str) -> list[str]:
    """A text, cut where a run without white space passes ``LONGEST`` characters."""
    if len(text) <= LONGEST or max(map(len, text.split()), default=0) <= LONGEST:
        return [text]
    out, begin, run = [], 0, 0
    for i, c in enumerate(text):
        run = 0 if c.isspace() else run + 1
        if run > LONGEST:
            out.append(text[begin:i])
            begin, run = i, 1
    return [*out, text[begin:]]


def vocabulary_counter(ranks: bytes, pattern: str = PATTERN) -> Counter:
    """Counter by the contents of a public ranks file, which travel with the tasks (they are of fixed size)."""
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: sum(len(encoding.encode_ordinary(p)) for p in parts(t)) if t else 0)

    return count


def counted(documents: DataFrame, tokenizers: dict[str, Counter], text_column: str = "text", *extra: str) -> DataFrame:
    """Rows with their counts instead of their texts, so that later joins do not move texts."""
    counts = [count(F.col(text_column)).alias(f"tokens_{name}") for name, count in tokenizers.items()]
    return documents.select("source", "lang", *extra, *counts, F.coalesce(F.length(text_column), F.lit(0)).cast("long").alias("characters"))


def signed(rows: DataFrame, sign: int, *tokenizers: str) -> DataFrame:
    """Changes that insert (+1) or delete (-1) counted rows in the given tokenizer versions."""
    listed = F.inline(F.array(*(F.struct(F.lit(t).alias("tokenizer"), F.lit(sign).cast("long").alias("sign"), F.col(f"`tokens_{t}`").cast("long").alias("tokens")) for t in tokenizers)))
    return rows.select("source", "lang", listed, "characters")


class Rollup:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self._path(f"{self.folder}/{kind}")
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def _publish(self, write: Callable[[str], None], place: str) -> bool:
        """Has ``write`` fill a folder aside and renames it; False if the place is taken, by an earlier or a concurrent call."""
        aside, final = self._path(f"{self.folder}/aside/{uuid.uuid4().hex}"), self._path(f"{self.folder}/{place}")
        write(aside.toString())
        self._files.mkdirs(final.getParent())
        if not self._files.exists(final) and self._files.rename(aside, final) and not self._files.exists(self._path(f"{self.folder}/{place}/{aside.getName()}")):
            return True
        self._files.delete(aside, True)
        self._files.delete(self._path(f"{self.folder}/{place}/{aside.getName()}"), True)
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch once; True if this call did it."""
        if batch in self._names("batches"):
            return False
        sums = [F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("tokens", "characters")]
        grouped = changes.groupBy(*GROUPS).agg(F.sum("sign").alias("documents"), *sums)
        return self._publish(lambda aside: grouped.write.parquet(aside), f"batches/{batch}")

    def _read(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.folder}/{p}" for p in places])

    def _listed(self) -> tuple[int, set[str], list[str]]:
        """Number of bases, the batches in the newest one, and the places whose sums are the totals: one look at the store."""
        bases, batches = self._names("bases"), self._names("batches")
        held: set[str] = set()
        if bases:
            held = {r.batch for r in self.spark.read.schema("batch string").json(f"{self.folder}/bases/{bases[-1]}/held").collect()}
        return len(bases), held, [f"bases/{b}/sums" for b in bases[-1:]] + [f"batches/{b}" for b in batches if b not in held]

    def _summed(self, places: list[str]) -> DataFrame:
        return self._read(places).groupBy(*GROUPS).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("documents", "tokens", "characters")))

    def totals(self, drop_empty: bool = False) -> DataFrame:
        out = self._summed(self._listed()[2])
        return out.where("documents <> 0 or tokens <> 0 or characters <> 0") if drop_empty else out

    def compact(self) -> bool:
        """Publishes a base of all batches listed now; False, and nothing changed, if another compaction was faster."""
        number, held, places = self._listed()
        held |= {p.removeprefix("batches/") for p in places if p.startswith("batches/")}

        def write(aside: str) -> None:
            self._summed(places).write.parquet(f"{aside}/sums")
            self.spark.createDataFrame([(b,) for b in sorted(held)], "batch string").coalesce(1).write.json(f"{aside}/held")

        return self._publish(write, f"bases/{number:08d}")


#: Written as another text where e-mail addresses are masked.
EMAIL, MASK = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>"


def op6_token_rollup(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals after five batches over all ``documents``, one of them sent twice, and a compaction.

    Inserts counted by words; deletes of the later copies of equal texts; a public
    vocabulary added for what is left; the language of live rows without one revised to
    ``und``; counts revised where live texts hold e-mail addresses, which are masked.
    """
    tokenizers = {"words-1": word_count, "byte-bpe-50k": vocabulary_counter(Path(vocabulary).read_bytes())}
    versions, scratch = tuple(tokenizers), Scratch(spark, "counts")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"digest": F.md5("text"), "mailed": F.coalesce(F.col("text").rlike(EMAIL), F.lit(False))})
    store = Rollup(spark, scratch.folder + "/store")
    rows = scratch.table(counted(documents, tokenizers, "text", "doc_id", "digest", "mailed"))
    first = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = scratch.table(first)
    # rows without text have no copies and stay out of the join
    texts = scratch.table(rows.where("digest is not null").join(first, "digest", "left").withColumn("later", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first"))
    later = texts.where("later")
    live = texts.where("not later").drop("later").unionByName(rows.where("digest is null"))
    store.commit("1-insert", signed(rows, 1, "words-1"))
    store.commit("2-delete", signed(later, -1, "words-1"))
    store.commit("1-insert", signed(rows, 1, "words-1"))
    store.commit("3-vocabulary", signed(rows, 1, "byte-bpe-50k").unionByName(signed(later, -1, "byte-bpe-50k")))
    store.compact()
    unknown = live.where("lang is null")
    store.commit("4-language", signed(unknown, -1, *versions).unionByName(signed(unknown.withColumn("lang", F.lit("und")), 1, *versions)))
    mailed = live.where("mailed").withColumn("lang", F.coalesce("lang", F.lit("und")))
    masked = documents.where("mailed").withColumn("text", F.regexp_replace("text", EMAIL, MASK))
    masked = counted(masked.withColumn("lang", F.coalesce("lang", F.lit("und"))), tokenizers, "text", "doc_id", "digest").join(first, "digest", "left").where("not coalesce(doc_id > first, false)")
    store.commit("5-masked", signed(mailed, -1, *versions).unionByName(signed(masked, 1, *versions)))
    return store.totals()


#: What is alive in the end, counted at once: the last text and language of each row that no earlier copy stands for.
#: Byte pairs are merged by rank, the leftmost of the least rank first, once for each distinct piece.
OP6_SQL = rf"""
WITH RECURSIVE ranks AS (SELECT hex(from_base64(token)) AS token, CAST(rank AS BIGINT) AS rank FROM read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'VARCHAR'}})),
live AS (SELECT row_number() OVER () AS r, source, coalesce(lang, 'und') AS lang, regexp_replace(text, '{EMAIL}', '{MASK}', 'g') AS t FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE text IS NULL OR NOT coalesce(doc_id > first, false)),
-- the mark stands ahead of the last white space of a run that more text follows
marked AS (SELECT r, regexp_replace(t, '([\s\x0b]+)([\s\x0b][^\s\x0b])', '\1' || chr(57344) || '\2', 'g') AS t FROM live WHERE t <> ''),
pieces AS (SELECT r, unnest(regexp_extract_all(t, '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\x0b\p{{L}}\p{{N}}' || chr(57344) || ']+|[\s\x0b]+')) AS piece FROM marked),
counts AS (SELECT r, piece, count(*) AS n FROM pieces GROUP BY ALL),
start AS (SELECT piece, regexp_extract_all(hex(encode(piece)), '..') AS p FROM (SELECT DISTINCT piece FROM counts)),
merged AS (SELECT piece, p FROM start
  UNION ALL SELECT piece, any_value(p)[:arg_min(i, rank * 100000 + i) - 1] || [any_value(p)[arg_min(i, rank * 100000 + i)] || any_value(p)[arg_min(i, rank * 100000 + i) + 1]] || any_value(p)[arg_min(i, rank * 100000 + i) + 2:]
    FROM (SELECT piece, p, unnest(range(1, len(p))) AS i FROM merged WHERE len(p) > 1) m JOIN ranks ON ranks.token = m.p[m.i] || m.p[m.i + 1] GROUP BY piece, len(p)),
sized AS (SELECT piece, min(len(p)) AS tokens FROM merged GROUP BY piece),
bpe AS (SELECT r, CAST(sum(n * tokens) AS BIGINT) AS tokens FROM counts JOIN sized USING (piece) GROUP BY r),
every AS (SELECT source, lang, 'words-1' AS tokenizer, CAST(coalesce(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens, coalesce(length(t), 0) AS characters FROM live
  UNION ALL SELECT source, lang, 'byte-bpe-50k', coalesce(tokens, 0), coalesce(length(t), 0) FROM live LEFT JOIN bpe USING (r)),
-- a group that lost all its rows stays with zeros
seen AS (SELECT DISTINCT source, lang, tokenizer FROM documents, (SELECT unnest(['words-1', 'byte-bpe-50k']) AS tokenizer) UNION SELECT source, lang, tokenizer FROM every)
SELECT s.source, s.lang, s.tokenizer, count(b.tokens) AS documents, CAST(coalesce(sum(b.tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(b.characters), 0) AS BIGINT) AS characters
FROM seen s LEFT JOIN every b ON s.source IS NOT DISTINCT FROM b.source AND s.lang IS NOT DISTINCT FROM b.lang AND s.tokenizer = b.tokenizer GROUP BY ALL
"""
