"""Removal of word passages that occur more than once in a corpus, by seed and extend.

Seeds are winnowed anchors: in every window of ``window`` words, the run of ``anchor``
words with the least hash (the leftmost of equal ones).  Equal windows have equal anchors
at equal places, so only anchors that occur twice can lie in a repeat.

Extension.  The windows that share one anchor occurrence are consecutive, and together
they are the anchor extended left and right as far as it decides.  All occurrences of an
anchor are extended at once: their extensions are joined by a 128-bit hash of their words,
so a passage in n documents costs n rows and not n * n pairs.  An extension that occurs
twice is a repeat as a whole.  Where an anchor has several different extensions, they are
cut back to their single windows, joined in the same way, and those that occur twice are
kept.  The union of repeated windows gives the maximal repeats of at least ``window`` words.

Nothing but anchors and hashes is shuffled until the repeats are known: the anchors and
extensions that matter are told apart by bit arrays of bounded size (see ``sieve``), and
the texts are scanned again.  Texts with repeats are shuffled once, to meet their spans.

Defined results: null and empty texts have no words and no repeats; a text shorter than
the window is never touched; a row that is repeated as a whole counts as often as it
occurs; windows are judged on the input; a text without repeats stays byte for byte.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.scratch import Scratch
from pagemill.llm.sieve import Sieve, build_sieve, passing
from pagemill.llm.words import Batch, RunHashes, sliced

WINDOW = 35
ANCHOR = 12
_KEY, _KEY2 = "_pagemill_key", "_pagemill_key2"


def anchors_of(batch: Batch, window: int, anchor: int):
    """Document, hash, first and last window of each selected anchor of a batch."""
    runs = RunHashes(batch.hashes)
    h = runs.all(anchor)
    width = window - anchor + 1
    least, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        if len(least) <= step:
            least = least[:0]
            break
        left, right = least[: len(least) - step], least[step:]
        least = np.where(h[left] <= h[right], left, right)
        span += step
    document = batch.document_of()
    start = np.arange(len(least))
    start = start[start + window <= batch.ends[document[start]]] if len(start) else start
    at = least[start]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1] if len(new) else start[:0]
    return runs, document[first], h[at[new]], first, last


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def occurrence(extension: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    start = start.astype(np.uint64)
    return extension ^ key ^ (start << np.uint64(32)) ^ start


def repeated_ranges(texts: DataFrame, scratch: Scratch, window: int, anchor: int) -> DataFrame:
    """``texts`` has ``_KEY``, ``_KEY2`` and ``text``; returns (key, key2, ranges of first and last repeated window).

    Equal rows share a key and the ranges, which are gathered without repeats: a row's
    ranges are as many as its windows at most.
    """
    import pyarrow as pa

    def seeds(batches):
        for whole in batches:
            for _, _, values in sliced(whole.column(0)):
                _, _, h, _, _ = anchors_of(Batch(values), window, anchor)
                one, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_pydict({"g": _signed(one), "n": n})

    repeated = scratch.table(texts.select("text").mapInArrow(seeds, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n >= 2").select("g"))
    seed_sieve = build_sieve(repeated, "g")

    def each(batches, chosen):
        for whole in batches:
            keys, others = (whole.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for k in (0, 1))
            for a, b, values in sliced(whole.column(2)):
                batch = Batch(values)
                runs, document, h, first, last = anchors_of(batch, window, anchor)
                pick = chosen(h)
                if pick is not None:
                    document, h, first, last = document[pick], h[pick], first[pick], last[pick]
                yield batch, runs, keys[a:b][document], others[a:b][document], batch.starts[document], h, first, last

    def extended(batches):
        sieve = Sieve(seed_sieve.value)
        for batch, runs, key, other, begin, h, first, last in each(batches, sieve.passes):
            yield pa.RecordBatch.from_pydict({
                "g": _signed(h), "e1": _signed(runs.at(first, last + window)), "e2": _signed(RunHashes(batch.hashes, 1).at(first, last + window)),
                "key": _signed(key), "key2": _signed(other), "start": (first - begin).astype(np.int32), "last": (last - begin).astype(np.int32),
            })

    found = scratch.table(texts.select(_KEY, _KEY2, "text").mapInArrow(extended, "g long, e1 long, e2 long, key long, key2 long, start int, last int"))
    extensions = scratch.table(found.groupBy("g", "e1", "e2").agg(F.count("*").alias("n"), F.min(F.struct("key", "start")).alias("one")))
    whole_repeats = found.join(extensions.where("n >= 2").select("g", "e1", "e2"), ["g", "e1", "e2"]).select("key", "key2", "start", "last")

    several = scratch.table(extensions.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds >= 2").select("g"))
    opened = scratch.table(extensions.join(several, "g").select(F.expr("e1 ^ one.key ^ shiftleft(cast(one.start as bigint), 32) ^ cast(one.start as bigint)").alias("o")))
    occurrence_sieve = build_sieve(opened, "o")

    def single(batches):
        sieve = Sieve(occurrence_sieve.value)
        for batch, runs, key, other, begin, _, first, last in each(batches, lambda h: None):
            pick = sieve.passes(occurrence(runs.at(first, last + window), key, first - begin))
            key, other, begin, first, last = key[pick], other[pick], begin[pick], first[pick], last[pick]
            n = last - first + 1
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield pa.RecordBatch.from_pydict({
                "w1": _signed(runs.at(at, at + window)), "w2": _signed(RunHashes(batch.hashes, 1).at(at, at + window)),
                "key": _signed(np.repeat(key, n)), "key2": _signed(np.repeat(other, n)), "start": (at - np.repeat(begin, n)).astype(np.int32),
            })

    windows = scratch.table(texts.select(_KEY, _KEY2, "text").mapInArrow(single, "w1 long, w2 long, key long, key2 long, start int"))
    twice = scratch.table(windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n >= 2").select("w1", "w2"))
    window_repeats = windows.join(twice, ["w1", "w2"]).select("key", "key2", "start", F.col("start").alias("last"))
    return whole_repeats.union(window_repeats).groupBy("key", "key2").agg(F.collect_set(F.struct("start", "last")).alias("ranges"))


def merged(ranges: list[dict], window: int) -> list[tuple[int, int]]:
    """Word spans [begin, end) covered by ranges of windows."""
    out: list[tuple[int, int]] = []
    for begin, last in sorted((r["start"], r["last"]) for r in ranges):
        end = last + window
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``documents`` with ``text_column`` freed of repeats, and ``n_words``, ``n_removed`` and ``repeats``.

    ``repeats`` lists the maximal repeats as word spans [begin, end).  Kept stretches keep
    their own white space.  Columns of the input with one of the new names are replaced.
    """
    if not 0 < anchor <= window:
        raise ValueError("0 < anchor <= window")
    documents = documents.drop("n_words", "n_removed", "repeats")
    scratch = Scratch(documents.sparkSession, "repeats")
    # 128 bits: a collision would cut a text by another one's spans
    keyed = documents.withColumns({_KEY: F.xxhash64(id_column, text_column), _KEY2: F.xxhash64(F.lit(_KEY2), text_column, id_column)})
    ranges = scratch.table(repeated_ranges(keyed.select(_KEY, _KEY2, F.col(text_column).alias("text")), scratch, window, anchor))
    ranges = ranges.withColumnsRenamed({"key": _KEY, "key2": _KEY2})
    bits = build_sieve(ranges.select(_KEY), _KEY)
    columns = [*documents.columns, "ranges"]
    joined = keyed.where(passing(bits, F.col(_KEY))).join(ranges, [_KEY, _KEY2], "left").select(columns)
    others = keyed.withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType)).select(*columns, _KEY)
    fields = [*documents.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
    at = documents.columns.index(text_column)

    def cut(batches):
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for a, b, texts in sliced(whole.column(at)):
                ranges = whole.column(len(fields) - 3).slice(a, b - a).to_pylist()
                batch, removed, spans = Batch(texts), np.zeros(b - a, np.int64), []
                for i in range(b - a):
                    own = merged(ranges[i] or [], window)
                    spans.append([{"begin": x, "end": y} for x, y in own])
                    if own:
                        first = batch.first[batch.starts[i] : batch.ends[i]] - batch.bytes_before[i]
                        keep, begin = [], 0
                        for x, y in own:
                            keep.append(texts[i][begin : first[x]])
                            begin = first[y] if y < len(first) else len(texts[i])
                            removed[i] += y - x
                        tail = texts[i][begin:]
                        texts[i] = b"".join([*keep, tail]) if tail else b"".join(keep).rstrip(b" \t\n\v\f\r")
                part = whole.slice(a, b - a)
                columns = [pa.array(texts, pa.binary()).cast(part.column(k).type) if k == at else part.column(k) for k in range(len(fields) - 3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(batch.counts), pa.array(removed), pa.array(spans, spans_type)], names=[f.name for f in fields])

    def untouched(batches):
        import pyarrow as pa

        sieve, width = Sieve(bits.value), len(columns)

        def rest():
            for batch in batches:
                keep = ~sieve.passes(batch.column(width).to_numpy(zero_copy_only=False).view(np.uint64))
                yield pa.RecordBatch.from_arrays(batch.columns[:width], names=columns).filter(pa.array(keep))

        return cut(rest())

    # one Python worker for a task in either branch
    return joined.mapInArrow(cut, T.StructType(fields)).union(others.mapInArrow(untouched, T.StructType(fields)))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: words covered by a 35-word window that also starts elsewhere are removed."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return remove_repeats(documents).select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


#: Exact in SQL, with windows as lists of words; sound for the small tables of the correctness check.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
w AS (SELECT s.r, s.i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM s JOIN d USING (r)),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) >= 2),
g AS (SELECT DISTINCT r, i + o AS p FROM w SEMI JOIN t USING (h), (SELECT unnest(range(0, 35)) AS o)),
c AS (SELECT r, list(p) AS ps FROM g GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(coalesce(ps, []), x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""
