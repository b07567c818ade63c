"""Quality rules: counts over words and lines, and tokeniser fertility against bands.

Fertility is measured with two public vocabularies: sentencepiece pieces that fall back to
bytes, and byte pairs.  Every distinct word (with its leading space) is encoded once for
each task and kept in a bounded store; a document's tokens are those of its words.  Three
measures result for each vocabulary: characters per token, the share of byte-fallback
tokens (of byte pairs: those that are no whole characters), and the entropy of the token
distribution in bits.  A document is rejected when a measure of either vocabulary leaves
the bands of its language; without a known language the bands of its main script hold.
The files are read once by the driver, which sends them along: they are of fixed size.

Bands come from the documents themselves.  Of every language and of every script, and of
every class of length in them (powers of two tokens, as short texts spread more and cannot
reach the entropy of long ones), the 5% and 95% quantiles over all documents that pass the
base rules are widened by a ``MARGINS`` part of the median (for byte shares, of 1).  A band
of n rows counts n to ``SHRINK_ROWS`` against the next wider one: class against language or
script, language against its fixed ``BANDS`` or, without such, the script, script against
its fixed bands.  So no number of rows switches a rule, and a rare language is judged as its
script is.  Bands of the first vocabulary never pass the fixed ones.

Base rules: at least 50 words, and at most half of the words in repeated 3-word windows.

Measures of a document are computed in its own row.  Quantiles are exact over rounded
measures, from counts by group and value, so only counts are shuffled, nothing but the
vocabularies passes through the driver, any number of languages is allowed, and reruns agree.

Defined results: null, empty and blank texts have zero counts, null measures, and fail the
base rules; a language that is null is judged by its script; lines are parts between \\n, and a repeated line counts only if it has a word;
equal rows are judged alike; a word beyond ``LONGEST`` bytes is encoded in parts, so that
very long ones take no more time than others.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.counts import PATTERN
from pagemill.llm.scratch import Scratch, bound_batches
from pagemill.llm.words import Batch, RunHashes, mix64, sliced

VOCABULARY, RANKS = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONGEST = 1000
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: (least, most) characters per token; most byte-fallback share; least entropy in bits.
#: By language, else by script: outer bounds of the bands that documents yield.
BANDS = {
    # random letters show 1.5 to 1.6 characters per token
    "en": (1.6, 6.5, 0.20, 3.0), "de": (1.6, 6.5, 0.20, 3.0), "es": (1.6, 6.5, 0.20, 3.0), "fr": (1.6, 6.5, 0.20, 3.0),
    "latin": (1.2, 7.0, 0.30, 3.0), "cyrillic": (0.9, 6.0, 0.30, 3.0), "greek": (0.6, 5.0, 0.50, 3.0),
    # text in bytes alone shows 0.8 and more, as words have a space mark
    "other": (0.2, 7.0, 0.75, 3.0),
}
#: Widths beyond the 5% and 95% quantiles, as parts of the median or, for byte shares, of 1.
MARGINS = {"chars_per_token": 0.10, "byte_share": 0.10, "token_entropy": 0.15}
#: Rows against which a band's own rows count; classes of length by the logarithm of tokens.
SHRINK_ROWS, CLASSES = 50, (5, 14)
#: Outer bounds of the second vocabulary, for every group.
WIDE = (0.2, 8.0, 1.0, 0.0)
_MEASURES = {"chars_per_token": 100, "byte_share": 1000, "token_entropy": 100}
#: Suffixes of the measures by vocabulary.
_KINDS = ("", "_bpe")
_STORE_LIMIT = 500_000
_ADDED = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), *((f"{m}{k}", T.DoubleType()) for k in _KINDS for m in _MEASURES), ("kept", T.BooleanType())]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


class Pieces:
    """A sentencepiece vocabulary from the contents of its file."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(self.pieces.get_piece_size())])

    def encode(self, words: list[str]) -> list[list[int]]:
        return self.pieces.encode(words, num_threads=1)


class BytePairs:
    """A byte-level vocabulary from the contents of its ranks file."""

    def __init__(self, ranks: bytes) -> None:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        # a word is one piece: it holds no white space
        self.encoding = tiktoken.Encoding("quality", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.is_byte = np.zeros(max(table.values()) + 1, bool)
        for token, rank in table.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.is_byte[rank] = True

    def encode(self, words: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(f" {w}") for w in words]  # its batches take a thread a word


class Fertility:
    """Tokens of words, from a store that is emptied when it grows past a bound."""

    def __init__(self, vocabulary) -> None:
        self.vocabulary, self.is_byte = vocabulary, vocabulary.is_byte
        self._empty()

    def _encoded(self, words: list[str]) -> list[list[int]]:
        long = [i for i, w in enumerate(words) if len(w) > LONGEST]
        ids = self.vocabulary.encode([w[:LONGEST] for w in words])
        for i in long:
            w = words[i]
            ids[i] = [t for own in self.vocabulary.encode([w[x : x + LONGEST] for x in range(0, len(w), LONGEST)]) for t in own]
        return ids

    def _empty(self) -> None:
        self.at: dict[int, int] = {}
        self.begin, self.count, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def rows_of(self, hashes: np.ndarray, word_at) -> np.ndarray:
        """Store rows of distinct word hashes; ``word_at(i)`` gives the i-th word."""
        if len(self.at) > _STORE_LIMIT:
            self._empty()
        keys = hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            ids = self._encoded([word_at(i).decode("utf-8", "replace") for i in new])
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            known = len(self.at)
            self.at.update((keys[i], known + n) for n, i in enumerate(new))
            self.begin = np.append(self.begin, len(self.tokens) + np.cumsum(count) - count)
            self.count = np.append(self.count, count)
            self.tokens = np.append(self.tokens, np.fromiter((t for own in ids for t in own), np.int32, int(count.sum())))
        return np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))

    def measure(self, batch: Batch, data: bytes, words: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, byte tokens and token entropy of each document; ``words`` is ``distinct_words`` of the batch."""
        n = len(batch.counts)
        distinct, example, document, word, times = words or distinct_words(batch)
        rows = self.rows_of(distinct, lambda i: data[batch.first[example[i]] : batch.last[example[i]]])
        row = rows[word]
        count = self.count[row]
        at = np.repeat(self.begin[row] - np.cumsum(count) + count, count) + np.arange(count.sum())
        token, weight, owner = self.tokens[at], np.repeat(times, count), np.repeat(document, count)
        total = np.bincount(owner, weight, n)
        fallback = np.bincount(owner, weight * self.is_byte[token], n)
        order = np.argsort(owner * len(self.is_byte) + token, kind="stable")
        key, w = (owner * len(self.is_byte) + token)[order], weight[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        share = np.add.reduceat(w, new) if len(new) else w.astype(float)
        own = owner[order][new]
        p = share / total[own]
        return total, fallback, np.bincount(own, -p * np.log2(p), n)


def distinct_words(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words with a place of each, and how often each document has each of its words."""
    distinct, example, which = np.unique(batch.hashes, return_index=True, return_inverse=True)
    n = max(1, len(distinct))
    pair, times = np.unique(batch.document_of() * n + which.reshape(-1), return_counts=True)
    return distinct, example, pair // n, pair % n, times


def repeated_words(batch: Batch, size: int = 3) -> np.ndarray:
    """Words of each document in windows of ``size`` words that occur in it twice or more."""
    document = batch.document_of()
    at = np.arange(max(0, len(document) - size + 1))
    at = at[document[at] == document[at + size - 1]] if len(at) else at
    with np.errstate(over="ignore"):
        h = RunHashes(batch.hashes).at(at, at + size) + mix64(document[at].astype(np.uint64))
    _, which, times = np.unique(h, return_inverse=True, return_counts=True)
    covered = np.zeros(len(document), bool)
    for k in range(size):
        covered[at[times[which] > 1] + k] = True
    return np.bincount(document[covered], minlength=len(batch.counts))


def repeated_lines(text: bytes | None) -> int:
    if not text or b"\n" not in text:
        return 0
    seen, out = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            out += bool(line.strip(b" \t\n\v\f\r"))
        else:
            seen.add(line)
    return out


def script_of(text: bytes | None) -> str:
    """The main script among letters that UTF-8 tells apart by their first byte."""
    data = np.frombuffer(text or b"", np.uint8)
    latin = ((data >= 65) & (data <= 122)).sum() + ((data >= 0xC3) & (data <= 0xC9)).sum()
    greek, cyrillic = ((data == 0xCE) | (data == 0xCF)).sum(), ((data >= 0xD0) & (data <= 0xD3)).sum()
    other = (data >= 0xD4).sum()
    return max((("latin", latin), ("greek", greek), ("cyrillic", cyrillic), ("other", other)), key=lambda x: x[1])[0]


def measure(documents: DataFrame, text_column: str = "text", vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """``documents`` with counts, measures, ``base_failed`` and ``_script``; columns of those names are replaced."""
    bound_batches(documents.sparkSession)
    documents = documents.drop("_script", *(name for name, _ in _ADDED))
    at, width = documents.columns.index(text_column), len(documents.columns)
    fields = [*documents.schema.fields, *(T.StructField(*x) for x in _ADDED[:-1]), T.StructField("_script", T.StringType())]
    files = documents.sparkSession.sparkContext.broadcast((Path(vocabulary).read_bytes(), Path(ranks).read_bytes()))

    def rows(batches):
        import pyarrow as pa

        fertility = [Fertility(kind(own)) for kind, own in zip((Pieces, BytePairs), files.value, strict=True)]
        for whole in batches:
            for x, y, texts in sliced(whole.column(at)):
                part = whole.slice(x, y - x)
                batch, data = Batch(texts), b"\n".join(t or b"" for t in texts) + b"\n"
                raw = np.frombuffer(data, np.uint8)
                ends = np.append(batch.bytes_before[1:], len(raw))
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
                characters = np.concatenate([[0], np.cumsum(_STARTS_CHARACTER[raw])])
                in_words = np.concatenate([[0], np.cumsum(characters[batch.last] - characters[batch.first])])
                word_chars = in_words[batch.ends] - in_words[batch.starts]
                n, repeated = batch.counts, repeated_words(batch)
                failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
                measured, words = [], distinct_words(batch)
                for own in fertility:
                    total, fallback, entropy = own.measure(batch, data, words)
                    measured += [pa.array(c, mask=total == 0) for c in (word_chars / np.maximum(total, 1), fallback / np.maximum(total, 1), entropy)]
                columns = [n, word_chars, symbols[ends] - symbols[batch.bytes_before], np.fromiter(map(repeated_lines, texts), np.int64, y - x), repeated]
                yield pa.RecordBatch.from_arrays([
                    *(part.column(k) for k in range(width)), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed),
                    *measured, pa.array([script_of(t) for t in texts], pa.string()),
                ], names=[f.name for f in fields])

    return documents.mapInArrow(rows, T.StructType(fields))


_EDGES = ("low", "high", "share", "entropy")


def _edges(counts: DataFrame, *keys: str) -> DataFrame:
    """Bands of each group of ``keys`` (one struct for each vocabulary) and its rows, from (keys, measure, value, n)."""
    own = counts.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    by = W.partitionBy(*keys, "measure")
    placed = own.withColumns({"upto": F.sum("n").over(by.orderBy("value")), "total": F.sum("n").over(by)})
    at = lambda m, q: F.min(F.when((F.col("measure") == m) & (F.col("upto") >= q * F.col("total")), F.col("value")))
    quantiles = {f"{m}{k}_{int(100 * q)}": at(f"{m}{k}", q) / steps for k in _KINDS for m, steps in _MEASURES.items() for q in (0.05, 0.5, 0.95)}
    found = placed.groupBy(*keys).agg(F.max(F.when(F.col("measure") == "byte_share", F.col("total"))).alias("rows"), *(v.alias(n) for n, v in quantiles.items()))

    def band(k: str) -> Column:
        value, wide = (lambda m, q: F.col(f"{m}{k}_{q}")), (lambda m: MARGINS[m] * F.col(f"{m}{k}_50"))
        edges = (value("chars_per_token", 5) - wide("chars_per_token"), value("chars_per_token", 95) + wide("chars_per_token"), value("byte_share", 95) + MARGINS["byte_share"], value("token_entropy", 5) - wide("token_entropy"))
        return F.struct(*(e.alias(n) for e, n in zip(edges, _EDGES, strict=True))).alias(f"band{k}")

    return found.select(*keys, "rows", *(band(k) for k in _KINDS))


def _constant(edges: tuple) -> Column:
    return F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(edges, _EDGES, strict=True)))


def _blend(own: Column, rows: Column, target: Column) -> Column:
    """``own`` as far as its rows tell, else ``target``."""
    n = F.coalesce(rows, F.lit(0)).cast("double")
    return F.struct(*(F.when(n > 0, (n * own[e] + SHRINK_ROWS * target[e]) / (n + SHRINK_ROWS)).otherwise(target[e]).alias(e) for e in _EDGES))


def _within(band: Column, outer: Column) -> Column:
    return F.struct(F.greatest(band["low"], outer["low"]).alias("low"), F.least(band["high"], outer["high"]).alias("high"), F.least(band["share"], outer["share"]).alias("share"), F.greatest(band["entropy"], outer["entropy"]).alias("entropy"))


def length_class() -> Column:
    tokens = F.col("word_chars") / F.col("chars_per_token")
    return F.least(F.greatest(F.floor(F.log2(tokens)).cast("int"), F.lit(CLASSES[0])), F.lit(CLASSES[1]))


def fit_bands(measured: DataFrame, lang_column: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Bands by (language, class) and by (script, class), beside those of the whole language or script, from all rows that pass the base rules."""
    scratch = Scratch(measured.sparkSession, "quality")
    some = measured.where(F.expr("not base_failed and token_entropy is not null and token_entropy_bpe is not null"))
    values = F.array(*(F.struct(F.lit(f"{m}{k}").alias("measure"), F.least(F.round(F.col(f"{m}{k}") * steps), F.lit(100_000)).cast("long").alias("value")) for k in _KINDS for m, steps in _MEASURES.items()))
    counts = some.select(F.col(lang_column).cast("string").alias("_lang"), "_script", length_class().alias("_class"), F.explode(values).alias("v"))
    counts = scratch.table(counts.groupBy("_lang", "_script", "_class", "v.measure", "v.value").agg(F.count("*").alias("n")))
    out = []
    for key in ("_lang", "_script"):
        own, whole = _edges(counts.where(F.col(key).isNotNull()), key, "_class"), _edges(counts.where(F.col(key).isNotNull()), key)
        names = lambda end: {c: f"{key}_{c}{end}" for c in ("rows", *(f"band{k}" for k in _KINDS))}
        out.append(scratch.table(own.withColumnsRenamed(names("_class")).join(whole.withColumnsRenamed(names("")), key)))
    return out[0], out[1]


def judge(documents: DataFrame, text_column: str = "text", lang_column: str = "lang", vocabulary: str = VOCABULARY, ranks: str = RANKS, bands: dict = BANDS, with_text: bool = True) -> DataFrame:
    """``documents`` with counts, measures, ``base_failed`` and ``kept``; columns of those names are replaced."""
    measured = measure(documents, text_column, vocabulary, ranks)
    measured = Scratch(documents.sparkSession, "measured").table(measured if with_text else measured.drop(text_column))
    by_lang, by_script = fit_bands(measured, lang_column)
    scripts = ("latin", "cyrillic", "greek", "other")
    keyed = measured.withColumns({"_lang": F.col(lang_column).cast("string"), "_class": F.when(~F.col("base_failed"), length_class())})
    joined = keyed.join(by_lang, ["_lang", "_class"], "left").join(by_script, ["_script", "_class"], "left")
    inside = F.lit(True)
    for k in _KINDS:
        outer = F.lit(None)
        for name in scripts:
            outer = F.when(F.col("_script") == name, _constant(WIDE if k else bands[name])).otherwise(outer)
        fixed = F.lit(None).cast("struct<low:double,high:double,share:double,entropy:double>")
        for name in () if k else sorted(set(bands) - set(scripts)):
            fixed = F.when(F.col("_lang") == name, _constant(bands[name])).otherwise(fixed)

        def fitted(key: str, outer: Column, k: str = k) -> Column:
            whole = _within(_blend(F.col(f"{key}_band{k}"), F.col(f"{key}_rows"), outer), outer)
            return _within(_blend(F.col(f"{key}_band{k}_class"), F.col(f"{key}_rows_class"), whole), outer)

        joined = joined.withColumns({"_outer": outer, "_fixed": fixed})
        joined = joined.withColumn("_of_script", fitted("_script", F.col("_outer")))
        # without fixed bands a language starts from its script's, and may pass them as far as its rows tell
        free = _blend(F.col(f"_lang_band{k}_class"), F.col("_lang_rows_class"), _blend(F.col(f"_lang_band{k}"), F.col("_lang_rows"), F.col("_of_script")))
        joined = joined.withColumn("_band", F.when(F.col("_lang").isNull(), F.col("_of_script")).when(F.col("_fixed").isNotNull(), fitted("_lang", F.col("_fixed"))).otherwise(_within(free, F.col("_outer"))))
        own = F.col(f"chars_per_token{k}").between(F.col("_band.low"), F.col("_band.high")) & (F.col(f"byte_share{k}") <= F.col("_band.share")) & (F.col(f"token_entropy{k}") >= F.col("_band.entropy"))
        joined = joined.withColumn(f"_inside{k}", own)
        inside = inside & F.col(f"_inside{k}")
    return joined.withColumn("kept", F.coalesce(~F.col("base_failed") & inside, F.lit(False))).select(*(c for c in measured.columns if c != "_script"), "kept")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract query over all ``documents``."""
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), with_text=False)
    return out.select("doc_id", *(name for name, _ in _ADDED))
