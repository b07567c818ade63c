"""Language identification with interpolated Kneser-Ney character models.

A word is a run of letters, lower-cased, between start and end marks; the models never
look across words.  For each order the seen n-grams of all languages form one sorted array
of hashes, and their contexts another, so that one search serves every language; beside
each hash lie the discounted shares, or weights, of those languages only that have it
(``SparseRows``), so the model grows with what its languages hold and not with their number
times all n-grams.  A document goes to the language of the least cross-entropy per character.

Training takes at most ``per_language`` labelled rows for each language, in expectation,
by a hash of their ids (whole texts; the bound is on rows).  Languages are the labels with
``min_rows`` labelled rows or more, the ``most_languages`` most frequent ones (``MIN_ROWS``
and ``MOST_LANGUAGES`` unless told otherwise), so that the fit stays bounded whatever the
labels are.  N-grams are counted by Spark; what reaches
the driver is the model.  A fifth of the sample is left out of the counts to
calibrate rejection.  A document's cross-entropy is measured in deviations above the
median of its language, where the deviation has a part between documents and a part that
shrinks with the length.  A document is rejected when that exceeds ``REJECT_Z`` and
``REJECT_MARGIN`` times the ``REJECT_SHARE`` quantile of the language's calibration rows.
Rows that another language's model scores better than their label are left out, and every
figure is a median or a quantile with rows beyond it, so that no single mixed or
mislabelled row sets a limit and limits do not loosen as the sample grows.  Rare texts of
several languages may be rejected.

Defined results: null, empty and letterless texts are ``und`` with score 0 and rejected;
rows without id are predicted but never learned from; ties go to the first language in
order; without any learnable row every text is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.scratch import Scratch, bound_batches
from pagemill.llm.words import RunHashes, mix64, sliced

ORDER, PER_LANGUAGE = 4, 4000
#: Least labelled rows of a language that is learned, and most languages: the most frequent ones.
MIN_ROWS, MOST_LANGUAGES = 10, 64
#: Least limit of rejection in deviations, and how far beyond which quantile of the calibration rows it lies.
REJECT_Z, REJECT_MARGIN, REJECT_SHARE = 8.0, 1.25, 0.99
#: Calibration rows from which the quantile has several rows beyond it, and from which a median of deviations holds.
_QUANTILE_ROWS, _MEDIAN_ROWS = 300, 5
_START, _END = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
#: Words kept, and scored at once.
_CACHE_LIMIT, _AT_ONCE = 100_000, 5_000
#: Characters beyond which more text adds no confidence.
_CONFIDENT = 60


def letters(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _codes(padded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "".join(padded)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return mix64(codes.astype(np.uint64) + np.uint64(1)), np.fromiter(map(len, padded), np.int64, len(padded))


class SparseRows:
    """Rows with a value for some languages each, and one default for the others.

    Where a matrix has at most ``FILL`` cells for each value, it is one: as few languages
    share most of their n-grams, that costs little memory and saves looking values up.
    """

    FILL = 5

    def __init__(self, place: np.ndarray, language: np.ndarray, value: np.ndarray, rows: int, default: float, languages: int) -> None:
        order = np.lexsort((language, place))
        self.language, self.value, self.default = language[order].astype(np.int32), value[order].astype(np.float32), default
        self.begin = np.searchsorted(place[order], np.arange(rows + 1))
        self.matrix = None
        if rows * languages <= self.FILL * len(value):
            self.matrix = self.at(np.arange(rows + 1), languages)
            self.language, self.value = self.language[:0], self.value[:0]

    def at(self, rows: np.ndarray, languages: int) -> np.ndarray:
        """Rows as a matrix; the one after the last holds nothing but the default."""
        if self.matrix is not None:
            return self.matrix[rows]
        out = np.full((len(rows), languages), self.default, np.float32)
        known = rows < len(self.begin) - 1
        first = np.where(known, self.begin[np.where(known, rows, 0)], 0)
        n = np.where(known, self.begin[np.where(known, rows, 0) + 1] - first, 0) if len(self.begin) > 1 else np.zeros(len(rows), np.int64)
        flat = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(rows)), n), self.language[flat]] = self.value[flat]
        return out

    @property
    def nbytes(self) -> int:
        return self.language.nbytes + self.value.nbytes + self.begin.nbytes + (0 if self.matrix is None else self.matrix.nbytes)


class Model:
    """Sorted hash arrays of one interpolated Kneser-Ney model for each language."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER) -> None:
        self.languages, self.order = sorted(counts), order
        grams = [{g: c for g, c in counts[x].items()} for x in self.languages]
        self.vocabulary = len({g[-1] for own in grams for g in own}) + 1
        self.sparse: list[tuple] = []
        per_order: list[list[dict[str, int]]] = [grams]
        for _ in range(order - 1):
            lower = []
            for own in per_order[-1]:
                types: dict[str, int] = {}
                for g in own:
                    types[g[1:]] = types.get(g[1:], 0) + 1
                lower.append(types)
            per_order.append(lower)
        for n, level in enumerate(reversed(per_order), 1):
            self.sparse.append(self._level(n, level))
        self.mean = np.zeros(len(self.languages))
        self.between, self.within = np.full(len(self.languages), 0.05), np.full(len(self.languages), 4.0)
        self.limit = np.full(len(self.languages), REJECT_Z)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for level in self.sparse for x in level)

    @property
    def levels(self) -> list[tuple]:
        """The same with whole matrices, to look at."""
        whole = lambda x: x.at(np.arange(len(x.begin)), len(self.languages))
        return [(grams, whole(share), contexts, whole(weight)) for grams, share, contexts, weight in self.sparse]

    def z(self, entropy: np.ndarray, size: np.ndarray, language) -> np.ndarray:
        """How many deviations above its language's mean a document's cross-entropy lies."""
        return (entropy - self.mean[language]) / np.sqrt(self.between[language] ** 2 + self.within[language] / np.maximum(size, 1))

    @staticmethod
    def _hash(strings: list[str], n: int) -> np.ndarray:
        codes, _ = _codes(strings)
        return RunHashes(codes).all(n)[::n] if strings and n else np.zeros(len(strings), np.uint64)

    def _level(self, n: int, level: list[dict[str, int]]):
        names = sorted(set().union(*level))
        contexts = sorted({g[:-1] for g in names})
        gram_at, context_at = {g: i for i, g in enumerate(names)}, {h: i for i, h in enumerate(contexts)}
        shares, weights = [], []
        for k, own in enumerate(level):
            if not own:
                continue
            ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
            discount = ones / (ones + 2 * twos) if ones and twos else 0.75
            row, place, value = np.array([context_at[g[:-1]] for g in own]), np.array([gram_at[g] for g in own]), np.array(list(own.values()), float)
            seen, of, types = np.unique(row, return_inverse=True, return_counts=True)
            total = np.bincount(of.reshape(-1), value)
            shares.append((place, np.full(len(place), k), np.maximum(value - discount, 0) / total[of.reshape(-1)]))
            weights.append((seen, np.full(len(seen), k), discount * types / total))
        gram_hash, context_hash = self._hash(names, n), self._hash(contexts, n - 1)
        a, b = np.argsort(gram_hash), np.argsort(context_hash)

        def rows(parts: list, order: np.ndarray, default: float) -> SparseRows:
            to = np.empty(len(order), np.int64)
            to[order] = np.arange(len(order))
            place, language, value = (np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64) for x in range(3))
            return SparseRows(to[place] if len(place) else place, language, value, len(order), default, len(self.languages))

        return gram_hash[a], rows(shares, a, 0.0), context_hash[b], rows(weights, b, 1.0)

    @staticmethod
    def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_hashes, wanted)
        at[at == len(sorted_hashes)] = 0
        return np.where(sorted_hashes[at] == wanted, at, len(sorted_hashes)) if len(sorted_hashes) else np.zeros(len(wanted), np.int64)

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word and language the sum of -log p and of its squares; characters with the end mark."""
        pad = self.order - 1
        codes, sizes = _codes([_START * pad + w + _END for w in words])
        n = sizes - pad
        begins = np.cumsum(n) - n
        at = np.repeat(np.cumsum(sizes) - sizes + pad - begins, n) + np.arange(n.sum())
        runs = RunHashes(codes)
        p = np.full((len(at), len(self.languages)), 1 / self.vocabulary)
        for k, (gram_hash, share, context_hash, weight) in enumerate(self.sparse, 1):
            context = self._find(context_hash, runs.at(at - k + 1, at)) if k > 1 else np.zeros(len(at), np.int64)
            p = share.at(self._find(gram_hash, runs.at(at - k + 1, at + 1)), len(self.languages)) + weight.at(context, len(self.languages)) * p
        loss = -np.log(p)
        return np.add.reduceat(loss, begins), np.add.reduceat(loss * loss, begins), n


class Scorer:
    """Scores documents word by word; words are looked up in a bounded store of earlier ones."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows = model, {}
        self.loss = self.square = np.zeros((0, len(model.languages)))
        self.size = np.zeros(0, np.int64)

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, mean of squared losses, characters (0 without letters)."""
        words = [letters(t) for t in texts]
        if len(self.rows) > _CACHE_LIMIT:
            self.__init__(self.model)
        new = list({w for ws in words for w in ws if w not in self.rows})
        for x in range(0, len(new), _AT_ONCE):
            part = new[x : x + _AT_ONCE]
            loss, square, size = self.model.score(part)
            self.rows.update(zip(part, range(len(self.rows), len(self.rows) + len(part)), strict=True))
            self.loss, self.square, self.size = np.vstack([self.loss, loss]), np.vstack([self.square, square]), np.append(self.size, size)
        counts = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((self.rows[w] for ws in words for w in ws), np.int64, int(counts.sum()))
        begins, full = np.cumsum(counts) - counts, counts > 0
        loss, square, size = (np.zeros((len(texts), *x.shape[1:])) for x in (self.loss, self.square, self.size))
        if full.any():
            for out, source in ((loss, self.loss), (square, self.square), (size, self.size)):
                out[full] = np.add.reduceat(source[at], begins[full])
        with np.errstate(invalid="ignore", divide="ignore"):
            return loss / size[:, None], square / size[:, None], size


def fold(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5


def _grams(order: int):
    def count(batches):
        import pyarrow as pa

        for batch in batches:
            words: dict[str, Counter] = {}
            for x, y, texts in sliced(batch.column(1)):
                for lang, text in zip(batch.column(0).slice(x, y - x).to_pylist(), texts, strict=True):
                    words.setdefault(lang, Counter()).update(letters(text and text.decode()))
            out: dict[tuple[str, str], int] = {}
            for lang, own in words.items():
                for w, n in own.items():
                    padded = _START * (order - 1) + w + _END
                    for i in range(len(padded) - order + 1):
                        key = (lang, padded[i : i + order])
                        out[key] = out.get(key, 0) + n
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in out], pa.string()), "gram": pa.array([k[1] for k in out], pa.string()), "n": pa.array(list(out.values()), pa.int64())})

    return count


def train(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", per_language: int = PER_LANGUAGE, order: int = ORDER, min_rows: int = MIN_ROWS, most_languages: int = MOST_LANGUAGES) -> Model | None:
    """Fits on the rows of ``labelled`` with text, language and id; None if no language has enough of them.

    The sample holds ``per_language`` rows of each of at most ``most_languages`` labels, those
    with the most rows, of at least ``min_rows``.
    """
    spark = labelled.sparkSession
    scratch = Scratch(spark, "language")
    named = labelled.where(F.col(lang_column).isNotNull() & F.col(id_column).isNotNull())
    # counts do not read the texts: rows without one only lower the rate
    counts = named.groupBy(F.col(lang_column).alias("lang")).agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    rates = scratch.table(counts.orderBy(F.desc("n"), "lang").limit(most_languages).select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), per_language / F.col("n")).alias("_rate")))
    if rates.isEmpty():
        return None
    draw = F.pmod(F.xxhash64(id_column, F.lit("train")), F.lit(1 << 20)) / F.lit(1 << 20)
    spare = F.pmod(F.xxhash64(id_column, F.lit("calibrate")), F.lit(5)) == 0
    # at most most_languages rows are broadcast
    drawn = named.where(F.col(text_column).isNotNull()).join(F.broadcast(rates), F.col(lang_column) == F.col("_lang")).where(draw < F.col("_rate"))
    sample = drawn.select(F.col("_lang").alias("lang"), F.col(text_column).alias("text"), spare.alias("spare"))
    sample = scratch.table(sample)
    rows = sample.where("not spare").select("lang", "text").mapInArrow(_grams(order), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    grams = {lang: dict(zip(own["gram"], own["n"].astype(int), strict=True)) for lang, own in rows.groupby("lang")}
    if not grams:
        return None
    model = Model(grams, order)
    shared, languages = spark.sparkContext.broadcast(model), model.languages

    def losses(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        for batch in batches:
            for x, y, texts in sliced(batch.column(1)):
                lang = batch.column(0).slice(x, y - x).to_pylist()
                entropy, square, size = scorer.documents([t and t.decode() for t in texts])
                at = np.array([languages.index(x) if x in languages else -1 for x in lang])
                pick = np.flatnonzero((size >= 40) & (at >= 0))
                mean = entropy[pick, at[pick]]
                agrees = mean <= entropy[pick].min(axis=1)
                yield pa.RecordBatch.from_pydict({"k": at[pick].astype(np.int32), "mean": mean, "within": square[pick, at[pick]] - mean**2, "n": size[pick], "agrees": agrees})

    spread = sample.where("spare").select("lang", "text").mapInArrow(losses, "k int, mean double, within double, n double, agrees boolean").toPandas()
    for k, own in spread.groupby("k"):
        calibrate(model, k, own[own["agrees"]] if own["agrees"].any() else own)
    return model


def calibrate(model: Model, k: int, rows) -> None:
    """Sets the deviations and the limit of language ``k`` by its calibration rows (mean, within, n)."""
    # medians: a few mislabelled or garbled rows do not move them
    model.mean[k], model.within[k] = rows["mean"].median(), max(rows["within"].median(), 0.5)
    long = rows[rows["n"] >= 400]
    model.between[k] = max(1.4826 * (long["mean"] - model.mean[k]).abs().median(), 0.02) if len(long) >= _MEDIAN_ROWS else 0.05
    model.limit[k] = REJECT_Z
    if len(rows) >= _QUANTILE_ROWS:
        model.limit[k] = max(REJECT_Z, REJECT_MARGIN * np.quantile(model.z(rows["mean"].to_numpy(), rows["n"].to_numpy(), k), REJECT_SHARE, method="lower"))


def identify(documents: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``documents`` with lang_pred, score, cross_entropy and rejected; columns of those names are replaced."""
    bound_batches(documents.sparkSession)
    documents = documents.drop("lang_pred", "score", "cross_entropy", "rejected")
    if model is None:
        return documents.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)})
    shared, at, width = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index(text_column), len(documents.columns)
    names = [*documents.columns, "lang_pred", "score", "cross_entropy", "rejected"]

    def predict(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        own = shared.value
        for whole in batches:
            for x, y, texts in sliced(whole.column(at)):
                part = whole.slice(x, y - x)
                entropy, _, size = scorer.documents([t and t.decode() for t in texts])
                some = size > 0
                best = np.where(some, np.argmin(np.where(some[:, None], entropy, 0), axis=1), 0)
                least = entropy[np.arange(len(best)), best]
                gap = np.where(some[:, None], entropy - least[:, None], 0) * np.minimum(size, _CONFIDENT)[:, None]
                score = np.where(some, 1 / np.exp(-gap).sum(axis=1), 0.0)
                z = own.z(least, size, best)
                lang = [own.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
                rejected = ~some | (np.where(some, z, 0) > own.limit[best])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(width)), pa.array(lang, pa.string()), pa.array(score), pa.array(least, mask=~some), pa.array(rejected)], names=names)

    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType())]
    return documents.mapInArrow(predict, T.StructType([*documents.schema.fields, *(T.StructField(*x) for x in added)]))


def fit_and_identify(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", **bounds: int) -> DataFrame:
    """Learns from the folds that are not held out, predicts every row; adds held_out too.  ``bounds`` are those of ``train``."""
    documents = documents.drop("held_out")
    learn = documents.where(fold(id_column) != 0)
    out = identify(documents, train(learn, id_column, text_column, lang_column, **bounds), text_column)
    return out.withColumn("held_out", F.coalesce(fold(id_column) == 0, F.lit(False)))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract query over all ``documents``."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return fit_and_identify(documents).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
