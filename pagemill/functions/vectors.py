"""Vectors as arrays, and encoders that turn texts into them.

An encoder called with a text column gives a column of unit vectors.  Inside a task it
also compares the two sides of word boundaries (``sides``), which for encoders that add up
words needs no context as a text at all.  ``hashing`` needs nothing but the text;
``sentence_model`` loads a model once for each worker, where that library is installed;
vectors computed elsewhere are joined by key instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[Column], Column]


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    length = F.when(norm(a) == 0, 1.0).otherwise(norm(a))
    return F.transform(a, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    one = lambda v: F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return dot(a, b) / (one(a) * one(b))


def row_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of equal rows; a zero vector counts as of length 1."""
    length = lambda x: np.where((n := np.sqrt((x * x).sum(axis=1))) == 0, 1.0, n)
    return (a * b).sum(axis=1) / (length(a) * length(b))


class TextEncoder:
    """Texts to vectors by ``encode``; everything else follows from it."""

    #: Boundaries that are compared at a time.
    boundaries_at_once = 2048

    def encode(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def sides(self, text: str, starts: np.ndarray, ends: np.ndarray, boundaries: np.ndarray, width: int) -> np.ndarray:
        """Likeness of up to ``width`` words before and from each boundary, given where words begin and end."""
        out = np.empty(len(boundaries))
        for a in range(0, len(boundaries), self.boundaries_at_once):
            part = boundaries[a : a + self.boundaries_at_once]
            first, last = np.maximum(0, part - width), np.minimum(len(starts), part + width) - 1
            left = [text[x:y] for x, y in zip(starts[first].tolist(), ends[part - 1].tolist(), strict=True)]
            right = [text[x:y] for x, y in zip(starts[part].tolist(), ends[last].tolist(), strict=True)]
            both = np.asarray(self.encode(left + right), np.float64)
            out[a : a + len(part)] = row_cosines(both[: len(part)], both[len(part) :])
        return out

    def __call__(self, column: Column) -> Column:
        @F.pandas_udf("array<double>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(list(np.asarray(self.encode(texts.fillna("").tolist()), np.float64)))

        return vectors(column)


class HashingEncoder(TextEncoder):
    """Counts of words in md5 buckets, at unit length."""

    boundaries_at_once = 4096

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions, self._buckets = dimensions, {}

    def __reduce__(self):
        return HashingEncoder, (self.dimensions,)  # what a worker remembers stays there

    def buckets(self, words: list[str]) -> np.ndarray:
        import hashlib

        if len(self._buckets) > 500_000:
            self._buckets.clear()
        for word in {w for w in words if w not in self._buckets}:
            self._buckets[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16) % self.dimensions
        return np.fromiter(map(self._buckets.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            row += np.bincount(self.buckets(text.split()), minlength=self.dimensions)
            row /= np.sqrt((row * row).sum()) or 1.0
        return out

    def sides(self, text: str, starts: np.ndarray, ends: np.ndarray, boundaries: np.ndarray, width: int) -> np.ndarray:
        """Counts of both windows are differences of running counts of the buckets, a stretch of the text at a time."""
        bucket, out = self.buckets([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.empty(len(boundaries))
        for a in range(0, len(boundaries), self.boundaries_at_once):
            part = boundaries[a : a + self.boundaries_at_once]
            first, last = max(0, int(part[0]) - width), min(len(bucket), int(part[-1]) + width)
            running = np.zeros((last - first + 1, self.dimensions), np.int32)
            running[np.arange(1, last - first + 1), bucket[first:last]] = 1
            np.cumsum(running, axis=0, out=running)
            here = running[part - first]
            left, right = here - running[np.maximum(first, part - width) - first], running[np.minimum(last, part + width) - first] - here
            dots, norms = (left * right).sum(axis=1), np.sqrt((left * left).sum(axis=1)) * np.sqrt((right * right).sum(axis=1))
            out[a : a + len(part)] = dots / np.where(norms == 0, 1.0, norms)
        return out


def hashing(dimensions: int = 64) -> HashingEncoder:
    return HashingEncoder(dimensions)


_MODELS: dict[str, object] = {}


def loaded(name: str):
    """A model of this worker process, loaded by its first task and kept for the others."""
    if name not in _MODELS:
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as missing:
            raise ImportError("this encoder needs sentence-transformers on the workers") from missing
        _MODELS[name] = SentenceTransformer(name)
    return _MODELS[name]


class SentenceModel(TextEncoder):
    def __init__(self, name: str, batch_size: int) -> None:
        self.name, self.batch_size = name, batch_size

    def encode(self, texts: list[str]) -> np.ndarray:
        return loaded(self.name).encode(texts, batch_size=self.batch_size, normalize_embeddings=True, show_progress_bar=False)


def sentence_model(name: str, batch_size: int = 32) -> SentenceModel:
    """A sentence-transformers model by name or path; null texts count as empty."""
    return SentenceModel(name, batch_size)
