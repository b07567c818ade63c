"""Words of a text and 64-bit hashes of word runs, over whole Arrow batches at once.

A word is a maximal run of characters other than space and \\t \\n \\v \\f \\r, which is
what ``bytes.split()`` yields on UTF-8.  Hash arithmetic wraps modulo 2**64.
"""

from __future__ import annotations

import numpy as np

#: Odd bases of the two polynomial hashes; fixed so that reruns agree.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_codes() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[1]))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = _byte_codes()
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of a base and of its inverse, grown when a longer run of words comes."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                fill = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)])
                self.up, self.down = fill(self.base), fill(self.inverse)
        return self.up[:n], self.down[:n]


_POWERS = tuple(_Powers(b) for b in BASES)


class RunHashes:
    """Hashes of any run of words in a concatenation of documents, from prefix sums."""

    def __init__(self, hashes: np.ndarray, which: int = 0) -> None:
        up, self._down = _POWERS[which].get(len(hashes) + 1)
        self._sums = np.zeros(len(hashes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * up[:-1], out=self._sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words[start:end], mixed."""
        with np.errstate(over="ignore"):
            return mix64((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))

    def all(self, k: int) -> np.ndarray:
        """Of every run of k words, also of those that cross the end of a document."""
        if len(self._sums) <= k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix64((self._sums[k:] - self._sums[:-k]) * self._down[: len(self._sums) - k] + np.uint64(k))


class Batch:
    """The words of several texts, one after the other, found and hashed by array operations.

    Null and empty texts have no words.  ``lower`` folds A-Z only.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False) -> None:
        lengths = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
        data = np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n", np.uint8)
        inside = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.first, self.last = edge[::2], edge[1::2]  # byte offsets; the last byte is a separator
        bounds = np.cumsum(lengths)
        self.ends = np.searchsorted(self.first, bounds)
        self.starts = np.concatenate([np.zeros(1, np.int64), self.ends[:-1]]) if len(texts) else self.ends
        self.counts = self.ends - self.starts
        self.bytes_before = bounds - lengths
        letters = RunHashes((_LOWER if lower else _BYTE)[data])
        self.hashes = letters.at(self.first, self.last)

    def document_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def slices(sizes: list[int], limit: int = 500_000) -> list[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``limit``, so that memory does not follow the batch."""
    out, begin, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            out.append((begin, i))
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out


def sliced(column, limit: int = 500_000):
    """(begin, end, values) of slices of a string or binary Arrow column, of about ``limit`` bytes; values are bytes.

    Only one slice at a time is turned into Python values.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.binary())
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, b, column.slice(a, b - a).to_pylist()
