"""Boolean trigram queries of regular expressions, and the inverted index that answers them.

A query says which three-byte strings, A-Z lower-cased, a text must hold to be able to match:
a trigram, ``("all", ...)``, ``("any", ...)`` or ``None`` for an expression that no trigram
is mandatory for.  It follows the parsed expression: a stretch of literals and of classes
of few characters is a bounded set of strings, each of which demands its trigrams; branches
are alternatives; repeats demand what their least number of rounds demands.  Whatever is
beyond that demands nothing, so a query may pass too many texts and never too few.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np

#: Strings that a stretch may stand for, characters of a class, rounds of a repeat that are spelt out.
_STRINGS, _CLASS, _ROUNDS = 64, 8, 64

Query = int | tuple | None


def fold(text: bytes) -> bytes:
    return text.lower()  # of bytes: A-Z only


def trigrams(text: bytes) -> set[int]:
    return {text[i] << 16 | text[i + 1] << 8 | text[i + 2] for i in range(len(text) - 2)}


def all_of(parts) -> Query:
    held = sorted({p for p in parts if p is not None}, key=repr)
    return None if not held else held[0] if len(held) == 1 else ("all", *held)


def any_of(parts) -> Query:
    held = sorted(set(parts), key=repr)
    return None if not held or None in held else held[0] if len(held) == 1 else ("any", *held)


def _strings_query(strings: set[bytes]) -> Query:
    return any_of(all_of(trigrams(s)) for s in strings)


def _character(code: int) -> bytes:
    return fold(chr(code).encode("utf-8", "surrogatepass"))


def _class(items) -> set[bytes] | None:
    """The characters of a class, if they are few."""
    out: set[bytes] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            out.add(_character(value))
        elif name == "RANGE" and value[1] - value[0] < 4 * _CLASS:
            out |= {_character(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= _CLASS else None


class _Stretch:
    """A sequence read so far: what it demands, and the strings that its last part may be."""

    def __init__(self) -> None:
        self.demands: list[Query] = []
        self.strings, self.whole = {b""}, True

    def append(self, strings: set[bytes]) -> None:
        joined = {a + b for a, b in product(self.strings, strings)} if len(self.strings) * len(strings) <= 16 * _STRINGS else None
        if joined is None or len(joined) > _STRINGS:
            self.demands.append(_strings_query(self.strings))
            self.whole = False
            tails = {s[-2:] for s in self.strings}
            joined = {a + b for a, b in product(tails, strings)}
            joined = joined if len(joined) <= _STRINGS else strings
        self.strings = joined

    def cut(self, demand: Query) -> None:
        self.demands += [_strings_query(self.strings), demand]
        self.strings, self.whole = {b""}, False

    def query(self) -> Query:
        return all_of([*self.demands, _strings_query(self.strings)])


def _read(sequence) -> _Stretch:
    out = _Stretch()
    for kind, value in sequence:
        name = str(kind)
        if name == "LITERAL":
            out.append({_character(value)})
        elif name == "IN":
            few = _class(value)
            out.append(few) if few is not None else out.cut(None)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            pass
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            _append(out, [_read(value[-1] if name == "SUBPATTERN" else value)])
        elif name == "BRANCH":
            _append(out, [_read(branch) for branch in value[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            once = _read(inner)
            if once.whole and (least, most) == (0, 1):
                out.append(once.strings | {b""})
            elif once.whole and least:
                for _ in range(min(least, _ROUNDS)):
                    out.append(once.strings)
                if least != most or least > _ROUNDS:
                    out.cut(None)
            else:
                out.cut(once.query() if least else None)
        else:
            out.cut(None)
    return out


def _append(out: _Stretch, branches: list[_Stretch]) -> None:
    strings = set().union(*(b.strings for b in branches))
    if all(b.whole for b in branches) and len(strings) <= _STRINGS:
        out.append(strings)
    else:
        out.cut(any_of(b.query() for b in branches))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What a text must hold to match ``pattern``, which is read with ASCII classes and case rules."""
    return _read(re._parser.parse(pattern, flags | re.ASCII)).query()


def asked(query: Query) -> set[int]:
    """The trigrams of a query."""
    if query is None:
        return set()
    return {query} if isinstance(query, int) else set().union(*(asked(q) for q in query[1:]))


class Vocabulary:
    """Trigrams that some query can ask for; only these have postings."""

    def __init__(self, codes: set[int]) -> None:
        self.codes = np.array(sorted(codes), np.int64)
        if len(self.codes) >= 2**16:
            raise ValueError("rules ask for 65,536 trigrams or more")
        self.numbers = np.zeros(1 << 24, np.uint16)
        self.numbers[self.codes] = np.arange(1, len(self.codes) + 1)


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
#: Bytes whose trigrams are looked up at a time.
_WINDOW = 1 << 22


class Segment:
    """Inverted index of some texts: for each trigram of the vocabulary the rows that hold it, ascending."""

    def __init__(self, texts: list[bytes | None], vocabulary: Vocabulary) -> None:
        self.rows = len(texts)
        self.at = {int(c): k for k, c in enumerate(vocabulary.codes)}
        ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)
        data = _FOLDED[np.frombuffer(b"\0".join(t or b"" for t in texts) + b"\0", np.uint8)]
        pairs = [np.zeros(0, np.int64)]
        for a in range(0, len(data) - 2, _WINDOW):
            part = data[a : a + _WINDOW + 2].astype(np.int32)
            number = vocabulary.numbers[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            hit = np.flatnonzero(number)
            row = np.searchsorted(ends, hit + a, side="right")  # one across an end counts for the first: too many, never too few
            pairs.append(np.unique((number[hit].astype(np.int64) - 1) * self.rows + row))
        merged = np.unique(np.concatenate(pairs))
        self.postings = np.split(merged % max(1, self.rows), np.searchsorted(merged, np.arange(1, len(vocabulary.codes)) * self.rows)) if len(vocabulary.codes) else []

    def candidates(self, query: Query) -> np.ndarray:
        """Rows that the query admits: postings intersected and united as it says."""
        if query is None:
            return np.arange(self.rows)
        if isinstance(query, int):
            return self.postings[self.at[query]]
        if query[0] == "any":
            return np.unique(np.concatenate([self.candidates(q) for q in query[1:]]))
        held = sorted((self.candidates(q) for q in query[1:]), key=len)
        out = held[0]
        for other in held[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, other, assume_unique=True)
        return out
