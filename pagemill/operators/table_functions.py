"""The window and semantic chunkers as table functions of SQL.

``register`` names them for a session:

    SELECT * FROM sliding_window(TABLE(SELECT id, text FROM t), 900, 200)
    SELECT * FROM fixed_length(TABLE(t), 900)
    SELECT * FROM semantic_chunks(TABLE(t), 450, 900, 1200, 45, 3)

The table has a column ``id`` and a string column ``text``; others are not looked at.  A
row gives (id, chunk_index, char_start, char_end, body), where id is a string.  Rows are cut
where they lie, in Arrow batches; ``TABLE(t) PARTITION BY (id)`` deals them by record first,
which nothing here needs.  Null and blank texts give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagemill.functions.vectors import hashing
from pagemill.operators.semantic import text_spans

_ROWS = "id string, chunk_index int, char_start int, char_end int, body string"
_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Starts are multiples of size - overlap; the last window is the first that reaches the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window needs a positive size and an overlap from 0 to less than it")
    step = size - overlap
    return [(i * step, min(i * step + size, n)) for i in range(max(0, -(-(n - size) // step)) + 1)] if n else []


def _cut(batch: pa.RecordBatch, spans) -> pa.Table:
    rows = []
    for key, text in zip(batch.column("id").cast(pa.string()).to_pylist(), batch.column("text").to_pylist(), strict=True):
        text = (text or "").strip()
        rows += [(key, k, a, b, text[a:b].strip()) for k, (a, b) in enumerate(spans(text), 1)]
    columns = zip(*rows, strict=True) if rows else [[]] * len(_TYPES)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=["id", "chunk_index", "char_start", "char_end", "body"])


def _batch(table) -> pa.RecordBatch:
    return table.to_batches()[0] if isinstance(table, pa.Table) else table


def _number(argument) -> int:
    return argument[0].as_py() if isinstance(argument, (pa.Array, pa.ChunkedArray)) else int(argument)


@F.arrow_udtf(returnType=_ROWS)
class FixedLength:
    def eval(self, records: pa.RecordBatch, size: pa.Array) -> Iterator[pa.Table]:
        yield _cut(records, lambda text: windows(len(text), _number(size), 0))


@F.arrow_udtf(returnType=_ROWS)
class SlidingWindow:
    def eval(self, records: pa.RecordBatch, size: pa.Array, overlap: pa.Array) -> Iterator[pa.Table]:
        yield _cut(records, lambda text: windows(len(text), _number(size), _number(overlap)))


@F.arrow_udtf(returnType=_ROWS)
class SemanticChunks:
    def __init__(self) -> None:
        self.encoder = hashing()

    def eval(self, records: pa.RecordBatch, least: pa.Array, target: pa.Array, most: pa.Array, width: pa.Array, step: pa.Array) -> Iterator[pa.Table]:
        bounds = [_number(a) for a in (width, step, least, target, most)]
        yield _cut(records, lambda text: [(s["char_start"], s["char_end"]) for s in text_spans(text, self.encoder, *bounds)] if text else [])


FUNCTIONS = {"fixed_length": FixedLength, "sliding_window": SlidingWindow, "semantic_chunks": SemanticChunks}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
