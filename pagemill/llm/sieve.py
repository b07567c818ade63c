"""A bit array of bounded size that passes every key of a table and few others.

Rows that fail it cannot match the table and need no shuffle.  It is only ever used ahead
of an exact step, so that a full array costs time and never a result: beyond ``MAX_BITS``
/ 16 keys it passes more rows, in the end all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 27
_CHUNK_BITS = 1 << 19


class Sieve:
    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    @staticmethod
    def slots(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            other = keys * np.uint64(0x9E3779B97F4A7C15)
        return keys & mask, (keys >> np.uint64(32)) & mask, (other >> np.uint64(29)) & mask

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for slot in self.slots(keys, self.mask):
            out &= (self.bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def build_sieve(keys: DataFrame, column: str):
    """Broadcast sieve of a long column of hashes.  What reaches the driver is the bit array, 16 MB at most."""
    spark = keys.sparkSession
    count = keys.count()
    size = 1 << 16
    while size < min(MAX_BITS, 16 * count):
        size *= 2
    mask, chunk = np.uint64(size - 1), min(size, _CHUNK_BITS)

    def partial(batches):
        import pyarrow as pa

        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for slot in Sieve.slots(values, mask):
                slot = slot.astype(np.int64)
                for c in np.unique(slot // chunk):
                    own = bits.setdefault(int(c), np.zeros(chunk // 8, np.uint8))
                    at = slot[slot // chunk == c] % chunk
                    np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(bits), pa.int32()), "bits": pa.array([b.tobytes() for b in bits.values()], pa.binary())})

    def merge(batches):
        import pyarrow as pa

        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(b, np.uint8)
                bits[c] = bits[c] | own if c in bits else own
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(bits), pa.int32()), "bits": pa.array([b.tobytes() for b in bits.values()], pa.binary())})

    tasks = max(1, min(8, count // 50_000 + 1))
    parts = keys.select(F.col(column).cast("long")).coalesce(tasks).mapInArrow(partial, "chunk int, bits binary")
    rows = parts.repartition(max(1, min(8, size // chunk)), "chunk").mapInArrow(merge, "chunk int, bits binary").collect()
    whole = np.zeros(size // 8, np.uint8)
    for row in rows:
        whole[row.chunk * (chunk // 8) : (row.chunk + 1) * (chunk // 8)] |= np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(whole)


def passing(bits, key: Column) -> Column:
    """Whether a long ``key`` passes a broadcast sieve.  Only keys go through Python; the rows stay where they are."""
    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sieve = Sieve(bits.value)
        for own in batches:
            yield pd.Series(sieve.passes(own.to_numpy().view(np.uint64)))

    return passes(key)


def sifted(frame: DataFrame, keys: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of ``frame`` whose ``key`` (long) may be among the hashes in the one column of ``keys``, and the others."""
    hit = passing(build_sieve(keys, keys.columns[0]), key)
    return frame.where(hit), frame.where(~hit)


def without_ids(frame: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not among the ids of ``gone``; rows that pass the sieve alone are shuffled."""
    hits, others = sifted(frame, gone.select(F.xxhash64(column).alias("k")), F.xxhash64(column))
    return others.unionByName(hits.join(gone.select(column).distinct(), column, "left_anti"))
