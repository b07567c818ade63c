"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces of that length and a rest.
Pieces are dealt by hash into shards of about ``SHARD_TOKENS`` tokens, and each shard is
packed on its own, longest piece first: a piece goes into the open bin with the least room
that still takes it, whatever that bin's length.  If there is none, a bin is opened, of
the length of least cost: for each permitted length that holds the piece the bin is filled
on trial with the longest of the pieces still to come that fit, and the length whose bin
costs least for each of its tokens is opened.  At last every bin is downsized to the
cheapest length that holds its contents, and costs are counted after that.  As a trial
sees one bin at a time, packings that open every bin with one least length are made too,
and the packing of least total cost is kept.  A sequence of length c costs
c * (1 + c / ``ATTENTION``): a part in proportion and a quadratic one for attention.

Shards are bounded by their tokens, so no task sees all pieces, and the waste at their
edges is at most a bin for each shard.

Defined results: documents without tokens are not packed; equal rows are packed as often
as they occur, numbered by ``copy``; ties go by row hash, so reruns agree; a row that
occurs very often is unfolded in ranges of ``RANGE`` copies, each in a task of its own;
columns of the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.mixing import word_count
from pagemill.llm.scratch import Scratch

LENGTHS, SHARD_TOKENS, ATTENTION = (512, 1024, 2048, 4096), 2_000_000, 16_384.0
RANGE = 10_000


def cost(length: int, attention: float = ATTENTION) -> float:
    return length * (1 + length / attention)


class _Waiting:
    """Sizes still to be placed, with how many there are of each; the bits of an integer tell which sizes there are."""

    def __init__(self, sizes: list[int]) -> None:
        self.n = Counter(sizes)
        self.present = sum(1 << s for s in self.n)

    def take(self, size: int) -> None:
        self.n[size] -= 1
        if not self.n[size]:
            self.present &= ~(1 << size)

    def filled(self, room: int) -> int:
        """Tokens that a bin of that room would hold, filled with the longest sizes that fit."""
        held, size, used = 0, 0, 0
        while True:
            fits = self.present & ((1 << (room - held + 1)) - 1)
            if size and used >= self.n[size]:
                fits &= (1 << size) - 1
            if not fits:
                return held
            at = fits.bit_length() - 1
            times = min(self.n[at] - (used if at == size else 0), (room - held) // at)
            used = times + (used if at == size else 0)
            size, held = at, held + times * at


def best_fit(sizes: list[int], lengths: tuple[int, ...], opening: int | None = None, attention: float = ATTENTION) -> list[int]:
    """The bin of each size, given in falling order.

    Bins are kept by room; the bits of an integer tell which rooms there are.  A bin is
    opened with the length of least cost a token, or, if ``opening`` is given, with the
    shortest one of at least that length that holds the piece.
    """
    rooms: dict[int, list[int]] = {}
    present, bins, out = 0, 0, []
    waiting = _Waiting(sizes) if opening is None else None

    def length_for(size: int) -> int:
        if waiting is None:
            return next(c for c in lengths if c >= max(size, opening))
        best = (math.inf, 0)
        for c in lengths:
            if c >= size:
                held = size + waiting.filled(c - size)
                best = min(best, (cost(next(x for x in lengths if x >= held), attention) / held, c))
        return best[1]

    for size in sizes:
        if waiting is not None:
            waiting.take(size)
        fits = present >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                present &= ~(1 << room)
        else:
            room, own = length_for(size), bins
            bins += 1
        left = room - size
        if left:
            rooms.setdefault(left, []).append(own)
            present |= 1 << left
        out.append(own)
    return out


def pack_sizes(sizes: np.ndarray, lengths: tuple[int, ...], attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each size (given in falling order) and the final length of each bin."""
    best = None
    ladder = np.array(lengths)
    price = np.array([cost(c, attention) for c in lengths])
    for opening in (None, *lengths):
        bins = np.array(best_fit(sizes.tolist(), lengths, opening, attention), np.int64)
        fitted = np.searchsorted(ladder, np.bincount(bins, sizes).astype(np.int64))
        total = price[fitted].sum()
        if best is None or total < best[0]:
            best = (total, bins, ladder[fitted])
    return best[1], best[2]


def pack(documents: DataFrame, tokens: Column, key: tuple[Column, Column], lengths: tuple[int, ...] = LENGTHS, shard_tokens: int = SHARD_TOKENS, attention: float = ATTENTION) -> DataFrame:
    """Placed pieces: key, key2, copy, piece, begin, size, bin, bin_length and offset.

    ``tokens`` counts a row's tokens and the two longs of ``key`` stand for its contents.
    """
    lengths = tuple(sorted(set(lengths)))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    scratch, most = Scratch(documents.sparkSession, "packing"), lengths[-1]
    items = documents.select(key[0].alias("key"), key[1].alias("key2"), tokens.cast("long").alias("tokens")).where("tokens > 0").groupBy("key", "key2", "tokens").agg(F.count("*").alias("n"))
    items = scratch.table(items)
    total, often = items.agg(F.sum(F.expr("tokens * n")), F.max("n")).first()
    shards = max(1, math.ceil((total or 0) / shard_tokens))
    ranged = items.withColumns({"first": F.lit(0).cast("long"), "last": F.col("n") - 1})
    if (often or 0) > RANGE:
        rest = items.where(F.col("n") > RANGE).withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {RANGE}L)"))).withColumn("last", F.least(F.col("first") + RANGE, F.col("n")) - 1)
        ranged = ranged.where(F.col("n") <= RANGE).unionByName(rest.repartition("key", "first"))
    copies = ranged.select("key", "key2", "tokens", F.explode(F.expr("sequence(first, last)")).alias("copy"))
    pieces = copies.select("key", "key2", "copy", "tokens", F.explode(F.expr(f"sequence(0L, (tokens - 1) div {most})")).alias("piece"))
    pieces = pieces.select("key", "key2", "copy", "piece", (F.col("piece") * most).alias("begin"), F.least(F.lit(most).cast("long"), F.col("tokens") - F.col("piece") * most).alias("size"))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("key", "key2", "copy", "piece"), F.lit(shards)))

    def place(frame):
        frame = frame.sort_values(["size", "key", "key2", "copy", "piece"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        sizes = frame["size"].to_numpy()
        bins, final = pack_sizes(sizes, lengths, attention)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        new = np.flatnonzero(np.diff(bins[order], prepend=-1))
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.repeat(before[new], np.diff(np.append(new, len(bins))))
        return frame.assign(bin=(frame["shard"].to_numpy() << 32) | bins, bin_length=final[bins], offset=offset).drop(columns="shard")

    return dealt.groupBy("shard").applyInPandas(place, "key long, key2 long, copy long, piece long, begin long, size long, bin long, bin_length long, offset long")


def pack_words(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, **options) -> DataFrame:
    """Packs by words: id, copy, piece, begin, size, bin, bin_length, offset, and the piece's text if asked for.

    Words of a piece are joined by single spaces.
    """
    documents = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    key = (F.xxhash64("_id", "_text"), F.xxhash64(F.lit("second"), "_text", "_id"))
    placed = pack(documents, word_count(F.col("_text")), key, **options)
    chosen = documents.select(key[0].alias("key"), key[1].alias("key2"), "_id", *(["_text"] if with_text else [])).dropDuplicates(["key", "key2"])
    out = placed.join(chosen, ["key", "key2"])
    if with_text:
        words = F.regexp_extract_all("_text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
        out = out.withColumn("_text", F.array_join(F.slice(words, (F.col("begin") + 1).cast("int"), F.col("size").cast("int")), " "))
    return out.select(F.col("_id").alias(id_column), "copy", "piece", "begin", "size", "bin", "bin_length", "offset", *([F.col("_text").alias(text_column)] if with_text else []))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed by words into 512 to 4,096."""
    return pack_words(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
