"""Near-duplicate documents by b-bit MinHash, with links confirmed on full shingle sets.

1. Each document's set of word shingles gets ``ROWS * BANDS`` minima.  Bands of ``ROWS``
   minima are hashed whole; of every minimum ``BITS`` low bits are kept, packed.
2. Documents with equal sets are one class.  Classes that share a band key are candidates.
   Their similarity is estimated from the number of equal low bits, m, corrected for
   chance: (m / K - c) / (1 - c) with c = 2 ** -BITS.  Candidates more than ``MARGIN``
   standard deviations below the threshold are given up, unless one has fewer than
   ``SMALL`` shingles: those are as cheap to compare in full.
3. The classes that candidates connect are compared on their full sets, in blocks
   (see ``blocks``), each set shipped about once.  Only confirmed links count.

A pair at the threshold of 0.8 shares a band with probability 1 - (1 - 0.8 ** 6) ** 32 =
0.99994; step 3 compares all members of a candidate component, so a link is lost only
where no chain of candidates joins its ends.

Sets are hashed to 64 bits for comparison and 128 bits for identity.  Full sets leave the
scan only for classes with candidates; a bit array of bounded size tells which.

Defined results: a text with fewer words than a shingle is one shingle of all its words;
a null, empty or blank text has an empty set, stays alone and is kept; rows with equal ids
are nodes of their own with one component id; a null id is never a component id, and a
row without id is kept only if no row of its component has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import linked_in_blocks
from pagemill.llm.scratch import Scratch
from pagemill.llm.sieve import Sieve, build_sieve
from pagemill.llm.words import Batch, RunHashes, mix64, sliced

ROWS, BANDS, BITS = 6, 32, 2
MARGIN, SMALL = 4.5, 64
SHINGLE, PERCENT = 5, 80
_K = ROWS * BANDS
_CHANCE = 2.0**-BITS
_PER_WORD = 64 // BITS
_LOW = np.uint64(int("01" * 32, 2))
#: Blocks: rows of signatures, and shingles of full sets (a set counts as _LEAST at least).
_ROWS_IN_BLOCK, _SHINGLES_IN_BLOCK, _LEAST = 256, 200_000, 600
_SEEDS = mix64(np.arange(1, 2 * _K + 1, dtype=np.uint64))
_MULTIPLIERS, _XORS = (_SEEDS[:_K] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[_K:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and how many each text has."""
    batch = Batch(texts, lower=True)
    runs = RunHashes(batch.hashes)
    n = np.maximum(batch.counts - shingle + 1, np.minimum(batch.counts, 1))
    begins = np.cumsum(n) - n
    at = np.repeat(batch.starts - begins, n) + np.arange(n.sum())
    hashes = runs.at(at, np.minimum(at + shingle, np.repeat(batch.ends, n)))
    for a, b in zip(begins, begins + n, strict=True):
        if b - a > 1:
            hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begins[n > 0]] = True
    return hashes[new], np.bincount(np.repeat(np.arange(len(n)), n)[new], minlength=len(n))


def set_ids(hashes: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """128 bits for each set: two sums of mixed members."""
    with np.errstate(over="ignore"):
        one = np.add.reduceat(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), begins)
        two = np.add.reduceat(mix64(hashes ^ np.uint64(0x14057B7EF767814F)), begins)
    return [x.tobytes() for x in np.stack([mix64(one), mix64(two)], axis=1)]


def minima(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """``_K`` minima of each set, a row for each hash function."""
    x, out, work = (hashes >> np.uint64(32)).astype(np.uint32), np.empty((_K, len(begins)), np.uint32), np.empty(len(hashes), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(_K):
            np.bitwise_xor(x, _XORS[k], out=work)
            np.multiply(work, _MULTIPLIERS[k], out=work)
            np.minimum.reduceat(work, begins, out=out[k])
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """Low bits of the minima of each set, in rows of 64-bit words.

    The minima are mixed first: low bits of a product depend on low bits of the factor
    alone, so that chance collisions of small sets would not be independent.
    """
    with np.errstate(over="ignore"):
        low = mix64(values.astype(np.uint64)) & np.uint64(2**BITS - 1)
    shifts = (np.arange(_K) % _PER_WORD * BITS).astype(np.uint64)[:, None]
    return np.bitwise_or.reduce((low << shifts).reshape(-1, _PER_WORD, values.shape[1]), axis=1).T.copy()


def band_keys(values: np.ndarray) -> np.ndarray:
    out = np.empty((values.shape[1], BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(values.shape[1], band + 1, np.uint64)
            for row in values[band * ROWS : (band + 1) * ROWS]:
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + row)
            out[:, band] = key
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed low bits of rows, corrected for chance collisions."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & _LOW).sum(axis=1)
    return (1 - differ / _K - _CHANCE) / (1 - _CHANCE)


def floor_of(percent: int) -> float:
    p = _CHANCE + (1 - _CHANCE) * percent / 100
    return percent / 100 - MARGIN * np.sqrt(p * (1 - p) / _K) / (1 - _CHANCE)


def _matrix(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed bits of rows, and which rows are of small sets."""
    rows = np.frombuffer(b"".join(payloads), np.uint64).reshape(len(payloads), -1)
    return rows[:, :-1], rows[:, -1] < SMALL


def alike_inside(percent: int):
    """Estimated links of rows in runs, for all runs of a table at once."""
    least = floor_of(percent)

    def inside(payloads, begins):
        rows, small = _matrix(payloads)
        n = len(rows)
        sizes = np.diff(np.append(begins, n))
        end = np.repeat(begins + sizes, sizes)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        live, step = np.arange(n), 1
        while len(live := live[live + step < end[live]]):
            hit = live[(estimates(rows[live], rows[live + step]) >= least) | small[live] | small[live + step]]
            left.append(hit)
            right.append(hit + step)
            step += 1
        return np.concatenate(left), np.concatenate(right)

    return inside


def alike_across(percent: int):
    least = floor_of(percent)

    def across(payloads, left, right, roots):
        (rows, small), out = _matrix(payloads), [(left[:0], right[:0])]
        for i in left:
            other = right[roots[right] != roots[i]]
            hit = other[(estimates(rows[i][None, :], rows[other]) >= least) | small[i] | small[other]]
            out.append((np.full(len(hit), i), hit))
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    return across


def similar(sets: list[np.ndarray], left: Iterator[int], right: np.ndarray, label: list[int], percent: int) -> list[tuple[int, int]]:
    """Links with ``100 * intersection >= percent * union`` between left and right rows not connected yet.

    Of the links that close a circle some are left out.  Intersections are counted through
    an inverted index of the right rows.
    """
    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    sizes = np.array([len(s) for s in sets])
    members = np.concatenate([sets[j] for j in right])
    owner = np.repeat(right, sizes[right])
    order = np.argsort(members, kind="stable")
    members, owner = members[order], owner[order]
    out = []
    for i in left:
        mine = find(i)
        others = [j for j in right if find(j) != mine]
        if not others:
            continue
        low, high = np.searchsorted(members, sets[i], "left"), np.searchsorted(members, sets[i], "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for j in others:
            if 100 * common[j] >= percent * (sizes[i] + sizes[j] - common[j]) and find(j) != find(i):
                label[find(j)] = find(i)
                out.append((i, j))
    return out


def equal_sets(percent: int):
    """Confirmed links of rows in runs, and between rows, on full sets."""

    def arrays(links):
        return (np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64))

    def inside(payloads, begins):
        sets, links = [np.frombuffer(p, np.uint64) for p in payloads], []
        label = list(range(len(sets)))
        for a, b in zip(begins, np.append(begins[1:], len(sets)), strict=True):
            if b - a == 2:
                common = len(np.intersect1d(sets[a], sets[a + 1], assume_unique=True))
                links += [(a, a + 1)] * (100 * common >= percent * (len(sets[a]) + len(sets[a + 1]) - common))
            elif b - a > 2:
                links += similar(sets, range(a, b), np.arange(a, b), label, percent)
        return arrays(links)

    def across(payloads, left, right, roots):
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        first: dict[int, int] = {}
        label = [first.setdefault(int(r), i) for i, r in enumerate(roots)]
        return arrays(similar(sets, left, right, label, percent) if len(left) and len(right) else [])

    return inside, across


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each document: its id, ``n_shingles``, ``component_id`` and ``kept``."""
    import pyarrow as pa

    scratch = Scratch(documents.sparkSession, "minhash")
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()

    def signed(batches):
        for whole in batches:
            for a, b, values in sliced(whole.column(1)):
                hashes, n = shingle_sets(values, shingle)
                full = np.flatnonzero(n)
                begins = (np.cumsum(n) - n)[full]
                nodes: list = [None] * (b - a)
                signs, keys = list(nodes), list(nodes)
                if len(full):
                    least = minima(hashes, begins)
                    signed_sets = np.column_stack([packed(least), n[full].astype(np.uint64)])
                    for i, node, sign, key in zip(full, set_ids(hashes, begins), signed_sets, band_keys(least).view(np.int64), strict=True):
                        nodes[i], signs[i], keys[i] = node, sign.tobytes(), key
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n_shingles", "node", "sign", "bands"])

    rows = scratch.table(texts.mapInArrow(signed, f"id {id_type}, n_shingles long, node binary, sign binary, bands array<long>"))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    classes = scratch.table(classes)
    shared = scratch.table(classes.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n >= 2").select("key"))
    band_sieve = build_sieve(shared, "key")

    def in_bands(batches):
        sieve = Sieve(band_sieve.value)
        for batch in batches:
            bands = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(sieve.passes(bands.view(np.uint64)))
            row = pa.array(hit // BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(bands[hit]), batch.column(0).take(row), pa.array(np.ones(len(hit), np.int64)), batch.column(1).take(row)], names=["grp", "node", "weight", "payload"])

    members = scratch.table(classes.select("node", "sign", "bands").mapInArrow(in_bands, "grp long, node binary, weight long, payload binary"))
    candidates = scratch.table(linked_in_blocks(members, _ROWS_IN_BLOCK, alike_inside(percent), alike_across(percent), scratch))
    scratch.drop(members)

    def named(ids: DataFrame, column: str) -> DataFrame:
        """Adds a hash of the id, which tells a class's one row from its copies."""
        return ids.withColumn("ih", F.xxhash64(column))

    def row_keys(nodes: list[bytes], ids) -> np.ndarray:
        return np.frombuffer(b"".join(n[:8] for n in nodes), np.uint64) ^ ids.to_numpy(zero_copy_only=False).view(np.uint64)

    def keyed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": row_keys(batch.column(0).to_pylist(), batch.column(1)).view(np.int64)})

    represent = named(candidates.join(classes.select("node", "id"), "node"), "id").select("node", "ih")
    set_sieve = build_sieve(scratch.table(represent.mapInArrow(keyed, "h long")), "h")

    def full_sets(batches):
        sieve = Sieve(set_sieve.value)
        for whole in batches:
            for a, b, values in sliced(whole.column(0)):
                hashes, n = shingle_sets(values, shingle)
                full = np.flatnonzero(n)
                if len(full):
                    begins = (np.cumsum(n) - n)[full]
                    nodes = set_ids(hashes, begins)
                    hit = np.flatnonzero(sieve.passes(row_keys(nodes, whole.column(1).slice(a, b - a).take(pa.array(full)))))
                    yield pa.RecordBatch.from_pydict({"node": pa.array([nodes[i] for i in hit], pa.binary()), "payload": pa.array([hashes[begins[i] : begins[i] + n[full[i]]].tobytes() for i in hit], pa.binary())})

    sets = named(texts, "id").select("text", "ih").mapInArrow(full_sets, "node binary, payload binary").dropDuplicates(["node"])
    groups = candidates.join(sets, "node").select(F.col("component").alias("grp"), "node", F.greatest(F.length("payload") / 8, F.lit(_LEAST)).cast("long").alias("weight"), "payload")
    groups = scratch.table(groups)
    inside, across = equal_sets(percent)
    linked = scratch.table(linked_in_blocks(groups, _SHINGLES_IN_BLOCK, inside, across, scratch))
    scratch.drop(groups)

    ids = classes.select("node", "id")
    least = linked.join(ids, "node").groupBy("component").agg(F.min("id").alias("low"))
    names = ids.join(linked.join(least, "component").select("node", "low"), "node", "left").select("node", F.coalesce("low", "id").alias("name"))
    out = rows.select("id", "n_shingles", "node").join(scratch.table(names), "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("name")))
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.select(F.col("id").alias(id_column), "n_shingles", "component_id", kept.alias("kept"))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query: two-word shingles over all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shingle=2)


#: Every pair with a shingle in common by itself: for small tables.
OP7_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT n, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
z AS MATERIALIZED (SELECT n, count(*) AS size FROM s GROUP BY n),
p AS MATERIALIZED (SELECT a.n AS a, b.n AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.n <> b.n GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.n = p.a JOIN z y ON y.n = p.b WHERE 100 * shared >= 80 * (x.size + y.size - shared)),
r AS (SELECT n AS a, n AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS n, min(d.doc_id) AS component_id FROM r JOIN d ON d.n = r.b GROUP BY r.a)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (n) LEFT JOIN z USING (n)
"""
