"""Centroid clustering of vectors over subvector dictionaries, in exact integers.

Vectors become integers once, floor(scale * x), and are stored in chunks of at most
``CHUNK`` rows.  A chunk cuts its dimensions into blocks and keeps, for each block, the
dictionary of its distinct subvectors and one code a vector: nothing is lost, and the
vectors themselves are not stored again.  Blocks begin as single dimensions; neighbours
are merged, to twice the width each time, while that makes a round cheaper (a vector costs
one addition a block, a dictionary entry one product a dimension).  So copies and vectors
of few levels end in wide blocks with short dictionaries, scattered ones in narrow blocks
whose dictionaries are bounded by the levels of a dimension.

A round is one narrow pass: the distances of every dictionary entry to the part of each
centroid in its block are computed once, a vector's distances are sums of those by code,
and the sums of a cluster come from its counts of codes times the dictionaries.  Tasks hand
on one row for each cluster and dimension; the driver sees clusters x dimensions numbers.
No vector is shuffled in any round, so a hot vector is no hot key, and a dictionary never
grows beyond its chunk, whatever the input.

Defined results: rows whose vector is null, of another length, or holds null or non-finite
components are left out, as are those longer than 2**30 after scaling, whose squared
distances are beyond a long; rows with equal or null ids are vectors of their own; rows
without an id are seeds only when others run out, and equal hashes go by vector; fewer
vectors than clusters give fewer clusters, an empty table no rows; ties go to the smaller
number; totals beyond a long are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.scratch import Scratch

CLUSTERS, ROUNDS, SEED, SCALE, DIMENSIONS = 8, 10, 3, 1024, 64
#: Rows that share dictionaries, and the greatest squared length of a scaled vector.
CHUNK, MOST_SQUARED = 8192, 2.0**60


def encode(x: np.ndarray, clusters: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first dimension, dictionary, codes) of each block of the rows of ``x``."""
    n, blocks = len(x), []
    for d in range(x.shape[1]):
        values, codes = np.unique(x[:, d], return_inverse=True)
        blocks.append((d, values[:, None], codes.reshape(-1)))
    cost = lambda entries, width: n * clusters + entries * width * clusters
    while len(blocks) > 1:
        merged, won, k = [], False, 0
        while k < len(blocks):
            if k + 1 == len(blocks) or blocks[k][1].shape[1] != blocks[k + 1][1].shape[1]:
                merged.append(blocks[k])
                k += 1
                continue
            (at, one, a), (_, two, b) = blocks[k], blocks[k + 1]
            both, codes = np.unique(a.astype(np.int64) * len(two) + b, return_inverse=True)
            wide = np.concatenate([one[both // len(two)], two[both % len(two)]], axis=1)
            if cost(len(wide), wide.shape[1]) < cost(len(one), one.shape[1]) + cost(len(two), two.shape[1]):
                merged.append((at, wide, codes.reshape(-1)))
                won = True
            else:
                merged += [blocks[k], blocks[k + 1]]
            k += 2
        if not won:
            break
        blocks = merged
    return blocks


def decode(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.concatenate([entries[codes] for _, entries, codes in sorted(blocks, key=lambda b: b[0])], axis=1)


def by_code(blocks, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, rows x centroids, as sums of those of dictionary entries."""
    total = 0
    for at, entries, codes in blocks:
        apart = entries[:, None, :] - centroids[None, :, at : at + entries.shape[1]]
        total = total + (apart * apart).sum(axis=2)[codes]
    return total


def sums_by_code(blocks, cluster: np.ndarray, clusters: int, dimensions: int) -> np.ndarray:
    """Componentwise sums of each cluster's vectors, from its counts of codes."""
    out = np.zeros((clusters, dimensions), np.int64)
    for at, entries, codes in blocks:
        counts = np.bincount(cluster * len(entries) + codes, minlength=clusters * len(entries)).reshape(clusters, -1)
        out[:, at : at + entries.shape[1]] = counts @ entries
    return out


def _packed(blocks) -> dict[str, list]:
    """Arrays of one chunk as bytes; codes take two bytes, as a chunk has no more than 65,536 rows."""
    return {"first": [at for at, _, _ in blocks], "width": [e.shape[1] for _, e, _ in blocks], "entries": [e.astype("<i8").tobytes() for _, e, _ in blocks], "codes": [c.astype("<u2").tobytes() for _, _, c in blocks]}


def _unpacked(row: dict) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [
        (at, np.frombuffer(entries, "<i8").reshape(-1, width), np.frombuffer(codes, "<u2").astype(np.int64))
        for at, width, entries, codes in zip(row["first"], row["width"], row["entries"], row["codes"], strict=True)
    ]


_CHUNK_FIELDS = "first array<int>, width array<int>, entries array<binary>, codes array<binary>"


def integers(vectors: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: int) -> DataFrame:
    """(id, x): the vectors that take part, in whole numbers."""
    sound = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is the greatest
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double") * scale) + 1, 2))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).where(F.size("v") == dimensions).where(F.forall("v", sound))
    return rows.where(squared < MOST_SQUARED).select("id", scaled.alias("x"))


def cluster_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, scale: int = SCALE, chunk: int = CHUNK,
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every vector that takes part, and the final centroids.

    The first centroids are the vectors whose ``seed:id`` has the least sha256.
    """
    if not 1 <= chunk <= 65_536:
        raise ValueError("a chunk has 1 to 65,536 rows")
    scratch = Scratch(vectors.sparkSession, "centroids")
    rows = integers(vectors, id_column, vector_column, dimensions, scale)
    id_type = rows.schema["id"].dataType
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(digest.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, dimensions)
    k = len(centroids)

    def chunks(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, min(chunk, batch.num_rows - a))
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
                row = {"ids": part.column("id"), **_packed(encode(x, k))}
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), row.pop("ids"))
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True))], names=["ids", *row])

    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), *T.StructType.fromDDL(_CHUNK_FIELDS).fields])
    encoded = scratch.table(rows.mapInArrow(chunks, schema))

    def summed(at: np.ndarray):
        def task(batches):
            import pyarrow as pa

            sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                for row in batch.to_pylist():
                    blocks = _unpacked(row)
                    near = by_code(blocks, at).argmin(axis=1)
                    counts += np.bincount(near, minlength=k)
                    sums += sums_by_code(blocks, near, k, dimensions)
            place = np.tile(np.arange(-1, dimensions), k)
            amount = np.concatenate([counts[:, None], sums], axis=1).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), dimensions + 1)), pa.array(place), pa.array(amount)], names=["cluster", "place", "amount"])

        return task

    codes = encoded.select("first", "width", "entries", "codes")
    for _ in range(rounds if k else 0):
        parts = codes.mapInArrow(summed(centroids), "cluster long, place long, amount long")
        totals = {(r.cluster, r.place): int(r.total) for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("total")).collect()}
        moved = centroids.copy()
        for c in range(k):
            if totals[c, -1]:
                moved[c] = [totals[c, d] // totals[c, -1] for d in range(dimensions)]
        if (moved == centroids).all():
            break
        centroids = moved

    def assigned(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                apart = by_code(_unpacked(row.select(["first", "width", "entries", "codes"]).to_pylist()[0]), centroids)
                near = apart.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), pa.array(near.astype(np.int32)), pa.array(apart[np.arange(len(near)), near])], names=["id", "cluster", "distance"])

    out = encoded.mapInArrow(assigned, T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))
    return scratch.table(out), centroids.tolist()


def _long(total: Decimal) -> int | None:
    return int(total) if total < 2**63 else None


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    """Contract query over all ``embeddings``."""
    assigned, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    whole = _long(sum(inertia.values(), Decimal(0)))
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    facts = [(c, _long(inertia[c]), whole, digest(own)) for c, own in enumerate(centroids) if c in inertia]
    # one row for each cluster
    summary = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return assigned.join(summary, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned_sql(r: int) -> str:
    """Nearest of the centroids c{r - 1}."""
    apart = "list_sum(list_transform(list_zip(k.x, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"a{r} AS MATERIALIZED (SELECT k.vec_id, k.n, arg_min(c.c, ({apart}, c.c)) AS c, min({apart}) AS distance FROM kept k, c{r - 1} c GROUP BY k.vec_id, k.n)"


def _moved_sql(r: int) -> str:
    """The centroids after round r."""
    return f"""{_assigned_sql(r)},
s{r} AS MATERIALIZED (SELECT a.c, i.i, sum(k.x[i.i])::HUGEINT AS s, count(*) AS n FROM a{r} a JOIN kept k ON k.n = a.n, range(1, 65) i(i) GROUP BY a.c, i.i),
c{r} AS MATERIALIZED (
  SELECT c, m FROM c{r - 1} WHERE c NOT IN (SELECT c FROM a{r})
  UNION ALL SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) FROM s{r} GROUP BY c)"""


#: Ten rounds written out; x is compared as double, and sums are exact.
OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::INTEGER AS c, x AS m FROM kept QUALIFY c < {CLUSTERS}),
{",".join(_moved_sql(r) for r in range(1, ROUNDS + 1))},
{_assigned_sql(ROUNDS + 1)}
SELECT a.vec_id, a.c AS cluster, a.distance::BIGINT AS distance, sum(a.distance) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.m, ',')) AS centroid_sha256
FROM a{ROUNDS + 1} a JOIN c{ROUNDS} c ON c.c = a.c
"""
