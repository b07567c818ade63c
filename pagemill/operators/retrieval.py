"""Exact dense retrieval in blocks, ranked runs, and prompts.

Queries and chunks are packed into blocks of vectors.  Each pair of blocks is one matrix
product, which keeps the best k of its chunks for each query, so what is shuffled after it
is k rows for each query and chunk block; the last step ranks those.  Texts stay out of
the scoring and are joined to the ranked rows.

Query blocks are broadcast if all query vectors have ``BROADCAST_BYTES`` at most.  Beyond
that both sides meet in a grid: chunks are dealt into its columns and queries into its rows,
``TILE`` blocks each, so a chunk is copied once a row and a query once a column, about the
root of the number of tiles.  A tile holds its chunks in balls around centroids.  By the
triangle inequality no chunk of a ball is nearer to a query than the centroid's product
and the query's length times the radius allow; balls go by that bound, and a query skips
those that cannot reach its k-th best.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import strip, truthy
from pagemill.functions.vectors import Encoder
from pagemill.sources.scratch import bound_batches

BLOCK, TILE = 1024, 64
BROADCAST_BYTES = 64 << 20


def build_index(chunks: DataFrame, encoder: Encoder) -> DataFrame:
    """Chunks with the vectors of their bodies; nothing but the body is encoded."""
    return chunks.withColumn("vector", encoder(F.coalesce("body", F.lit(""))))


def index_metadata(index: DataFrame, model_name: str) -> DataFrame:
    return index.groupBy("strategy").agg(F.count("*").cast("int").alias("num_chunks"), F.max(F.size("vector")).alias("embedding_dim")).select("strategy", F.lit(model_name).alias("model_name"), "num_chunks", "embedding_dim", F.lit("content.body").alias("text_field"), F.lit(False).alias("metadata_indexed"))


def _blocks(vectors: DataFrame, key: str, count: int, groups: list[str], name: str) -> DataFrame:
    block = F.pmod(F.xxhash64(key), F.lit(max(1, -(-count // BLOCK)))).cast("int")
    rows = F.struct(F.col(key).alias("key"), F.col("vector").alias("vector"))
    return vectors.where("vector is not null").groupBy(*groups, block.alias(f"{name}_block")).agg(F.collect_list(rows).alias(name))


class Balls:
    """Chunks of one tile in balls, to be searched by products that their bounds do not rule out."""

    def __init__(self, vectors: np.ndarray, names, size: int = BLOCK, rounds: int = 2) -> None:
        self.names, self.products = names, 0
        self.place = np.empty(len(vectors), np.int64)
        self.place[np.argsort(np.array(names.to_pylist()), kind="stable")] = np.arange(len(vectors))
        count = max(1, -(-len(vectors) // size))
        centres = vectors[np.linspace(0, len(vectors) - 1, count).astype(int)]
        for _ in range(rounds + 1):
            own = np.concatenate([(vectors[a : a + size] @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1) for a in range(0, len(vectors), size)])
            centres = np.stack([vectors[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(count)])
        self.vectors, self.members = vectors, [m for j in range(count) if len(m := np.flatnonzero(own == j))]
        self.centres = np.stack([vectors[m].mean(axis=0) for m in self.members])
        self.radius = np.array([np.sqrt(((vectors[m] - c) ** 2).sum(axis=1)).max() for m, c in zip(self.members, self.centres, strict=True)])

    def best(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, chunk, score) of the k best of each query; ties by the chunks' names."""
        bound = asked @ self.centres.T + np.sqrt((asked * asked).sum(axis=1))[:, None] * self.radius
        score, chunk = np.full((len(asked), k), -np.inf), np.full((len(asked), k), -1)
        for j in np.argsort(-bound.max(axis=0), kind="stable").tolist():
            # scores are rounded, so equal ones may differ by a little here
            rows = np.flatnonzero(bound[:, j] >= score[:, -1] - 1e-8)
            if not len(rows):
                continue
            members = self.members[j]
            self.products += len(rows) * len(members)
            values = np.concatenate([score[rows], np.round(asked[rows] @ self.vectors[members].T, 9)], axis=1)
            which = np.concatenate([chunk[rows], np.broadcast_to(members, (len(rows), len(members)))], axis=1)
            order = np.lexsort((np.where(which >= 0, self.place[which], len(self.place)), -values), axis=1)[:, :k]
            score[rows], chunk[rows] = np.take_along_axis(values, order, axis=1), np.take_along_axis(which, order, axis=1)
        row, rank = np.nonzero(chunk >= 0)
        return row, chunk[row, rank], score[row, rank]


def in_tiles(queries: DataFrame, chunks: DataFrame, query_key: str, chunk_key: str, own, rows: int, columns: int) -> DataFrame:
    """Both sides as rows of a grid's tiles (r, c), chunks first; each chunk ``rows`` times, each query ``columns`` times."""
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = {**dict(queries.dtypes), **dict(chunks.dtypes)}
    none = lambda key: F.lit(None).cast(kinds[key])
    vector = F.col("vector").cast("array<double>").alias("vector")
    held = chunks.where("vector is not null").select(every(rows).alias("r"), dealt(chunk_key, columns).alias("c"), F.lit(0).alias("side"), own.alias("own"), none(query_key).alias("q"), F.col(chunk_key).alias("name"), vector)
    asked = queries.where("vector is not null").select(dealt(query_key, rows).alias("r"), every(columns).alias("c"), F.lit(1).alias("side"), F.lit("").alias("own"), F.col(query_key).alias("q"), none(chunk_key).alias("name"), vector)
    return held.unionAll(asked)


def _in_grid(queries: DataFrame, chunks: DataFrame, k: int, query_key: str, chunk_key: str, group: str | None, rows: int, columns: int, schema: str) -> DataFrame:
    """The k best of each query within each column of a grid of rows x columns tiles."""
    own = F.col(group).cast("string") if group else F.lit("")
    kinds = {**dict(queries.dtypes), **dict(chunks.dtypes)}
    tiles = in_tiles(queries, chunks, query_key, chunk_key, own, rows, columns).repartition("r", "c").sortWithinPartitions("r", "c", "side", "own")

    def search(batches):
        import pyarrow as pa

        matrix = lambda part: part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        at, waiting, balls = None, [], None
        for batch in batches:
            r, c, side = (batch.column(n).to_numpy() for n in ("r", "c", "side"))
            edges = np.flatnonzero((np.diff(r) != 0) | (np.diff(c) != 0) | (np.diff(side) != 0)) + 1
            for x, y in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if x == y:
                    continue
                if (r[x], c[x]) != at:
                    at, waiting, balls = (r[x], c[x]), [], None
                if side[x] == 0:
                    waiting.append(batch.slice(x, y - x))
                    continue
                if balls is None:
                    table = pa.Table.from_batches(waiting, batch.schema).combine_chunks()
                    waiting, balls = [], {}
                    for name in sorted(set(table.column("own").to_pylist())):
                        part = table.filter(pa.compute.equal(table.column("own"), name)).combine_chunks().to_batches()[0]
                        balls[name] = Balls(matrix(part), part.column("name"), BLOCK)
                for a in range(x, y, BLOCK):
                    part = batch.slice(a, min(BLOCK, y - a))
                    for name, own_balls in balls.items():
                        row, chunk, score = own_balls.best(matrix(part), k)
                        columns = [pa.array([name] * len(row), pa.string())] if group else []
                        yield pa.RecordBatch.from_arrays([*columns, part.column("q").take(pa.array(row)), own_balls.names.take(pa.array(chunk)), pa.array(score)], names=[*([group] if group else []), query_key, chunk_key, "score"])

    return tiles.mapInArrow(search, schema if not group else schema.replace(f"{group} {kinds[group]}", f"{group} string", 1)).select(*([F.col(group).cast(kinds[group]).alias(group)] if group else []), query_key, chunk_key, "score")


def top_k(queries: DataFrame, chunks: DataFrame, k: int, query_key: str = "qa_id", chunk_key: str = "chunk_id", group: str | None = None) -> DataFrame:
    """(group, query, chunk, score, rank): the k chunks of greatest inner product, ties by chunk key.

    ``group`` (a strategy, say) ranks the chunks of each of its values apart.  Scores are
    rounded to 9 places.  Null vectors and chunks without a group take no part; keys are
    taken as they are, so repeated and null ones compete like others.  Without chunks or
    with k <= 0 the result is empty.
    """
    bound_batches(queries.sparkSession)  # a row of blocks has about a megabyte
    groups = [group] if group else []
    chunks = chunks.where(F.col(group).isNotNull()) if group else chunks
    kinds = {**dict(queries.dtypes), **dict(chunks.dtypes)}
    size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    n_queries, n_chunks = size[0], chunks.count()
    n_blocks, chunk_blocks = (max(1, -(-n // BLOCK)) for n in (n_queries, n_chunks))
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in groups), f"{query_key} {kinds[query_key]}", f"{chunk_key} {kinds[chunk_key]}", "score double"])
    if k <= 0:
        return queries.sparkSession.createDataFrame([], f"{schema}, rank int")
    order = W.partitionBy(*groups, query_key).orderBy(F.desc("score"), chunk_key)
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if 8 * size[1] > BROADCAST_BYTES:
        return ranked(_in_grid(queries, chunks, k, query_key, chunk_key, group, -(-n_blocks // TILE), -(-chunk_blocks // TILE), schema))
    left = _blocks(queries, query_key, n_queries, [], "q")
    right = _blocks(chunks, chunk_key, n_chunks, groups, "c")
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("q_block"))
    pairs = right.join(F.broadcast(left), "q_block").select(*groups, "q", "c")
    at = len(groups)

    def best(batches):
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                q, c = one.column(at).flatten(), one.column(at + 1).flatten()
                x, y = (v.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1) for v in (q, c))
                score = np.round(x @ y.T, 9)
                n = min(k, score.shape[1])
                names = c.field("key")
                place = np.empty(len(names), np.int64)
                place[np.argsort(np.array(names.to_pylist()), kind="stable")] = np.arange(len(names))
                order = np.lexsort((np.broadcast_to(place, score.shape), -score), axis=1)[:, :n]
                rows = np.repeat(np.arange(len(x)), n)
                columns = [pa.array(one.column(0).to_pylist() * len(rows), one.column(0).type)] if groups else []
                yield pa.RecordBatch.from_arrays([*columns, q.field("key").take(pa.array(rows)), names.take(pa.array(order.ravel())), pa.array(score[rows, order.ravel()])], names=[*groups, query_key, chunk_key, "score"])

    return ranked(pairs.mapInArrow(best, schema))


def retrieve(questions: DataFrame, index: DataFrame, encoder: Encoder, k: int) -> DataFrame:
    """One run for each question and strategy of the index, with its ranked results.

    Questions without an id are left out, a null text counts as empty; question ids, and the
    chunk ids of a strategy, are taken to be unique, as the stages make them.
    """
    asked = questions.select(F.col("id").alias("qa_id"), "question", F.col("type").alias("qa_type")).where("qa_id is not null")
    vectors = asked.select("qa_id", encoder(F.coalesce("question", F.lit(""))).alias("vector"))
    ranked = top_k(vectors, index.select(F.col("id").alias("chunk_id"), "strategy", "vector"), k, group="strategy")
    full = ranked.join(index.select(F.col("id").alias("chunk_id"), "strategy", "evidence_ids", "body", "lco", "chunk_type"), ["chunk_id", "strategy"])
    result = F.struct("rank", "score", "chunk_id", "evidence_ids", "body", F.struct("lco", "chunk_type").alias("metadata"))
    results = full.groupBy("qa_id", "strategy").agg(F.array_sort(F.collect_list(result)).alias("results"))
    every = asked.select("qa_id", "question", "qa_type", F.explode(F.array(*map(F.lit, _strategies(index)))).alias("strategy"))
    kind = dict(results.dtypes)["results"]
    return every.join(results, ["qa_id", "strategy"], "left").select("qa_id", "question", "qa_type", "strategy", F.lit(k).alias("top_k"), F.coalesce("results", F.array().cast(kind)).alias("results"))


def _strategies(index: DataFrame) -> list[str]:
    """The few strategy names of an index."""
    return sorted(r.strategy for r in index.select("strategy").distinct().collect())


def prompts(runs: DataFrame, context_k: int = 5) -> DataFrame:
    """Runs with their first results as numbered contexts of a grounded question."""
    if context_k < 0:
        raise ValueError("context_k must not be negative")
    contexts = F.slice("results", 1, context_k) if context_k else F.slice("results", 1, 0)
    parts = F.transform("contexts", lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), strip(F.coalesce(c["body"], F.lit("")))))
    prompt = F.concat(
        F.lit("Use nothing but the context below to answer. Say so if the context does not hold the answer.\n\nQuestion:\n"), F.coalesce(truthy(F.col("question")), F.lit("")),
        F.lit("\n\nContext:\n"), F.array_join(parts, "\n\n"), F.lit("\n\nAnswer:"),
    )
    return runs.withColumn("contexts", contexts).select("qa_id", "strategy", "question", F.lit(context_k).alias("context_k"), "contexts", prompt.alias("prompt"))
