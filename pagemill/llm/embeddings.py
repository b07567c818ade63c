"""Near-duplicate vectors with an inverted multi-index.

Two codebooks, one for each half of the unit vectors, are fitted on a bounded sample
(``SAMPLE`` rows by hash).  Their product is a grid of cells; every vector is indexed in
the cell of its two nearest codes.

Two vectors can be linked only within a radius r, r * r = 2 - 2 * threshold.  The distance
from a half to the border between its own code and another bounds from below the distance
to anything filed under that other code, and the squares of both halves add up.  The
multi-sequence traversal visits the cells of the grid in the order of that sum.  With a
target recall of 1 it ends when the sum passes r * r: nothing that could be linked is left
then, but in many dimensions that is most of the grid.  With a lower one it ends at the
bound within which that share of pairs at the threshold is found: partners in random
directions are made for the sample's vectors, and the sample's own links are counted too.
A pair is found from either of its ends, and pairs above the threshold are nearer, so more
than the target is found.

Each vector is sent once to every cell that it visits, and compared there with what the
cell holds, by matrix products in double precision over blocks of bounded size.  What comes
back are link counts and a spanning forest, never pairs.  A pair that both ends could find
counts in the cell of lesser number.  Cells hold about ``BLOCK`` vectors at any size of the
input, as the codebooks grow with its root, up to ``MAX_CODES``.

A cell with more than ``CROWDED`` times as many is dealt into blocks.  Near copies that
fill it lie in balls, of half the linking angle around centres of high density in a sample
of the cell: members of one ball are linked with one another without a comparison.  Only
vectors outside of balls, and visitors, meet every block.  Equal vectors are one class
before all that.

Defined results: a vector that is null, zero, of another length than most, or has null or
non-finite components links with nothing and is its own component; rows with equal ids are
vectors of their own; a null id is never a component id; vectors are scaled before their
length is taken, so components of any finite size are sound; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.blocks import forest
from pagemill.llm.components import connected_components
from pagemill.llm.scratch import Scratch

THRESHOLD, SAMPLE, MAX_CODES, BLOCK = 0.95, 20_000, 1024, 1024
#: Recall at the threshold that the query's traversal is ended by.
TARGET_RECALL = 0.999
#: Cells of more than so many blocks are dealt; sample of such a cell; most balls, and the least part of the sample in one.
CROWDED, CELL_SAMPLE, MOST_BALLS, LEAST_BALL = 4, 256, 8, 0.04
_VISITORS = 512


def fit_codebook(halves: np.ndarray, codes: int, rounds: int = 12, apart: float = 1e-12) -> np.ndarray:
    """Lloyd's algorithm from farthest-first seeds; deterministic for given rows.

    Seeds are farther apart than the root of ``apart``, so that no group of near copies is
    cut into many cells.
    """
    chosen = [0]
    distance = ((halves - halves[0]) ** 2).sum(axis=1)
    while len(chosen) < codes and distance.max() > apart:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((halves - halves[chosen[-1]]) ** 2).sum(axis=1))
    centres = halves[chosen].copy()
    for _ in range(rounds):
        near = distances(halves, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, halves)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(centres, axis=0)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


def border_bounds(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For every row and code the squared distance to the border between that code and the row's nearest."""
    d = distances(x, centres)
    own = d.argmin(axis=1)
    apart = np.sqrt(distances(centres, centres))[own]
    gap = np.maximum(d - d[np.arange(len(x)), own][:, None], 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(apart > 0, gap / (2 * apart), 0) ** 2


def multi_sequence(one: np.ndarray, two: np.ndarray, most: float):
    """Cells (i, j) in the order of one[i] + two[j], while that is at most ``most``."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    queue, seen = [(one[a[0]] + two[b[0]], 0, 0)], {(0, 0)}
    while queue and queue[0][0] <= most:
        _, i, j = heapq.heappop(queue)
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(queue, (one[a[x]] + two[b[y]], x, y))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def bounds_of_pairs(x: np.ndarray, y: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each row of x the bound at which its traversal reaches the cell of the same row of y."""
    half, rows = one.shape[1], np.arange(len(x))
    out = border_bounds(x[:, :half], one)[rows, distances(y[:, :half], one).argmin(axis=1)]
    if two.shape[1]:
        out = out + border_bounds(x[:, half:], two)[rows, distances(y[:, half:], two).argmin(axis=1)]
    return out


def traversal_end(drawn: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float, recall: float) -> float:
    """The bound within which the given share of pairs at the threshold, and of the sample's links, is found from either end."""
    rng = np.random.default_rng(0)
    x = drawn[rng.permutation(len(drawn))[:4000]]
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * aside / np.where(length > 0, length, 1)
    found = [np.minimum(bounds_of_pairs(x, y, one, two), bounds_of_pairs(y, x, one, two))]
    links: list[np.ndarray] = []
    for a in range(0, len(drawn), 1000):
        part = drawn[a : a + 1000]
        i, j = np.nonzero(np.triu(part @ drawn.T >= threshold, a + 1))
        if len(i):
            keep = rng.permutation(len(i))[:20_000]
            links.append(np.minimum(bounds_of_pairs(part[i[keep]], drawn[j[keep]], one, two), bounds_of_pairs(drawn[j[keep]], part[i[keep]], one, two)))
    found += [np.concatenate(links)] if links else []
    return float(max(np.quantile(f, recall) for f in found))


def visited(x: np.ndarray, one: np.ndarray, two: np.ndarray, most: float) -> list[list[int]]:
    """The cells that each row's traversal visits, its own one left out."""
    half, out = one.shape[1], []
    low1 = border_bounds(x[:, :half], one)
    low2 = border_bounds(x[:, half:], two) if two.shape[1] else np.zeros((len(x), 1))
    for r in range(len(x)):
        # codes beyond the end by themselves are in no cell within it
        a, b = np.flatnonzero(low1[r] <= most), np.flatnonzero(low2[r] <= most)
        cells = [int(a[i]) * len(two) + int(b[j]) for i, j in multi_sequence(low1[r][a], low2[r][b], most)]
        own = int(distances(x[r : r + 1, :half], one).argmin()) * len(two) + int(distances(x[r : r + 1, half:], two).argmin())
        out.append([c for c in cells if c != own])
    return out


def dense_balls(x: np.ndarray, half_angle: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres of balls that hold much of a sample, and which of them may be linked with a larger one."""
    near, left, centres = x @ x.T >= np.cos(half_angle), np.ones(len(x), bool), []
    while len(centres) < MOST_BALLS:
        count = (near & left).sum(axis=1) * left
        best = int(count.argmax())
        if count[best] < max(3, LEAST_BALL * len(x)):
            break
        members = near[best] & left
        centres.append(x[members].mean(axis=0))
        left &= ~members
    centres = np.array(centres).reshape(-1, x.shape[1])
    if len(centres):
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    # balls whose centres are farther apart than two linking angles have no link
    meets = np.triu(centres @ centres.T >= np.cos(min(4 * half_angle, np.pi)), 1).any(axis=0)
    return centres, meets


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, max_codes: int = MAX_CODES, sample: int = SAMPLE, block: int = BLOCK, target_recall: float = 1.0) -> DataFrame:
    """One row for each vector: its id, ``n_links``, ``component_id`` and ``kept``."""
    import pyarrow as pa

    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    value = F.col("v")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    sound = value.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    length = rows.where(sound).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n = length[0].n if length else 0
    key = F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda x: F.hex(F.xxhash64(x))))))
    keyed = scratch.table(rows.withColumn("node", F.when(F.coalesce(sound & (F.size("v") == n), F.lit(False)), key)))
    classes = keyed.where("node is not null").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("times"), F.min("id").alias("id"))
    classes = scratch.table(classes)
    total = classes.count()
    if not total:
        out = keyed.select(F.col("id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return out.withColumn("kept", F.lit(True))

    span = 1 << 30
    drawn = classes.where(F.pmod(F.xxhash64("node"), F.lit(span)) < int(min(1.0, sample / total) * span)).select("v").collect()
    drawn = unit(np.array([r.v for r in (drawn or classes.limit(1).collect())]))
    drawn = drawn[np.lexsort(drawn.T)]
    half, codes = (n + 1) // 2, min(max_codes, max(2, int(np.ceil(np.sqrt(total / block)))))
    apart = max(1e-12, (1 - threshold) / 2)
    first, second = fit_codebook(drawn[:, :half], codes, apart=apart), fit_codebook(drawn[:, half:], codes, apart=apart) if n > half else np.zeros((1, 0))
    books = spark.sparkContext.broadcast((first, second))
    most = max(0.0, 2 - 2 * threshold) + 1e-9
    if target_recall < 1:
        most = min(most, traversal_end(drawn, first, second, threshold, target_recall) + 1e-9)
    single = vectors.schema[vector_column].dataType.elementType.simpleString() == "float"
    stored = np.float32 if single else np.float64  # what the input holds, so nothing is lost
    half_angle = np.arccos(np.clip(threshold, -1, 1)) / 2

    def units(column) -> np.ndarray:
        return unit(np.frombuffer(b"".join(column.to_pylist()), stored).reshape(len(column), n))

    def file_away(batches):
        one, two = books.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                raw = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, n)
                x = unit(raw)
                cell = distances(x[:, :half], one).argmin(axis=1) * len(two) + distances(x[:, half:], two).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in raw.astype(stored)], pa.binary()), pa.array(visited(x, one, two, most), pa.list_(pa.int32()))], names=["node", "times", "cell", "x", "visits"])

    filed = scratch.table(classes.select("node", "v", "times").mapInArrow(file_away, "node binary, times long, cell int, x binary, visits array<int>"))
    cells = scratch.table(filed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", "n", F.when(F.col("n") > CROWDED * block, F.ceil(F.col("n") / (CROWDED * block))).otherwise(1).cast("int").alias("nb")))

    def centres(batches):
        for batch in batches:
            out: list[tuple] = []
            for r in range(batch.num_rows):
                middles, meets = dense_balls(units(batch.column(1).slice(r, 1).flatten()), half_angle)
                out.append((batch.column(0)[r].as_py(), [m.tobytes() for m in middles], meets.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int32(), pa.list_(pa.binary()), pa.list_(pa.bool_())))], names=["cell", "middles", "meets"])

    def in_balls(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, cell = units(batch.column(3)), batch.column(2).to_numpy()
            ball, loose = np.full(len(x), -1, np.int32), np.ones(len(x), bool)
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                middles, meets = batch.column(6)[int(rows[0])].as_py(), batch.column(7)[int(rows[0])].as_py()
                for k in range(len(middles) - 1, -1, -1):
                    inside = rows[x[rows] @ np.frombuffer(middles[k], np.float64) >= np.cos(half_angle) + 1e-9]
                    ball[inside], loose[inside] = k, meets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(ball), pa.array(loose)], names=[*names, "ball", "loose"])

    names = ["node", "times", "cell", "x", "visits", "nb"]
    placed = filed.join(cells.select("cell", "nb"), "cell").select(*names)
    crowded = cells.where("nb > 1")
    whole = placed.where("nb = 1").withColumns({"ball": F.lit(-1), "loose": F.lit(True)})
    inside_balls = None
    if not crowded.isEmpty():
        rate = F.pmod(F.xxhash64("node", F.lit("cell")), F.lit(span)) < F.floor(F.least(F.lit(1.0), CELL_SAMPLE / F.col("n_rows")) * span)
        sampled = filed.join(crowded.select("cell", F.col("n").alias("n_rows")), "cell").where(rate).groupBy("cell").agg(F.collect_list("x").alias("xs"))
        balls = scratch.table(sampled.mapInArrow(centres, "cell int, middles array<binary>, meets array<boolean>"))
        none = lambda kind: F.array().cast(f"array<{kind}>")
        dealt = placed.where("nb > 1").join(balls, "cell", "left").select(*names, F.coalesce("middles", none("binary")).alias("middles"), F.coalesce("meets", none("boolean")).alias("meets"))
        dealt = scratch.table(dealt.mapInArrow(in_balls, "node binary, times long, cell int, x binary, visits array<int>, nb int, ball int, loose boolean"))
        whole = whole.unionByName(dealt)
        inside_balls = scratch.table(dealt.where("ball >= 0").groupBy("cell", "ball").agg(F.sum("times").alias("total"), F.min("node").alias("other")))
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    whole = whole.withColumn("b", own)
    shipped = ["node", "times", "home", "b0", "ball", "loose", "visits", "x"]
    home = [F.col("cell").alias("home"), F.col("b").alias("b0")]
    # what a vector visits is asked of residents only
    unread = F.array().cast("array<int>").alias("visits")
    residents = whole.select("cell", "b", F.lit(0).alias("side"), "node", "times", *home, "ball", "loose", "visits", "x")
    # vectors outside of balls meet the other blocks of their own cell
    among = whole.where("nb > 1 and loose").select("*", F.explode(F.expr("filter(sequence(0, nb - 1), k -> k <> b)")).alias("to")).select("cell", F.col("to").alias("b"), F.lit(1).alias("side"), "node", "times", *home, "ball", "loose", unread, "x")
    guests = whole.select("*", F.explode("visits").alias("to")).join(cells.select(F.col("cell").alias("to"), F.col("nb").alias("to_nb")), "to")
    guests = guests.select(F.col("to").alias("to_cell"), F.explode(F.expr("sequence(0, to_nb - 1)")).alias("to_b"), "node", "times", *home, "ball", "loose", unread, "x")
    guests = guests.select(F.col("to_cell").alias("cell"), F.col("to_b").alias("b"), F.lit(1).alias("side"), *shipped)
    met = residents.select("cell", "b", "side", *shipped).union(among.select("cell", "b", "side", *shipped)).union(guests)
    met = met.repartition("cell", "b").sortWithinPartitions("cell", "b", "side")

    class Held:
        """Rows of a block as arrays."""

        def __init__(self, batch) -> None:
            self.names = batch.column("node").to_pylist()
            self.times, self.home, self.b0, self.ball = (batch.column(c).to_numpy() for c in ("times", "home", "b0", "ball"))
            self.loose = batch.column("loose").to_numpy(zero_copy_only=False)
            visits = batch.column("visits")
            self.visits = np.sort(np.repeat(np.arange(len(visits)), np.diff(visits.offsets.to_numpy())) << 32 | visits.flatten().to_numpy().astype(np.int64))
            self.x = units(batch.column("x"))

        def visiting(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
            """Whether each of these rows visits the cell beside it."""
            wanted = rows << 32 | cells.astype(np.int64)
            return self.visits[np.minimum(np.searchsorted(self.visits, wanted), len(self.visits) - 1)] == wanted if len(self.visits) else np.zeros(len(rows), bool)

    def emitted(who, many, label):
        rows = np.flatnonzero(many)
        b = np.flatnonzero(label != np.arange(len(who)))
        return pa.RecordBatch.from_arrays([
            pa.array([who[i] for i in rows] + [who[i] for i in b], pa.binary()), pa.array([*many[rows].tolist(), *[0] * len(b)], pa.int64()), pa.array([None] * len(rows) + [who[label[i]] for i in b], pa.binary()),
        ], names=["node", "links", "other"])

    def among_residents(r: Held):
        """Links inside a block, a stripe of rows at a time."""
        many, ends = np.zeros(len(r.x), np.int64), []
        for a in range(0, len(r.x), _VISITORS):
            linked = r.x[a : a + _VISITORS] @ r.x.T >= threshold
            linked &= (r.ball[a : a + _VISITORS, None] < 0) | (r.ball[a : a + _VISITORS, None] != r.ball[None, :])
            linked[np.arange(len(linked)), a + np.arange(len(linked))] = False
            many[a : a + _VISITORS] = linked @ r.times
            i, j = np.nonzero(linked)
            ends.append((i + a, j))
        i, j = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        return emitted(r.names, many, forest(len(r.x), i, j))

    def with_guests(cell: int, block_no: int, r: Held, g: Held):
        linked = g.x @ r.x.T >= threshold
        near = g.home == cell
        # of the own cell: once for a pair that both replicate, never for one ball
        linked[near] &= (~r.loose[None, :] | (g.b0[near][:, None] < block_no)) & ((g.ball[near][:, None] < 0) | (g.ball[near][:, None] != r.ball[None, :]))
        i, j = np.nonzero(linked)
        # what the residents visit tells whether the other end finds the pair too, in a cell of lesser number
        far = np.flatnonzero(g.home[i] < cell)
        drop = far[r.visiting(j[far], g.home[i[far]])]
        linked[i[drop], j[drop]] = False
        i, j = np.nonzero(linked)
        who = r.names + g.names
        many = np.concatenate([linked.T @ g.times, linked @ r.times])
        return emitted(who, many, forest(len(who), j, i + len(r.names)))

    def verify(batches):
        at, held, resident = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, b, side = (batch.column(c).to_numpy() for c in ("cell", "b", "side"))
            new = np.flatnonzero(np.diff(cell, prepend=-1) | np.diff(b, prepend=-1) | np.diff(side, prepend=-1))
            for x, y in zip(new, np.append(new[1:], len(cell)), strict=True):
                here = (int(cell[x]), int(b[x]))
                if here != at:
                    if held:
                        yield among_residents(Held(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))
                    at, held, resident = here, [], None
                if side[x] == 0:
                    held.append(batch.slice(x, y - x))
                    continue
                if resident is None and held:
                    resident = Held(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                    yield among_residents(resident)
                for z in range(x, y, _VISITORS):
                    if resident is not None:
                        yield with_guests(*here, resident, Held(batch.slice(z, min(_VISITORS, y - z))))
        if held:
            yield among_residents(Held(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))

    found = met.mapInArrow(verify, "node binary, links long, other binary")
    if inside_balls is not None:
        member = whole.where("ball >= 0").select("node", "times", "cell", "ball").join(inside_balls, ["cell", "ball"])
        found = found.union(member.select("node", (F.col("total") - F.col("times")).alias("links"), F.when(F.col("node") != F.col("other"), F.col("other")).alias("other")))
    found = scratch.table(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    named = components.join(classes.select("node", "id"), "node")
    least = named.groupBy("component").agg(F.min("id").alias("low"))
    names = named.join(least, "component").select("node", "low")
    result = classes.select("node", "times", "id").join(links, "node", "left").join(names, "node", "left")
    result = scratch.table(result.select("node", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("low", "id").alias("name")))
    out = keyed.select("id", "node").join(result, "node", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("name")).alias("component_id"))
    kept = F.when(F.col("component_id").isNull(), True).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", kept.alias("kept"))


def op4_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over all ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), target_recall=TARGET_RECALL)


#: Every pair by itself: for small tables.
OP4_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT *, row_number() OVER () AS n FROM (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)),
s AS MATERIALIZED (SELECT n, vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NOT NULL AND isfinite(e))) = len(x) AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM s a JOIN s b ON a.n <> b.n AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {THRESHOLD}),
r AS (SELECT n AS a, n AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS n, min(v.vec_id) AS component_id FROM r JOIN v ON v.n = r.b GROUP BY r.a),
k AS (SELECT a AS n, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (n) LEFT JOIN k USING (n)
"""
