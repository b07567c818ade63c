"""Near-duplicates, repeated passages and vectors against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import blocks, embeddings, minhash, substrings
from pagemill.llm.scratch import Scratch
from pagemill.llm.sieve import Sieve, build_sieve


def near_copies(seed=1):
    """Groups of near copies around the threshold, copies, short and odd texts."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(4000)]
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(2, 30)):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 9))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(40)]
    rows += [rows[0], rows[0].upper(), "one", "ONE ", "two", "a b", "", None, " \n\t", "x y z x y z"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in frame.collect()}


def test_near_duplicates_equal_brute_force(spark):
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for k in (2, 5):
        assert found(minhash.near_duplicates(frame, shingle=k)) == brute_components(rows, k)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_ROWS_IN_BLOCK", 4)
    monkeypatch.setattr(minhash, "_SHINGLES_IN_BLOCK", 2000)
    rows = near_copies(2)
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)) == brute_components(rows, 2)


def test_near_duplicate_cases(spark):
    frame = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", "x"), (None, "q r", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, n_shingles string")
    rows = sorted(map(tuple, minhash.near_duplicates(frame, shingle=2).collect()), key=str)
    assert rows == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (2, 0, 2, True), (3, 0, 3, True)], key=str)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0


def test_estimates_correct_for_chance():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64)) for _ in range(2)]
    for shared in (0, 1500, 2700):
        b = np.unique(np.concatenate([sets[0][:shared], sets[1][: 3000 - shared]]))
        signs = minhash.packed(minhash.minima(np.concatenate([sets[0], b]), np.array([0, len(sets[0])])))
        truth = len(np.intersect1d(sets[0], b)) / len(np.union1d(sets[0], b))
        assert abs(minhash.estimates(signs[:1], signs[1:])[0] - truth) < 0.15


def test_forest():
    assert blocks.forest(6, np.array([4, 2, 0]), np.array([2, 1, 5])).tolist() == [0, 1, 1, 3, 1, 0]


def test_sieve_passes_all_keys(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    held = np.array([r.k for r in keys.collect()], np.int64).view(np.uint64)
    sieve = Sieve(build_sieve(keys, "k").value)
    assert sieve.passes(held).all()
    assert sieve.passes(held * np.uint64(3)).mean() < 0.05
    assert not Sieve(build_sieve(keys.limit(0), "k").value).passes(held).any()


def brute_repeats(rows, window=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    count = {}
    for _, w in words:
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - window + 1):
            if count[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    common = [[f"p{k}x{rng.randrange(9)}" for _ in range(n)] for k, n in enumerate((34, 35, 36, 60, 200))]
    rows = []
    for _ in range(60):
        parts = [word() for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(common)
            a = rng.randrange(0, len(p) // 2)
            parts += p[a : a + rng.randrange(20, 120)] + [word() for _ in range(rng.randrange(0, 30))]
        rows.append(rng.choice([" ", "  ", "\n", "\t"]).join(parts))
    rows += ["z " * 100, "only once " * 30, "", None, " ", rows[0], rows[0], "é\u00a0ü " * 40]
    return list(enumerate(rows))


def test_repeats_equal_brute_force(spark):
    rows = passages()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = substrings.remove_repeats(frame)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    got = sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256)).collect()), key=str)
    assert got == brute_repeats(rows)
    before = dict(rows)
    for r in out.collect():
        assert r.n_removed == sum(s.end - s.begin for s in r.repeats)
        assert all(s.end - s.begin >= 35 for s in r.repeats)
        if not r.n_removed:
            assert r.text == before[r.doc_id]


def test_repeat_cases(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, text, "k"), (1, text, "k"), (None, "tail " + text, "k"), (2, None, "k")], "doc_id long, text string, n_words string")
    rows = sorted((str(r.doc_id), r.text, r.n_removed) for r in substrings.remove_repeats(frame).collect())
    assert rows == [("1", "", 40), ("1", "", 40), ("2", None, 0), ("None", "tail ", 40)] or rows == [("1", "", 40), ("1", "", 40), ("2", None, 0), ("None", "tail", 40)]
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 10))
    x = np.concatenate([c + rng.normal(scale=s, size=(n, 10)) for c, s, n in zip(centres, np.linspace(0.05, 0.5, 12), [40] * 12, strict=True)]).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 30, axis=0), x[5:6] * 3])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 10), (9002, [float("nan")] + [1.0] * 9), (9003, [1.0]), (9004, [None] + [1.0] * 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    label = blocks.forest(len(u), *np.nonzero(linked))
    want = {i: (int(linked[i].sum()), int(label[i]), int(label[i]) == i) for i in range(len(u))} | {i: (0, i, True) for i in range(9000, 9005)}
    for block in (16, 256):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame, block=block).collect()}
        assert got == want
    fewer = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame, block=16, target_recall=0.9).collect()}
    assert all(fewer[i] <= want[i][0] for i in want)
    assert sum(fewer.values()) >= 0.9 * sum(n for n, _, _ in want.values())


def linked_counts(rows, threshold=0.95):
    u = rows.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = np.zeros(len(u), np.int64)
    for a in range(0, len(u), 2000):
        out[a : a + 2000] = (u[a : a + 2000] @ u.T >= threshold).sum(axis=1) - 1
    return out


def test_crowded_cells_are_exact(spark):
    """Two groups of near copies far beyond a block, around each other, and strays between them."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=16)
    other = centre + rng.normal(scale=0.35, size=16)
    x = np.concatenate([c + rng.normal(scale=s, size=(n, 16)) for c, s, n in ((centre, 0.02, 900), (other, 0.03, 500), (centre, 0.4, 400), (np.zeros(16), 1.0, 300))]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = linked_counts(x)
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame, block=16).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_recall_of_the_production_traversal(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(3000, 64))
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=unit.shape)
    aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    # partners just within the threshold, the hardest ones to find
    x = np.concatenate([unit, 0.951 * unit + np.sqrt(1 - 0.951**2) * aside])
    frame = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(frame, block=32, target_recall=embeddings.TARGET_RECALL).collect()}
    want = linked_counts(x)
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.995 * want.sum()


def test_fifty_thousand_near_copies(spark):
    frame = spark.range(50_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.sin(k * 7.0) + F.lit(0.001) * F.sin(F.col("id") * (k + 0.5))).alias("embedding"))
    rows = embeddings.near_vectors(frame, target_recall=embeddings.TARGET_RECALL).groupBy("n_links", "component_id").count().collect()
    assert [tuple(r) for r in rows] == [(49_999, 0, 50_000)]


def test_lengths_beyond_the_range_of_squares(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [2e200, -1e200])]
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_vector_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in embeddings.near_vectors(spark.createDataFrame([(1, None)], schema)).collect()] == [(1, 0, 1, True)]
    twins = spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [2.0, 0.0])], schema)
    assert sorted(map(tuple, embeddings.near_vectors(twins).collect()), key=str) == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False)], key=str)


def test_traversal_visits_every_cell_within_the_radius():
    rng = np.random.default_rng(4)
    one, two = rng.random(6), rng.random(5)
    cells = list(embeddings.multi_sequence(one, two, 1.0))
    assert sorted(cells) == sorted((i, j) for i in range(6) for j in range(5) if one[i] + two[j] <= 1.0)
    sums = [one[i] + two[j] for i, j in cells]
    assert sums == sorted(sums)


def test_scratch_needs_a_shared_folder(spark):
    assert Scratch(spark, "x").folder.count("pagemill-x-") == 1
