"""Centroid clustering, whitening and secret scans against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import centroids, secrets, trigrams, whitening

VECTORS = "vec_id long, embedding array<double>, label int, x string, cluster int"


def plain_clusters(rows, k=8, rounds=10, seed=3, scale=1024):
    """Everything in Python integers."""
    kept = [(i, [int(np.floor(scale * np.float64(c))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    centres = [x for _, x in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for n in range(len(centres)):
            members = [x for (_, x), o in zip(kept, own, strict=True) if o == n]
            if members:
                centres[n] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = [(i, *nearest(x)[::-1]) for i, x in kept]
    return sorted(out, key=str), centres


def some_vectors(n=300, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 64))
    rows = [(i, (middle[i % 6] + 0.4 * rng.normal(size=64)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # copies of one vector
    rows += [(0, rows[1][1]), (None, rows[2][1]), (None, rows[2][1]), (2000, [0.0] * 64), (2001, (-np.ones(64) / 3).tolist())]
    odd = [(3000, None), (3001, []), (3002, [1.0] * 63), (3003, [None] + [1.0] * 63), (3004, [float("nan")] + [1.0] * 63), (3005, [float("inf")] + [0.0] * 63), (3006, [1e300] + [0.0] * 63)]
    return rows, odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 7) for i, v in rows], VECTORS)


def test_clusters_equal_plain_integers(spark):
    rows, odd = some_vectors()
    expected, centres = plain_clusters(rows)
    for chunk in (17, 8192):
        got, final = centroids.cluster_vectors(frame(spark, rows + odd).repartition(3), chunk=chunk)
        assert sorted(((r.id, r.cluster, r.distance) for r in got.collect()), key=str) == expected
        assert final == centres


def test_few_or_no_vectors(spark):
    rows, odd = some_vectors()
    for given in ([], odd, rows[:3], rows[:1] * 20):
        got, final = centroids.cluster_vectors(frame(spark, given))
        expected, centres = plain_clusters([r for r in given if r[0] is None or r[0] < 3000])
        assert sorted(((r.id, r.cluster, r.distance) for r in got.collect()), key=str) == expected and final == centres


def test_contract_columns_of_clusters(spark, tmp_path):
    rows, odd = some_vectors(60)
    frame(spark, rows + odd).write.parquet(str(tmp_path / "embeddings.parquet"))
    expected, centres = plain_clusters(rows)
    inertia = {}
    for _, c, d in expected:
        inertia[c] = inertia.get(c, 0) + d
    sha = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    wanted = sorted(((i, c, d, inertia[c], sum(inertia.values()), sha(c)) for i, c, d in expected), key=str)
    assert sorted((tuple(r) for r in centroids.op11_centroid_clustering(spark, str(tmp_path)).collect()), key=str) == wanted


def test_dictionaries_lose_nothing_and_widen_where_rows_repeat():
    rng = np.random.default_rng(2)
    for x in (rng.integers(-400, 400, (500, 64)), np.repeat(rng.integers(-9, 9, (3, 64)), 100, axis=0), rng.integers(0, 2, (200, 64)), rng.integers(-5, 5, (1, 64)), rng.integers(-5, 5, (40, 3))):
        blocks = centroids.encode(x, 8)
        assert (centroids.decode(blocks) == x).all()
        centres = rng.integers(-300, 300, (8, x.shape[1]))
        assert (centroids.by_code(blocks, centres) == ((x[:, None] - centres[None]) ** 2).sum(axis=2)).all()
        near = rng.integers(0, 8, len(x))
        assert (centroids.sums_by_code(blocks, near, 8, x.shape[1]) == [[x[near == c][:, d].sum() for d in range(x.shape[1])] for c in range(8)]).all()
    copies = centroids.encode(np.repeat(rng.integers(-9, 9, (3, 64)), 100, axis=0), 8)
    assert len(copies) == 1 and len(copies[0][1]) == 3  # whole vectors, three of them


def plain_whitening(x):
    """Eigenvectors of the covariance by SVD of the centred rows."""
    apart = np.array([[len(x) * int(v) for v in row] for row in x], object) - np.array([sum(map(int, c)) for c in x.T], object)
    rows = apart.astype(float) / len(x)
    _, s, right = np.linalg.svd(rows, full_matrices=False)
    return [sum(v * v for v in row) for row in apart.tolist()], rows, s**2 / len(x), right


def test_whitening_equals_plain_svd(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(700, 40)) @ rng.normal(size=(40, 40)) * np.geomspace(1, 30, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5, rows[9][1]), (None, rows[10][1])] + [(9000 + i, rows[0][1]) for i in range(50)]
    odd = [(3000, None), (3001, []), (3003, [None] + [1.0] * 39), (3004, [float("nan")] + [1.0] * 39), (3005, [float("inf")] * 40), (3006, [1e300] * 40), (3007, [1.0] * 39)]
    frame(spark, rows + odd).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    deviations, apart, eigenvalues, right = plain_whitening(x)
    got = {}
    for r in whitening.op13_embedding_whitening(spark, str(tmp_path)).collect():
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == len(rows) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(eigenvalues[r.component - 1] / eigenvalues.sum(), rel=1e-9)
    assert len(got) == len({(i, d) for (i, _), d in zip(rows, deviations, strict=True)})
    white = apart @ right.T / np.sqrt(eigenvalues)
    for (i, _), d, w in zip(rows, deviations, white, strict=True):
        own = got[i, d]
        assert sorted(own) == list(range(1, 33))
        assert all(np.abs(own[k + 1]) == pytest.approx(np.abs(w[k]), rel=1e-7, abs=1e-7) for k in range(32))


@pytest.mark.parametrize("kind", ["deficient", "graded", "equal", "single", "few"])
def test_ill_conditioned_and_deficient_rows(spark, kind):
    rng = np.random.default_rng(1)
    x = {
        "deficient": rng.integers(-500, 500, (900, 5)) @ rng.integers(-9, 9, (5, 12)),
        "graded": (rng.normal(size=(900, 8)) * 10.0 ** np.arange(8)).astype(np.int64),
        "equal": np.full((50, 4), 7), "single": np.full((1, 4), 7), "few": rng.integers(-100, 100, (5, 12)),
    }[kind]
    given = spark.createDataFrame([(i, [float(v) / 64 for v in row]) for i, row in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows, fitted = whitening.whiten(given)
    singular = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    rank = int((singular > 1e-9 * max(singular[0], 1e-300)).sum()) if singular[0] > 0 else 0
    assert len(fitted.eigenvalues) == rank and fitted.passes <= whitening.PASSES
    assert np.sqrt(fitted.eigenvalues * fitted.n) == pytest.approx(singular[:rank], rel=1e-8)
    assert whitening.identity_error(rows) < 1e-6
    assert rows.count() == len(x)


def test_whitening_of_nothing(spark):
    empty, fitted = whitening.whiten(frame(spark, []))
    assert empty.count() == 0 and fitted.n == 0 and whitening.identity_error(empty) == 0.0


def test_deviations_beyond_a_long_are_null():
    far = whitening.Whitening(10**7, [0, 0], np.zeros((0, 2)), np.zeros(0), np.zeros(0), 1)
    assert far.deviations(np.array([[300, 1], [3, 4]])) == [(3 * 10**9) ** 2 + 10**14, 25 * 10**14]
    assert far.deviations(np.array([[10**6, 1]])) == [None]


#: The contract's expressions, stated here on their own.
PLAIN = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def plain_spans(text):
    found = []
    for k, (kind, (expression, group, least)) in enumerate(PLAIN.items()):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in expression.finditer(text or "") if len(m.group(group)) >= least]
    return [s for _, _, s in sorted(found)]


def texts_with_secrets():
    rng = random.Random(3)
    pieces = ["password", "PassWord", "passwd", "secret", "ſecret", "token", "toKen", "api_key", "APIKEY", "api-key", "=", ":", " = ", "\"", "'", "AKIA", "akia", "ABCDEFGH12345678", "ABCD123", "deadbeef", "0123456789abcdef0", "é", "ñandú", "😀", "\n", "\t", " ", "abcdefghijkl", "a.b-c=d/e+f_g", "word", "key", "\0"]
    out = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(600)]
    out += ["token=secret: abcdefghijklmnop", "token=api_key: abcdefghijklmnop", "AKIAAKIA" + "A" * 9, "AKIA" + "A" * 13, "AKIA" + "A" * 14, "", None, "a" * 15, "a" * 16, "pa", "ssword", "password" + " " * 50 + "=" + " " * 9 + "'" + "x" * 12]
    out += ["é " * 700_000 + "token: " + "Z" * 20 + " é" * 700_000, "A" * 3_000_000]  # longer than a segment
    return out


def test_secrets_equal_plain_scan(spark, tmp_path):
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts_with_secrets())] + [(1, "x"), (1, "x")]
    spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, kind int").write.parquet(str(tmp_path / "documents.parquet"))
    expected = sorted(((i, *(sum(s.startswith(k) for s in own) for k in PLAIN), hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(own)) for i, own in ((i, plain_spans(t)) for i, t in rows)), key=str)
    got = secrets.op12_secret_scan(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected


def test_published_formats_are_found(spark):
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choice("ABCDEFGHXYZabcxyz0123456789") for _ in range(n))
    planted = {
        "private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + letters(36), "gitlab": "glpat-" + letters(20), "google": "AIza" + letters(35), "slack": "xoxb-" + letters(24),
        "stripe": "sk_live_" + letters(24), "package_index": "npm_" + letters(36), "web_token": f"eyJ{letters(12)}.eyJ{letters(12)}.{letters(12)}", "credentials": "postgres://user:pa5sw0rdX@h",
    }
    assert set(planted) == {r.kind for r in secrets.MORE}
    rows = [(n, f"before {t} after") for n, t in enumerate(planted.values())] + [(99, "http://host/path?user:a@b and -----BEGIN CERTIFICATE----- xox npm_ eyJ")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, (kind, text) in enumerate(planted.items()):
        assert (kind, 7, 7 + len(text)) in got[n]
    assert got[99] == []


def test_queries_never_lose_a_match():
    """Any expression: every text that matches it is a candidate, and mandatory trigrams rule others out."""
    rng = random.Random(7)
    atoms = ["a", "b", "Ab", "xyz", "[ab]", "[a-z]", "\\d", ".", "é", "(?:ab|cd)", "(?:abc|d)?", "(?:ab)+", "a{2,3}", "(x|yy){2}", "b*", "\\b", "^", "(?=a)", "(?i:k)", "(abc|abd|xbc)"]
    texts = ["".join(rng.choice(["a", "b", "ab", "xyz", "é", "c", "cd", "abc", "Abd", "x", "yy", " ", "7", "\n", "K"]) for _ in range(rng.randrange(0, 14))) for _ in range(400)]
    for _ in range(250):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 7)))
        for flags in (0, re.IGNORECASE):
            query = trigrams.trigram_query(pattern, flags)
            index = trigrams.Segment([t.encode() for t in texts], trigrams.Vocabulary(trigrams.asked(query)))
            matching = {n for n, t in enumerate(texts) if re.search(pattern, t, flags | re.ASCII)}
            assert matching <= set(index.candidates(query).tolist()), pattern
    access = secrets.BASE[1].query()
    index = trigrams.Segment([b"AKIA", b"aki kia", b"ak", None, b"", b"x kiaki"], trigrams.Vocabulary(trigrams.asked(access)))
    assert index.candidates(access).tolist() == [0, 1, 5]
    assert secrets.BASE[2].query() is None


def test_postings_reach_over_windows(monkeypatch):
    monkeypatch.setattr(trigrams, "_WINDOW", 7)
    texts = [b"....abc...abcabc", b"ab", b"cab c", None, b"xxxxxxxxxxxxABC"]
    query = trigrams.trigram_query("abc")
    assert trigrams.Segment(texts, trigrams.Vocabulary(trigrams.asked(query))).candidates(query).tolist() == [0, 4]


def test_rules_need_kinds_of_their_own(spark):
    with pytest.raises(ValueError):
        secrets.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), (secrets.BASE[0], secrets.BASE[0]))
    empty = secrets.scan(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.where(F.size("spans") > 0).count() == 0
