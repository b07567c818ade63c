"""URL filters and source mixing."""

import pytest
from pyspark.sql import functions as F

from pagemill.llm import components, mixing, urls
from pagemill.llm.scratch import Scratch


def verdicts(spark, pages, links=(), rules=urls.RULES):
    frame = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    joined = spark.createDataFrame(list(links), "a string, b string")
    return [(r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame, joined, list(rules)).orderBy("page_id").collect()]


def test_rules(spark):
    got = verdicts(spark, ["http://A.example.ORG/es/1?x#y", "https://example.org/en/12", "http://x.com/fr/", "http://x.com/de/1", "http://x.net/", "x.org/", None, "", "a://org", "http://notexample.org/es/"])
    assert got == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/1", "com/de/", "block"),
        ("x.net", "/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "", None, "allow"), ("notexample.org", "/es/", "org/", "allow")]


def test_blocks_reach_aliases_but_not_allowed_ones(spark):
    chain = [f"http://n{i}.net/" for i in range(40)]
    links = [(a, b) for a, b in zip(chain, chain[1:], strict=False)] + [(chain[20], "http://bad.com/de/x"), (chain[3], "http://ok.com/fr/1"), ("http://p.net/", "http://q.net/")]
    got = verdicts(spark, [*chain, "http://ok.com/fr/1#top", "http://q.net/", chain[0] + "#f", None], [*links, (None, "http://x.net/")])
    assert [g[3] for g in got] == ["block"] * 40 + ["allow", "allow", "block", "allow"]


def test_links_in_html(spark):
    pages = [
        (1, "http://a.net/x/y", '<link href="/c" rel="canonical">'), (2, "http://a.net/x/y", "<LINK REL=canonical HREF='z'>"), (3, "https://a.net", '<meta http-equiv="refresh" content="0; url=//b.net/1">'),
        (4, "http://a.net/", "<p>canonical</p>"), (5, None, '<link rel="canonical" href="/c">'), (6, "http://a.net/", None)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(r.b for r in urls.html_links(frame, "url", "html").collect()) == ["http://a.net/c", "http://a.net/x/z", "https://b.net/1"]


def test_clashing_columns_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "http://x.com/de/", "old", "old")], "page_id long, url string, verdict string, host string")
    none = spark.createDataFrame([], "a string, b string")
    assert urls.judge(frame, none, urls.RULES).first().verdict == "block"
    assert urls.judge(frame.limit(0), none, urls.RULES).count() == 0


def test_components_equal_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5), (7, None)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            parent[find(a)] = find(b)
    key = lambda c: F.md5(F.col(c).cast("string"))
    frame = spark.createDataFrame(edges, "a long, b long").select(key("a").alias("a"), key("b").alias("b"))
    names = {r.k: r.i for r in spark.range(300).select(key("id").alias("k"), F.col("id").alias("i")).collect()}
    groups = {}
    for r in components.connected_components(frame, Scratch(spark, "test")).collect():
        groups.setdefault(r.component, set()).add(names[r.node])
    want = {}
    for a, b in edges:
        if b is not None and a != b:
            want.setdefault(find(a), set()).update((a, b))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def water_fill(sizes, weights, share, cap):
    total, level = share * sum(sizes.values()), {s: 0.0 for s in sizes}
    open_, left = set(sizes), total
    while open_:
        part = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > cap * sizes[s]}
        if not over:
            return {**level, **part}
        for s in over:
            level[s] = cap * sizes[s]
            left -= level[s]
        open_ -= over
    return level


@pytest.mark.parametrize("sizes", [[10, 1000, 20, 500, 5], [1, 1, 1], [100], [7, 0, 3], [3000, 10, 10, 10]])
def test_targets_fill_like_water(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    rows = [(f"d{s}", "w " * n, s) for s, n in named.items()]
    got = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()}
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(named))}
    want = water_fill(named, weights, 1.5, 2.0)
    for s, n in named.items():
        assert got[s].target == pytest.approx(want[s])
        assert got[s]["size"] == n
        assert got[s].taken in (0, n, 2 * n)


def test_mixing_cases(spark):
    rows = [(i, "a b c", "s" if i % 3 else None, "x") for i in range(600)] + [(None, None, "s", "x"), (1, "a b c", "s", "x"), (900, " \t ", "z", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    mixed = mixing.mix(frame)
    again = mixing.mix(frame.repartition(7))
    key = lambda f: sorted((str(r.doc_id), r["size"], r.taken) for r in f.collect())
    assert key(mixed) == key(again)
    sums = {r.source: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()}
    for s in ("s", None):
        assert sums[s].taken == pytest.approx(sums[s].target, rel=0.1)
    assert sums["z"].target == 0
    out = mixing.emit(mixed)
    assert out.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(frame.limit(0)).count() == 0


def test_equal_rows_draw_apart(spark):
    rows = [(1, "a b c", "s")] * 4000 + [(None, "d e", "s")] * 3000 + [(i, "f", "t") for i in range(9000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(frame, weights=(1.0, 1.0))
    sums = {r.source: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()}
    assert sums["s"].n == 7000
    assert sums["s"].taken == pytest.approx(sums["s"].target, rel=0.03)
    count = lambda f: sorted((str(r.doc_id), r.taken, r.n) for r in f.groupBy("doc_id", "taken").agg(F.count("*").alias("n")).where("doc_id is null or doc_id = 1").collect())
    assert count(mixed) == count(mixing.mix(frame.repartition(9, "doc_id"), weights=(1.0, 1.0)))


def test_many_sources(spark):
    rows = [(i, "w " * (i % 7 + 1), f"host{i:05d}") for i in range(3000)]
    got = {r.source: r.target for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    named = {s: len(t.split()) for _, t, s in rows}
    want = water_fill(named, {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(named))}, 1.5, 2.0)
    assert got == pytest.approx(want)
