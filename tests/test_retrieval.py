"""Top-k, prompts, metrics, tables, stages and the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.config import Config
from pagemill.jobs import stages
from pagemill.operators import evaluation, retrieval
from pagemill.schemas import QUESTIONS, RAW, RUNS
from pagemill.sources import tables
from pagemill.streaming.chunks import start


def test_top_k_equals_brute_force(spark):
    x = np.random.default_rng(1).integers(-2, 3, (60, 6)).astype(float)
    chunks = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(x)], "c long, s string, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:7])], "q long, vector array<double>")
    got = {(r.s, r.q, r["rank"]): (r.c, r.score) for r in retrieval.top_k(asked, chunks, 4, "q", "c", "s").collect()}
    for s in "ab":
        for q in range(7):
            order = sorted((-(x[q] @ x[i]), i) for i in range(60) if "ab"[i % 2] == s)[:4]
            assert [got[s, q, k + 1] for k in range(4)] == [(i, -v) for v, i in order]
    assert retrieval.top_k(asked, chunks, 0, "q", "c").count() == 0
    assert retrieval.top_k(asked, chunks.limit(0), 3, "q", "c").count() == 0


def run(qa, bodies, strategy="s", ranks=None):
    ranks = ranks or range(1, len(bodies) + 1)
    return (qa, "q", "t", strategy, 5, [(r, 1.0, f"c{r}", [f"e{r}"], b, ("l", "k")) for r, b in zip(ranks, bodies, strict=True)])


def questions(spark, *rows):
    return spark.createDataFrame([(i, t, "q", groups, units, units) for i, t, groups, units in rows], QUESTIONS)


def test_set_recall(spark):
    asked = questions(spark, ("1", "t", [["One"], ["two", " "], [], ["  "]], ["e1", "zz"]), ("2", None, [], []))
    runs = spark.createDataFrame([run("1", ["has  ONE", "zip", "zip", "two"]), run("2", ["one"]), run("3", ["one"])], RUNS)
    details = evaluation.detail_rows(asked, runs)
    rows = {r.qa_id: r for r in details.collect()}
    a, b = rows["1"], rows["2"]
    assert set(rows) == {"1", "2"}
    assert (a.recall_1, a.recall_3, a.recall_5, a.set_recall_3, a.set_recall_5, a.set_recall_rank, a.set_recall_rr, a.first_hit_rank, a.rr) == (0.5, 0.5, 1.0, False, True, 4, 0.25, 1, 1.0)
    assert (b.unit_count, b.recall_5, b.set_recall_5, b.set_recall_rank, b.rr, b.hit_5) == (0, 0.0, False, None, 0.0, False)
    totals = {(r.strategy, r.qa_type): r for r in evaluation.summary(details).collect()}
    assert set(totals) == {("s", "ALL"), ("s", "t"), ("s", "unknown")}
    assert (totals["s", "ALL"].n, totals["s", "ALL"].mrr) == (2, 0.5)
    found = {(r.strategy, r.qa_type): (r.n_hits, r.genuine, r.coincidental, r.genuine_rate) for r in evaluation.diagnostics(asked, runs).collect()}
    assert found == {("s", "ALL"): (2, 1, 1, 0.5), ("s", "t"): (2, 1, 1, 0.5), ("s", "unknown"): (0, 0, 0, 0.0)}
    by_ids = {r.qa_id: r for r in evaluation.detail_rows(asked, runs, by="ids").collect()}
    assert (by_ids["1"].recall_5, by_ids["1"].unit_count, by_ids["1"].first_hit_rank) == (0.5, 2, 1)


def test_missing_rank_and_repeated_questions(spark):
    asked = questions(spark, ("1", "a", [["x"]], []), ("1", "b", [["y"]], [])).withColumn("o", F.monotonically_increasing_id())
    last = evaluation.last_questions(asked, "o")
    assert [r.type for r in last.collect()] == ["b"]
    row = evaluation.detail_rows(last, spark.createDataFrame([run("1", ["y"], ranks=[None])], RUNS)).first()
    assert (row.first_hit_rank, row.hit_1, row.rr, row.set_recall_rank) == (0, True, 0.0, 1)


def test_prompts(spark):
    prompt = retrieval.prompts(spark.createDataFrame([run("1", [" one ", "two", "three"])], RUNS), 2).first()
    assert len(prompt.contexts) == 2
    assert prompt.prompt.endswith("Question:\nq\n\nContext:\n[1] one\n\n[2] two\n\nAnswer:")
    with pytest.raises(ValueError, match="negative"):
        retrieval.prompts(spark.createDataFrame([run("1", [])], RUNS), -1)


def test_jsonl(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    (place / "a.jsonl").write_text('{"id": "1", "type": null}\n\n  \n{"id": "2"}\n')
    frame = tables.read_jsonl(spark, str(place), "id string, type string")
    assert sorted(r.id for r in frame.collect()) == ["1", "2"]
    tables.write_jsonl(frame, str(tmp_path / "out"))
    assert '"type":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    (place / "a.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="not JSON"):
        tables.read_jsonl(spark, str(place), "id string").collect()


def test_lines_have_numbers_and_failures_name_them(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    rows = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string", line="at").collect()
    assert sorted((r.id, r["at"].no) for r in rows) == [("1", 1), ("2", 3)]
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{oops\n')
    with pytest.raises(Exception, match="a.jsonl, line 3"):
        tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string", line="at").collect()


def test_the_last_of_repeated_questions_stays(spark, tmp_path):
    (tmp_path / "qa").mkdir()
    lines = [{"id": str(i % 3), "question": f"q{i}"} for i in range(7)]
    (tmp_path / "qa/qa.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    got = {r.id: r.question for r in stages.questions(spark, Config(str(tmp_path), {})).collect()}
    assert got == {"0": "q6", "1": "q4", "2": "q5"}


def test_json_document(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int").coalesce(1)
    tables.write_json(frame, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.txt"))
    assert json.loads(text) == [{"k": "a", "n": 1}, {"k": "b", "n": None}]
    assert text.count("\n") > 4


def test_top_k_beyond_the_broadcast_bound(spark, monkeypatch):
    vectors = spark.range(300).select(F.col("id").alias("c"), F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("vector"))
    asked = vectors.where("c % 7 = 0").withColumnRenamed("c", "q")
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    broadcast = sorted(map(tuple, retrieval.top_k(asked, vectors, 3, "q", "c").collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, retrieval.top_k(asked, vectors, 3, "q", "c").collect())) == broadcast
    assert len(broadcast) == 3 * 43


def test_pages_without_words(spark):
    words = spark.createDataFrame([("d", 1, "a"), ("d", 2, None), ("d", 1, "b")], "source_doc string, page_no int, text string")
    assert [tuple(r) for r in tables.pages_without_words(words).collect()] == [("d", 2)]


def test_stage_order():
    assert stages.selected_stages("chunks", "retrieve") == ["chunks", "index", "retrieve"]
    with pytest.raises(ValueError, match="after"):
        stages.selected_stages("evaluate", "corpus")


def test_all_stages(spark, tmp_path):
    from tests.test_sections import BODY, CONTINUED, HEAD, page

    words = spark.createDataFrame(page(HEAD + BODY) + page(CONTINUED, 2), stages.WORDS)
    words.write.parquet(str(tmp_path / "words"))
    (tmp_path / "qa").mkdir()
    qa = {"id": "1", "type": "t", "question": "Restore. A.1", "evidence_keywords": [["Restore."]], "evidence_units": ["3.4.5/A.1"], "evidence_ids": ["3.4.5/A.1"]}
    (tmp_path / "qa/qa.jsonl").write_text(json.dumps(qa) + "\n")
    config = Config(str(tmp_path), {"words_path": "words", "sections": [{"start": 1, "end": 2}]})
    stages.run(spark, config)
    done = stages.current(spark, config, "output")
    rows = done.table("eval/details").collect()
    assert {r.strategy for r in rows} == set(config.strategies())
    assert all(r.hit_5 for r in rows)
    assert done.table("rag_inputs").count() == 5
    assert spark.read.csv(done.place("eval/summary"), header=True).where("qa_type = 'ALL'").count() == 5


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([("1", (None, None, None, None, None), "x" * 1000)], RAW)
    rows.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for _ in range(2):
        start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_top_k_bounds_batches_of_blocks_by_bytes(spark):
    """A row holds a block of vectors; 10,000 of them in one batch, as rows alone bound it, are gigabytes of Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(name, None)
    try:
        spark.conf.unset(name)
        rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "id int, vector array<double>")
        found = retrieval.top_k(rows.where("id < 2"), rows.withColumnRenamed("id", "c"), 1, "id", "c")
        assert spark.conf.get(name) == "4m"
        assert [(r.id, r.c) for r in found.orderBy("id").collect()] == [(0, 0), (1, 8)]
    finally:
        spark.conf.unset(name) if kept is None else spark.conf.set(name, kept)
