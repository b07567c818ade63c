"""Versions, line numbers, running numbers, table functions, settings and the grid of top-k."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.config import Config, load_config
from pagemill.functions.vectors import hashing
from pagemill.jobs import stages
from pagemill.operators import retrieval, semantic, table_functions, windows
from pagemill.operators.numbering import numbered
from pagemill.operators.questions import smoke_questions
from pagemill.sources import tables
from pagemill.sources.versions import Tables
from tests.test_chunks import raw


def values(frame):
    return sorted(r[0] for r in frame.collect())


def test_tables_appear_together_and_readers_keep_theirs(spark, tmp_path):
    place = Tables(spark, str(tmp_path / "t"))
    assert place.current().places == {} and place.current().number == 0
    with place.draft() as out:
        assert values(out.write("a", spark.range(3))) == [0, 1, 2]
        assert "a" not in place.current()  # not before all are there
        out.write("b", spark.range(1))
    old = place.current()
    with pytest.raises(RuntimeError, match="half-way"), place.draft() as out:
        out.write("a", spark.range(9))
        raise RuntimeError("half-way")
    assert values(place.current().table("a")) == [0, 1, 2] and place.current().number == 1
    with place.draft() as out:
        out.write("a", spark.range(5, 7))
    assert values(place.current().table("a")) == [5, 6] and values(place.current().table("b")) == [0]
    assert values(old.table("a")) == [0, 1, 2]  # pinned
    assert place.prune(keep=2) == [] and len(place.prune(keep=1)) == 0  # the first draft still holds b
    with place.draft() as out:
        out.write("b", spark.range(2))
    assert len(place.prune(keep=1)) == 1
    assert values(place.current().table("a")) == [5, 6] and values(place.current().table("b")) == [0, 1]
    with pytest.raises(KeyError, match="no table 'c'"):
        place.current().table("c")


def test_drafts_of_two_publishers_lose_nothing(spark, tmp_path):
    one, two = (Tables(spark, str(tmp_path / "t")) for _ in range(2))
    first, second = one.draft(), two.draft()
    with second:
        second.write("b", spark.range(2))
    with first:
        first.write("a", spark.range(1))
    assert sorted(one.current().places) == ["a", "b"] and one.current().number == 2
    assert not one._create("00000000000000000002.claim", "x")


def test_a_failing_stage_leaves_the_version_before(spark, tmp_path, monkeypatch):
    from tests.test_sections import BODY, CONTINUED, HEAD, page

    spark.createDataFrame(page(HEAD + BODY) + page(CONTINUED, 2), stages.WORDS).write.parquet(str(tmp_path / "words"))
    config = Config(str(tmp_path), {"words_path": "words"})
    stages.run(spark, config, last="corpus")
    before = stages.current(spark, config, "processed")
    counts = {name: before.table(name).count() for name in before.places}
    assert set(counts) == {"pages", "sections", "blocks", "raw", "hierarchical", "hierarchical_source", "condition_chunks", "label_gaps"}

    def fails(*_):
        raise OSError("disk")

    monkeypatch.setattr(stages.sections, "condition_records", fails)  # after five tables are written
    with pytest.raises(OSError, match="disk"):
        stages.run(spark, config, last="corpus")
    after = stages.current(spark, config, "processed")
    assert after.places == before.places and {name: after.table(name).count() for name in after.places} == counts


def test_index_tables_are_of_one_version(spark, tmp_path):
    chunks = lambda n: spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("strategy"))
    meta = lambda n: spark.createDataFrame([("s", n)], "strategy string, num_chunks int")
    tables.save_index(chunks(3), meta(3), str(tmp_path / "i"))
    held = tables.load_index(spark, str(tmp_path / "i"))
    tables.save_index(chunks(5), meta(5), str(tmp_path / "i"))
    for (c, m), n in ((held, 3), (tables.load_index(spark, str(tmp_path / "i"), ["s"]), 5)):
        assert c.count() == n and m.first().num_chunks == n
    assert tables.load_index(spark, str(tmp_path / "i"), ["other"])[0].count() == 0


def test_line_numbers_of_files_of_several_splits(spark, tmp_path):
    rng = random.Random(4)
    lines = ["" if rng.random() < 0.1 else json.dumps({"id": f"{n}-{'é' * rng.randrange(60)}"}, ensure_ascii=False) for n in range(4000)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "in/b.jsonl").write_text("\r\n".join(lines[:700]))
    (tmp_path / "in/c.jsonl").write_text("")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        rows = tables.read_jsonl(spark, str(tmp_path / "in"), "id string", line="at").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    want = [(name, no, json.loads(line)["id"]) for name, own in (("a", lines), ("b", lines[:700])) for no, line in enumerate(own, 1) if line]
    assert sorted((r["at"].file.rsplit("/", 1)[1][0], r["at"].no, r.id) for r in rows) == sorted(want)


def test_running_numbers_without_a_window_over_all(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("w")).repartition(7)
    got = numbered(rows.union(rows.where("v < 10")), ["v", "w"], "n")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    listed = sorted((r.n, r.v, r.w) for r in got.collect())
    assert [n for n, _, _ in listed] == list(range(1, 5011)) and [x[1:] for x in listed] == sorted(x[1:] for x in listed)
    assert numbered(rows.limit(0), ["v"], "n").count() == 0


def test_all_smoke_questions_are_numbered(spark):
    records = spark.range(300).select(
        F.col("id").cast("string").alias("id"), F.struct(F.lit("3.4").alias("lco"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("A."), F.col("id"))).alias("action_label")).alias("metadata"),
        F.struct(F.lit("late").alias("condition_text"), F.when(F.col("id") % 2 == 0, "1 hour").alias("completion_time")).alias("content"), (1000 - F.col("id")).alias("o"))
    every = smoke_questions(records, "o", None)
    assert "Window" not in every._jdf.queryExecution().executedPlan().toString()
    ids = sorted((int(r.id.rsplit("_", 1)[1]), r.id, r.evidence_ids[0], r.question) for r in every.collect())
    want = [k for k in range(299, -1, -1) if k % 5 for _ in range(1 + (k % 2 == 0))]
    assert [n for n, *_ in ids] == list(range(1, len(want) + 1)) and [int(e) for *_, e, _ in ids] == want
    few = smoke_questions(records, "o", 25)
    assert "Window" not in few._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in few.collect()) == sorted(i for n, i, *_ in ids if n <= 25)


def test_chunkers_as_table_functions(spark):
    table_functions.register(spark)
    texts = ["x" * 2000, " é😀 " * 700, None, "  ", "short", " ".join(f"w{i % 19}" for i in range(900))]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "id long, text string, body string").repartition(3)
    chunked = lambda frame: sorted((r.metadata.parent_id, r.metadata.chunk_index, r.metadata.char_start, r.metadata.char_end, r.content.body) for r in frame.collect())
    called = lambda call: sorted(map(tuple, spark.sql(f"SELECT * FROM {call}", docs=docs).collect()))
    records = raw(spark, *texts)
    assert called("fixed_length(TABLE(SELECT id, text FROM {docs}), 900)") == chunked(windows.naive_fixed_length(records))
    assert called("sliding_window(TABLE(SELECT * FROM {docs}), 900, 200)") == chunked(windows.sliding_window(records))
    assert called("sliding_window(TABLE({docs}) PARTITION BY (id), 900, 200)") == chunked(windows.sliding_window(records))
    assert called("semantic_chunks(TABLE(SELECT id, text FROM {docs}), 450, 900, 1200, 45, 3)") == chunked(semantic.semantic(records, encoder=hashing(), model_name="h"))
    with pytest.raises(Exception, match="overlap"):
        called("sliding_window(TABLE(SELECT * FROM {docs}), 10, 10)")


def test_balls_give_the_same_rows_for_fewer_products():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 16)) * 4
    chunks = middle[rng.integers(0, 30, 6000)] + 0.2 * rng.normal(size=(6000, 16))
    chunks[100:140] = chunks[7]  # ties
    asked = middle[rng.integers(0, 30, 300)] + 0.2 * rng.normal(size=(300, 16))
    names = pa.array([f"c{(i * 7919) % 6000:05d}" for i in range(6000)])
    held = retrieval.Balls(chunks, names, size=100)
    row, chunk, score = held.best(asked, 5)
    full = np.round(asked @ chunks.T, 9)
    for q in range(300):
        want = sorted(range(6000), key=lambda c: (-full[q, c], names[c].as_py()))[:5]
        assert chunk[row == q].tolist() == want and score[row == q].tolist() == full[q, want].tolist()
    assert held.products < 0.5 * full.size
    assert sum(map(len, held.members)) == 6000
    few = retrieval.Balls(chunks[:3], names[:3])
    assert len(few.best(asked[:2], 5)[0]) == 6


def test_grid_copies_each_side_about_the_root_of_its_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"v{i}", "ab"[i % 2] if i % 50 else None, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(900)]
    chunks = spark.createDataFrame([*rows, ("v1", "a", rows[1][2]), ("none", "a", None)], "name string, s string, vector array<double>")
    asked = chunks.selectExpr("concat('q', name) q", "vector")
    monkeypatch.setattr(retrieval, "BLOCK", 20)
    small = sorted(map(str, retrieval.top_k(asked, chunks, 3, "q", "name", "s").drop("rank").collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(retrieval, "TILE", 9)
    grid = retrieval.top_k(asked, chunks, 3, "q", "name", "s")
    assert sorted(map(str, grid.drop("rank").collect())) == small
    # 46 blocks a side in tiles of 9: 6 x 6 tiles, so six copies of each side
    dealt = retrieval.in_tiles(asked, chunks, "q", "name", F.lit(""), 6, 6)
    held = [(r.side, r.n, r.tiles) for r in dealt.groupBy("side").agg(F.count("*").alias("n"), F.count_distinct("r", "c").alias("tiles")).collect()]
    assert sorted(held) == [(0, 6 * 901, 36), (1, 6 * 901, 36)]


def test_settings_are_checked(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(
        "words_path: hdfs://h/words\npaths: {output_dir: s3://b/out, qa_dir: qa}\nsections: [{start: 3, end: 9}, {start: 12, end: 12, title: x}]\nunknown: 1\n"
        "layout: {defaults: {col1_max: 200}, overrides: {3.4.5: {col2_max: 400, note: x}}}\nevaluation: {k_values: [1, 2]}\nembedding_model: {name: m}\n"
        "chunking: {strategies: [semantic, sliding_window], params: {semantic: {model_name: null, min_chars: 10, batch_size: 4}}}\n"
    )
    own = load_config(str(tmp_path / "c.yaml"))
    assert own.place(own.raw["words_path"]) == "hdfs://h/words" and own.table("output", "runs") == "s3://b/out/runs" and own.table("qa", "x") == f"{tmp_path}/qa/x" and own.folder("chunks") == f"{tmp_path}/chunks"
    assert own.page_ranges == [(3, 9), (12, 12)] and own.k_values == (1, 2) and own.model_name == "m" and own.layout == {"col1_max": 200, "col2_max": 410.0, "header_margin": 95.0} and own.overrides == {"3.4.5": {"col2_max": 400}}
    assert own.strategies() == ["semantic", "sliding_window"] and own.strategies("action_logic") == ["action_logic"]
    assert own.parameters("semantic") == {"min_chars": 10, "target_chars": 900, "max_chars": 1200, "context_window_words": 45, "boundary_step_words": 3, "batch_size": 4}
    (tmp_path / "empty.yaml").write_text("")
    bare = load_config(str(tmp_path / "empty.yaml"))
    assert bare.page_ranges == [] and bare.k_values == (1, 3, 5) and len(bare.strategies()) == 5 and bare.overrides == {}
    for bad, said in (({"sections": [{"start": 5, "end": 4}]}, "sections"), ({"evaluation": {"k_values": [0]}}, "k_values"), ({"chunking": {"strategies": ["x"]}}, "unknown chunking"), ({"chunking": {"params": {"semantic": {"min": 1}}}}, "unknown parameters"), ({"layout": {"defaults": {"col1_max": "a"}}}, "edges")):
        with pytest.raises(ValueError, match=said):
            Config("/b", bad)
    with pytest.raises(ValueError, match="no folder"):
        bare.folder("x")
    (tmp_path / "list.yaml").write_text("- 1")
    with pytest.raises(ValueError, match="no mapping"):
        load_config(str(tmp_path / "list.yaml"))


def test_reports_of_too_many_rows_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "REPORT_ROWS", 10)
    tables.write_csv(spark.range(10), str(tmp_path / "a"))
    for write in (tables.write_csv, tables.write_json):
        with pytest.raises(ValueError, match="more than 10 rows"):
            write(spark.range(11), str(tmp_path / "b"))
