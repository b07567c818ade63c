"""Windows, semantic cuts and pilots."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions.vectors import TextEncoder, hashing
from pagemill.operators import semantic, structure, windows

RAW = "id string, metadata struct<lco:string,title:string,source_doc:string,source_pages:array<int>>, raw_text string"


def raw(spark, *texts):
    return spark.createDataFrame([(str(i), (None, "t", "d", [1]), t) for i, t in enumerate(texts)], RAW)


def spans(spark, n, size, overlap=0):
    row = spark.range(1).select(windows.window_spans(F.repeat(F.lit("x"), F.lit(n)), size, overlap).alias("s")).first().s
    return None if row is None else [(r.char_start, r.char_end) for r in row]


def test_window_spans(spark):
    assert spans(spark, 2000, 900, 200) == [(0, 900), (700, 1600), (1400, 2000)]
    assert spans(spark, 900, 900) == [(0, 900)]
    assert spans(spark, 901, 900) == [(0, 900), (900, 901)]
    assert spans(spark, 0, 900) is None


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (5, -1), (5, 5)])
def test_window_parameters(spark, size, overlap):
    with pytest.raises(ValueError, match="."):
        windows.window_spans(F.lit("x"), size, overlap)


def test_chunks_cover_the_text(spark):
    chunks = windows.sliding_window(raw(spark, "😀" * 1500, None, "  ", "b" * 10)).collect()
    assert [(c.id, c.metadata.char_start, c.metadata.char_end, len(c.content.body)) for c in sorted(chunks, key=lambda c: c.id)] == [
        ("sliding_window::0#1", 0, 900, 900), ("sliding_window::0#2", 700, 1500, 800), ("sliding_window::3#1", 0, 10, 10)]
    assert chunks[0].metadata.lco == "0"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=60), st.integers(0, 9))
def test_greedy_cuts_follow_the_rule(lengths, seed):
    rng = np.random.default_rng(seed)
    starts = np.cumsum([0, *[n + 1 for n in lengths[:-1]]])
    ends = starts + lengths
    n = len(lengths)
    boundaries = np.unique(np.append(np.arange(1, n, 3), n - 1)) if n > 1 else np.zeros(0, np.int64)
    scores = rng.integers(0, 4, len(boundaries)) / 4
    least, target, most = 10, 20, 30
    want, a = [], 0
    while a < n:
        if ends[-1] - starts[a] <= most:
            want.append((a, n))
            break
        pool = [(s, b) for b, s in zip(boundaries, scores, strict=True) if b > a and starts[a] + least <= starts[b] <= starts[a] + most]
        late = [x for x in pool if starts[x[1]] >= starts[a] + target]
        b = min(late or pool)[1] if pool else next((k for k in range(a + 1, n) if starts[k] >= starts[a] + most), n)
        want.append((a, int(b)))
        a = int(b)
    got = semantic.greedy_cuts(starts, ends, boundaries, scores, least, target, most)
    assert [(x, y) for x, y, _ in got] == want


def test_boundary_candidates():
    assert semantic.boundary_candidates(8, 3) == [1, 4, 7]
    assert semantic.boundary_candidates(7, 3) == [1, 4, 6]
    assert semantic.boundary_candidates(1, 3) == []


def test_repeated_and_null_ids_are_cut_like_others(spark):
    texts = [" ".join(f"{stem}{i % n}" for i in range(700)) for stem, n in (("word", 17), ("other", 23))]
    metadata = "struct<lco:string,title:string,source_doc:string,source_pages:array<int>>"
    spans = lambda rows: sorted((r.metadata.char_start, r.metadata.char_end, r.content.body) for r in semantic.semantic(spark.createDataFrame([(i, None, t) for i, t in rows], f"id string, metadata {metadata}, raw_text string"), encoder=hashing(), model_name="h").collect())
    alone = [spans([(str(i), t)]) for i, t in enumerate(texts)]
    assert spans([("a", texts[0]), ("a", texts[1])]) == sorted(alone[0] + alone[1])
    assert spans([("a", texts[0]), ("a", texts[0]), (None, texts[1])]) == sorted(alone[0] * 2 + alone[1])


def test_semantic_chunks(spark):
    body = " ".join(f"word{i % 17}" for i in range(600))
    rows = semantic.semantic(raw(spark, body, "short text", ""), encoder=hashing(), model_name="h").collect()
    own = sorted((r.metadata for r in rows if r.metadata.parent_id == "0"), key=lambda m: m.chunk_index)
    assert own[0].word_start == 0
    assert own[-1].word_end == 600
    assert all(a.word_end == b.word_start for a, b in zip(own, own[1:], strict=False))
    assert all(450 <= m.char_end - m.char_start <= 1210 for m in own[:-1])
    assert [r.content.body for r in rows if r.metadata.parent_id == "1"] == ["short text"]


def test_structured_chunks(spark):
    schema = "id string, metadata struct<lco:string,chunk_type:string,evidence_ids:array<string>>, content struct<body:string>"
    rows = spark.createDataFrame([("x", ("1", None, []), (" b ",)), ("y", ("1", "lco_statement", ["z"]), (None,))], schema)
    a, b = structure.condition_aware(rows).orderBy("id").collect()
    assert (a.metadata.chunk_type, a.metadata.evidence_ids, a.content.body) == ("condition", ["x"], "b")
    assert (b.metadata.chunk_type, b.metadata.evidence_ids, b.content.body) == ("lco_statement", ["z"], "")
    assert structure.action_logic(rows).orderBy("id").first().metadata.evidence_ids == ["x"]


def test_pilots(spark):
    text = "CONDITION D: x\n D.1 do\n\nCONDITION E: y\nE.1 do\nE.2 do"
    lines = structure.text_lines(spark.createDataFrame([("s", text)], "id string, t string"), "t")
    chunked = structure.structure_islands(lines)
    assert [r.chunk for r in chunked.orderBy("line_no").collect()] == [0, 0, 1, 1, 1]
    together = structure.located_together(chunked, [("D", r"^CONDITION D:"), ("D", r"^D\.1"), ("E", r"^E\.2"), ("E", r"^D\.1"), ("F", "^F")])
    assert {r.letter: r.together for r in together.collect()} == {"D": True, "E": False, "F": False}
    vectors = [(0, 1.0, 0.0)]
    for k, d in enumerate((0.1, 0.2, 0.3, 0.4), 1):
        angle = np.arctan2(vectors[-1][2], vectors[-1][1]) + np.arccos(1 - d)
        vectors.append((k, float(np.cos(angle)), float(np.sin(angle))))
    frame = spark.createDataFrame([("s", k, str(k), [x, y]) for k, x, y in vectors], "id string, line_no int, line string, vector array<double>")
    rows = structure.distance_islands(frame).orderBy("line_no").collect()
    assert rows[0].threshold == pytest.approx(0.325)
    assert [r.chunk for r in rows] == [0, 0, 0, 0, 1]


@given(st.lists(st.sampled_from(["a", "b", "cc", "é", "dd", "😀", "word"]), min_size=0, max_size=90), st.integers(1, 12), st.integers(1, 5), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_running_windows_equal_contexts_as_texts(words, width, step, at_once):
    text, encoder = "  ".join(words), hashing()
    encoder.boundaries_at_once = at_once
    at = np.cumsum([0] + [len(w) + 2 for w in words])[:-1]
    ends = at + [len(w) for w in words] if words else at
    boundaries = np.array(semantic.boundary_candidates(len(words), step), np.int64)
    want = TextEncoder.sides(encoder, text, at, ends, boundaries, width)
    assert encoder.sides(text, at, ends, boundaries, width) == pytest.approx(want, abs=1e-12)
    for i, b in enumerate(boundaries.tolist()):
        left, right = encoder.encode([" ".join(words[max(0, b - width) : b]), " ".join(words[b : b + width])])
        assert want[i] == pytest.approx(float(left @ right), abs=1e-12)


def test_semantic_needs_no_shuffle_and_takes_long_texts(spark):
    body = " ".join(f"w{i % 31}" for i in range(150_000))
    chunks = semantic.semantic(raw(spark, body, body, "short"), encoder=hashing(), model_name="h")
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    rows = sorted((r.metadata.parent_id, r.metadata.chunk_index, r.metadata.word_start, r.metadata.word_end) for r in chunks.collect())
    for own in ("0", "1"):
        spans = [r[2:] for r in rows if r[0] == own]
        assert spans[0][0] == 0 and spans[-1][1] == 150_000 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x1c\x1f\x85\xa0\u180e\u200b\u2003\u2028\u3000😀é")), max_size=6))
@settings(max_examples=200, deadline=None)
def test_word_spans_are_the_runs_of_non_space(texts):
    got = semantic.word_spans.func(pa.array(texts, pa.string())).to_pylist()
    assert got == [[{"s": m.start(), "e": m.end()} for m in re.finditer(r"\S+", t or "")] for t in texts]


def test_word_spans_of_a_batch_take_few_bytes_a_word(spark):
    """A row of Python objects for each word took 400 bytes a word, of every text of a batch at once."""
    texts = ["ab " * 200] * 1000
    tracemalloc.start()
    try:
        assert len(semantic.word_spans.func(pa.array(texts)).flatten()) == 200_000
        assert tracemalloc.get_traced_memory()[1] < 30 * 200_000
    finally:
        tracemalloc.stop()
    rows = spark.createDataFrame([(t,) for t in ("a  bc", "", None)], "t string").select(semantic.word_spans("t").alias("w")).collect()
    assert [r.w for r in rows] == [[(0, 1), (3, 5)], [], []]
