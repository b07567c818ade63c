"""The pipeline on documents with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm.scratch import Scratch
from tests.llm.test_duplicates import brute_components, brute_repeats


def documents(spark):
    rng = random.Random(9)
    vocabulary = [a + b + c for a in ("ba", "ko", "ri", "the") for b in ("na", "tu", "sh") for c in ("", "m", "st", "ing")]
    rows = [[i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))), "en", f"s{i % 3}"] for i in range(120)]
    rows[50][1] = rows[3][1]
    words = rows[4][1].split()
    rows[51][1] = " ".join(words[:-1] + ["changed"])
    passage = " ".join(rng.choice(vocabulary) + str(k) for k in range(60))
    for i in (60, 61):
        rows[i][1] += " " + passage
    long_ = " ".join(rng.choice(vocabulary) for _ in range(150))
    rows += [[200, None, "en", "s0"], [201, "", None, None], [202, "12345 67890", "en", "s1"], [203, "zxqv kjwq xzvk qqzx jvkx " * 20, "en", "s1"], [None, rows[7][1] + " more", "en", "s2"], [None, rows[8][1], "en", "s2"], [8, rows[8][1], "en", "s0"], [9, rows[10][1], "en", "s0"], [None, long_, "en", "s1"], [None, long_ + " end", "en", "s1"]]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int")


def test_stages(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    scratch, docs, after = Scratch(spark, "test"), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = after[name] = scratch.table(stage(spark, docs, str(tmp_path)))
    ids = lambda name: sorted(str(r.doc_id) for r in after[name].collect())
    assert ids("language_id") == sorted([*(str(i) for i in range(120)), "8", "9", *["None"] * 4])
    # rows by place: those without an id come last, equal ids in the order of the text hash
    first = after["language_id"].withColumn("h", F.xxhash64("text")).collect()
    first = sorted(((r.doc_id, r.text, r.h) for r in first), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    place = {i: stays for i, (_, _, stays) in brute_components([(k, r[1]) for k, r in enumerate(first)], 5).items()}
    want = sorted((str(r[0]), r[1]) for k, r in enumerate(first) if place[k])
    assert sorted((str(r.doc_id), r.text) for r in after["minhash_near_dedup"].collect()) == want
    assert [i for i, _ in want].count("None") == 1
    assert [i for i, _ in want].count("8") == 1
    second = [(r.doc_id, r.text) for r in after["minhash_near_dedup"].collect()]
    left = sorted((str(i), n - gone) for i, n, gone, _ in brute_repeats(second))
    assert sorted((str(r.doc_id), len(r.text.split())) for r in after["substring_dedup"].collect()) == left
    assert dict(left)["60"] < 250
    mixed = after["mix_sources"].collect()
    assert {str(r.doc_id) for r in mixed} <= {i for i, _ in left}
    assert sum(r["size"] for r in after["best_fit_packing"].collect()) == sum(len(r.text.split()) for r in mixed)
    assert after["mix_sources"].columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == after["best_fit_packing"].count()


def test_empty_table(spark, tmp_path):
    documents(spark).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
