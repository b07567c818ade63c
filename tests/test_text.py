"""Text rules on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


CLEAN = [
    ("a ----NOTE---- keep  this ---- b", "a (NOTE: keep this) b", "a keep this b"),
    ("a ---REVIEWER'S NOTE--- drop --- b", "a b", "a b"),
    ("A.1 [Verify] ----NOTES---- tail", "A.1 Verify tail", "A.1 Verify tail"),
    ("x \x1c y", "x y", "x y"),
    ("a ----\u00a0NOTE\u2003----keep\u00a0---- b", "a (NOTE: keep) b", "a keep b"),
    ("-----", "", ""),
    ("", "", ""),
]


@pytest.mark.parametrize(("raw", "cleaned", "plain"), CLEAN)
def test_scaffolds(spark, raw, cleaned, plain):
    assert one(spark, text.clean_text(F.col("t")), t=raw) == cleaned
    assert one(spark, text.normalize_raw(F.col("t")), t=raw) == plain


def test_notes(spark):
    assert one(spark, text.extract_note(F.col("t")), t="do (NOTE: a (b) c) d") == "a (b"
    assert one(spark, text.strip_note(F.col("t")), t="do (NOTE: a) d") == "do d"
    assert one(spark, text.extract_note(F.col("t")), t="none") is None


def test_labels(spark):
    assert tuple(one(spark, text.parse_label(F.col("t")), t="B.2.1")) == ("B", 2, 1)
    assert tuple(one(spark, text.parse_label(F.col("t")), t="A.3")) == ("A", 3, None)
    assert one(spark, text.parse_label(F.col("t")), t="B.") is None


def test_sentences_and_brackets(spark):
    assert [one(spark, text.sentence(F.col("t")), t=x) for x in ("a", "a.", " b? ", "", None)] == ["a.", "a.", "b?", "", ""]
    assert one(spark, text.strip_bracket(F.col("t")), t="[[ A.1") == "A.1"
    assert one(spark, text.is_optional(F.col("t")), t="a]") is True


def test_evidence_ids(spark):
    ids = text.evidence_ids(F.col("s"), F.col("b"))
    assert one(spark, ids, s="3.4.5", b="LCO says B.2 then A.1 then B.2") == ["3.4.5/B.2", "3.4.5/A.1", "3.4.5/LCO"]
    assert one(spark, ids, s="", b="A.1") == []


def test_matching(spark):
    assert one(spark, text.match_text(F.col("t")), t=" The  CAT\n") == "the cat"
    assert one(spark, text.references(F.col("t")), t="SR 3.4.5.1 and SR  1.2.3.4") == ["SR 3.4.5.1", "SR  1.2.3.4"]
    assert one(spark, text.one_connector(F.col("t")), t=["OR", None, "OR", "AND"]) == "OR/AND"
