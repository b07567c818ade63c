"""Text rules as column expressions: note scaffolding, labels, sentences, matching.

White space means all Unicode white space with U+001C to U+001F, stripped and collapsed
alike.  Texts keep null unless a rule says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the documents' printed layout.
SPACE = r"[\s\x1c-\x1f]"
#: The characters of ``SPACE`` under (?U).
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
ACTION_LABEL = r"^[A-Z]\.\d+(?:\.\d+)?$"
CONNECTOR = r"^(?:AND|OR)$"
CONDITION_LABEL = r"^[A-Z]\.$"
SECTION_ID = r"\b(\d\.\d+\.\d+)\b"
REFERENCE = r"SR\s+\d+\.\d+\.\d+\.\d+"
NOTE_OPEN = r"^-{3,}NOTES?-{3,}$"
DASH_RUN = r"^-{3,}$"
LABEL_IN_TEXT = r"\b([A-Z]\.\d+(?:\.\d+)?)\b"
TIME_START = r"(?i)^(?:Immediately|\d+(?:\.\d+)?\s+(?:second|minute|hour|day|month|year)s?|Prior\s+to|Before|Upon|Once|Within)\b"
_NOTE_HEAD = rf"-{{3,}}{SPACE}*NOTES?{SPACE}*-{{3,}}"
_EDITOR_NOTE = rf"(?isU)-{{3,}}{SPACE}*REVIEWER['’]S{SPACE}+NOTES?{SPACE}*-{{3,}}.*?-{{3,}}"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is found once for each row or element, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)  # keeps its type, which F.get works out anew for each element


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES))


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(x, f"(?U){SPACE}+", " "))


def _is_plain(x: Column) -> Column:
    """Whether a text is printable ASCII without scaffolds and brackets and with single spaces inside; most texts are so."""
    marked = F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit(" "))
    for mark in ("---", "[", "]", "  "):
        marked |= F.contains(x, F.lit(mark))
    return ~marked & x.rlike(r"\A[ -~]*\z")


def _without_scaffolds(x: Column, note: str) -> Column:
    """A plain text stays as it is, and no other rule reads it."""
    return once(x, lambda x: F.when(_is_plain(x), x).otherwise(_unscaffolded(x, note)))


def _unscaffolded(x: Column, note: str) -> Column:
    x = F.regexp_replace(x, _EDITOR_NOTE, " ")
    x = F.regexp_replace(x, rf"(?isU){_NOTE_HEAD}{SPACE}*(.*?){SPACE}*-{{3,}}", note)
    x = F.regexp_replace(x, rf"(?iU){_NOTE_HEAD}", " ")
    return collapse(F.translate(F.regexp_replace(x, "-{3,}", " "), "[]", ""))


def clean_text(x: Column) -> Column:
    """Editors' notes go, other notes become ``(NOTE: ...)``; no dashes, no brackets."""
    return _without_scaffolds(x, r"(NOTE: $1)")


def normalize_raw(x: Column) -> Column:
    """As ``clean_text``, but notes stay as plain words."""
    return _without_scaffolds(x, " $1 ")


def extract_note(x: Column) -> Column:
    """The first note of a cleaned text, up to its first closing parenthesis; null if none."""
    return F.when(F.contains(x, F.lit("(NOTE:")) & x.rlike(r"\(NOTE:\s*.*?\)"), strip(F.regexp_extract(x, r"\(NOTE:\s*(.*?)\)", 1)))


def strip_note(x: Column) -> Column:
    return strip(F.when(F.contains(x, F.lit("(NOTE:")), F.regexp_replace(x, r"\(NOTE:.*?\)\s*", "")).otherwise(x))


def strip_bracket(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"^\[+", ""))


def is_optional(x: Column) -> Column:
    return F.contains(x, F.lit("[")) | F.contains(x, F.lit("]"))


def parse_label(label: Column) -> Column:
    """Struct (condition, group, alt) of a label such as B.2.1; null for anything else."""
    pattern = r"^([A-Z])\.(\d+)(?:\.(\d+))?$"
    part = lambda k: F.nullif(F.regexp_extract(label, pattern, k), F.lit("")).try_cast("int")
    return F.when(label.rlike(pattern), F.struct(F.regexp_extract(label, pattern, 1).alias("condition"), part(2).alias("group"), part(3).alias("alt")))


def connector_between(before: Column, after: Column) -> Column:
    """What two parsed labels suggest: OR in one group, else AND; null across conditions."""
    return F.when(before["condition"] == after["condition"], F.when(before["group"] == after["group"], "OR").otherwise("AND"))


def references(x: Column) -> Column:
    return F.when(~F.contains(x, F.lit("SR")), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(x, F.lit(REFERENCE), 0))


def sentence(x: Column) -> Column:
    """Stripped, with a full stop unless it ends in one of ``.?!``; null and blank become empty."""
    x = strip(F.coalesce(x, F.lit("")))
    return F.when(x == "", "").when(x.rlike(r"[.?!]$"), x).otherwise(F.concat(x, F.lit(".")))


def truthy(x: Column) -> Column:
    """Null where empty."""
    return F.nullif(x, F.lit(""))


def or_none(x: Column) -> Column:
    """The word None where a template prints a missing value."""
    return F.coalesce(x, F.lit("None"))


def evidence_ids(section: Column, body: Column) -> Column:
    """Ids of the labels printed in a body, in order of first appearance, then its statement's."""
    found = F.transform(F.array_distinct(F.regexp_extract_all(body, F.lit(LABEL_IN_TEXT), 1)), lambda x: F.concat(section, F.lit("/"), x))
    statement = F.concat(section, F.lit("/LCO"))
    empty = F.array().cast("array<string>")
    out = F.when(F.contains(body, F.lit("LCO")) & ~F.array_contains(found, statement), F.array_append(found, statement)).otherwise(found)
    return F.when(truthy(section).isNull(), empty).otherwise(out)


def match_text(x: Column) -> Column:
    """Lower case with single spaces, for keyword containment."""
    return collapse(F.lower(x))


def label_set(labels: Column) -> Column:
    """``{a, b}`` without repeats, in order."""
    return F.concat(F.lit("{"), F.array_join(F.array_distinct(labels), ", "), F.lit("}"))


def one_connector(connectors: Column) -> Column:
    """The connector of a relation: null if none, joined by / if they differ."""
    return truthy(F.array_join(F.array_distinct(F.filter(connectors, lambda c: c.isNotNull() & (c != ""))), "/"))
