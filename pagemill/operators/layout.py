"""Geometry of positioned words: rows, columns, bands and regions of a page.

Words are rows (source_doc, page_no, page_height, word_ord, text, x0, x1, top, bottom).
A page's words are gathered in one row by one aggregate (``whole_pages``), so one shuffle by
page serves all steps.  A null text is an empty one.  Reading order is found for all regions
of an Arrow batch together, by array operations (``joined_regions``, ``box_texts``), and so
are a page's regions, bands and texts (``page_texts``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import ACTION_LABEL, CONDITION_LABEL, CONNECTOR, DASH_RUN, NOTE_OPEN, SECTION_ID, SPACES, strip, truthy

#: The number comes first, as sorts compare the first key's prefix before anything else.
PAGE = ["page_no", "source_doc"]
WORD = ("top", "x0", "word_ord", "x1", "bottom", "text")
#: Words whose tops differ by less are on one printed line of a heading.
_LINE = 6


def column_of(x0: Column, first: Column, second: Column) -> Column:
    return F.when(x0 < first, "COND").when(x0 < second, "ACT").otherwise("TIME")


# The geometry of printed rows and of subscripts.
#: A word joins a row whose middle is within this share of the row's height of its own.
_SAME_ROW = 0.7
#: A subscript has at most so many characters, follows one of at most so many, by a gap in this range,
#: is at most so much taller and lower by at least this share of the height.
_SUB_CHARS, _BASE_CHARS, _SUB_GAP, _SUB_TALLER, _SUB_LOWER = 5, 3, (-1.0, 4.0), 1.15, 0.10


def grown_rows(begins: np.ndarray, counts: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, in the order given, its row in its region and that row's final top.

    Words of a region come one after the other from ``begins``.  A word joins the first row
    whose box, grown by the words before it, is level with it, or opens a row.  Step t takes
    the t-th word of all regions at once.
    """
    row, row_top = np.zeros(len(top), np.int64), np.zeros(len(top))
    order = np.argsort(-counts, kind="stable")
    first, size = begins[order], counts[order]
    low, high, used = np.full((len(order), 8), np.nan), np.full((len(order), 8), np.nan), np.zeros(len(order), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))  # regions with more than t words
        at, k = first[:n] + t, int(used[:n].max(initial=0))
        if k == low.shape[1]:
            low, high = (np.concatenate([x, np.full_like(x, np.nan)], axis=1) for x in (low, high))
        middle = (top[at] + bottom[at]) / 2
        a, b = low[:n, : k + 1], high[:n, : k + 1]
        level = np.abs(middle[:, None] - (a + b) / 2) <= _SAME_ROW * np.maximum(1.0, b - a)  # no row is level if it is not open yet
        joins = level.any(axis=1)
        own = np.where(joins, level.argmax(axis=1), used[:n])
        low[np.arange(n), own] = np.fmin(low[np.arange(n), own], top[at])
        high[np.arange(n), own] = np.fmax(high[np.arange(n), own], bottom[at])
        used[:n] += ~joins
        row[at] = own
    place = np.repeat(np.arange(len(order)), size)
    at = np.repeat(first, size) + np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
    row_top[at] = low[place, row[at]]
    return row, row_top


def _opens(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _rows(region: np.ndarray, counts: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``grown_rows`` of words sorted by region and top.

    Of neighbours with one top and bottom only the first is placed: its row holds their
    middle from then on, and no row before it has changed, so the others join it too.
    """
    opens = _opens(region, top, bottom) | ~(bottom >= top)
    at = np.flatnonzero(opens)
    counts = np.bincount(region[at], minlength=len(counts))
    row, row_top = grown_rows(np.cumsum(counts) - counts, counts, top[at], bottom[at])
    of = np.cumsum(opens) - 1
    return row[of], row_top[of]


def _printed(region: np.ndarray, row_top: np.ndarray, row: np.ndarray, x0: np.ndarray) -> np.ndarray:
    """The order of words by region, row and x0; regions that are in order already are not sorted."""
    falls = [k[1:] < k[:-1] for k in (row_top, row)]
    ties = [k[1:] == k[:-1] for k in (row_top, row)]
    back = (region[1:] == region[:-1]) & (falls[0] | ties[0] & (falls[1] | ties[1] & ~(x0[1:] >= x0[:-1])))
    order = np.arange(len(region))
    moved = np.zeros(int(region[-1]) + 1 if len(region) else 0, bool)
    moved[region[1:][back]] = True
    at = np.flatnonzero(moved[region])
    order[at] = at[np.lexsort((x0[at], row[at], row_top[at], region[at]))]
    return order


def _read(counts: np.ndarray, top: np.ndarray, x0: np.ndarray, x1: np.ndarray, bottom: np.ndarray, text: pa.Array) -> pa.Array:
    """The texts of regions of so many words each, which are sorted by region, top, x0 and order."""
    import pyarrow.compute as pc

    region = np.repeat(np.arange(len(counts)), counts)
    row, row_top = _rows(region, counts, top, bottom)
    order = _printed(region, row_top, row, x0)
    top, x0, x1, bottom, row, text = top[order], x0[order], x1[order], bottom[order], row[order], text.take(pa.array(order))
    chars = pc.utf8_length(text).to_numpy(zero_copy_only=False)

    same = np.zeros(len(row), bool)
    same[1:] = (row[1:] == row[:-1]) & (region[1:] == region[:-1])
    before = np.maximum(np.arange(len(row)) - 1, 0)
    tall, own = np.maximum(1.0, bottom - top)[before], np.maximum(1.0, bottom - top)
    gap, lower = x0 - x1[before], (top + bottom) / 2 - ((top + bottom) / 2)[before]
    short = (chars > 0) & (chars <= _SUB_CHARS) & (chars[before] > 0) & (chars[before] <= _BASE_CHARS)
    glued = same & short & (gap >= _SUB_GAP[0]) & (gap <= _SUB_GAP[1]) & (own <= _SUB_TALLER * tall) & (lower > _SUB_LOWER * tall)
    between = pa.array(["", "_", " "]).take(pa.array(np.where(_opens(region), 0, np.where(glued, 1, 2))))
    pieces = pc.binary_join_element_wise(between, text, "")
    return pc.binary_join(pa.ListArray.from_arrays(_ends(counts), pieces), "")


def _ends(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def _numbers(rows: pa.Array, *names: str) -> list[np.ndarray]:
    return [rows.field(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]


def joined_regions(regions):
    """The text of each region (a list of word structs) in reading order, for a whole Arrow array.

    Words are sorted by top, x0 and order and form rows; rows go by their tops, words in a
    row by x0; a subscript is glued to the word before it with ``_``.  Null and empty
    regions have no text; a null word is an empty one.
    """
    import pyarrow.compute as pc

    counts = pc.fill_null(pc.list_value_length(regions), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = regions.flatten()
    top, x0, x1, bottom, number = _numbers(words, "top", "x0", "x1", "bottom", "word_ord")
    order = np.lexsort((number, x0, top, np.repeat(np.arange(len(counts)), counts)))
    text = pc.fill_null(words.field("text"), "").take(pa.array(order))
    return _read(counts, top[order], x0[order], x1[order], bottom[order], text)


def _placed(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Numbers that compare by group first and by value then."""
    out = np.empty(len(value), np.complex128)
    out.real, out.imag = group, value
    return out


#: Words of an array: numbers as arrays, texts as an Arrow array.
_Words = dict[str, np.ndarray]


def _boxed(w: _Words, text: pa.Array, page: np.ndarray, col: np.ndarray, lo: np.ndarray, hi: np.ndarray, on: np.ndarray, by_line: np.ndarray, by_first: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Texts, first words and lines of boxes (see ``box_texts``) over words sorted by page, top, x0 and order.

    Words are dealt by page and column once; a box is a stretch of them.
    """
    import pyarrow.compute as pc

    group, own = w["page"] * 8 + w["col"], page * 8 + col
    order = np.argsort(group, kind="stable")
    tops, lines = _placed(group[order], w["top"][order]), _placed(group[order], w["line"][order])
    start, stop = np.searchsorted(tops, _placed(own, lo)), np.searchsorted(tops, _placed(own, hi))
    one = np.flatnonzero(~np.isnan(on))
    at = _placed(own[one], on[one])
    start[one], stop[one] = np.maximum(start[one], np.searchsorted(lines, at)), np.minimum(stop[one], np.searchsorted(lines, at, side="right"))
    sizes = np.maximum(stop - start, 0)
    box = np.repeat(np.arange(len(sizes)), sizes)
    at = order[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(box))]

    read = lambda sizes, at: _read(sizes, *(w[k][at] for k in ("top", "x0", "x1", "bottom")), text.take(pa.array(at)))
    joined = pc.if_else(pa.array(sizes > 0), read(sizes, at), pa.scalar(None, pa.string()))
    asked = by_line[box]
    row_box, row_at = box[asked], at[asked]
    begins = np.flatnonzero(_opens(row_box, w["line"][row_at]))
    rows = read(np.diff(np.append(begins, len(row_at))), row_at)
    rows = pa.ListArray.from_arrays(_ends(np.bincount(row_box[begins], minlength=len(sizes))), rows)
    asked = by_first[box]
    first_box, first_at = box[asked], at[asked]
    more = ~_of(w["kind"][first_at], "bracket", "blank")
    first_box, first_at = first_box[more], first_at[more]
    by = np.lexsort((*(w[k][first_at] for k in ("number", "x0", "line")), first_box))
    begins = by[_opens(first_box[by])]
    taken = np.full(len(sizes), -1)
    taken[first_box[begins]] = first_at[begins]
    return joined, text.take(pa.array(taken, pa.int64(), mask=taken < 0)), rows


def box_texts(words, boxes):
    """For each box of each page its words in reading order, for whole Arrow arrays; null if it holds none.

    A box holds the words with lo <= top < hi in its column, on one printed line if ``line``
    is given.  ``lines`` asks for the texts of its lines one by one, ``first`` for its first
    word (by line, x0 and order) that is more than a bracket.
    """
    import pyarrow.compute as pc

    counts, n_boxes = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, boxes))
    words, boxes = words.flatten(), boxes.flatten()
    names = ("top", "x0", "x1", "bottom", "number", "line", "col", "kind")
    w = dict(zip(names, _numbers(words, *(n.replace("number", "word_ord") for n in names)), strict=True)) | {"page": np.repeat(np.arange(len(counts)), counts)}
    order = np.lexsort((w["number"], w["x0"], w["top"], w["page"]))
    text = pc.fill_null(words.field("text"), "").take(pa.array(order))
    lo, hi, on, col = _numbers(boxes, "lo", "hi", "line", "col")
    asked = (boxes.field(n).to_numpy(zero_copy_only=False).astype(bool) for n in ("lines", "first"))
    joined, first, lines = _boxed({k: v[order] for k, v in w.items()}, text, np.repeat(np.arange(len(n_boxes)), n_boxes), col, lo, hi, on, *asked)
    return pa.ListArray.from_arrays(_ends(n_boxes), pa.StructArray.from_arrays([joined, first, lines], ["joined", "first", "lines"]))


def reading_order(words: list[dict]) -> str:
    """Words of one region as text."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([(n, pa.string() if n == "text" else pa.float64()) for n in WORD]))
    return joined_regions(pa.array([words], kind))[0].as_py()


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_TEXT = T.StringType()


@F.arrow_udf(_TEXT)
def join_words(regions: pa.Array) -> pa.Array:
    return joined_regions(regions)


@F.arrow_udf(T.ArrayType(_record(joined=_TEXT, first=_TEXT, lines=T.ArrayType(_TEXT))))
def join_boxes(words: pa.Array, boxes: pa.Array) -> pa.Array:
    return box_texts(words, boxes)


#: Found once, each in a step of its own: the planner may not merge them into what reads their result.
join_words, join_boxes = join_words.asNondeterministic(), join_boxes.asNondeterministic()


#: What a word is by its text alone; no text is of two kinds.
KINDS = ("word", "foot", "completion", "surveillance", "frequency", "statement", "condition", "action", "connector", "note", "dashes", "bracket", "blank")
#: Columns of a placed word: the narrative, and the three of a table.
NARRATIVE, COND, ACT, TIME = range(4)
#: Where ``$`` and ``\b`` match, for the expressions of Arrow.
_END, _WORD_ENDS = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z", r"(?:[^\p{L}\p{Nd}\p{Mn}_]|\z)"
_STATEMENT = r"^LCO[ \t\n\x0b\f\r]+\d+\.\d+\.\d+" + _WORD_ENDS
_FOOT = r"^(?:CE\z|BWR/\d+$|\d+\.\d+\.\d+-\d+$|Rev\.)"


def _of(kinds: np.ndarray, *names: str) -> np.ndarray:
    return np.isin(kinds, [KINDS.index(n) for n in names])


def kinds_of(text: pa.Array) -> np.ndarray:
    """The number of each word's kind in ``KINDS``; texts that occur again are judged once."""
    import pyarrow.compute as pc

    coded = text.dictionary_encode()
    texts = coded.dictionary
    matches = lambda pattern: pc.match_substring_regex(texts, pattern.replace("$", _END))
    rules = {
        "completion": pc.equal(texts, "COMPLETION"), "surveillance": pc.equal(texts, "SURVEILLANCE"), "frequency": pc.is_in(texts, pa.array(["REQUIREMENTS", "FREQUENCY"])), "bracket": pc.equal(texts, "["), "statement": pc.starts_with(texts, "LCO"),
        "foot": matches(_FOOT), "condition": matches(CONDITION_LABEL), "action": matches(ACTION_LABEL), "connector": matches(CONNECTOR), "note": matches(NOTE_OPEN), "dashes": matches(DASH_RUN), "blank": pc.equal(pc.utf8_trim(pc.utf8_ltrim(texts, "["), SPACES), ""),
    }
    kinds = np.zeros(len(texts), np.int64)
    for kind, holds in reversed(rules.items()):
        kinds[holds.to_numpy(zero_copy_only=False)] = KINDS.index(kind)
    return kinds[coded.indices.to_numpy()]


def whole_pages(words: DataFrame) -> DataFrame:
    """One row for each page, by one aggregate: its height and ``words``, structs of ``WORD``.

    Rows are words, or stretches of a page's words in an array ``words`` of such structs,
    which is gathered at less cost than the words one by one.
    """
    rows = words.where("page_no is not null").withColumn("source_doc", F.coalesce("source_doc", F.lit("")))
    if "words" in words.columns:
        gathered = F.flatten(F.collect_list("words"))
    else:
        rows = rows.where("top is not null and not isnan(top) and bottom is not null and x0 is not null and x1 is not null")
        gathered = F.collect_list(F.struct(*WORD))
    return rows.groupBy(*PAGE).agg(F.max("page_height").alias("page_height"), gathered.alias("words"))


def bands(anchors: DataFrame, bottom: str, *keys: str) -> DataFrame:
    """Half-open bands [band_top, band_bottom) from distinct anchor tops; the last ends at ``bottom``."""
    order = W.partitionBy(*PAGE, *keys).orderBy("band_top")
    distinct = anchors.select(*PAGE, *keys, F.col("top").alias("band_top"), F.col(bottom).alias("_end")).distinct()
    return distinct.withColumn("band_bottom", F.coalesce(F.lead("band_top").over(order), F.col("_end"))).drop("_end")


def in_bands(words: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Words with the band that holds their top; bands of a page do not overlap.

    Words and beginnings of bands are merged in the order of their tops: a word's band is
    the last one that began, so the work grows with the sum of both and not their product.
    """
    by, own = [*PAGE, *keys], [c for c in spans.columns if c not in (*PAGE, *keys)]
    band = F.struct("band_top", "band_bottom", *(c for c in own if c not in ("band_top", "band_bottom")))
    begins = spans.select(*by, F.col("band_top").alias("top"), band.alias("_band"))
    merged = words.withColumn("_word", F.lit(True)).unionByName(begins, allowMissingColumns=True)
    last = F.max("_band").over(W.partitionBy(*by).orderBy("top").rangeBetween(W.unboundedPreceding, W.currentRow))
    held = merged.withColumn("_band", last).where("_word and top >= _band.band_top and top < _band.band_bottom")
    return held.select(*words.columns, "_band.*")


def _first(page: np.ndarray, holds: np.ndarray, n: int) -> np.ndarray:
    """For each page the place of its first word for which it holds, or -1."""
    out, at = np.full(n, -1), np.flatnonzero(holds)
    begins = at[_opens(page[at])]
    out[page[begins]] = begins
    return out


def _last_bottom(w: _Words, holds: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The greatest bottom of each page's words for which it holds."""
    out, at = none.copy(), np.flatnonzero(holds)
    begins = np.flatnonzero(_opens(w["page"][at]))
    if len(at):
        out[w["page"][at[begins]]] = np.maximum.reduceat(w["bottom"][at], begins)
    return out


def _surveillance(w: _Words, narr_top: np.ndarray) -> np.ndarray:
    """Whether each word opens a table of surveillances: the next word on its line says so."""
    out, tops = np.zeros(len(w["top"]), bool), _placed(w["page"], w["top"])
    asked = np.flatnonzero(_of(w["kind"], "surveillance") & (narr_top[w["page"]] <= w["top"]))
    place = lambda k, side: np.searchsorted(tops, _placed(w["page"][asked], w["top"][asked] + k * (_LINE + 1)), side)
    start, stop = place(-1, "left"), place(1, "right")
    for part in np.array_split(np.arange(len(asked)), 1 + int((stop - start).sum()) // 1_000_000):  # bounded, however many there are
        sizes = (stop - start)[part]
        own = np.repeat(asked[part], sizes)
        at = np.repeat(start[part] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(own))
        follows = (np.abs(w["top"][at] - w["top"][own]) < _LINE) & ((w["x"][at] > w["x"][own]) | (w["x"][at] == w["x"][own]) & (w["nth"][at] > w["nth"][own]))
        own, at = own[follows], at[follows]
        by = np.lexsort((w["kind"][at], w["nth"][at], w["x"][at], own))
        first = by[_opens(own[by])]
        out[own[first]] = _of(w["kind"][at[first]], "frequency")
    return out


def _zones(w: _Words, height: np.ndarray, col1: np.ndarray, col2: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The column of each word, -1 outside narrative and table, and the top of each page's table (nan: none).

    The narrative goes from the heading to the table, the table from its head to a footer, to
    surveillances or to the end of the page; a page without a height goes on to its last
    word.  Of the two sides of a comparison only the right one may be nan, which is greatest.
    """
    page, top, n = w["page"], w["top"], len(height)
    first = lambda holds, none: np.where((at := _first(page, holds, n)) >= 0, np.append(top, np.nan)[at], none)
    narr_top = _last_bottom(w, ~(margin[page] <= top), np.zeros(n))
    end = first(_of(w["kind"], "foot"), height)
    level = np.abs(top - first(_of(w["kind"], "completion"), np.nan)[page]) < _LINE
    line_top = first(level, np.nan)
    table, tbl_top = ~np.isnan(line_top), _last_bottom(w, level, np.full(n, np.nan))
    end = first(_surveillance(w, narr_top), end)
    narr_bottom = np.where(table, line_top, end)
    narrative = (narr_top[page] <= top) & ~(narr_bottom[page] <= top)
    inside = (tbl_top[page] <= top) & ~(end[page] <= top)
    column = np.where(w["x0"] < col1[page], COND, np.where(w["x0"] < col2[page], ACT, TIME))
    return np.where(narrative, NARRATIVE, np.where(inside, column, -1)), tbl_top


def _notes(w: _Words):
    """Whether words are inside a note: each ends with a dash run and opens at the first opening since the one before."""
    at = np.flatnonzero((w["col"] == ACT) & _of(w["kind"], "note", "dashes"))
    at = at[np.lexsort((*(w[k][at] for k in ("kind", "nth", "x", "top")), w["page"][at]))]
    closes = _of(w["kind"][at], "dashes")
    begins = np.flatnonzero(_opens(w["page"][at], np.cumsum(closes) - closes))
    ends = np.append(begins[1:], len(at))[: len(begins)] - 1
    span = (ends > begins) & closes[ends] if len(at) else np.zeros(0, bool)
    page, opens, close = w["page"][at[begins[span]]], w["top"][at[begins[span]]], w["top"][at[ends[span]]]
    opened = _placed(page, opens)

    def inside(at: np.ndarray) -> np.ndarray:
        if not len(page):
            return np.zeros(len(at), bool)
        k = np.searchsorted(opened, _placed(w["page"][at], w["top"][at])) - 1
        return (k >= 0) & (page[k] == w["page"][at]) & (w["top"][at] < close[k])

    return inside


def _bands(w: _Words, tbl_top: np.ndarray):
    """(page, a, z) of the conditions' bands, the pages that hold a condition, and the band of each of some words or -1.

    A page without a condition has one band, its whole table; what is above the first one is
    in none.
    """
    at = np.flatnonzero((w["col"] == COND) & _of(w["kind"], "condition"))
    at = at[_opens(w["page"][at], w["top"][at])]
    anchored = np.zeros(len(tbl_top), bool)
    anchored[w["page"][at]] = True
    whole = np.flatnonzero(~anchored & ~np.isnan(tbl_top))
    page, a = np.concatenate([w["page"][at], whole]), np.concatenate([w["top"][at], tbl_top[whole]])
    order = np.argsort(page, kind="stable")
    page, a = page[order], a[order]
    z, begun = _following(page, a, np.full(len(a), np.inf)), _placed(page, a)

    def band(at: np.ndarray) -> np.ndarray:
        if not len(page):
            return np.full(len(at), -1)
        k = np.searchsorted(begun, _placed(w["page"][at], w["top"][at]), side="right") - 1
        return np.where((k >= 0) & (page[k] == w["page"][at]) & (w["top"][at] < z[k]), k, -1)

    return page, a, z, anchored, band


def _following(key: np.ndarray, value: np.ndarray, none: np.ndarray) -> np.ndarray:
    """The next value of the same key."""
    out = none.copy()
    same = np.flatnonzero(key[1:] == key[:-1])
    out[same] = value[same + 1]
    return out


def _bracketed(w: _Words, asked: np.ndarray, inside, band) -> np.ndarray:
    """Whether the action word before each one in its band is a bracket outside a note."""
    at = np.flatnonzero((w["col"] == ACT) & np.isin(w["page"], w["page"][asked]))
    of = band(at)
    at, of = at[of >= 0], of[of >= 0]
    by = np.lexsort((*(w[k][at] for k in ("top", "kind", "nth", "x", "line")), of))
    at, of = at[by], of[by]
    begins = np.flatnonzero(_opens(of, *(w[k][at] for k in ("line", "x", "nth"))))
    before = np.repeat(begins, np.diff(np.append(begins, len(at)))) - 1
    opens = np.zeros(len(w["top"]), bool)
    has = (before >= 0) & (of[before] == of) if len(at) else np.zeros(0, bool)
    mark = at[before[has]]
    opens[at[has]] = _of(w["kind"][mark], "bracket") & ~inside(mark)
    return opens[asked]


def _actions(w: _Words, tbl_bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, b, z) of the actions: they begin at labels and connectors outside notes; ``[`` outside a note makes the label after it begin one too."""
    page, _, ends, _, band = tbl_bands
    inside = _notes(w)
    at = np.flatnonzero((w["col"] == ACT) & _of(w["kind"], "action", "connector"))
    begins = ~inside(at)
    asked = np.flatnonzero(~begins & _of(w["kind"][at], "action"))
    if len(asked):
        begins[asked] = _bracketed(w, at[asked], inside, band)
    at = at[begins]
    at = at[_opens(w["page"][at], w["top"][at])]
    of = band(at)
    at, of = at[of >= 0], of[of >= 0]
    return of, w["top"][at], _following(of, w["top"][at], ends[of])


def page_texts(words: pa.Array, height: pa.Array, *layout: pa.Array) -> pa.Array:
    """What is printed on each page (words, its height, col1_max, col2_max, header_margin), for whole Arrow arrays.

    ``heading``, above the margin; ``narrative``; ``trimmed``, the narrative from the line that opens the statement, if
    another line is before it; ``bands`` of the table with the texts of their columns, the
    lines of their times if the page has a condition (``anchored``), and ``steps``, the
    actions at ``b``, with the ``first`` word that is more than a bracket, without brackets
    before it.  Null without a word that has a place.
    """
    import pyarrow.compute as pc

    n, counts = len(words), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = words.flatten()
    names = ("top", "x0", "x1", "bottom", "number")
    w = dict(zip(names, _numbers(words, *(k.replace("number", "word_ord") for k in names)), strict=True)) | {"page": np.repeat(np.arange(n), counts)}
    known = ~np.isnan(w["top"])
    for x in (words, *(words.field(k) for k in ("x0", "x1", "bottom"))):
        if x.null_count:
            known &= x.is_valid().to_numpy(zero_copy_only=False)
    order = np.flatnonzero(known)
    order = order[np.lexsort(tuple(w[k][order] for k in ("number", "x0", "top", "page")))]
    w, text = {k: v[order] for k, v in w.items()}, pc.fill_null(words.field("text"), "").take(pa.array(order))
    w |= {"line": np.rint(w["top"]), "kind": kinds_of(text), "x": np.where(np.isnan(w["x0"]), np.inf, w["x0"]), "nth": np.where(np.isnan(w["number"]), -np.inf, w["number"])}
    col1, col2, margin = (x.to_numpy(zero_copy_only=False) for x in layout)
    above = np.flatnonzero(~(margin[w["page"]] <= w["top"]))
    heading = _read(np.bincount(w["page"][above], minlength=n), *(w[k][above] for k in ("top", "x0", "x1", "bottom")), text.take(pa.array(above)))
    with np.errstate(invalid="ignore"):
        w["col"], tbl_top = _zones(w, pc.fill_null(height, float("inf")).to_numpy(zero_copy_only=False), col1, col2, margin)
    seen = np.bincount(w["page"], minlength=n) > 0
    inner = np.flatnonzero(w["col"] >= 0)
    w, text = {k: v[inner] for k, v in w.items()}, text.take(pa.array(inner))
    page, a, z, anchored, _ = tbl_bands = _bands(w, tbl_top)
    of, b, ends = _actions(w, tbl_bands)

    said = np.flatnonzero((w["col"] == NARRATIVE) & _of(w["kind"], "statement"))
    said = said[_opens(w["page"][said], w["line"][said])]
    full = lambda n, x: np.full(n, x, np.float64)
    # boxes: narratives, lines that may open the statement, three columns of each band, two of each action
    parts = [
        (np.arange(n), NARRATIVE, full(n, -np.inf), full(n, np.inf), full(n, np.nan)), (w["page"][said], NARRATIVE, full(len(said), -np.inf), full(len(said), np.inf), w["line"][said]),
        *((page, col, a, z, full(len(a), np.nan)) for col in (COND, ACT, TIME)), *((page[of], col, b, ends, full(len(b), np.nan)) for col in (ACT, TIME)),
    ]
    sizes = [len(p[0]) for p in parts]
    cols = np.repeat([p[1] for p in parts], sizes)
    boxes = [np.concatenate([p[k] for p in parts]) for k in (0, 2, 3, 4)]
    by_line, by_first = (np.repeat([k == i for k in range(len(parts))], sizes) for i in (4, 5))
    joined, first, lines = _boxed(w, text, boxes[0], cols, *boxes[1:], by_line & anchored[boxes[0]], by_first)
    cut = np.cumsum([0, *sizes])
    slices = lambda x: [x.slice(cut[k], sizes[k]) for k in range(len(parts))]
    narrative, opening, *columns, acts, times = slices(joined)

    opens = np.flatnonzero(pc.fill_null(pc.match_substring_regex(opening, _STATEMENT), False).to_numpy(zero_copy_only=False))
    opens = said[opens[_opens(w["page"][said[opens]])]]
    begins = _first(w["page"], w["col"] == NARRATIVE, n)[w["page"][opens]]
    opens = opens[w["line"][opens] > w["line"][begins]]
    trimmed = np.full(n, -1)
    trimmed[w["page"][opens]] = np.arange(len(opens))
    lowest = np.flatnonzero((w["col"] == NARRATIVE) & _opens(w["page"], w["line"], w["col"]))
    lowest = lowest[np.searchsorted(_placed(w["page"][lowest], w["line"][lowest]), _placed(w["page"][opens], w["line"][opens]))] if len(opens) else lowest[:0]
    none = np.zeros(len(opens), bool)
    rest = _boxed(w, text, w["page"][opens], np.full(len(opens), NARRATIVE), w["top"][lowest], full(len(opens), np.inf), full(len(opens), np.nan), none, none)[0]

    labels = pc.utf8_trim(pc.utf8_ltrim(slices(first)[5], "["), SPACES)
    steps = pa.StructArray.from_arrays([pa.array(b), acts, labels, times], ["b", "act", "first", "ct"]).filter(labels.is_valid())
    steps = pa.ListArray.from_arrays(_ends(np.bincount(of[labels.is_valid().to_numpy(zero_copy_only=False)], minlength=len(a))), steps)
    bands = pa.StructArray.from_arrays([*columns, slices(lines)[4], steps], ["cond", "act", "time", "lines", "steps"])
    bands = pa.ListArray.from_arrays(_ends(np.bincount(page, minlength=n)), bands)
    late = rest.take(pa.array(trimmed, pa.int64(), mask=trimmed < 0))
    return pa.StructArray.from_arrays([heading, narrative, late, pa.array(anchored), bands], ["heading", "narrative", "trimmed", "anchored", "bands"], mask=pa.array(~seen))


_STEP = _record(b=T.DoubleType(), act=_TEXT, first=_TEXT, ct=_TEXT)
_BAND = _record(cond=_TEXT, act=_TEXT, time=_TEXT, lines=T.ArrayType(_TEXT), steps=T.ArrayType(_STEP))


@F.arrow_udf(_record(heading=_TEXT, narrative=_TEXT, trimmed=_TEXT, anchored=T.BooleanType(), bands=T.ArrayType(_BAND)))
def read_pages(words: pa.Array, height: pa.Array, col1: pa.Array, col2: pa.Array, margin: pa.Array) -> pa.Array:
    return page_texts(words, height, col1, col2, margin)


read_pages = read_pages.asNondeterministic()


def printed_pages(pages: DataFrame, layout: dict, overrides: DataFrame | None = None) -> DataFrame:
    """Whole pages with their section id (``lco``), title and ``page_texts``; ids may bring a layout of their own.

    ``overrides`` has lco and some of col1_max, col2_max, header_margin: a configured table of
    a few numbers for a section, which is broadcast.  Pages of such a section are read again.
    """
    names = ("col1_max", "col2_max", "header_margin")
    given = {n: F.lit(float(layout[n])) for n in names}
    lco = truthy(F.regexp_extract("read.heading", SECTION_ID, 1))
    read = pages.withColumn("read", read_pages("words", "page_height", *given.values()))
    if overrides is not None:
        own = overrides.select("lco", F.lit(True).alias("_own"), *(F.col(n).cast("double").alias(f"_{n}") for n in names if n in overrides.columns))
        layout_of = [F.coalesce(f"_{n}", given[n]) if n in overrides.columns else given[n] for n in names]
        joined = read.withColumn("lco", lco).join(F.broadcast(own), "lco", "left")
        read = joined.withColumn("again", read_pages(F.when(F.col("_own"), F.col("words")), "page_height", *layout_of)).withColumn("read", F.coalesce("again", "read"))
    headed = read.where("read is not null").withColumn("lco", lco)
    title = F.when(F.col("lco").isNotNull(), truthy(strip(F.split_part(F.col("read.heading"), F.col("lco"), F.lit(1)))))
    return headed.select(*PAGE, "lco", title.alias("title"), "read.*").drop("heading")


def note_spans(actions: DataFrame) -> DataFrame:
    """(open, close) tops of notes in the action column; an open one without a dash run after it is none."""
    marks = actions.select(*PAGE, "top", "x0", "word_ord", F.col("text").rlike(NOTE_OPEN).alias("opens"), F.col("text").rlike(DASH_RUN).alias("closes")).where("opens or closes")
    order = W.partitionBy(*PAGE).orderBy("top", F.bround("top"), "x0", "word_ord").rowsBetween(W.unboundedPreceding, -1)
    islands = marks.withColumn("island", F.coalesce(F.sum(F.col("closes").cast("int")).over(order), F.lit(0)))
    ends = islands.groupBy(*PAGE, "island").agg(F.min(F.when(F.col("opens"), F.col("top"))).alias("open"), F.max(F.when(F.col("closes"), F.col("top"))).alias("close"))
    return ends.where("open is not null and close is not null").drop("island")


def condition_anchors(words: DataFrame) -> DataFrame:
    return words.where((F.col("col") == "COND") & F.col("text").rlike(CONDITION_LABEL))
