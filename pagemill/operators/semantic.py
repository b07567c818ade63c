"""Chunks cut at the word boundaries whose two sides are least alike.

A record is cut where it lies: one Arrow pass sends its text to Python and brings back the
spans, so nothing is shuffled and no context becomes a row.  The encoder compares the two
sides of all boundaries of a text at once (``TextEncoder.sides``): encoders of word counts
by running sums over the text, model encoders in batches of contexts that never leave the
task.  Equal texts of a batch are cut once.

Defined results: repeated and null ids are cut like others; blank texts have no chunks;
ties go to the first boundary; texts of any length are cut whole, their boundaries scored a
stretch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import evidence_ids, strip
from pagemill.functions.vectors import TextEncoder
from pagemill.operators.windows import as_chunks, raw_metadata

_SPAN = "struct<word_start:int,word_end:int,char_start:int,char_end:int,score:double>"
_WORD = re.compile(r"\S+")
#: Whether a code point is white space; none beyond the last one is.
_SPACES = np.array([chr(c).isspace() for c in range(0x3002)])


def _spans_of(text: str) -> np.ndarray:
    """Begins (first row) and ends of the words of a text, as ``_WORD`` finds them."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(code) + 2, bool)
    inside[1:-1] = ~_SPACES[np.minimum(code, len(_SPACES) - 1)]
    return np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32).reshape(-1, 2).T


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
def word_spans(texts: pa.Array) -> pa.Array:
    """Begin and end of each run of non-space characters, in code points; no words where there is no text.

    Texts are taken one at a time and leave eight bytes a word, so a batch needs little
    more than its own texts.
    """
    found = [_spans_of(t.as_py() or "") for t in texts]
    s, e = np.concatenate([np.empty((2, 0), np.int32), *found], axis=1)
    ends = np.cumsum([0, *(f.shape[1] for f in found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(s), pa.array(e)], ["s", "e"]))


def boundary_candidates(n: int, step: int) -> list[int]:
    """1, 1 + step, ... below n, and n - 1; none under two words."""
    return sorted({*range(1, n, step), n - 1}) if n >= 2 else []


def greedy_cuts(starts: np.ndarray, ends: np.ndarray, boundaries: np.ndarray, scores: np.ndarray, least: int, target: int, most: int):
    """Spans of words; the boundary of least score after the target, else of those in range, else the first past the limit."""
    out, begin, n = [], 0, len(starts)
    places = starts[boundaries]  # ascending, as are starts and boundaries
    while begin < n:
        origin = starts[begin]
        if ends[-1] - origin <= most:
            out.append((begin, n, None))
            break
        low = max(np.searchsorted(places, origin + least), np.searchsorted(boundaries, begin, side="right"))
        high = np.searchsorted(places, origin + most, side="right")
        wanted = max(low, np.searchsorted(places, origin + target))
        low = wanted if wanted < high else low
        if low < high:
            best = low + int(np.argmin(scores[low:high]))
            cut, score = int(boundaries[best]), float(scores[best])
        else:
            cut, score = max(begin + 1, int(np.searchsorted(starts, origin + most))), None
        out.append((begin, cut, score))
        begin = cut
    return out


def text_spans(text: str, encoder: TextEncoder, width: int, step: int, least: int, target: int, most: int) -> list[dict]:
    """The chunks of one text, by words and by characters."""
    found = [m.span() for m in _WORD.finditer(text)]
    starts, ends = np.array(found, np.int64).reshape(-1, 2).T
    boundaries = np.array(boundary_candidates(len(found), step), np.int64)
    whole = not len(found) or ends[-1] - starts[0] <= most
    scores = np.zeros(len(boundaries)) if whole else np.round(encoder.sides(text, starts, ends, boundaries, width), 9)
    return [{"word_start": a, "word_end": b, "char_start": int(starts[a]), "char_end": int(ends[b - 1]), "score": s} for a, b, s in greedy_cuts(starts, ends, boundaries, scores, least, target, most)]


def semantic(records: DataFrame, *, encoder: TextEncoder, model_name: str, min_chars: int = 450, target_chars: int = 900, max_chars: int = 1200, context_window_words: int = 45, boundary_step_words: int = 3) -> DataFrame:
    if not model_name:
        raise ValueError("chunks of a semantic cut carry their model's name")
    if not 0 < min_chars <= target_chars <= max_chars:
        raise ValueError(f"bounds of a chunk have to rise from above 0, not {min_chars}, {target_chars}, {max_chars}")
    if min(context_window_words, boundary_step_words) < 1:
        raise ValueError("contexts and steps have one word at least")
    text = strip(F.coalesce("raw_text", F.lit("")))
    part = lambda a, b: F.substring(F.col("text"), a + 1, b - a)

    @F.pandas_udf(f"array<{_SPAN}>")
    def cuts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            once = {t: text_spans(t, encoder, context_window_words, boundary_step_words, min_chars, target_chars, max_chars) for t in texts.unique()}
            yield texts.map(once)

    # else the filter that explode implies is a second pass over all texts
    spans = records.select("id", *raw_metadata(records), text.alias("text")).where("text <> ''").withColumn("spans", cuts.asNondeterministic()("text"))
    cut = spans.select("id", "lco", "title", "source_doc", "source_pages", "text", F.posexplode("spans").alias("k", "span"))
    body = strip(part(F.col("span.char_start"), F.col("span.char_end")))
    cut = cut.select("*", body.alias("body"), (F.col("k") + 1).alias("chunk_index"), "span.word_start", "span.word_end", "span.char_start", "span.char_end", F.col("span.score").alias("selected_boundary_similarity"))
    cut = cut.withColumns({
        "parent_id": F.col("id"), "chunk_type": F.lit("semantic_embedding_boundary"), "semantic_method": F.lit("word_boundary_context_coherence"), "embedding_model": F.lit(model_name),
        "context_window_words": F.lit(context_window_words), "boundary_step_words": F.lit(boundary_step_words), "evidence_ids": evidence_ids(F.col("lco"), F.col("body")),
    })
    names = ["lco", "title", "source_doc", "source_pages", "parent_id", "chunk_type", "semantic_method", "chunk_index", "char_start", "char_end", "word_start", "word_end", "embedding_model", "selected_boundary_similarity", "context_window_words", "boundary_step_words", "evidence_ids"]
    return as_chunks(cut, "semantic", F.concat_ws("#", "id", "chunk_index"), names, F.col("body"))
