"""Quality rules by suffix array.

Each text is a sequence of words.  A suffix array over the words, built by
prefix doubling on a block of texts at once (suffixes of different texts never
compare equal), and the longest common prefixes of neighbours in it give every
maximal repeated substring.  The union of their spans and the longest of them
are limited.  A task holds one block of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import q, releasing

SYMBOLS = b"#*$%&|<>"
#: Words of the texts that are indexed together; a longer text makes a block of its own.
BLOCK_WORDS = 200_000
#: The base rule's windows.
WINDOW = 5


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from it that starts elsewhere in its text too.

    ``words``: ids of the words of several texts, one after the other;
    ``ends``: for each position where its text ends.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.lexsort((words, ends))
    new = np.ones(n, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (ends[order][1:] != ends[order][:-1])
    at = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    levels, k = [], 1
    active = order[_tied(new)]
    while True:
        levels.append(rank.astype(np.int32) if n < 2**31 else rank.copy())
        if not len(active):
            break
        ahead = active + k
        inside = ahead < ends[active]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        by = np.lexsort((second, rank[active]))
        s, second = active[by], second[by]
        old = rank[s]
        group = np.ones(len(s), bool)
        group[1:] = old[1:] != old[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        i = np.arange(len(s))
        rank[s] = old + np.maximum.accumulate(np.where(part, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        active = s[_tied(part)]
        k *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = at
    left, right = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    left, right = left[near], right[near]
    common = np.zeros(len(near), np.int64)
    for level in reversed(range(len(levels))):
        a, b = left + common, right + common
        open_ = np.flatnonzero((a < ends[left]) & (b < ends[right]))
        same = levels[level][a[open_]] == levels[level][b[open_]]
        common[open_[same]] += 1 << level
    out = np.zeros(n, np.int64)
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def _tied(starts: np.ndarray) -> np.ndarray:
    """Which members of sorted groups, given where groups start, are not alone."""
    alone = starts.copy()
    alone[:-1] &= starts[1:]
    return ~alone


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeated substring of ``least`` words or more."""
    n = len(longest)
    starts = np.flatnonzero(longest >= least)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + longest[starts], -1)
    return np.cumsum(step[:-1]) > 0


def _measured(texts: list[bytes], min_words: int) -> dict[str, list]:
    split = [t.split() for t in texts]
    ids: dict[bytes, int] = {}
    flat = [ids.setdefault(w, len(ids)) for words in split for w in words]
    counts = np.array([len(w) for w in split], np.int64)
    stops = np.cumsum(counts)
    words = np.array(flat, np.int64)
    longest = longest_repeats(words, np.repeat(stops, counts))
    windows, spans = covered(longest, WINDOW), covered(longest, min_words)

    def per_text(values: np.ndarray, fold=np.add) -> list[int]:
        out = np.zeros(len(texts), np.int64)
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = fold.reduceat(values.astype(np.int64), (stops - counts)[some])
        return out.tolist()

    def lines(t: bytes) -> int:
        full = [x for x in t.split(b"\n") if x.strip()]
        return len(full) - len(set(full))

    edges = np.diff(np.concatenate(([0], spans.astype(np.int8), [0])))
    if len(spans):  # a span never reaches over the end of its text
        cut = (stops[:-1])[(stops[:-1] > 0) & (stops[:-1] < len(spans))]
        cut = np.unique(cut[spans[cut - 1] & spans[cut]])
    else:
        cut = np.zeros(0, np.int64)
    lo = np.sort(np.concatenate((np.flatnonzero(edges == 1), cut)))
    hi = np.sort(np.concatenate((np.flatnonzero(edges == -1), cut)))
    owner = np.searchsorted(stops, lo, side="right")
    begin = (stops - counts)[owner] if len(owner) else owner
    return {
        "n_words": counts.tolist(),
        "word_chars": [len(b"".join(w).decode("utf-8", "replace")) for w in split],
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": [lines(t) for t in texts],
        "n_repeat_words": per_text(windows),
        "covered_words": per_text(spans),
        "longest_repeat": per_text(longest, np.maximum),
        "spans": _lists(np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), int), lo - begin, hi - begin),
    }


def _lists(sizes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    pairs = pa.StructArray.from_arrays([pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], ["start", "end"])
    return pa.ListArray.from_arrays(offsets, pairs)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def measure_repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """One row per input row: id, the measures and the spans of repeats of ``min_words`` or more.

    Words are runs of anything but ASCII white space.  Defined cases: a null or
    empty text has no words and zeros; rows that repeat an id are measured each;
    an empty table gives an empty result; other columns are not read.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), *[T.StructField(m, T.LongType()) for m in MEASURES], T.StructField("spans", span)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            start, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t) // 6 + 1
                if size >= BLOCK_WORDS or i == len(texts) - 1:
                    found = _measured(texts[start : i + 1], min_words)
                    columns = [batch.column(0).slice(start, i + 1 - start)]
                    columns += [pa.array(found[m], pa.int64()) for m in MEASURES] + [found["spans"]]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, *MEASURES, "spans"])
                    start, size = i + 1, 0

    return df.select(q(id_col), q(text_col)).mapInArrow(releasing(run), schema)


def repetition_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 10,
    max_covered: float = 0.15,
    max_longest: int = 100,
) -> DataFrame:
    """The measures plus base_failed and kept.

    The base fails texts under 10 words and texts with over 20 % of their words
    in 5-word windows found twice.  Of the others the method rejects those with
    over ``max_covered`` of their words in repeats of ``min_words`` or more, or
    with a repeat of more than ``max_longest`` words.
    """
    m = measure_repetition(df, id_col, text_col, min_words)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    fine = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return m.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & fine)
