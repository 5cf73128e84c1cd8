"""Fuzzy substring dedup by collinear chaining.

Exact copies of a text are one node.  Each text gives seeds: of every
``window`` k-word shingles in a row the one with the least hash.  A seed that
several texts hold joins each of them to its first holder, never to each other,
so a passage in a third of all texts makes one row for each.  That holder may
have the seed and not the passage, so runs of two or more shared seeds in a row
join their holders to the first that has the whole run.  Holders of a seed that
this has not joined, by passages over the seed, to one and the same holder are
then held against each other, all of them, by the words around the seed.  The
matches of a text with one other text are chained in order: the score of a chain is its
words less gap costs, and the best predecessor of a match comes from a Fenwick
tree of prefix maxima.  Chains are then aligned over the words themselves,
between their matches and beyond both ends, and kept from ``min_words`` words
and ``min_identity`` on; of one that agrees less, the longest stretches that do
reach both are kept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import MIX
from .shared import discard, materialize, q, releasing, settled

_WORD = (1 << 64) - 1
_PLACE = np.uint64((1 << 24) - 1)
#: Price of a word of gap, on either side, against 1 for a matched word.
GAP_COST = 0.1
#: Words beyond the outer matches that the alignment may take in.
MARGIN = 64
#: An extension ends this far below its best score; a matched word counts 1, another -2.
DROP = 8


#: Bytes that part words.
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: What is left of eight bytes if a word has only the first so many of them.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words, in bytes, are hashed one by one.
LONG_WORD = 64


def hashed_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit hash for each word of texts, and how many each has; data: their bytes, ends: where each begins and ends.

    All words are read eight bytes at a time; words of up to eight bytes of one length never have the same hash.
    """
    size = len(data)
    word = ~_BLANK[data]
    bounds = np.zeros(size + 1, bool)
    bounds[ends] = True
    before, after = np.ones(size + 1, bool), np.ones(size + 1, bool)
    before[1:], after[:-1] = ~word, ~word
    begin = np.flatnonzero(word & (before | bounds)[:-1])
    wide = np.flatnonzero(word & (after | bounds)[1:]) + 1 - begin
    eights = np.ndarray((size + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = wide.astype(np.uint64) * np.uint64(MIX[1])
    some = np.arange(len(out))
    for at in range(0, LONG_WORD, 8):
        some = some[wide[some] > at]
        if not len(some):
            break
        h = (out[some] ^ (eights[begin[some] + at] & _LEFT[np.minimum(wide[some] - at, 8)])) * np.uint64(MIX[0])
        out[some] = h ^ (h >> np.uint64(32))
    out = (out ^ (out >> np.uint64(29))) * np.uint64(MIX[1])
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(wide > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : begin[i] + wide[i]].tobytes())
    return out, np.diff(np.searchsorted(begin, ends))


def word_hashes(text: str | None) -> np.ndarray:
    """``hashed_words`` of one text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return hashed_words(data, np.array([0, len(data)]))[0]


def short_hashes(text: str | bytes | None) -> np.ndarray:
    """The lower 32 bits of the hashes of a text's words; of bytes, which ``_seeded`` made of a text, just these."""
    if isinstance(text, bytes):
        return np.frombuffer(text, np.uint32)
    return word_hashes(text).astype(np.uint32)


def _sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """The least (or greatest) of each ``size`` neighbours, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def seeds(texts: list[np.ndarray], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and word positions of the winnowed k-word shingles of texts, given as word hashes; and how many each has.

    A shingle is a seed if it is the least of any ``window`` neighbours that
    hold it, or the least of a text with fewer; of equals the first.
    """
    sizes = np.array([len(t) - k + 1 for t in texts], np.int64).clip(0)
    starts = np.cumsum([0, *sizes])
    n = int(starts[-1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    kept = [i for i, size in enumerate(sizes) if size]
    words = np.concatenate([texts[i] for i in kept])
    # shingle j of text i starts at word j + (words of the texts before it)
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(n) - starts[of]
    first = at + np.repeat(np.cumsum([0, *[len(texts[i]) for i in kept]])[:-1], sizes[kept])
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, k, np.uint64)
        for j in range(k):
            out = (out ^ words[j : j + len(out)]) * np.uint64(MIX[0])
            out ^= out >> np.uint64(32)
        out *= np.uint64(MIX[1])
        out ^= out >> np.uint64(29)
    out = out[first]
    # ordered by the upper 40 bits, then by position
    order = (out & ~_PLACE) | np.minimum(at, int(_PLACE)).astype(np.uint64)
    picked = np.zeros(n, bool)
    if n >= window:
        least = _sliding(order, window, np.minimum)
        least[of[: n - window + 1] != of[window - 1 :]] = 0  # windows over two texts say nothing
        edge = np.zeros(window - 1, np.uint64)
        picked = _sliding(np.concatenate([edge, least, edge]), window, np.maximum) == order
    for i in kept:
        if sizes[i] < window:
            picked[starts[i] : starts[i + 1]] = False
            picked[starts[i] + int(order[starts[i] : starts[i + 1]].argmin())] = True
    return out[picked].view(np.int64), at[picked].astype(np.int32), np.bincount(of[picked], minlength=len(texts))


class Fenwick:
    """Prefix maxima of (score, index)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Of the positions below ``i``."""
        found = (float("-inf"), -1)
        while i:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def chains(matches: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """Disjoint chains of matches (here, there) that rise on both sides, best first.

    A match adds k; the gap cost is linear in both distances, so what a
    predecessor is worth to a match is a number of its own less one of the
    match's, and one prefix maximum over the other side finds the best.
    """
    order = sorted(set(matches))
    if all(p < p2 and h < h2 for (p, h), (p2, h2) in zip(order, order[1:], strict=False)):
        return _rising(order, k)
    ranks = {h: i for i, h in enumerate(sorted({h for _, h in order}))}
    tree, score, back = Fenwick(len(ranks)), [], []
    waiting: list[tuple[int, tuple[float, int]]] = []
    here = None
    for i, (p, h) in enumerate(order):
        if p != here:  # a predecessor lies strictly before on both sides
            for at, value in waiting:
                tree.put(at, value)
            waiting, here = [], p
        before, j = tree.upto(ranks[h])
        own = float(k)
        if j >= 0:
            linked = before - GAP_COST * (p + h) + k
            if linked > own:
                own = linked
            else:
                j = -1
        score.append(own)
        back.append(j)
        waiting.append((ranks[h], (own + GAP_COST * (p + h), i)))
    return _paths(order, score, back)


def _rising(order: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """``chains`` of matches that all rise on both sides: what a match is worth grows along them, so the best is the one before."""
    score, back, before = [], [], float("-inf")
    for i, (p, h) in enumerate(order):
        linked = before - GAP_COST * (p + h) + k
        own, j = (linked, i - 1) if linked > k else (float(k), -1)
        score.append(own)
        back.append(j)
        before = own + GAP_COST * (p + h)
    return _paths(order, score, back)


def _paths(order: list[tuple[int, int]], score: list[float], back: list[int]) -> list[list[tuple[int, int]]]:
    used, out = [False] * len(order), []
    for i in sorted(range(len(order)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(order[i])
            i = back[i]
        if path:
            out.append(path[::-1])
    return out


def unbroken(chain: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """A chain cut where it leaps over more than ``MARGIN`` words: what lies apart so far is no one passage."""
    out = [[chain[0]]]
    for (p, h), (p2, h2) in zip(chain, chain[1:], strict=False):
        if max(p2 - p, h2 - h) - k > MARGIN:
            out.append([])
        out[-1].append((p2, h2))
    return out


def _extended(equal: np.ndarray) -> int:
    """How many leading words go on matching, one by one, up to a drop."""
    equal = equal[:MARGIN]
    if equal.all():
        return len(equal)
    run = top = words = 0
    for i, same in enumerate(equal.tolist(), 1):
        run += 1 if same else -2
        if run > top:
            top, words = run, i
        elif top - run >= DROP:
            break
    return words


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(len(a), len(b))
    return a[:n] == b[:n]


def _common(a: np.ndarray | list[int], b: np.ndarray | list[int]) -> int:
    """Longest common subsequence of two short gaps."""
    left, right = (x if isinstance(x, list) else x.tolist() for x in (a, b))
    if left == right:
        return len(left)
    # words that agree at either end are in a longest one
    m, n, same = len(left), len(right), 0
    while m and n and left[m - 1] == right[n - 1]:
        m, n, same = m - 1, n - 1, same + 1
    lead, most = 0, min(m, n)
    while lead < most and left[lead] == right[lead]:
        lead += 1
    same += lead
    if lead == most:
        return same
    # a bit for each word of the right side, 0 where the row of the table rises
    at: dict[int, int] = {}
    for j, y in enumerate(right[lead:n]):
        at[y] = at.get(y, 0) | 1 << j
    every = (1 << n - lead) - 1
    row = every
    for x in left[lead:m]:
        if up := row & at.get(x, 0):
            row = row + up | row - up
    return same + (n - lead) - (row & every).bit_count()


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int) -> tuple[int, int, int, int, int]:
    """Start and end in ``a`` and ``b`` and the words that agree, along a chain of k-word matches."""
    (p, h), same = chain[0], 0
    lead = _extended(_equal(a[:p][::-1], b[:h][::-1]))
    same += int((a[p - lead : p] == b[h - lead : h]).sum())
    start_a, start_b, at_a, at_b = p - lead, h - lead, p, h
    of_a, of_b = a.tolist(), b.tolist()
    for p, h in chain:
        if p < at_a or h < at_b:  # overlaps what is aligned: go on on its diagonal
            skip = max(at_a - p, at_b - h)
            if skip >= k:
                continue
            p, h = p + skip, h + skip
            end = k - skip
        else:
            end = k
        same += _common(of_a[at_a:p], of_b[at_b:h])
        left, right = of_a[p : p + end], of_b[h : h + end]
        same += end if left == right else sum(map(eq, left, right))
        at_a, at_b = p + end, h + end
    tail = _extended(_equal(a[at_a:], b[at_b:]))
    same += int((a[at_a : at_a + tail] == b[at_b : at_b + tail]).sum())
    return start_a, at_a + tail, start_b, at_b + tail, same


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions (in a, in b) of a longest common subsequence of two short gaps."""
    rows = [np.zeros(len(b) + 1, np.int64)]
    for x in a:
        row = rows[-1].copy()
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return np.array(out[::-1], np.int64).reshape(-1, 2)


def agreeing(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int) -> np.ndarray:
    """Positions (in a, in b) of the words that ``align`` counts."""

    def diagonal(p: int, h: int, n: int) -> np.ndarray:
        return np.flatnonzero(a[p : p + n] == b[h : h + n])[:, None] + (p, h)

    start_a, end_a, start_b, end_b, _ = align(a, b, chain, k)
    (p, h), out = chain[0], []
    out.append(diagonal(start_a, start_b, p - start_a))
    at_a, at_b = p, h
    for p, h in chain:
        skip = max(at_a - p, at_b - h, 0)
        if skip >= k:
            continue
        p, h = p + skip, h + skip
        out.append(_pairs(a[at_a:p], b[at_b:h]) + (at_a, at_b))
        out.append(diagonal(p, h, k - skip))
        at_a, at_b = p + k - skip, h + k - skip
    out.append(diagonal(at_a, at_b, end_a - at_a))
    return np.concatenate(out)


def stretches(pairs: np.ndarray, min_words: int, min_identity: float) -> list[tuple[int, int, int, int, int]]:
    """Like ``align``: the longest stretch of at least ``min_words`` at ``min_identity``, then those before and after it."""
    found, todo = [], [pairs]
    while todo:
        part = todo.pop()
        n, best = len(part), (0, 0, 0)
        # words agreed less those that the share asks for, to the end of a pair: a stretch holds if neither side falls
        need = np.arange(1, n + 1)[:, None] - min_identity * (part + 1)
        for i in range(n):
            if n - i <= best[0] or n - i < min_identity * min_words:
                break
            held = np.flatnonzero((need[i:] - need[i] + (1 - min_identity) >= -1e-9).all(axis=1))
            j = i + int(held[-1])
            if j - i + 1 > best[0] and (part[j] - part[i] + 1 >= min_words).all():
                best = (j - i + 1, i, j)
        if best[0]:
            same, i, j = best
            (s, so), (e, eo) = part[i].tolist(), (part[j] + 1).tolist()
            found.append((s, e, so, eo, same))
            todo += [part[:i], part[j + 1 :]]
    return found


def passages(
    a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int]], k: int, min_words: int, min_identity: float
) -> list[tuple[int, int, int, int, int]]:
    """The alignment of a chain if it reaches both bounds, else the stretches of it that do."""
    s, e, so, eo, same = align(a, b, chain, k)
    if min(e - s, eo - so) < min_words or same < min_identity * min_words:
        return []
    if same >= min_identity * max(e - s, eo - so):
        return [(s, e, so, eo, same)]
    return stretches(agreeing(a, b, chain, k), min_words, min_identity)


def _lists(column: pa.ListArray, *fields: str) -> tuple[np.ndarray, ...]:
    """Offsets of the lists and, flat, the fields of their structs (or the values themselves)."""
    offsets, flat = column.offsets.to_numpy(), column.flatten()
    parts = [flat.field(f) for f in fields] if fields else [flat]
    return (offsets - offsets[0], *[c.to_numpy(zero_copy_only=False) for c in parts])


def _column(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(parts) if parts else [], kind))


#: Texts whose seeds a task remembers to have given.
SEEN = 400_000


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``hashed_words`` of a column of strings, some texts at a time."""
    texts = texts.cast(pa.string())
    texts = texts.fill_null("") if texts.null_count else texts
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    words, counts, i = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + 1_000_000, "right")) - 1)
        h, n = hashed_words(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        words.append(h)
        counts.append(n)
        i = j
    return np.concatenate(words), np.concatenate(counts)


def _binary(words: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Words of 32 bits as one binary value for each text."""
    ends = np.cumsum([0, *(4 * counts)])
    if ends[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(words)])
    return pa.array([words[begin // 4 : end // 4].tobytes() for begin, end in zip(ends, ends[1:], strict=False)], pa.binary())


def _seeded(df: DataFrame, id_col: str, text_col: str, k: int, window: int) -> DataFrame:
    """id, node (hash of the text), check (another one), n words, words (``short_hashes``, for later steps to read), seeds.

    ``first`` tells which place of a seed is its first in the text.

    Of equal texts in a task only the first gives seeds, so a group of copies
    has no more than the number of tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.slice(begin, 1000)
                words, n = _words(part.column(3))
                short, starts, new = words.astype(np.uint32), np.cumsum(n) - n, []
                for node, begin_at, many in zip(part.column(1).to_pylist(), starts.tolist(), n.tolist(), strict=True):
                    new.append(words[begin_at : begin_at + (0 if node in seen else many)])
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                hashes, at, counts = seeds(new, k, window)
                sizes = pa.array(np.cumsum([0, *counts]).astype(np.int32))
                first = _first(np.repeat(np.arange(len(new)), counts), hashes)
                pairs = pa.StructArray.from_arrays([pa.array(hashes), pa.array(at), pa.array(first)], ["h", "at", "first"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i) for i in range(3)],
                        pa.array(n, pa.int32()),
                        _binary(short, n),
                        pa.ListArray.from_arrays(sizes, pairs),
                    ],
                    ["id", "node", "check", "n", "words", "seeds"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    text = q(text_col)
    return df.select(q(id_col), F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("check"), text).mapInArrow(
        releasing(run), f"id {kind}, node long, check long, n int, words binary, seeds array<struct<h:long,at:int,first:boolean>>"
    )


def _runs(
    node: np.ndarray, at: np.ndarray, h: np.ndarray, other: np.ndarray, there: np.ndarray, k: int, window: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """``runs`` of many texts at once, whose seeds stand in order: the seeds that runs begin at, in order, and the keys of these."""
    n, keys = len(at), h.view(np.uint64)
    # whether a seed goes on from the one before it, and on the same diagonal band of the same first holder
    on, same = np.zeros(n, bool), np.zeros(n, bool)
    on[1:] = (node[1:] == node[:-1]) & (np.diff(at) <= window)
    leap = np.diff(there)
    same[1:] = (other[1:] == other[:-1]) & (leap > 0) & (leap <= window)
    i = np.arange(n)
    key, alike, size, found = keys * np.uint64(MIX[1]), np.ones(n, bool), 1, []
    while len(i):
        kept = i + size < n
        kept[kept] = on[i[kept] + size]
        i, key, alike = i[kept], key[kept], alike[kept]
        j = i + size
        alike = alike & same[j]
        key = (key ^ keys[j]) * np.uint64(MIX[0])
        key ^= key >> np.uint64(32)
        size += 1
        long = at[j] + k - at[i] >= least
        out = ~alike if not size & (size - 1) else ~alike & long
        found.append((i[out], key[out]))
        i, key, alike = i[~long], key[~long], alike[~long]
    begins, key = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (i, key)
    order = np.argsort(begins, kind="stable")
    begins, key = begins[order], key[order].view(np.int64)
    # of equal runs of one text
    order = np.lexsort((key, node[begins]))
    equal = (np.diff(node[begins[order]]) == 0) & (np.diff(key[order]) == 0)
    several = np.append(equal, False) | np.insert(equal, 0, False) if len(order) else np.zeros(0, bool)
    drop, last = [], {}
    for x in np.sort(order[several]).tolist():
        b = int(begins[x])
        named = int(node[b]), int(key[x])
        if at[b] - last.get(named, -least) >= least:
            last[named] = int(at[b])
        else:
            drop.append(x)
    return np.delete(begins, drop), np.delete(key, drop)


def runs(found: list[tuple[int, int, int, int]], k: int, window: int, least: int) -> list[tuple[int, int]]:
    """(hash, position) of the runs of neighbouring seeds: from each, those of 2, 4, 8 ... seeds and the first of ``least`` words.

    Seeds are (position, hash, first holder, place there).  Those of one text
    lie no more than ``window`` words apart, so a wider leap is over a seed that
    no other text holds.  A run that one text is the first holder of, in order,
    is left out: all holders meet that text on every seed of it anyway.  Of equal
    runs that overlap, as in a text of one word, the first counts.
    """
    at, h, other, there = np.array(found, np.int64).reshape(-1, 4).T.copy()
    begins, keys = _runs(np.zeros(len(at), np.int64), at, h, other, there, k, window, least)
    return list(zip(keys.tolist(), at[begins].tolist(), strict=True))


def _run_keys(shared: DataFrame, k: int, window: int, min_words: int) -> DataFrame:
    """Keys of ``runs`` and their places, and which are the first of their key in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.slice(begin, 1000)
                offsets, *held = _lists(part.column(1), "at", "h", "other", "there")
                row, (at, h, other, there) = np.repeat(np.arange(len(part)), np.diff(offsets)), (c.astype(np.int64) for c in held)
                order = np.lexsort((there, other, h, at, row))
                row, at, h, other, there = (c[order] for c in (row, at, h, other, there))
                new = np.ones(len(row), bool)  # copies of a text have given its seeds, too
                new[1:] = np.any([c[1:] != c[:-1] for c in (row, at, h, other, there)], axis=0)
                row, at, h, other, there = (c[new] for c in (row, at, h, other, there))
                begins, keys = _runs(row, at, h, other, there, k, window, min_words)
                nodes = part.column(0).to_numpy()[row[begins]]
                columns = [pa.array(nodes), pa.array(keys), pa.array(at[begins].astype(np.int32)), pa.array(_first(row[begins], keys))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "h", "at", "first"])

    return shared.select("node", "held").mapInArrow(releasing(run), "node long, h long, at int, first boolean")


def _first(of: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which entries are the first with their key in their text; the entries of a text stand together."""
    order = np.lexsort((keys, of))
    first = np.ones(len(of), bool)
    first[order[1:]] = (np.diff(of[order]) != 0) | (keys[order[1:]] != keys[order[:-1]])
    return first


def _met(keys: DataFrame) -> DataFrame:
    """Keys (node, h, at, first) that several nodes hold, with their place in the first holder, which is among them.

    Grouping combines before the shuffle, and the join to the keys that several
    hold is one that Spark can split, so a key may be in any share of the texts.
    """
    node = F.col("node")
    place = F.min_by("at", F.when(F.col("first"), node)).alias("there")
    several = keys.groupBy("h").agg(F.min(node).alias("other"), F.max(node).alias("most"), place).where("other <> most")
    return keys.select("node", "h", "at").join(several.select("h", "other", "there"), "h")


REGION = "node long, other long, start int, sizes array<int>, p array<int>, h array<int>, words array<int>"


def _regions(rows: DataFrame, k: int, min_words: int) -> DataFrame:
    """Chains of (node, matches, text) that may reach ``min_words``, with the words around them.

    Chains of two texts whose words overlap share a row, so the words, and the
    text they are held against, go through a shuffle once; ``sizes`` are the
    numbers of matches of each.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32()]
    names = ["node", "other", "start", "sizes", "p", "h", "words"]

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(c, t) for c, t in zip(columns[:3], kinds, strict=True)]
        sizes = [np.array([len(chain) for chain in held], np.int32) for held in columns[3]]
        places = np.array([m for held in columns[3] for chain in held for m in chain], np.int32)
        ends = pa.array(np.cumsum([0, *(int(x.sum()) for x in sizes)]).astype(np.int32))
        pairs = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(places[:, i]))) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*arrays, _column(sizes, pa.int32()), *pairs, _column(columns[4], pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held_words = [], 0
        for batch in batches:
            offsets, *held = _lists(batch.column(1), "other", "at", "there")
            for i, node in enumerate(batch.column(0).to_pylist()):
                by: dict[int, list[tuple[int, int]]] = {}
                for other, at, there in zip(*[c[offsets[i] : offsets[i + 1]].tolist() for c in held], strict=True):
                    by.setdefault(other, []).append((at, there))
                h = short_hashes(batch.column(2)[i].as_py()).view(np.int32)
                for other, found in by.items():
                    kept = []
                    for whole in chains(found, k) if len(found) > 1 else [found]:
                        for chain in unbroken(whole, k) if len(whole) > 1 else [whole]:
                            (p0, h0), (p1, h1) = chain[0], chain[-1]
                            if min(p1 - p0, h1 - h0) + k + 2 * MARGIN >= min_words:
                                kept.append(chain)
                    for together in overlapping(kept, k):
                        start, end = max(0, together[0][0][0] - MARGIN), max(c[-1][0] for c in together) + k + MARGIN
                        out.append((node, other, start, together, h[start:end]))
                        held_words += len(out[-1][4])
                        if len(out) >= 500 or held_words >= 1_000_000:
                            yield made(out)
                            out, held_words = [], 0
        if out:
            yield made(out)

    return rows.select("node", "matches", "text").mapInArrow(releasing(run), REGION)


def overlapping(found: list[list[tuple[int, int]]], k: int) -> list[list[list[tuple[int, int]]]]:
    """Chains by their first places, those whose words and margins overlap together."""
    out, end = [], 0
    for chain in sorted(found):
        if max(0, chain[0][0] - MARGIN) >= end:
            out.append([])
        out[-1].append(chain)
        end = max(end, chain[-1][0] + k + MARGIN)
    return out


#: Places of a seed that are held against each other in one task; more are cut into blocks that meet two by two.
BLOCK = 16384
AROUND = "h long, node long, at int, label long, n long, words binary, near array<long>, off array<int>"


def _apart(rows: DataFrame, k: int) -> DataFrame:
    """Seeds h of (node, held, laid) that a node holds and no passage over it joins to the seed's first holder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, h, at, first, there = _lists(batch.column(1), "h", "at", "other", "there")
            cuts, other, start, end, other_start, other_end = _lists(
                batch.column(2), "other", "start", "end", "other_start", "other_end"
            )
            over = first == np.repeat(batch.column(0).to_numpy(), np.diff(offsets))
            for lo, hi, begin, stop in zip(offsets, offsets[1:], cuts, cuts[1:], strict=False):
                for text in np.unique(other[begin:stop]).tolist():
                    held, laid = lo + np.flatnonzero(first[lo:hi] == text), begin + np.flatnonzero(other[begin:stop] == text)
                    for i in range(0, len(held), 1000):  # places by passages
                        some = held[i : i + 1000]
                        p, q = at[some, None], there[some, None]
                        fits = (start[laid] <= p) & (p + k <= end[laid]) & (other_start[laid] <= q) & (q + k <= other_end[laid])
                        over[some] |= fits.any(axis=1)
                # one place of a seed that is joined is enough
                over[lo:hi] |= np.isin(h[lo:hi], h[lo:hi][over[lo:hi]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[~over]))], ["h"])

    return rows.select("node", "held", "laid").mapInArrow(releasing(run), "h long")


def _covered(rows: DataFrame, k: int) -> DataFrame:
    """Passages of (node, held, laid) to other nodes with the seeds of ``held`` that they cover, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            offsets, h, at = _lists(batch.column(1), "h", "at")
            cuts, *sides = _lists(batch.column(2), "other", "start", "end", "other_start", "other_end")
            picked, seeds_of, size = [], [], 0

            def made() -> pa.RecordBatch:
                some = np.array(picked, np.int64)
                of = nodes[np.searchsorted(cuts, some, "right") - 1]
                columns = [pa.array(of), *(pa.array(sides[i][some]) for i in (0, 3, 4)), _column(seeds_of, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, ["node", "other", "other_start", "other_end", "h"])

            for lo, hi, begin, stop in zip(offsets, offsets[1:], cuts, cuts[1:], strict=False):
                order = np.argsort(at[lo:hi], kind="stable")
                places, hashes = at[lo:hi][order], h[lo:hi][order]
                first = np.searchsorted(places, sides[1][begin:stop], "left").tolist()
                last = np.searchsorted(places, sides[2][begin:stop] - k, "right").tolist()
                for i, a, b in zip(range(begin, stop), first, last, strict=True):
                    if a < b:
                        picked.append(i)
                        seeds_of.append(np.unique(hashes[a:b]))
                        size += len(seeds_of[-1])
                        if size >= 500_000:
                            yield made()
                            picked, seeds_of, size = [], [], 0
            if picked:
                yield made()

    kinds = "node long, other long, other_start long, other_end long, h array<long>"
    return rows.select("node", "held", "laid").mapInArrow(releasing(run), kinds)


def _led(rows: DataFrame, k: int) -> DataFrame:
    """(h, node, other) of the seeds of covered passages (``_covered``) that ``held``, in order, of the other node has inside, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, others, starts, ends = (batch.column(i).to_numpy() for i in range(4))
            cuts, own = _lists(batch.column(4))
            offsets, h, at = _lists(batch.column(5), "h", "at")
            found = []
            for i, (begin, stop, lo, hi) in enumerate(zip(cuts, cuts[1:], offsets, offsets[1:], strict=False)):
                seeds, hashes, places = own[begin:stop], h[lo:hi], at[lo:hi]
                first, last = np.searchsorted(hashes, seeds, "left"), np.searchsorted(hashes, seeds, "right")
                inside = first < last
                inside[inside] = (places[first[inside]] >= starts[i]) & (places[first[inside]] + k <= ends[i])
                for j in np.flatnonzero(~inside & (last - first > 1)).tolist():  # several places of one seed
                    of = places[first[j] : last[j]]
                    n = int(np.searchsorted(of, starts[i], "left"))
                    inside[j] = n < len(of) and of[n] + k <= ends[i]
                found.append(seeds[inside])
            sizes = [len(x) for x in found]
            columns = [np.concatenate([np.zeros(0, np.int64), *found]), np.repeat(nodes, sizes), np.repeat(others, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "node", "other"])

    picked = rows.select("node", "other", "other_start", "other_end", "h", "held")
    return picked.mapInArrow(releasing(run), "h long, node long, other long")


def _open(shared: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(h, node, at, label, n) of the seeds whose holders do not all have one label; n places in all.

    A holder's label is the least other one to which a passage over the seed in both joins it, or its own node.  No
    holder is less than the first one, so a seed has one label if all are joined to that: most go by this, which takes
    the passages of a text to its own seeds; only for seeds of the others are these held against those of the other texts.
    """
    side = ["other", "start", "end", "other_start", "other_end"]
    laid = found.groupBy("node").agg(F.collect_list(F.struct(*side)).alias("laid"))
    empty = F.array().cast(laid.schema["laid"].dataType)
    apart = _apart(shared.join(laid, "node", "left").withColumn("laid", F.coalesce("laid", empty)), k).distinct()
    places = materialize(shared.select("node", F.inline("held")).select("h", "node", "at").join(apart, "h", "left_semi"), "places")
    listed = places.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("h", "at"))).alias("held"))
    covered = _covered(listed.join(laid, "node"), k)
    led = _led(covered.join(listed.withColumnRenamed("node", "other"), "other"), k).groupBy("h", "node").agg(F.min("other").alias("first"))
    labelled = places.join(led, ["h", "node"], "left").select("h", "node", "at", F.least("node", "first").alias("label"))
    several = labelled.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("one"), F.max("label").alias("two"))
    return labelled.join(several.where("one <> two").select("h", "n"), "h")


def _around(rows: DataFrame, k: int, wide: int) -> DataFrame:
    """Places (h, at, label, n) of (node, places, text) with the words around them, 0 where there are none, and other places among these.

    Of places of one seed that overlap one another, as in a text of one word, the first and the last count: on any
    other diagonal no more words agree than on that of the first ones, or of the last.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["h", "node", "at", "label", "n", "words", "near", "off"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            offsets, *held = _lists(batch.column(1), "h", "at", "label", "n")
            for i, node in enumerate(batch.column(0).to_pylist()):
                every = sorted(zip(*[c[offsets[i] : offsets[i + 1]].tolist() for c in held], strict=True))
                ends = [None, *every, None]
                found = [
                    x
                    for before, x, after in zip(ends, every, ends[2:], strict=False)
                    if not (before and after and before[0] == x[0] == after[0] and x[1] - before[1] < k and after[1] - x[1] < k)
                ]
                found.sort(key=lambda x: x[1])
                hashes = np.maximum(short_hashes(batch.column(2)[i].as_py()), np.uint32(1))
                padded = np.concatenate([np.zeros(wide, np.uint32), hashes, np.zeros(wide, np.uint32)])
                ats, met = [x[1] for x in found], set()
                for h, at, label, n in found:
                    text = padded[at : at + k + 2 * wide].tobytes()
                    if (h, label, text) in met:  # as in a text of one line again and again
                        continue
                    met.add((h, label, text))
                    near = found[bisect_left(ats, at - MARGIN) : bisect_right(ats, at + MARGIN)]
                    near = [x for x in near if x[0] != h]
                    out.append((h, node, at, label, n, text, [x[0] for x in near], [x[1] - at for x in near]))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.select("node", "places", "text").mapInArrow(releasing(run), AROUND)


def _sharing(keys: np.ndarray, rows: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """Positions in ``rows`` of those with the same key, two by two; None if these are more than ``most``."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    ends = np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) + 1 if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=0).astype(np.float64)
    if (sizes * (sizes - 1) / 2).sum() > most:
        return None

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for step in range(1, int(sizes.max()) if len(sizes) else 0):
            same = np.flatnonzero(keys[step:] == keys[:-step])
            yield rows[same], rows[same + step]

    return pairs()


def _grams(x: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Triples of words by their place, as (key, row): all but the ``least`` - 1 of each row that are most frequent.

    Rows that have ``least`` triples in the same places share one of those that are left.
    """
    with np.errstate(over="ignore"):
        g = x[:, :-2] * np.uint32(0x9E3779B1) ^ x[:, 1:-1] * np.uint32(0x85EBCA77) ^ x[:, 2:] * np.uint32(0xC2B2AE3D)
        g = (g ^ (g >> np.uint32(15))) * np.uint32(0x27D4EB2F) + np.arange(g.shape[1], dtype=np.uint32) * np.uint32(0x165667B1)
    row, _ = np.nonzero((x[:, :-2] != 0) & (x[:, 1:-1] != 0) & (x[:, 2:] != 0))
    g = g[(x[:, :-2] != 0) & (x[:, 1:-1] != 0) & (x[:, 2:] != 0)]
    _, at, counts = np.unique(g, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    key = rank[at]
    order = np.lexsort((-key, row))
    row, key, several = row[order], key[order], counts[at][order] > 1
    starts = np.searchsorted(row, np.arange(len(x)))
    keep = (np.arange(len(row)) - starts[row] >= least - 1) & several
    return key[keep], row[keep]


def _grown(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of words that agree how many leading ones ``_extended`` takes in, and how many of these agree."""
    side = side[:, :MARGIN]
    run = np.cumsum(side * np.int32(3) - np.int32(2), axis=1)
    dropped = np.maximum.accumulate(np.maximum(run, 0), axis=1) - run >= DROP
    run[np.logical_or.accumulate(dropped, axis=1)] = -1
    best = run.argmax(axis=1)
    words = np.where(run[np.arange(len(side)), best] > 0, best + 1, 0)
    return words, (side & (np.arange(side.shape[1]) < words[:, None])).sum(axis=1)


def _alone(equal: np.ndarray, middle: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words, and those that agree, of the alignment (``align``) of the match in the middle alone; for rows of words that agree."""
    wide, same = np.full(len(equal), k), equal[:, middle : middle + k].sum(axis=1)
    for side in (equal[:, :middle][:, ::-1], equal[:, middle + k :]):
        words, agree = _grown(side)
        wide += words
        same += agree
    return wide, same


def _meet(x: np.ndarray, sides: np.ndarray, labels: np.ndarray, nodes: np.ndarray, near: list, k: int, min_words: int, min_identity: float):
    """Pairs of rows (i, j) with passages over the seed in their middle, or that may have such if more is looked at.

    x: the words around the seed, 0 where there are none, twice ``min_words`` on either side.  So a passage, or a part of it
    that reaches both bounds, lies within the words around one of its seeds.  Rows of one label are joined already, and a
    pair that has a passage here has one label from then on.
    """
    least = int(np.ceil(min_identity * min_words - 1e-9))
    roots, n, middle = np.unique(labels, return_inverse=True)[1], len(x), (x.shape[1] - k) // 2
    begins, stops = (x != 0).argmax(axis=1), x.shape[1] - (x[:, ::-1] != 0).argmax(axis=1)
    told = set()

    def joined(i: int, j: int) -> bool:
        lo, hi = max(begins[i], begins[j]), min(stops[i], stops[j])
        return bool(passages(x[i, lo:hi], x[j, lo:hi], [(middle - lo, middle - lo)], k, min_words, min_identity))

    def led(i: int, j: int) -> bool:
        """Whether the seeds that both have around the middle one lead to a passage over it."""
        there: dict[int, list[int]] = {}
        for g, to in near[j]:
            there.setdefault(g, []).append(middle + to)
        lo, there_lo, mid = int(begins[i]), int(begins[j]), (middle - int(begins[i]), middle - int(begins[j]))
        matches = [mid, *((middle + to - lo, q - there_lo) for g, to in near[i] for q in there.get(g, ()))]
        a, b = x[i, lo : stops[i]], x[j, there_lo : stops[j]]
        return any(
            s <= mid[0] and mid[0] + k <= e and so <= mid[1] and mid[1] + k <= eo
            for whole in chains(matches, k)
            for chain in unbroken(whole, k)
            if mid in chain
            for s, e, so, eo, _ in passages(a, b, chain, k, min_words, min_identity)
        )

    def linked(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """Those with a passage, or with a stretch over the seed on the diagonal that reaches both bounds.

        As a passage does, a stretch starts and ends with a word that agrees.  One that lies beside the seed has seeds of
        its own, or none that an alignment could start from.
        """
        equal = (x[i] == x[j]) & (x[i] != 0)
        pick = np.flatnonzero(equal.sum(axis=1) >= least)
        i, j, equal = i[pick], j[pick], equal[pick]
        gain = np.cumsum(np.pad(equal, ((0, 0), (1, 0))) - np.float32(min_identity), axis=1)
        stop = np.arange(middle + k, gain.shape[1])
        low = np.minimum.accumulate(np.where(equal, gain[:, :-1], np.float32(np.inf)), axis=1)
        over = ((gain[:, stop] - low[:, np.minimum(stop - min_words, middle)] >= -1e-3) & equal[:, stop - 1]).any(axis=1)
        wide, same = _alone(equal, middle, k)
        alone = (wide >= min_words) & (same >= least)
        pick = over | alone
        for a, b, stretch, one in zip(i[pick].tolist(), j[pick].tolist(), over[pick].tolist(), alone[pick].tolist(), strict=True):
            if roots[a] == roots[b]:
                continue
            pair = (int(nodes[a]), int(nodes[b]))
            if one and joined(a, b) or stretch and led(a, b):
                roots[roots == roots[b]] = roots[a]
            elif not stretch or pair in told:
                continue
            told.add(pair)
            yield a, b

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (roots[i] != roots[j]) & ((sides[i] == 0) | (sides[i] != sides[j]))

    rare = None
    if n > 256:
        # each word that differs is in three triples
        triples = int(min_words - 2 - 3 * (1 - min_identity) * min_words + 1e-9)
        if triples > 1:
            rare = _sharing(*_grams(x, triples), most=n * n / 32)
    if rare is not None:
        for i, j in rare:
            some = may(i, j)
            i, j = i[some], j[some]
            for at in range(0, len(i), 20_000):
                yield from linked(i[at : at + 20_000], j[at : at + 20_000])
    else:
        right = np.flatnonzero(sides == 2)
        if n <= 64:  # all at once; roots that change meanwhile are looked at again
            i, j = np.triu_indices(n, 1)
            some = may(i, j)
            yield from linked(i[some], j[some])
        for i in np.flatnonzero(sides != 2) if n > 64 else ():
            j = np.arange(i + 1, n) if sides[i] == 0 else right
            j = j[roots[j] != roots[i]]
            if len(j):
                y = x[i, begins[i] : stops[i]]
                j = j[np.count_nonzero(x[j, begins[i] : stops[i]] == y, axis=1) >= least]
                if len(j):
                    yield from linked(np.full(len(j), i), j)
    # other seeds that lie elsewhere: the passage leaves the diagonal, and no more words agree than both sides have
    flat = [(h, i, off) for i, held in enumerate(near) for h, off in held]
    if flat:
        h, row, off = (np.array(c) for c in zip(*flat, strict=True))
        # what agrees before the middle is in both sides before it, and so after it: a bit for each of 2^13 slots of either
        slot = (x * np.uint32(0x9E3779B1)) >> np.uint32(19)
        slot[:, middle:] += np.uint32(1 << 13)
        bit, slot = np.uint8(1) << (slot & np.uint32(7)).astype(np.uint8), slot >> np.uint32(3)
        bit[x == 0] = 0
        bit[:, middle : middle + k] = 0
        maps = np.zeros((n, 1 << 11), np.uint8)
        np.bitwise_or.at(maps, (np.arange(n)[:, None], slot), bit)
        tried = set()

        def enough(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.count_nonzero(maps[j[:, None], slot[i]] & bit[i], axis=1) + k >= least

        def elsewhere() -> Iterator[np.ndarray]:
            """Pairs of rows as one number, many at once."""
            held, size = [], 0
            for a, b in _sharing(h, np.arange(len(h)), float("inf")):
                some = (off[a] != off[b]) & may(row[a], row[b])
                i, j = row[a[some]], row[b[some]]
                held.append(np.minimum(i, j) * n + np.maximum(i, j))
                size += len(i)
                if size >= 20_000:
                    yield np.unique(np.concatenate(held))
                    held, size = [], 0
            if size:
                yield np.unique(np.concatenate(held))

        for pairs in elsewhere():
            for at in range(0, len(pairs), 4000):
                i, j = np.divmod(pairs[at : at + 4000], n)
                pick = np.flatnonzero((roots[i] != roots[j]) & enough(i, j))
                pick = np.array([p for p in pick.tolist() if int(pairs[at + p]) not in tried], np.int64)
                tried.update(pairs[at + pick].tolist())
                pick = pick[may_align(x[i[pick]], x[j[pick]], k, min_words, min_identity)]
                for p, q in zip(i[pick].tolist(), j[pick].tolist(), strict=True):
                    pair = (int(nodes[p]), int(nodes[q]))
                    if roots[p] == roots[q]:
                        continue
                    if led(p, q):
                        roots[roots == roots[q]] = roots[p]
                    elif pair in told:
                        continue
                    told.add(pair)
                    yield p, q


#: Pairs of rows up to which ``_reach`` goes by the places that agree instead of the whole table.
FEW = 32


def _reach_of(n: int, wide: int, row: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``_reach`` by the places (r, c) of each row that agree: the least ends of subsequences of each length say what one there ends."""
    values, before, ends = [], -1, []
    for i, at in zip(row.tolist(), c.tolist(), strict=True):
        if i != before:
            before, ends = i, []
        length = bisect_left(ends, at)
        ends[length : length + 1] = [at]
        values.append(length + 1)
    best = np.full((2 * wide + 1, n), -1, np.int16)
    best[0] = 0
    np.maximum.at(best, (r + c + 2, row), np.array(values, np.int16))
    return best


def _reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows and each sum s of two lengths: the most words in order that agree of beginnings with s words
    in all, whose last words are of these; -1 if there are no such."""
    n, wide = a.shape
    if n <= FEW:
        # places that agree, from left to right in a, from right to left in b
        row, r, c = np.nonzero((a[:, :, None] == b[:, None, ::-1]) & (a != 0)[:, :, None])
        if len(row) <= 200 * FEW:
            return _reach_of(n, wide, row, r, wide - 1 - c)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    best, last = np.full((2 * wide + 1, n), -1, np.int16), np.zeros((wide + 1, n), np.int16)
    best[0] = 0
    for r in range(wide):
        equal = (b == a[r]) & (a[r] != 0)
        np.maximum.accumulate(np.maximum(last[1:], last[:-1] + equal), axis=0, out=last[1:])
        ends = best[r + 2 : r + 2 + wide]
        np.maximum(ends, np.where(equal, last[1:], -1), out=ends)
    return best


def may_align(a: np.ndarray, b: np.ndarray, k: int, min_words: int, min_identity: float) -> np.ndarray:
    """Which pairs of rows may have a passage over the k words in their middle, however it is aligned.

    What agrees on either side of the middle is no more than a longest common subsequence, and the longer side of a
    passage has at least half of the words of both.
    """
    found = np.zeros(len(a), bool)
    middle = (a.shape[1] - k) // 2
    for at in range(0, len(a), 500):
        x, y = a[at : at + 500], b[at : at + 500]
        lead, tail = _reach(x[:, :middle][:, ::-1], y[:, :middle][:, ::-1]), _reach(x[:, middle + k :], y[:, middle + k :])
        lost = min_identity / 2 * np.arange(len(lead), dtype=np.float32)[:, None]
        lead, tail = (np.where(c < 0, np.float32(-np.inf), c - lost) for c in (lead, tail))
        most = np.maximum.accumulate(lead[::-1], axis=0)[::-1]  # of beginnings with so many words or more
        rest = (2 * (min_words - k) - np.arange(len(tail))).clip(0, len(most) - 1)
        found[at : at + 500] = (most[rest] + tail >= -(1 - min_identity) * k - 1e-3).any(axis=0)
    return found


def _left(around: DataFrame, k: int, min_words: int, min_identity: float) -> DataFrame:
    """Matches (node, other, at, there) of places that no passage joins yet and that ``_meet`` does not rule out."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK))
    cut = around.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node", "at"), F.col("blocks")))
    own, other = F.col("own"), F.col("with")
    placed = cut.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.xxhash64("h", F.least(own, other), F.greatest(own, other)).alias("task"),
        F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side"),
        *["node", "at", "label", "words", "near", "off", "h"],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def pairs() -> pa.RecordBatch:
            sides, nodes, ats, labels, texts, near, off = zip(*rows, strict=True)
            out: list[tuple[int, int, int, int]] = []
            if len(set(labels)) > 1:
                x = np.frombuffer(b"".join(texts), np.uint32).reshape(len(rows), -1)
                there = [list(zip(a, b, strict=True)) for a, b in zip(near, off, strict=True)]
                for i, j in _meet(x, np.array(sides), np.array(labels), np.array(nodes), there, k, min_words, min_identity):
                    if nodes[i] != nodes[j]:
                        i, j = (i, j) if nodes[i] > nodes[j] else (j, i)
                        out.append((nodes[i], nodes[j], ats[i], ats[j]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["node", "other", "at", "there"])

        for batch in batches:
            for t, h, *row in zip(batch.column(0).to_pylist(), batch.column(8).to_pylist(), *[c.to_pylist() for c in batch.columns[1:8]], strict=True):
                if (t, h) != task:
                    if rows:
                        yield pairs()
                    task, rows = (t, h), []
                rows.append(row)
        if rows:
            yield pairs()

    dealt = placed.repartition("task").sortWithinPartitions("task", "h", "node", "at", "side")
    return dealt.mapInArrow(releasing(run), "node long, other long, at int, there int")


def _beside(a: np.ndarray, b: np.ndarray, p: np.ndarray, h: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """Which of the ``MARGIN`` words from p in a and h in b on, step by step, agree; of each pair of places no more than ``most``."""
    off = np.arange(MARGIN)
    there, off = off < most[:, None], off * step
    return there & (a[np.where(there, p[:, None] + off, 0)] == b[np.where(there, h[:, None] + off, 0)])


def _between(a: np.ndarray, b: np.ndarray, p: np.ndarray, h: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """How many of the ``wide`` words (one at least) from p in a and h in b on agree."""
    starts = np.cumsum(wide) - wide
    off = np.arange(int(wide.sum())) - np.repeat(starts, wide)
    return np.add.reduceat((a[np.repeat(p, wide) + off] == b[np.repeat(h, wide) + off]).astype(np.int64), starts)


def _agreeing_around(a: np.ndarray, b: np.ndarray, p: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
    """For each match (p in a, h in b) how many words agree on its diagonal, up to ``MARGIN`` beyond it."""
    lead = _beside(a, b, p - 1, h - 1, np.minimum(p, h), -1)
    tail = _beside(a, b, p + k, h + k, np.minimum(len(a) - p, len(b) - h) - k, 1)
    return lead.sum(axis=1) + _between(a, b, p, h, np.full(len(p), k)) + tail.sum(axis=1)


def _straight(
    a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, shift: np.ndarray, room: tuple[np.ndarray, np.ndarray], min_words: int, min_identity: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of chains that keep to a diagonal, from ``first`` to ``last`` in a and ``shift`` beyond that in b, with ``room`` words before
    and after in both: those that have one passage, as start, end and words that agree, else none; and which are left to align."""
    least, found = min_identity * min_words, [[], [], [], []]
    for at in range(0, len(first), 4000):
        some = slice(at, at + 4000)
        p, e, by = first[some], last[some], shift[some]
        lead, tail = _beside(a, b, p - 1, p + by - 1, room[0][some], -1), _beside(a, b, e, e + by, room[1][some], 1)
        same = _between(a, b, p, p + by, e - p)
        # no more words than agree on the diagonal of the chain can be aligned
        enough, whole = lead.sum(axis=1) + same + tail.sum(axis=1) >= least, same == e - p
        (before, agree), (after, agree2) = _grown(lead), _grown(tail)
        p, e, same = p - before, e + after, same + agree + agree2
        fits = enough & whole & (e - p >= min_words) & (same >= least)
        one = fits & (same >= min_identity * (e - p))
        for held, x in zip(found, (p, e, np.where(one, same, 0), enough & ~whole | fits & ~one), strict=True):
            held.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The short hashes of texts, one after another, and where each begins and ends."""
    if pa.types.is_binary(column.type) and not column.null_count:
        _, ends, data = column.buffers()
        ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.int32) if data else np.zeros(0, np.int32)
        return flat, (ends - ends[0]).astype(np.int64) // 4
    texts = [short_hashes(x) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.uint32), *texts]).view(np.int32), np.cumsum([0, *map(len, texts)])


PASSAGE = "node long, other long, start long, end long, other_start long, other_end long, n_words long, identity double"


def _aligned(rows: DataFrame, k: int, min_words: int, min_identity: float) -> DataFrame:
    """Passages of the regions joined with the other text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, others, starts = (batch.column(i).to_numpy() for i in range(3))
            rows, sizes = _lists(batch.column(3))
            (_, ps), (_, hs) = _lists(batch.column(4)), _lists(batch.column(5))
            cut, words = _lists(batch.column(6))
            texts, ends = _texts(batch.column(7))
            if not len(sizes):
                continue
            # of each chain: its row, its matches and the words it has on either side
            of, stop = np.repeat(np.arange(len(batch)), np.diff(rows)), np.cumsum(sizes)
            begin, starts = stop - sizes, starts.astype(np.int64)
            ps, hs = ps.astype(np.int64), hs.astype(np.int64)
            first, last, shift = ps[begin], ps[stop - 1] + k, hs - ps
            straight = np.logical_and.reduceat(shift == np.repeat(shift[begin], sizes), begin)
            shift = shift[begin]
            to_a, to_b = cut[of] - starts[of], ends[of]  # where word 0 of the text and of the other one would stand
            before = np.minimum(first - starts[of], first + shift)
            after = np.minimum(cut[of + 1] - to_a - last, ends[of + 1] - to_b - last - shift)
            straight &= (before >= 0) & (after >= 0)
            on = np.flatnonzero(straight)
            s, e, same, left = _straight(
                words, texts, (first + to_a)[on], (last + to_a)[on], (shift + to_b - to_a)[on], (before[on], after[on]), min_words, min_identity
            )
            s, e, one = s - to_a[on], e - to_a[on], same > 0
            whole = (nodes[of[on]], others[of[on]], s, e, s + shift[on], e + shift[on], same, same / np.maximum(e - s, 1))
            made, out = [tuple(c[one] for c in whole)], []
            for c in np.sort(np.concatenate([on[left.astype(bool)], np.flatnonzero(~straight)])).tolist():
                i, lo, hi = int(of[c]), int(begin[c]), int(stop[c])
                start, there = max(int(starts[i]), int(ps[lo]) - MARGIN), max(0, int(hs[lo]) - MARGIN)
                skip = int(cut[i]) - int(starts[i])
                a = words[start + skip : min(int(ps[hi - 1]) + k + MARGIN + skip, int(cut[i + 1]))]
                b = texts[there + int(ends[i]) : min(int(hs[hi - 1]) + k + MARGIN + int(ends[i]), int(ends[i + 1]))]
                found = list(zip((ps[lo:hi] - start).tolist(), (hs[lo:hi] - there).tolist(), strict=True))
                for s, e, so, eo, same in passages(a, b, found, k, min_words, min_identity):
                    out.append((nodes[i], others[i], s + start, e + start, so + there, eo + there, same, same / max(e - s, eo - so)))
            if out:
                made.append(tuple(np.array(c) for c in zip(*out, strict=True)))
            kinds = [pa.int64()] * 7 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c), t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)],
                ["node", "other", "start", "end", "other_start", "other_end", "n_words", "identity"],
            )

    picked = rows.select("node", "other", "start", "sizes", "p", "h", "words", "text")
    return picked.mapInArrow(releasing(run), PASSAGE)


def _with_seeds(met: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, other, matches) of the pairs of rows (node, other, at, there): these, and the seeds that both texts hold, at their first place in the other one.

    A pair stays one row with the seeds of both as lists, so the rows are no more than the pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, own_at, own_there = _lists(batch.column(2), "at", "there")
            (cuts, h), (_, at), (offsets, h2), (_, at2) = (_lists(batch.column(i)) for i in range(3, 7))
            ats, theres = [], []
            for first, last, lo, hi, begin, stop in zip(own, own[1:], cuts, cuts[1:], offsets, offsets[1:], strict=False):
                order = np.lexsort((at2[begin:stop], h2[begin:stop]))
                held, there = h2[begin:stop][order], at2[begin:stop][order]
                places = np.searchsorted(held, h[lo:hi], "left")
                same = places < len(held)
                same[same] = held[places[same]] == h[lo:hi][same]
                ats.append(np.concatenate([own_at[first:last], at[lo:hi][same]]))
                theres.append(np.concatenate([own_there[first:last], there[places[same]]]))
            columns = [batch.column(0), batch.column(1), _column(ats, pa.int32()), _column(theres, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "other", "at", "there"])

    pairs = met.where("node <> other").groupBy("node", "other").agg(F.collect_set(F.struct("at", "there")).alias("met"))
    listed = shared.select(F.col("node").alias("of"), F.col("held.h").alias("h"), F.col("held.at").alias("at"))
    of_node = pairs.join(listed, F.col("node") == F.col("of")).drop("of")
    others = listed.select("of", F.col("h").alias("other_h"), F.col("at").alias("other_at"))
    picked = of_node.join(others, F.col("other") == F.col("of")).select("node", "other", "met", "h", "at", "other_h", "other_at")
    return picked.mapInArrow(releasing(run), "node long, other long, at array<int>, there array<int>")


def _gathered(pairs: DataFrame) -> DataFrame:
    """(node, matches) of rows (node, other, at, there) with lists of places."""
    places = F.transform(F.arrays_zip("at", "there"), lambda x: F.struct(F.col("other").alias("other"), x["at"].alias("at"), x["there"].alias("there")))
    return pairs.groupBy("node").agg(F.flatten(F.collect_list(places)).alias("matches"))


def matched(met: DataFrame) -> DataFrame:
    """(node, matches) of rows (node, other, at, there)."""
    return met.where("node <> other").groupBy("node").agg(F.collect_set(F.struct("other", "at", "there")).alias("matches"))


def repeated_passages(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 6,
    window: int = 16,
    min_words: int = 50,
    min_identity: float = 0.8,
) -> DataFrame:
    """One row per passage: id, start, end, other_id, other_start, other_end, n_words, identity.

    Positions count words (runs of anything but ASCII white space) from 0, ends
    excluded; n_words of them agree and identity is their share of the longer
    side.  A row of a text that others repeat exactly stands for one of them,
    the smallest id; each further copy has one row against it, over the whole
    text, if that is ``min_words`` long.  Passages inside one text are not looked for.

    Every passage that has k + window - 1 words in a row without a difference is
    seeded.  Defined cases: null, empty and short texts have no passages; a null
    id stands for its text only if all ids are null; rows that repeat an id and
    a text count as copies; an empty table gives an empty result; other columns
    are not read.
    """
    seeded = materialize(_seeded(df, id_col, text_col, k, window), "seeds")
    flat = seeded.select("node", F.inline("seeds"))
    shared = materialize(
        _met(flat).groupBy("node").agg(F.collect_set(F.struct("h", "at", "other", "there")).alias("held")), "shared"
    )
    docs = seeded.drop("seeds")
    nodes = docs.groupBy("node").agg(F.min("id").alias("least_id"))
    columns = ["node", "other", "at", "there"]
    met = shared.select("node", F.inline("held")).select(*columns)
    met = met.unionByName(_met(materialize(_run_keys(shared, k, window, min_words), "runs")).select(*columns))
    matches = matched(met)
    # texts, as the hashes of their words, are looked up by fingerprint and id of the row that stands for them
    texts = docs.select(F.col("node").alias("fp"), F.col("id").alias("of"), F.col("words").alias("text"))
    names = nodes.select("node", "least_id")

    def with_text(rows: DataFrame, key: str) -> DataFrame:
        named = rows.join(names.select(F.col("node").alias(key), "least_id"), key)
        return named.join(texts, (F.col(key) == F.col("fp")) & F.col("least_id").eqNullSafe(F.col("of")))

    def aligned(matches: DataFrame) -> DataFrame:
        regions = materialize(_regions(with_text(matches, "node"), k, min_words), "regions")
        out = materialize(_aligned(with_text(regions, "other"), k, min_words, min_identity).distinct(), "passages")
        discard(regions)
        return out

    found = aligned(matches)
    listed = F.collect_list(F.struct("h", "at", "label", "n")).alias("places")
    places = settled(lambda: _open(shared, found, k).groupBy("node").agg(listed), "open")
    around = materialize(_around(with_text(places, "node"), k, 2 * min_words), "around")
    discard(places)
    left = materialize(_left(around, k, min_words, min_identity).distinct(), "left")
    discard(around)
    # with all other seeds that the two share, as chains need them
    found = found.unionByName(aligned(_gathered(_with_seeds(left.select(*columns), shared)))).distinct()
    partial = (
        found.join(names.withColumnRenamed("least_id", "id"), "node")
        .join(names.select(F.col("node").alias("other"), F.col("least_id").alias("other_id")), "other")
        .select("id", "start", "end", "other_id", "other_start", "other_end", "n_words", "identity")
    )
    n = F.col("n").cast("long")
    copies = docs.where(F.col("n") >= min_words).groupBy("node", "check").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    whole = (
        docs.where(F.col("n") >= min_words)
        .select("id", "node", "check", "n")
        .join(copies.where("copies > 1"), ["node", "check"])
        .where(~F.col("id").eqNullSafe(F.col("least_id")))
        .select(
            "id",
            F.lit(0).cast("long").alias("start"),
            n.alias("end"),
            F.col("least_id").alias("other_id"),
            F.lit(0).cast("long").alias("other_start"),
            n.alias("other_end"),
            n.alias("n_words"),
            F.lit(1.0).alias("identity"),
        )
    )
    return partial.unionByName(whole).withColumnRenamed("id", id_col)
