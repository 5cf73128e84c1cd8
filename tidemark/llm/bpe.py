"""Byte-level BPE encoding and decoding by prefix dynamic programming.

In the merge order of a rank file every prefix of a byte string has exactly one
encoding, so exactly one last token.  ``PrefixTable`` stores that token for each
prefix: a token t that ends at byte i is the last token of prefix i if it may
follow the last token of the prefix before it, which holds if merging the two
tokens' bytes alone gives the two tokens again.  Appending bytes only adds
entries; after an edit the entries before it stay and those after it are taken
over again as soon as a stretch as long as the longest token agrees.

The split pattern is applied first and each match is encoded by itself.
Matches repeat, so a worker keeps a table of bounded size of those it has encoded.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import q, releasing

#: Bytes that each table of encoded matches may take, and characters of the longest match it keeps.
CACHED_BYTES, CACHED_CHARS = 40 << 20, 64
PAIRS = 300_000
#: Bytes of text that one batch given back is made from; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20
#: A space before white space or at the end.
ODD_SPACE = " (?:[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"
IDS = pa.list_(pa.int32())
#: Above any rank.
NEVER = 1 << 62

# Code points that are letters or numbers in the Unicode tables of ``regex``, and neither in those (version
# 16) by which the published ids were made.
NEWER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: Neither letter, number nor white space in any version.
PRIVATE = "\ue000"


def read_ranks(path: str) -> dict[bytes, int]:
    """Of a file of lines ``base64 rank``; a vocabulary has a fixed size."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks, what they merge to, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        top = max(ranks.values(), default=-1) + 1
        self.bytes: list[bytes | None] = [None] * top
        for t, r in ranks.items():
            self.bytes[r] = t
        self.sizes = [len(t or b"") for t in self.bytes]
        self.longest = max(self.sizes, default=1)
        #: By token, the tokens asked about after it.
        self._after: dict[int, dict[int, bool]] = {}
        self._pairs = 0
        #: The two tokens whose merge gives a token, -1 for none; how far the token's own bytes lead (see ``_parts``).
        self.left, self.right, self.sound = array("i", [-1]) * top, array("i", [-1]) * top, bytearray(top)
        #: Finds all tokens that end at each byte; only those that merging gives.
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for r in range(top):
            if self.bytes[r] is not None and self._parts(r):
                self.finder.add_word(self.bytes[r].decode("latin-1"), r)
        self.finder.make_automaton()

    def merged(self, data: bytes, last: list[bytes] | None = None) -> list[int]:
        """Lowest rank first, leftmost of equals: the definition, used on single tokens and odd pairs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(self.ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in self.ranks]
            if not found:
                break
            i = min(found)[1]
            if last is not None:
                last[:] = parts[i : i + 2]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _parts(self, token: int) -> int:
        """0 if merging the token's own bytes doesn't give the token; 2 if ranks rise from its bytes up to it, else 1.

        A part merges inside the token as it does alone, so the last two parts
        tell the whole tree.  Ranks rise in any trained vocabulary.
        """
        last: list[bytes] = []
        if self.merged(self.bytes[token], last) != [token]:
            return 0
        sound = 2
        if last:
            self.left[token], self.right[token] = (self.ranks[p] for p in last)
            for part in (self.left[token], self.right[token]):
                if self.sizes[part] > 1 and (part > token or self.sound[part] < 2):
                    sound = 1
        self.sound[token] = sound
        return sound

    def _spine(self, token: int, side: array) -> list[int]:
        """The parts at one end of the token, smallest first, itself last."""
        out = [token]
        while (token := side[token]) >= 0:
            out.append(token)
        return out[::-1]

    def follows(self, a: int, b: int) -> bool:
        """Merging the bytes of both gives both again.

        Two parts meet at the border at any time; they merge if their rank is
        below that at which either is absorbed into its own token (on a tie the
        left merge comes first).
        """
        after = self._after.get(a)
        if after is None:
            after = self._after[a] = {}
        if (ok := after.get(b)) is None:
            if self._pairs >= PAIRS:
                for held in self._after.values():  # emptied in place: a running loop may hold one
                    held.clear()
                self._pairs = 0
            self._pairs += 1
            ok = after[b] = self._apart(a, b)
        return ok

    def last_tokens(self, data: str, start: int, last: list[int], stop: int | None = None) -> list[int]:
        """``last`` filled for the prefixes that end from ``start`` to ``stop``; those before are there.

        ``data`` holds one byte per character.
        """
        stop = len(data) if stop is None else stop
        last += [-1] * (stop - start)
        known, follows, sizes, none = self._after.get, self.follows, self.sizes, {}
        found = self.finder.iter(data, max(0, start - self.longest + 1), stop) if start or stop < len(data) else self.finder.iter(data)
        for end, t in found:
            if last[end] < 0:
                j = end - sizes[t]
                if j < 0:
                    last[end] = t
                else:
                    before = last[j]
                    ok = known(before, none).get(t)
                    if ok or (ok is None and follows(before, t)):
                        last[end] = t
        if -1 in last:
            raise ValueError(f"no token ends at byte {last.index(-1)}")
        return last

    def _apart(self, a: int, b: int) -> bool:
        if self.sound[a] < 2 or self.sound[b] < 2:
            return self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        one, two, i, j = self._spine(a, self.right), self._spine(b, self.left), 0, 0
        while True:
            # a part is absorbed at the rank of the next one up
            p = one[i + 1] if i + 1 < len(one) else NEVER
            q_ = two[j + 1] if j + 1 < len(two) else NEVER
            both = self.ranks.get(self.bytes[one[i]] + self.bytes[two[j]])
            if both is not None and both < p and both <= q_:
                return False
            if p == q_ == NEVER:
                return True
            if p <= q_:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The last token of each prefix of ``data``; entry i is that of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, "", []
        self.append(data)

    def _fill(self, start: int, stop: int) -> None:
        self.last = self.vocabulary.last_tokens(self.data, start, self.last, stop)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more.decode("latin-1")
        self._fill(start, len(self.data))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for the bytes from ``start`` to ``stop``; how many entries were computed."""
        old, size, reach = self.last, len(self.data), self.vocabulary.longest
        self.data = self.data[:start] + new.decode("latin-1") + self.data[stop:]
        self.last = old[:start]
        shift, i = len(new) - (stop - start), start + len(new)
        self._fill(start, i)
        while i < len(self.data):
            to = min(len(self.data), i + reach)
            self._fill(i, to)
            same = self.last[i:to] == old[i - shift : to - shift]
            i = to
            if same and to < len(self.data):  # whatever ends later follows one of these
                self.last += old[i - shift : size]
                break
        return i - start

    def tokens(self) -> list[int]:
        out, i = [], len(self.last)
        while i:
            t = self.last[i - 1]
            out.append(t)
            i -= len(self.vocabulary.bytes[t])
        return out[::-1]


class _Known(dict):
    """A table that computes what it doesn't hold and starts anew when it has ``CACHED_BYTES``."""

    def __init__(self, compute):
        self.compute, self.taken = compute, 0

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.compute(key)
        if len(key) <= CACHED_CHARS:
            # about what a row of a dict, a string and a tuple of numbers take
            self.taken += 200 + 4 * len(key) + 40 * len(ids)
            if self.taken > CACHED_BYTES:
                self.clear()
                self.taken = 0
            self[key] = ids
        return ids


class Encoder:
    """Texts to ids and back, by the ranks and a split pattern.

    ``space_starts``: under the pattern every space before a character that is
    no white space starts a match, so texts may be cut there and the cuts
    encoded by themselves.  It holds for the usual patterns whose words take
    one space in front; it only saves time.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, space_starts: bool = False):
        self.vocabulary = Vocabulary(ranks)
        self._compiled = regex.compile(pattern)
        self._newer = regex.compile(f"[{NEWER}]")
        self.space_starts = space_starts
        self._pieces = _Known(self._compute)
        self._after_space = _Known(self._compute_cut)
        self._odd_space = regex.compile(r" (?:\s|$)").search
        self._tokens = pa.array(self.vocabulary.bytes, pa.binary())

    def _classed(self, text: str) -> str:
        """``text`` with every code point that is newer than the ids as one of no class."""
        return text if text.isascii() else self._newer.sub(PRIVATE, text)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        classed = self._classed(text)
        if classed is text or classed == text:
            return self._compiled.findall(text)
        return [text[m.start() : m.end()] for m in self._compiled.finditer(classed)]

    def ends(self, text: str, at: int) -> Iterator[tuple[int, int]]:
        """Start and end of the matches from ``at`` on."""
        return (m.span() for m in self._compiled.finditer(self._classed(text), at))

    def encode_bytes(self, piece: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(piece)
        if whole is not None:
            return [whole]
        last, n = self.vocabulary.last_tokens(piece.decode("latin-1"), 0, []), len(piece) - 1
        out, sizes = [], self.vocabulary.sizes
        while n >= 0:
            out.append(t := last[n])
            n -= sizes[t]
        out.reverse()
        return out

    def _compute(self, piece: str) -> tuple[int, ...]:
        return tuple(self.encode_bytes(piece.encode("utf-8", "replace")))

    def _compute_cut(self, cut: str) -> tuple[int, ...]:
        """Of a space and ``cut``, whose first match begins with the space."""
        if not cut:
            return self._compute(" ")
        first, *more = self.split(" " + cut)
        if not more:
            return self._compute(first)
        return (*self._after_space[first[1:]], *chain.from_iterable(map(self._pieces.__getitem__, more)))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Of one match of the pattern."""
        return self._pieces[piece]

    def _matches(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._pieces.__getitem__, self.split(text))))

    def encode_column(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of each text (none of a null).  Cuts that repeat in the column are looked up once."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.space_starts or not len(texts):
            return pa.array([self.encode(t) for t in texts.to_pylist()], IDS)
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        cut = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        starts, words = cut.offsets.to_numpy(), cut.flatten()
        later = np.delete(np.arange(len(words)), starts[:-1])
        keyed = words.take(pa.array(later)).dictionary_encode()
        at = np.empty(len(words), np.int64)
        at[later] = keyed.indices.to_numpy()
        # what follows a space comes from the table of cuts; the head of a text and a text with an odd space by themselves
        known = self._after_space
        found = list(map(known.__getitem__, keyed.dictionary.to_pylist()))
        heads = [
            self._matches(t) if o else self._matches(t.partition(" ")[0])
            for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)
        ]
        at[starts[:-1]] = len(found) + np.arange(len(heads))
        sizes = np.fromiter(map(len, chain(found, heads)), np.int32, len(found) + len(heads))
        flat = np.fromiter(chain.from_iterable(chain(found, heads)), np.int32, int(sizes.sum()))
        each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
        ids = each.take(pa.array(at))
        return pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[starts]), ids.flatten())

    def decode_column(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each list of ids; none of a null."""
        ids = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
        values, starts = ids.flatten(), ids.offsets.to_numpy()
        if len(values) and not 0 <= pc.min(values).as_py() <= pc.max(values).as_py() < len(self._tokens):
            raise ValueError("an id is outside the vocabulary")
        held = self._tokens.take(values)
        if held.null_count:
            raise ValueError("an id is outside the vocabulary")
        _, offsets, data = held.buffers()
        ends = np.frombuffer(offsets, np.int32)[held.offset : held.offset + len(held) + 1]
        places = pa.array(np.ascontiguousarray(ends[starts - starts[0]]))
        return pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, places.buffers()[1], data])

    def encode(self, text: str) -> list[int]:
        if not self.space_starts or self._odd_space(text):
            return self._matches(text)
        first, *cuts = text.split(" ")
        out = self._matches(first)
        out.extend(chain.from_iterable(map(self._after_space.__getitem__, cuts)))
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


class EditableText:
    """A text with its ids, kept by match; an append or an edit encodes only the matches it can touch.

    A match is settled by its own characters and the two after it, so matches
    that end two characters or more before a change stay.  After the change,
    matching goes on until it meets an old boundary, from where on the old
    matches hold.
    """

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.ends: list[int] = []
        self.ids: list[tuple[int, ...]] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters; how many matches were encoded."""
        keep = int(np.searchsorted(self.ends, start - 2, side="right")) if self.ends else 0
        at = self.ends[keep - 1] if keep else 0
        shift = len(new) - (stop - start)
        later = {e + shift: k for k, e in enumerate(self.ends) if e >= stop}
        self.text = self.text[:start] + new + self.text[stop:]
        ends, ids, encoded = self.ends[:keep], self.ids[:keep], 0
        for begin, end in self.encoder.ends(self.text, at):
            ends.append(end)
            ids.append(self.encoder.encode_piece(self.text[begin:end]))
            encoded += 1
            if end >= start + len(new) and end in later:
                k = later[end]
                ends += [e + shift for e in self.ends[k + 1 :]]
                ids += self.ids[k + 1 :]
                break
        self.ends, self.ids = ends, ids
        return encoded

    def tokens(self) -> list[int]:
        return [t for piece in self.ids for t in piece]


_shared: dict[int, Encoder] = {}


def _encoder(held) -> Encoder:
    """One encoder per worker process, kept from task to task with what it has encoded."""
    ranks, pattern, space_starts = held.value
    key = hash((pattern, space_starts, len(ranks), hash(frozenset(ranks.items()))))
    if key not in _shared:
        _shared.clear()
        _shared[key] = Encoder(ranks, pattern, space_starts)
    return _shared[key]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in turn, cut where ``sizes`` add up to ``most``."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(batch):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encode_texts(
    df: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    text_col: str = "text",
    out_col: str = "ids",
    space_starts: bool = False,
    decoded_col: str | None = None,
    carry: list[str] | None = None,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """The ``carry`` columns (all by default) plus the texts' ids, an array of int; a null text has none.

    ``decoded_col`` names a further column with the bytes that the ids decode
    to, made in the same pass.  Rows pass through one by one, whatever else
    they hold; columns named like a result are replaced; an empty table gives
    an empty result; a text of any length is encoded whole.  ``batch_bytes`` of
    text are encoded at once: fewer take less memory and more time.
    """
    results = [out_col] if decoded_col is None else [out_col, decoded_col]
    taken = {c.lower() for c in results}
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in taken]
    held = df.sparkSession.sparkContext.broadcast((ranks, pattern, space_starts))
    base = df.select(q(text_col), *[q(c) for c in names])
    kinds = [T.ArrayType(T.IntegerType(), False), T.BinaryType()]
    schema = T.StructType([*base.schema.fields[1:], *[T.StructField(c, t) for c, t in zip(results, kinds, strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for part in _slices(batch, lengths, batch_bytes):
                ids = encoder.encode_column(part.column(0))
                out = [*part.columns[1:], ids]
                if decoded_col is not None:
                    out.append(encoder.decode_column(ids))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return base.mapInArrow(releasing(run), schema)


def decode_ids(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` plus the bytes of its ids; null ids give no bytes.  An id outside the vocabulary fails the job."""
    base = df.drop(out_col)
    held = df.sparkSession.sparkContext.broadcast((ranks, "", False))
    place = base.columns.index(ids_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held)
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
            for part in _slices(batch, counts.astype(np.int64) * 4):
                yield pa.RecordBatch.from_arrays([*part.columns, encoder.decode_column(part.column(place))], names=schema.names)

    return base.mapInArrow(releasing(run), schema)
