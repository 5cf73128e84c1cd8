"""N-gram Jaccard join in size-banded tiles with bitmap signatures.

Documents become sets of hashed word shingles; equal sets are one node.  All
sets are put into one order of shingles: by how often a table of ``SLOTS``
counters has met a shingle's slot, rarest first, then by hash.  In any fixed
order two sets that link share a shingle among the first
n - ceil(percent * n / 100) + 1 of each, and the smaller one has it even among
its first n - ceil(2 * percent * n / (100 + percent)) + 1.  These first shingles
are the keys by which sets meet, so no link is lost whatever the counters say;
rarest first, lines and phrases that many texts share make no keys.

With ``parts`` there is no order to count for.  Sets are put into bands by size,
such that only sets of one band or of neighbouring ones can link.  Two that
link, the larger one in a given band, differ in no more than d shingles, so each
set is cut by hash into more than d parts, and some part is the same in both.
The sums of the parts are the keys.  This is cheaper where the bound is high.

The connected components of "shares a key" are the clusters.  A cluster is cut
into tiles of bounded size, by band and hash where one does not do.  A first
round holds all sets of a tile against each other and against a few hubs of the
neighbouring tiles; a second one meets pairs of tiles, and there only those sets
that share a key with a set of another component in the other tile.

In a tile each set has a bitmap of hashed shingles.  The set bits in which two
differ bound the overlap from above; pairs that pass, and are not connected
yet, are intersected exactly as sorted arrays.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import discard, materialize, q, releasing, settled

MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Limits of a tile, and the hubs of a band.
TILE_DOCS, TILE_SHINGLES, HUBS = 4000, 3_000_000, 32
#: Counters of shingles, a power of two, and how many are sent together.
SLOTS, _BLOCK = 1 << 25, 1 << 14
_CACHED, _CACHED_WORDS = 400_000, 100_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Words(dict):
    """64-bit hashes of words, a bounded table."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, k: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words are one shingle, none are none."""
    split = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    n = len(split)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, n)
    size = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for j in range(size):
            out = (out ^ h[j : n - size + 1 + j]) * np.uint64(MIX[0])
            out ^= out >> np.uint64(32)
        out *= np.uint64(MIX[1])
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Bands:
    """Bands of set sizes, and into how many parts a set is cut to meet those whose larger one is of a band."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1]
        self._edges: dict[int, np.ndarray] = {}

    def of(self, n: int) -> int:
        """The band of a size; a size and one that links with it lie in the same or in neighbouring bands."""
        while self.starts[-1] <= n:  # the next one starts where two steps of the bound have been made
            self.starts.append(-(-self.starts[-1] * 10000 // self.percent**2) + 1)
        return bisect_right(self.starts, n) - 1

    def differences(self, band: int) -> int:
        """The most shingles in which two that link can differ, the larger one in ``band``."""
        self.of(self.starts[-1])
        return 2 * (self.starts[band + 1] - 1) * (100 - self.percent) // (100 + self.percent)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Keys of a sorted set, the last bit set in those of its own band, which a key must have to matter."""
        n, out = len(s), []
        own = self.of(n)
        if not n:
            return np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((s ^ (s >> np.uint64(31))) * np.uint64(MIX[2]), dtype=np.uint64)])
            for band in (own, own + 1):
                if band > own and 100 * n < self.percent * self.starts[band]:
                    continue
                d = self.differences(band)
                if not d:
                    continue  # only equal sets link, and these are one node
                spare = d // 16
                parts = d + 1 + spare
                at = np.searchsorted(s, self._cuts(parts))
                start, end = np.concatenate([[0], at]), np.concatenate([at, [n]])
                key = (sums[end] - sums[start]) ^ (np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)) * np.uint64(MIX[1])
                key = (key ^ (key >> np.uint64(29))) * np.uint64(MIX[0])
                key ^= key >> np.uint64(32)
                key = (key & ~np.uint64(1)) | np.uint64(band == own)
                filled = end > start
                # at least spare + 1 parts are the same; only if all these are empty are empty parts needed
                out.append(key[filled] if parts - int(filled.sum()) <= spare else key)
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)

    def _cuts(self, parts: int) -> np.ndarray:
        if parts not in self._edges:
            if len(self._edges) >= 64:
                self._edges.clear()
            self._edges[parts] = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        return self._edges[parts]


def keys_of(s: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set; the last bit is set in those that a larger partner must share one of."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    rank = (counts[_slots(s)].astype(np.uint64) << np.uint64(32)) | (s >> np.uint64(32))
    first = s[np.argsort(rank, kind="stable")[: n + 1 + -percent * n // 100]]
    sure = n + 1 + -2 * percent * n // (100 + percent)
    return ((first & ~np.uint64(1)) | (np.arange(len(first)) < sure).astype(np.uint64)).view(np.int64)


def _slots(s: np.ndarray) -> np.ndarray:
    return ((s * np.uint64(MIX[1])) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _counts(df: DataFrame, text_col: str, k: int) -> np.ndarray:
    """How many sets have a shingle of each slot; of equal sets in a task the first counts.

    Each task gives its table in blocks, a count of 255 and more as 255, which
    are added up by block: what comes to the driver is ``SLOTS`` bytes at any
    size of the input.  The counts only order the shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, table = _Words(), _Seen(), np.zeros(SLOTS, np.uint8)
        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py(), k, words)
                if seen.new(xxhash.xxh3_128_digest(s.tobytes())):
                    at = _slots(s)
                    table[at] += table[at] < 255
        parts = table.reshape(-1, _BLOCK)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["block", "counts"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total = held.setdefault(block, np.zeros(_BLOCK, np.uint64))
                total += np.frombuffer(counts, np.uint8)
        data = [_levels(c).tobytes() for c in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(data, pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    out = np.zeros(SLOTS, np.uint8)
    # the driver takes the table from files, one partition at a time: a collect holds it several times over
    blocks = materialize(df.select(q(text_col)).mapInArrow(releasing(run), kind).repartition("block").mapInArrow(releasing(add), kind), "counts")
    for row in blocks.toLocalIterator():
        out[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.counts, np.uint8)
    discard(blocks)
    return out


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes of the same order: 0, and eight steps for each power of two from 1 on."""
    return np.where(counts > 0, 1 + np.floor(8 * np.log2(np.maximum(counts, 1))), 0).clip(max=255).astype(np.uint8)


class _Seen(set):
    """Names a task has met, as many as it can keep."""

    def new(self, name: bytes) -> bool:
        if name in self:
            return False
        if len(self) >= _CACHED:
            self.clear()
        self.add(name)
        return True


def _described(df: DataFrame, id_col: str, text_col: str, k: int, percent: int, parts: bool) -> DataFrame:
    """id, fp (hash of the text), n, sig (16 bytes that name the set), node (its first 8) and keys, written.

    Of equal sets in a task only the first has keys, so a group of copies has no more than the number of tasks.
    """

    held = None if parts else df.sparkSession.sparkContext.broadcast(_counts(df, text_col, k))  # SLOTS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, bands, counts = _Words(), _Seen(), Bands(percent), None if parts else held.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                n, sigs, keys = [], [], []
                for text in part.column(2):
                    s = shingles(text.as_py(), k, words)
                    n.append(len(s))
                    sigs.append(sig := xxhash.xxh3_128_digest(s.tobytes()))
                    if not seen.new(sig):
                        s = s[:0]
                    keys.append(bands.keys(s) if parts else keys_of(s, counts, percent))
                sizes = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(keys)))
                nodes = pa.array([int.from_bytes(x[:8], "big", signed=True) for x in sigs], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), nodes, lists],
                    ["id", "fp", "n", "sig", "node", "keys"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    described = df.select(q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("fp"), q(text_col).alias("text")).mapInArrow(
        releasing(run), f"id {kind}, fp long, n long, sig binary, node long, keys array<long>"
    )
    try:
        return materialize(described, "shingled")
    finally:
        if held is not None:
            held.destroy()  # else it stays until the driver happens to collect its garbage


def _shared(docs: DataFrame) -> DataFrame:
    """(key, u, v) of the nodes u that share a key with another one, v the first of them.

    Rows of one key are sorted, those with the last bit first, and joined to the
    first; they stream through a task, narrow, however many they are.
    """
    key = F.explode("keys")
    keyed = docs.select("node", key.alias("raw")).select(
        "node", F.expr("raw & ~1L").alias("key"), F.expr("cast(raw & 1L as int)").alias("sure")
    )
    first = Window.partitionBy("key").orderBy(F.desc("sure"), "node")
    met = keyed.select(
        "key", F.col("node").alias("u"), F.first("node").over(first).alias("v"), F.first("sure").over(first).alias("matters")
    )
    return materialize(met.where("matters = 1 and u <> v").select("key", "u", "v"), "shared-keys")


def overlap_enough(common, a, b, percent: int):
    """100 * intersection >= percent * union."""
    return 100 * common >= percent * (a + b - common)


def link_tile(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int):
    """Links (i, j) that connect what is not connected yet: enough for the components, not all links.

    ``labels``: components so far; ``left``, ``right``: which positions to hold
    against which.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    bits = 1 << int(max(6, min(14, (2 * int(np.median(sizes)) + 1).bit_length())))
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    for i, s in enumerate(sets):
        at = (s >> np.uint64(50)) & np.uint64(bits - 1)
        np.bitwise_or.at(maps[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    roots, out = labels.copy(), []
    right = right[np.argsort(sizes[right], kind="stable")]
    ordered = sizes[right]
    for i in left[np.argsort(sizes[left], kind="stable")]:
        lo = np.searchsorted(ordered, -(-percent * sizes[i] // 100))
        hi = np.searchsorted(ordered, sizes[i] * 100 // percent, side="right")
        near = right[lo:hi]
        near = near[roots[near] != roots[i]]
        if not len(near):
            continue
        differ = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1, dtype=np.int64)
        most = (sizes[near] + sizes[i] - differ) // 2
        pick = np.flatnonzero(overlap_enough(most, sizes[near], sizes[i], percent))
        for j in near[pick[np.argsort(differ[pick], kind="stable")]]:
            if roots[j] == roots[i]:
                continue
            common = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if overlap_enough(common, sizes[i], sizes[j], percent):
                out.append((int(i), int(j)))
                roots[roots == roots[j]] = roots[i]
    return out


def _tiles(members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) found in the tasks of ``members``: task, side (0: both, 1: left, 2: right), sig, known, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = _Words(), None
        found: dict[tuple[bytes, int], tuple[bytes | None, np.ndarray]] = {}

        def links() -> pa.RecordBatch:
            sigs = [key[0] for key in found]
            sides = np.array([key[1] for key in found])
            names: dict[bytes, int] = {}
            labels = np.array([names.setdefault(known or key[0], len(names)) for key, (known, _) in found.items()])
            sets = [s for _, s in found.values()]
            pairs = link_tile(sets, labels, np.flatnonzero(sides < 2), np.flatnonzero(sides != 1), percent) if sets else []
            return pa.RecordBatch.from_arrays(
                [pa.array([sigs[i] for i, _ in pairs], pa.binary()), pa.array([sigs[j] for _, j in pairs], pa.binary())], ["u", "v"]
            )

        for batch in batches:
            for t, side, sig, known, text in zip(*[c.to_pylist() for c in batch.columns[:4]], batch.column(4), strict=True):
                if t != task:
                    if found:
                        yield links()
                    task = t
                    found.clear()
                if (sig, side) not in found:  # rows may repeat
                    found[sig, side] = known, shingles(text.as_py(), k, words)
        if found:
            yield links()

    placed = members.select("task", "side", "sig", "known", "text").repartition("task").sortWithinPartitions("task")
    return placed.mapInArrow(releasing(run), "u binary, v binary")


def _tiled(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` (cluster, sig, n) plus band and tile; a cluster that fits one tile has one band.

    Also ``tiles``, the number of the cluster's tiles.
    """
    step = float(np.log(100 / percent))
    many = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(TILE_DOCS)), F.ceil(F.sum("n") / F.lit(TILE_SHINGLES)))
    whole = sets.groupBy("cluster").agg(many.alias("needed"))
    band = F.when(F.col("needed") > 1, F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + 1e-9)).otherwise(F.lit(0))
    banded = sets.join(whole, "cluster").withColumn("band", band.cast("int"))
    of_band = banded.groupBy("cluster", "band").agg(many.alias("in_band"))
    return banded.join(of_band, ["cluster", "band"]).select(
        "cluster", "sig", "node", "n", "band", F.pmod(F.xxhash64("sig"), F.col("in_band")).alias("tile"), F.col("needed").alias("tiles")
    )


def _links(held: DataFrame, shared: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) within the clusters, enough of them for the components.

    held: cluster, sig, node, n, text; shared: the keys that nodes share.
    """
    texts = held.select("sig", "text")
    all_ = materialize(_tiled(held.select("cluster", "sig", "node", "n"), percent), "tiles")
    cut = all_.where("tiles > 1")
    around = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    meets = _least(cut, HUBS).select("cluster", around.alias("band"), F.col("sig").alias("hub"))
    task = F.xxhash64("cluster", "band", "tile").alias("task")
    none = F.lit(None).cast("binary").alias("known")
    first = all_.select(task, F.lit(0).alias("side"), "sig", none).unionByName(
        cut.select("cluster", "band", "tile")
        .distinct()
        .join(meets, ["cluster", "band"])
        .select(task, F.lit(2).alias("side"), F.col("hub").alias("sig"), none)
    )
    links = materialize(_tiles(first.join(texts, "sig"), k, percent), "links")
    labels = components(links)
    known = materialize(
        cut.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").select(
            "cluster", "band", "tile", "sig", "node", F.coalesce("label", "sig").alias("known")
        ),
        "known",
    )
    # only those that share a key with a set of another component can link any more, and only with the tiles of such sets
    members = shared.select("key", F.col("u").alias("node")).unionByName(shared.select("key", F.col("v").alias("node")).distinct())
    members = members.join(known.select("node", "band", "tile", F.xxhash64("known").alias("part")), "node")
    mixed = members.groupBy("key").agg(F.min("part").alias("one"), F.max("part").alias("other")).where("one <> other")
    members = materialize(members.join(mixed.select("key"), "key"), "mixed")
    there = members.groupBy("key", F.col("band").alias("band_2"), F.col("tile").alias("tile_2")).agg(
        F.min("part").alias("least"), F.max("part").alias("most")
    )
    meets = (
        members.join(there, "key")
        .where("abs(band - band_2) <= 1 and (band <> band_2 or tile <> tile_2) and (least <> part or most <> part)")
        .select("node", "band_2", "tile_2")
        .distinct()
    )
    own, other = F.struct("band", "tile"), F.struct(F.col("band_2").alias("band"), F.col("tile_2").alias("tile"))
    second = meets.join(known, "node").select(
        F.xxhash64("cluster", F.least(own, other), F.greatest(own, other)).alias("task"),
        F.when(own < other, 1).otherwise(2).alias("side"),
        "sig",
        "known",
    )
    more = _tiles(second.join(texts, "sig"), k, percent)
    return labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(more)


def _least(banded: DataFrame, count: int) -> DataFrame:
    """Up to ``count`` members of each cluster and band: one of each of so many hash classes."""
    return (
        banded.groupBy("cluster", "band", F.pmod(F.xxhash64("sig"), F.lit(count)).alias("class"))
        .agg(F.min("sig").alias("sig"))
        .select("cluster", "band", "sig")
    )


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, parts: bool = False
) -> DataFrame:
    """One row per input row: id, n_shingles and component_id, the smallest id reachable by links.

    Two texts link when 100 * |A & B| >= percent * |A | B| over their sets of
    k-word shingles, A-Z lower-cased.  Defined cases: null, empty and blank
    texts have empty sets and link with nothing, each its own component (a null
    id with an empty text has a null component); a null id never is a
    component_id unless all ids of the component are null; rows that repeat an
    id and a text are one; an empty table gives an empty result; a text of any
    length is one set; other columns are not read.

    ``parts`` tells by which keys sets meet; the result is the same.
    """
    described = _described(df, id_col, text_col, k, percent, parts)
    shared = _shared(described)
    docs = materialize(described.drop("keys"), "sets")
    discard(described)  # the keys take more room than all that follows
    nodes = (
        docs.where("n > 0")
        .groupBy("sig")
        .agg(
            F.min("id").alias("least_id"),
            F.first("n").alias("n"),
            F.first("node").alias("node"),
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "fp")).alias("holder"),
        )
    )
    texts = df.select(q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("fp"), q(text_col).alias("text"))

    def members() -> DataFrame:
        member = nodes.join(components(shared.select("u", "v")), "node").select(
            F.col("label").alias("cluster"), "sig", "node", "n", F.col("holder.id").alias("hid"), F.col("holder.fp").alias("hfp")
        )
        # the members grow with the table, so the join is the same at every size
        joined = member.join(texts.hint("shuffle_merge"), F.col("hid").eqNullSafe(F.col("id")) & (F.col("hfp") == F.col("fp")))
        return joined.groupBy("sig").agg(
            F.first("cluster").alias("cluster"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("text").alias("text")
        )

    held = settled(members, "members")
    labels = settled(lambda: components(_links(held, shared, k, percent)).select(F.col("node").alias("sig"), "label"), "labels")
    discard(held)
    discard(shared)
    by_sig = nodes.select("sig", "least_id").join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    by_label = by_sig.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = by_sig.join(by_label, "label").select("sig", "component_id")
    some = docs.where("n > 0").join(named, "sig").select("id", "n", "component_id")
    none = docs.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
