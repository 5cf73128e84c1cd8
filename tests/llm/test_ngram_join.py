"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from tidemark.llm import ngram_join, shared
from tidemark.llm.components import components
from tidemark.llm.ngram_join import Bands, jaccard_components, keys_of


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=120, edits=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, base = [], []
    shared = rng.choices(vocabulary, k=40)
    for i in range(n):
        if base and rng.random() < 0.6:
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = rng.choices(vocabulary, k=rng.choice([1, 3, 30, 120, 400]))
            if rng.random() < 0.4:
                w += shared
        base.append(w)
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else "\n ".join(w)))
    return rows + [(9000, None), (9001, ""), (9002, " \t"), (9003, rows[0][1]), (9004, rows[0][1] + " \n")]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_components_match_all_pairs(spark, k, percent):
    rows = corpus(k)
    random.Random(1).shuffle(rows)
    want = brute(rows, k, percent)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent, parts=percent == 85).collect()
    assert len(got) == len(rows) and len({c for _, c in want.values()}) < len(rows) - 10
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_large_clusters_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_DOCS", 10)
    monkeypatch.setattr(ngram_join, "HUBS", 3)
    rows = corpus(11, n=90, edits=9)
    rng = random.Random(2)
    hot = rng.choices([f"h{i}" for i in range(900)], k=150)
    for i in range(200, 290):  # a large group of near copies, some of which don't link with each other
        w = list(hot)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    want = brute(rows, 4, 85)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("parts", [True, False])
def test_a_large_cluster_that_does_not_link(spark, monkeypatch, parts):
    monkeypatch.setattr(ngram_join, "TILE_DOCS", 10)
    monkeypatch.setattr(ngram_join, "HUBS", 3)
    rng = random.Random(5)
    shared = [f"s{j}" for j in range(100)]
    rows = []
    for i in range(120):  # all share a passage of half their words, few link
        w = shared + [f"o{rng.random()}" for _ in range(rng.randint(80, 110))]
        rows.append((i, " ".join(w)))
        if i % 40 == 0:
            w[rng.randrange(len(w))] = "edit"
            rows.append((1000 + i, " ".join(w)))
    want = brute(rows, 4, 85)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85, parts=parts).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_second_round_sends_sets_only_to_tiles_they_share_a_key_with(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_DOCS", 10)
    monkeypatch.setattr(ngram_join, "HUBS", 3)
    rounds, tiles = [], ngram_join._tiles
    monkeypatch.setattr(ngram_join, "_tiles", lambda members, k, percent: rounds.append(members.count()) or tiles(members, k, percent))
    rng = random.Random(8)
    passages = [[f"p{rng.random()}" for _ in range(60)] for _ in range(201)]
    rows = [(i, " ".join(passages[i] + passages[i + 1])) for i in range(200)]  # a cluster in which each meets two others
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()
    assert all(r.component_id == r.doc_id for r in got)
    assert rounds[0] >= len(rows) and len(rounds) == 2 and rounds[1] <= 2 * len(rows)


@pytest.mark.parametrize("parts", [True, False])  # the pipeline meets by prefix keys
def test_only_results_stay_on_disk(spark, parts):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = {str(b) for b in blocks.getAllBlocks().mkString(" ").split()}
    written = len(shared._written)
    found = jaccard_components(spark.createDataFrame(corpus(3), "doc_id long, text string"), k=4, percent=85, parts=parts)
    left = {b for b in blocks.getAllBlocks().mkString(" ").split() if b not in before and b.startswith("shuffle")}
    assert len(shared._written) - written == 2  # one row per document, and the labels
    assert not left
    assert found.count() == len(corpus(3))


@pytest.mark.parametrize("percent", [80, 85, 50])
def test_sets_that_link_share_a_part(percent):
    rng, bands = np.random.default_rng(percent), Bands(percent)
    for _ in range(3000):
        n = int(rng.integers(1, rng.choice([8, 40, 400, 3000])))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        # as many words go and come as the bound lets
        common = n - int(rng.integers(0, n + 1 - -(-n * percent // 100)))
        extra = int(rng.integers(0, max(1, common * 100 // percent - n + 1)))
        b = np.unique(np.concatenate([a[:common], rng.integers(0, 2**64, extra, dtype=np.uint64)]))
        a = np.unique(a)
        if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
            one, two = bands.keys(a), bands.keys(b)
            met = np.intersect1d(one & ~1, two & ~1)
            assert len(met)
            assert {k & ~1 for k in (*one.tolist(), *two.tolist()) if k & 1} & set(met.tolist())


@pytest.mark.parametrize("percent", [80, 85, 50])
def test_sets_that_link_share_a_key(percent):
    rng = np.random.default_rng(percent)
    counts = rng.integers(0, 4, ngram_join.SLOTS).astype(np.uint32)
    for _ in range(3000):
        n = int(rng.integers(1, rng.choice([8, 40, 400, 3000])))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        # as many words go and come as the bound lets
        common = n - int(rng.integers(0, n + 1 - -(-n * percent // 100)))
        extra = int(rng.integers(0, max(1, common * 100 // percent - n + 1)))
        b = np.unique(np.concatenate([a[:common], rng.integers(0, 2**64, extra, dtype=np.uint64)]))
        a = np.unique(a)
        if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
            one, two = (keys_of(x, counts, percent) for x in (a, b))
            met = set((one & ~1).tolist()) & set((two & ~1).tolist())
            assert met & {k & ~1 for k in (*one.tolist(), *two.tolist()) if k & 1}


def test_components_by_rounds(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(130)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    lone = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    assert {r.node: r.label for r in got} == {k: v for k, v in root.items() if k not in lone} and len(got) == len(root) - len(lone)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n string")
    assert jaccard_components(df).count() == 0
    rows = [(3, "a b c d e f", "z"), (3, "a b c d e f", "z"), (None, "A b c d e f", None), (5, "q", "z"), (None, "q", "z"), (7, None, "z")]
    got = jaccard_components(spark.createDataFrame(rows, df.schema)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [
        (-1, 1, 5), (-1, 2, 3), (3, 2, 3), (3, 2, 3), (5, 1, 5), (7, 0, 7),
    ]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u int, v int")
    assert {r.node: r.label for r in components(chain).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_counters_tell_rare_shingles_from_shared_ones_at_6_gb():
    """With 900 million shingles counted, about those of 6 GB, few that 20 texts share are among the keys of a text."""
    rng = np.random.default_rng(8)
    counted = rng.poisson(900e6 / ngram_join.SLOTS, ngram_join.SLOTS).astype(np.uint32)
    keys = shared_keys = 0
    for _ in range(20):
        s = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
        common = rng.choice(s, 60, replace=False)
        here = counted.copy() if not keys else here
        at = ngram_join._slots(common)
        here[at] += 20
        first = keys_of(s, here, 80).view(np.uint64) & ~np.uint64(1)
        keys += len(first)
        shared_keys += int(np.isin(first, common & ~np.uint64(1)).sum())
    assert shared_keys < 0.005 * keys, (shared_keys, keys)


def test_levels_keep_the_order():
    counts = np.array([0, 1, 2, 3, 4, 7, 8, 100, 255, 1000, 10**6, 2**32], np.uint64)
    levels = ngram_join._levels(counts).astype(int)
    assert levels[0] == 0 and (np.diff(levels) > 0).all()


def test_counters_come_to_the_driver_in_parts(spark, monkeypatch):
    """No collect holds the whole table, its broadcast goes once the keys are written, and freed memory is given back."""
    sent, relieved = [], []
    broadcast, relieve = type(spark.sparkContext).broadcast, shared.relieve
    df = spark.createDataFrame([(i, f"a b c d e f g {i // 2}") for i in range(8)], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", lambda self: (_ for _ in ()).throw(AssertionError("collect")))
        m.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
        m.setattr(shared, "relieve", lambda session: relieved.append(session) or relieve(session))
        got = jaccard_components(df)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(i, i // 2 * 2) for i in range(8)]
    assert len(sent) == 1 and not sent[0]._jbroadcast.isValid() and len(relieved) > 5
    assert shared.trimmed(spark)
