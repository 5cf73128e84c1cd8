"""Mixing against plain Python."""

import heapq
import random
import re
from fractions import Fraction

from pyspark.sql import functions as F

from tidemark.llm.mixing import cyclic_weights, mix, mixed_texts, sainte_lague, water_fill


def brute_seats(votes, seats):
    """The highest-quotient rule, one seat at a time; ties by position."""
    heap = [(-Fraction(v, 1), i, 1) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    out = [0] * len(votes)
    for _ in range(seats if heap else 0):
        _, i, d = heapq.heappop(heap)
        out[i] += 1
        heapq.heappush(heap, (-Fraction(votes[i], d + 2), i, d + 2))
    return out


def test_sainte_lague_is_the_highest_quotient_rule(spark):
    rng = random.Random(4)
    cases = [([rng.randint(0, 5000) for _ in range(rng.randint(1, 12))], rng.randint(0, 300)) for _ in range(25)]
    cases += [([1] * 9, 4), ([1, 1, 1, 97], 10), ([0, 0], 5), ([26] * 40, 104), ([1000] + [3] * 30, 17)]
    rows = [(g, i, v, s) for g, (votes, s) in enumerate(cases) for i, v in enumerate(votes)]
    df = spark.createDataFrame(rows, "g int, i int, v long, s long")
    got = {(r.g, r.i): r.quota for r in sainte_lague(df, ["g"], ["i"], "v", "s").collect()}
    for g, (votes, s) in enumerate(cases):
        assert [got[g, i] for i in range(len(votes))] == brute_seats(votes, s), (votes, s)


def test_water_fill_reshares_until_none_is_above(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = [rng.choice([0, 1, 5, 50, 5000]) for _ in range(9)]
        rows = [(f"s{i}", 0, s) for i, s in enumerate(sizes)]
        df = cyclic_weights(spark.createDataFrame(rows, "src string, no_src int, source_size long"))
        got = {r.src: r.target for r in water_fill(df, "source_size", "weight", 3).collect()}
        total, fixed = sum(sizes), {}
        while True:  # the rule as it is told
            open_ = [i for i in range(9) if i not in fixed]
            rest = total - sum(fixed.values())
            w = sum(i % 3 + 1 for i in open_)
            share = {i: rest * (i % 3 + 1) / w for i in open_} if w else {}
            above = [i for i in open_ if share[i] > 3 * sizes[i]]
            if not above:
                break
            fixed |= {i: 3 * sizes[i] for i in above}
        for i in range(9):
            assert abs(got[f"s{i}"] - {**share, **fixed}[i]) < 1e-6 * max(1, total)


def test_mix_meets_targets_and_cuts_texts(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        source = rng.choice(["a", "b", "b", "b", "c", None, "d"])
        n = rng.choice([0, 1, 3, 40, 900])
        rows.append((i, None if n == 0 and i % 2 else " ".join(f"w{rng.randint(0, 99)}" for _ in range(n)) + "\n", source, 7))
    rows += [rows[5], rows[6]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mix(df, block_words=8, shard_words=5000)
    got = out.collect()
    assert len(got) == len(rows)
    sums = {}
    for r in got:
        n = len((r.text or "").split())
        assert r.size == n and 0 <= r.taken <= 3 * n
        assert r.taken == sum((s["to"] - s["from"]) * s["times"] for s in r.spans)
        sums.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    for target, taken, size in sums.values():
        assert abs(target - taken) <= 1 and target <= 3 * size + 1e-6
    again = mix(df, block_words=8, shard_words=5000).select("doc_id", "taken")
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r.taken) for r in got)
    texts = mixed_texts(out.where("doc_id > 10")).select("doc_id", "text").collect()
    words = {}
    for r in texts:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.doc_id: r.taken for r in got if r.taken and r.doc_id > 10}
    source = {r[0]: r[1] for r in rows}
    for r in texts:  # every piece of the cut text stands in the document
        assert all(w in source[r.doc_id].split() for w in r.text.split())
    once = [r for r in got if r.spans and all(s["times"] == 1 for s in r.spans) and r.taken == r.size]
    whole = {r.doc_id: r.text for r in texts}
    assert all(whole[r.doc_id] == r.text for r in once if r.doc_id in whole and r.doc_id > 10)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0
    only = mix(spark.createDataFrame([(1, None, None), (2, "", "x")], df.schema)).collect()
    assert [r.taken for r in only] == [0, 0] and re.fullmatch(".*", str(only[0].spans))
    assert mix(df.select("*", F.lit(1).alias("target"))).columns.count("target") == 1


def test_small_sources_meet_their_targets(spark):
    rng = random.Random(9)
    sizes = [1, 2, 3, 10, 33, 40, 64, 100, 5000]
    rows = []
    for s, n in enumerate(sizes):
        while n:
            part = min(n, rng.randint(1, 40))
            rows.append((len(rows), " ".join(f"w{i}" for i in range(part)), f"s{s}"))
            n -= part
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in got:
        assert r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[k] - target[k]) <= max(1, 0.02 * target[k]) for k in target), (taken, target)


def test_reruns_agree_over_partitionings_with_ties(spark):
    rng = random.Random(10)
    rows = [
        (rng.choice([None, 1, 2, i]), " ".join(rng.choices("abcdef", k=rng.choice([3, 3, 50, 3000]))), rng.choice(["a", "b", None]))
        for i in range(120)
    ]
    rows += rows[:20]
    kind = "doc_id long, text string, source string"

    def taken(partitions):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, kind).repartition(partitions)
        return sorted(((str(r.doc_id), r.text, str(r.source), r.taken) for r in mix(df, shard_words=2000).collect()))

    assert taken(1) == taken(7)
