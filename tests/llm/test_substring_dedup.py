"""Chaining against quadratic search; planted passages, exact and fuzzy."""

import random

import numpy as np
import pyarrow as pa

from tidemark.llm import substring_dedup as sd
from tidemark.llm.substring_dedup import GAP_COST, _agreeing_around, _alone, _meet, _open, _regions, agreeing, align, chains, may_align, passages, repeated_passages, runs, seeds


def best_chain(matches, k):
    order = sorted(set(matches))
    score = []
    for p, h in order:
        own = float(k)
        for j, (p2, h2) in enumerate(order[: len(score)]):
            if p2 < p and h2 < h:
                own = max(own, score[j] - GAP_COST * (p - p2 + h - h2) + k)
        score.append(own)
    return max(score)


def value(chain, k):
    return k + sum(k - GAP_COST * (p - p2 + h - h2) for (p2, h2), (p, h) in zip(chain, chain[1:], strict=False))


def test_fenwick_chains_are_as_good_as_a_quadratic_search():
    rng = random.Random(13)
    for _ in range(200):
        matches = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 40))]
        found = chains(matches, 6)
        assert abs(value(found[0], 6) - best_chain(matches, 6)) < 1e-9
        assert sorted(m for c in found for m in c) == sorted(set(matches))
        assert all(p < p2 and h < h2 for c in found for (p, h), (p2, h2) in zip(c, c[1:], strict=False))


def test_seeds_are_shared_by_long_matches():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate((rng.integers(0, 2**63, 111).astype(np.uint64), a[100:127], rng.integers(0, 2**63, 50).astype(np.uint64)))
    x, y = seeds([a], 8, 20), seeds([b], 8, 20)
    assert set(x[0]) & set(y[0])
    assert len(x[0]) < 60 and len(seeds([a[:7]], 8, 20)[0]) == 0 and len(seeds([a[:8]], 8, 20)[0]) == 1


def test_seeds_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (0, 5, 6, 7, 21, 22, 300, 0, 40, 3)]
    texts += [np.tile(texts[3][:p], 9) for p in (1, 2, 5, 7)]
    h, at, counts = seeds(texts, 6, 16)
    ends = np.cumsum(counts)
    for t, start, end in zip(texts, ends - counts, ends, strict=True):
        every, _, _ = seeds([t], 6, 1)  # all shingles
        windows = range(max(1, len(every) - 15)) if len(every) else []
        of = every.view(np.uint64) >> np.uint64(24)
        assert at[start:end].tolist() == sorted({w + int(of[w : w + 16].argmin()) for w in windows})
        assert h[start:end].tolist() == every[at[start:end]].tolist()


def test_alignment_counts_agreeing_words():
    a = np.arange(100)
    b = np.concatenate((np.arange(500, 510), np.arange(0, 40), [999], np.arange(41, 100)))
    assert align(a, b, [(5, 15), (60, 70)], 8) == (0, 100, 10, 110, 99)


def test_planted_passages_are_found(spark):
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(80)]
    rows, planted = [], {}
    for i in range(80):
        w = [word() for _ in range(rng.randint(60, 300))]
        if i % 4 == 0:  # exact, or with a word changed, dropped or put in
            p = list(passage)
            if i % 8 == 0:
                p[40] = "changed"
                del p[60]
                p.insert(10, "extra")
            at = rng.randint(0, len(w))
            w[at:at] = p
            planted[i] = (at, at + len(p))
        if i % 4 == 1:  # too short to count
            w[30:30] = passage[:40]
        rows.append((i, " ".join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "a b"), (3, rows[3][1])]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hit = {}
    for r in got:
        hit.setdefault(r.doc_id, []).append(r)
        if r.identity == 1.0:
            a, b = dict(rows)[r.doc_id].split(), dict(rows)[r.other_id].split()
            assert a[r.start : r.end] == b[r.other_start : r.other_end]
    assert {500, 501} <= set(hit) and {r.other_id for r in hit[500]} == {3}
    caught = set(hit) | {r.other_id for r in got}
    assert caught == set(planted) | {3, 500, 501}
    for i, (s, e) in planted.items():
        for r in hit.get(i, []):
            assert abs(r.start - s) <= 12 and abs(r.end - e) <= 12 and r.n_words >= 50, (i, r)


def test_nothing_repeats(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c " * 40), (1, "a b c " * 40), (2, "x y")]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.other_id, r.n_words) for r in got] == [(None, 1, 120)]


def test_a_lone_match_beside_a_longer_chain_is_aligned(spark):
    matches = [(10, a, a) for a in (0, 10, 20)] + [(11, 24, 0), (11, 300, 5)]
    kind = "node long, matches array<struct<other:long,at:int,there:int>>, text string"
    rows = spark.createDataFrame([(1, matches, " ".join(f"w{i}" for i in range(400)))], kind)
    got = sorted((r.other, list(zip(r.p, r.h, strict=True))) for r in _regions(rows, 8, 50).collect())
    assert got == [(10, [(0, 0), (10, 10), (20, 20)]), (11, [(24, 0)]), (11, [(300, 5)])]


def test_a_chain_over_an_insertion_is_cut_to_its_passages():
    a = np.concatenate((np.arange(60), np.arange(900, 940), np.arange(60, 120)))
    b = np.arange(120)
    chain = [(0, 0), (40, 40), (110, 70), (150, 110)]
    assert sorted(passages(a, b, chain, 8, 50, 0.8)) == [(0, 60, 0, 60, 60), (100, 160, 60, 120, 60)]
    assert passages(b, b, [(0, 0), (100, 100)], 8, 50, 0.8) == [(0, 120, 0, 120, 120)]
    assert passages(a, b, chain, 8, 61, 0.8) == []


def test_stretches_are_those_of_a_scan():
    rng = random.Random(3)
    for _ in range(60):
        b = np.array([rng.randrange(10**6) for _ in range(120)])
        a = np.array([x if rng.random() < 0.75 else -1 for x in b])
        a[20:28], a[90:98] = b[20:28], b[90:98]
        chain = [(20, 20), (90, 90)]
        s, e, so, eo, same = align(a, b, chain, 8)
        pairs = agreeing(a, b, chain, 8)
        assert len(pairs) == same and (pairs[:, 0] == pairs[:, 1]).all()
        at = [int(x) for x in pairs[:, 0]]
        fit = [j - i + 1 for i in range(len(at)) for j in range(i, len(at)) if at[j] - at[i] + 1 >= 50 and j - i + 1 >= 0.8 * (at[j] - at[i] + 1) - 1e-9]
        got = passages(a, b, chain, 8, 50, 0.8)
        if same >= 0.8 * (e - s):
            assert got == [(s, e, so, eo, same)]
        else:
            assert max((x[4] for x in got), default=0) == max(fit, default=0)


def test_runs_of_seeds():
    each = lambda *found: runs([(at, h, i, 0) for i, (at, h) in enumerate(found)], 8, 20, 50)  # noqa: E731  no two with one first holder
    assert [at for _, at in each((0, 5), (10, -6), (30, 7), (51, 8))] == [0, 10]
    assert [at for _, at in each(*((i, i) for i in range(0, 100, 10)))][:4] == [0, 0, 0, 10]
    a, b = each((0, 5), (10, -6)), each((3, -6), (9, 5))
    assert a[0][0] != b[0][0] and a[0][0] == each((7, 5), (17, -6))[0][0]
    assert runs([(0, 5, 1, 40), (10, 6, 1, 50), (20, 7, 1, 60)], 8, 20, 50) == []
    assert [at for _, at in runs([(0, 5, 1, 40), (10, 6, 1, 50), (20, 7, 2, 60)], 8, 20, 50)] == [10]
    assert len(each(*((i, 1) for i in range(100)))) == 6 * 2
    assert [at for _, at in runs([(0, 5, 1, 40), (10, 6, 1, 5)], 8, 20, 50)] == [0]


def test_passages_of_frequent_lines_are_found(spark):
    rng = random.Random(15)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], []
    for i in range(80):
        n = (27, 35)[i % 2]
        a, b = words(n), words(n)
        for line in (a, b):  # each alone in several texts
            rows += [(len(rows) + j, " ".join(words(30) + line + words(30))) for j in range(6)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows) + j, " ".join(words(30) + a + b + words(30))) for j in range(2)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {tuple(sorted((r.doc_id, r.other_id))): r.n_words for r in got}
    assert set(found) == set(pairs) and all(n >= 50 for n in found.values())


def best_local_identity(a, b, min_words):
    """Share of equal words of the best stretch of ``min_words`` on any diagonal, by trying all."""
    best = 0
    for shift in range(min_words - len(a), len(b) - min_words + 1):
        lo, hi = max(0, -shift), min(len(a), len(b) - shift)
        equal = np.cumsum([0, *(x == y for x, y in zip(a[lo:hi], b[lo + shift : hi + shift], strict=True))])
        if hi - lo >= min_words:
            best = max(best, int((equal[min_words:] - equal[:-min_words]).max()) / min_words)
    return best


def test_recall_at_scattered_substitutions(spark):
    """Passages of 80 words, 15 % of them changed: at least 0.9 of those that a search over all diagonals finds."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for i in range(200):
        passage = [word() for _ in range(80)]
        changed = [word() if rng.random() < 0.15 else w for w in passage]
        for j, p in enumerate((passage, changed)):
            w = [word() for _ in range(rng.randint(20, 60))]
            at = rng.randint(0, len(w))
            rows.append((2 * i + j, " ".join(w[:at] + p + w[at:])))
    want = {i for i in range(200) if best_local_identity(rows[2 * i][1].split(), rows[2 * i + 1][1].split(), 50) >= 0.8}
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id // 2 for r in found if r.doc_id // 2 == r.other_id // 2}
    assert all(r.doc_id // 2 == r.other_id // 2 for r in found)
    assert len(want) > 180 and len(got & want) >= 0.9 * len(want), (len(got & want), len(want))


def test_defined_cases(spark):
    rng = random.Random(22)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60000))
    part = " ".join(long.split(" ")[30000:30070])
    rows = [(1, long, 1), (2, "x y " + part + " z", 2), (3, None, 3), (3, None, 3), (4, "", 4), (2, "x y " + part + " z", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long").selectExpr("*", "1 as h", "2 as `other.id`", "3 as id")
    got = repeated_passages(df)
    assert got.columns == ["doc_id", "start", "end", "other_id", "other_start", "other_end", "n_words", "identity"]
    found = {(r.doc_id, r.start, r.end, r.other_id, r.other_start, r.other_end) for r in got.collect()}
    assert found in ({(1, 30000, 30070, 2, 2, 72)}, {(2, 2, 72, 1, 30000, 30070)})


def test_holders_of_a_seed_meet_without_its_first_holder(spark):
    """A common line of 24 words, and pairs of texts that go on from it alike, every fourth word changed."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, pairs = words(24), set()
    rows = [(i, " ".join(words(40) + line + words(40))) for i in range(400)]
    for _ in range(20):
        more = words(36)
        changed = [w if j % 4 != 3 else words(1)[0] for j, w in enumerate(more)]
        n = len(rows)
        rows += [(n, " ".join(words(30) + line + more + words(30))), (n + 1, " ".join(words(35) + line + changed + words(20)))]
        pairs.add((n, n + 1))
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in got} == pairs
    assert all(r.n_words >= 40 and r.identity >= 0.8 for r in got)


def test_few_and_many_places_meet_alike():
    """All pairs with 40 equal words of some 50 are met, in one block or two, by triples of words or by all words."""
    rng = np.random.default_rng(6)
    for n in (40, 400):
        x = rng.integers(1, 2**32, (n, 206)).astype(np.uint32)
        x[:, 100:106] = x[0, 100:106]
        want = set()
        for i in range(0, 20, 2):
            x[i + 1, 80:150] = np.where(rng.random(70) < 0.12, x[i + 1, 80:150], x[i, 80:150])
            x[i + 1, 100:106] = x[0, 100:106]
            want.add((i, i + 1))
        for sides in (np.zeros(n, int), np.arange(n) % 2 + 1):
            met = _meet(x, sides, np.arange(n), np.arange(n), [[]] * n, 6, 50, 0.8)
            assert {tuple(sorted(map(int, p))) for p in met} == want


def test_chains_of_two_texts_share_their_words(spark):
    """Lone matches side by side go through the shuffle in one row, with the words around them once."""
    matches = [(10, a, 500 - a) for a in range(100, 200, 10)] + [(10, 390, 90)]
    rows = spark.createDataFrame([(1, matches, " ".join(f"w{i}" for i in range(400)))], "node long, matches array<struct<other:long,at:int,there:int>>, text string")
    near, far = sorted(_regions(rows, 8, 50).collect(), key=lambda r: r.start)
    assert list(zip(near.p, near.h, strict=True)) == [(a, 500 - a) for a in range(100, 200, 10)] and list(near.sizes) == [1] * 10
    assert (near.start, len(near.words)) == (36, 190 + 8 + 64 - 36)
    assert (far.start, len(far.words), list(far.p), list(far.h)) == (326, 400 - 326, [390], [90])


def test_agreement_around_lone_matches_is_that_of_their_diagonals():
    rng = np.random.default_rng(8)
    a, b = (rng.integers(0, 3, n).astype(np.int32) for n in (150, 400))
    p, h = rng.integers(0, 142, 5000), rng.integers(0, 392, 5000)
    got = _agreeing_around(a, b, p, h, 8)
    for i, j, n in zip(p.tolist(), h.tolist(), got.tolist(), strict=True):
        steps = range(-min(i, j, 64), min(8 + 64, 150 - i, 400 - j))
        assert n == sum(a[i + t] == b[j + t] for t in steps)


def met(x, near):
    n = len(x)
    return [tuple(sorted(map(int, p))) for p in _meet(x, np.zeros(n, int), np.arange(n), np.arange(n), near, 6, 50, 0.8)]


def test_texts_that_share_less_than_a_passage_do_not_meet():
    """40 to 49 words alike, or two lines far enough apart, are no passage: no pair of them goes on to be aligned."""
    rng = np.random.default_rng(7)
    for n in (40, 400):
        x = rng.integers(1, 2**32, (n, 206)).astype(np.uint32)
        x[:, 100:145] = x[0, 100:145]
        assert met(x, [[]] * n) == []
    x = rng.integers(1, 2**32, (20, 206)).astype(np.uint32)
    line = x[0, :24].copy()
    x[:, 100:124] = x[0, 100:124]
    for i in range(20):
        x[i, 144 + i : 168 + i] = line
    assert met(x, [[(7, 44 + i)] for i in range(20)]) == []


def test_a_family_that_shares_a_passage_has_no_more_links_than_texts():
    """Two lines of 24 words with 2 to 8 others between: every text is linked, but not every pair."""
    rng = np.random.default_rng(9)
    x = rng.integers(1, 2**32, (21, 206)).astype(np.uint32)
    line, near = x[0, :24].copy(), []
    x[:, 100:124] = x[0, 100:124]
    for i in range(21):
        at = 126 + i % 7
        x[i, at : at + 24] = line
        near.append([(9, 12), (7, at - 100), (8, at + 9 - 100)])
    found = met(x, near)
    linked, grown = {0}, True
    while grown:
        more = {j for p in found if set(p) & linked for j in p} - linked
        grown = bool(more)
        linked |= more
    assert linked == set(range(21)) and len(found) == 20


def test_what_may_align_is_no_less_than_what_does():
    rng = np.random.default_rng(10)
    x = rng.integers(1, 2**32, (600, 206)).astype(np.uint32)
    y = rng.integers(1, 2**32, (600, 206)).astype(np.uint32)
    want = np.zeros(600, bool)
    for i in range(600):
        # a copy of what is around the middle, with words changed, dropped and put in
        keep, lost = rng.random(206) >= 0.22 * rng.random(), rng.random(206) < 0.04 * rng.random()
        begin, stop = 100 - int(rng.integers(0, 60)), 106 + int(rng.integers(0, 60))
        changed = np.where(keep, x[i], y[i])
        after, before = changed[106:stop][~lost[106:stop]], changed[begin:100][~lost[begin:100]]
        y[i, 100:106], y[i, 106 : 106 + len(after)] = x[i, 100:106], after
        y[i, 100 - len(before) : 100] = before
        every = [(p, h) for p in range(201) for h in range(max(0, p - 20), min(201, p + 21)) if (x[i, p : p + 6] == y[i, h : h + 6]).all()]
        chain = next(c for c in chains(every, 6) if (100, 100) in c)
        want[i] = any(s <= 100 and 106 <= e for s, e, *_ in passages(x[i], y[i], chain, 6, 50, 0.8))
    got = may_align(x, y, 6, 50, 0.8)
    assert 100 < want.sum() < 500 and got[want].all() and got.sum() < want.sum() + 60
    equal = x == y
    for a, b, wide, same in zip(x, y, *_alone(equal, 100, 6), strict=True):
        s, e, _, _, n = align(a, b, [(100, 100)], 6)
        assert (e - s, n) == (wide, same)


def test_open_seeds_are_those_with_several_labels(spark):
    rng = random.Random(11)
    places = {(rng.randrange(20), rng.randrange(20), rng.randrange(0, 300)) for _ in range(60)}  # h, node, at
    first = {h: min(n for g, n, _ in places if g == h) for h, _, _ in places}
    there = {h: min(at for g, n, at in places if g == h and n == first[h]) for h in first}
    held = {}
    for h, node, at in places:
        held.setdefault(node, []).append((h, at, first[h], there[h]))
    found = []
    for node in held:
        for _ in range(20):
            s, o = rng.randrange(0, 60), rng.randrange(0, 60)
            found.append((node, rng.randrange(0, 10), s, s + 240, o, o + 240))
    found = [p for p in found if p[0] > p[1]]
    label = {}
    for h, node, at in places:
        over = [q for n, q, s, e, so, eo in found for g, m, to in places if n == node and (g, m) == (h, q) and s <= at and at + 6 <= e and so <= to and to + 6 <= eo]
        label[h, node] = min([node, *over, label.get((h, node), node)])
    want = set()
    for h in first:
        own = [(node, at, label[h, node]) for g, node, at in places if g == h]
        if len({x[2] for x in own}) > 1:
            want |= {(h, node, at, to, len(own)) for node, at, to in own}
    kind = "node long, held array<struct<h:long,at:int,other:long,there:int>>"
    shared = spark.createDataFrame(list(held.items()), kind)
    laid = spark.createDataFrame(found, "node long, other long, start long, end long, other_start long, other_end long")
    got = [tuple(r) for r in _open(shared, laid, 6).select("h", "node", "at", "label", "n").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert {h for h in first if len({n for g, n, _ in places if g == h}) > 1} - {h for h, *_ in want}  # some are joined to one


def test_words_are_hashed_once_and_serve_every_later_step(spark):
    texts = [" ".join(f"w{(i * j) % 97}é" for i in range(120)) for j in (1, 2, 3)] + ["", None]
    seeded = sd._seeded(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id", "text", 6, 16).collect()
    words = {r.id: bytes(r.words) for r in seeded}
    for i, text in enumerate(texts):
        assert words[i] == sd.short_hashes(text).tobytes() and len(words[i]) == 4 * len((text or "").split())
    rows = [(i, [(9, 10, 40), (9, 60, 90)], i) for i in range(3)]
    kind = "node long, matches array<struct<other:long,at:int,there:int>>, text"
    by_text = _regions(spark.createDataFrame([(n, m, texts[i]) for n, m, i in rows], f"{kind} string"), 6, 50)
    by_words = _regions(spark.createDataFrame([(n, m, bytearray(words[i])) for n, m, i in rows], f"{kind} binary"), 6, 50)
    assert sorted(by_words.collect()) == sorted(by_text.collect())


def test_common_words_are_those_of_a_plain_search():
    rng = np.random.default_rng(5)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(0, 12)) for _ in range(2))
        assert sd._common(a, b) == plain(a.tolist(), b.tolist())


def test_passages_join_a_seed_by_any_of_its_places_in_the_other_text(spark):
    held = "node long, held array<struct<h:long,at:int>>"
    laid = ", laid array<struct<other:long,start:long,end:long,other_start:long,other_end:long>>"
    rows = spark.createDataFrame([(7, [(5, 90), (3, 12), (3, 14), (4, 55)], [(1, 10, 60, 100, 150), (2, 50, 60, 0, 10)])], held + laid)
    covered = sd._covered(rows, 6)
    assert sorted((r.other, r.h) for r in covered.collect()) == [(1, [3])]
    for places, want in (([20, 144], [3]), ([20, 145], []), ([99], []), ([100], [3])):
        other = spark.createDataFrame([(1, [(3, p) for p in places])], held.replace("node", "other"))
        assert [r.h for r in sd._led(covered.join(other, "other"), 6).collect()] == want


def test_a_pair_of_texts_stays_one_row_with_the_seeds_of_both(spark):
    rng = random.Random(15)
    held = {node: [(rng.randrange(12), at, 0, 0) for at in range(0, 10 * rng.randrange(1, 9), 10)] for node in range(20)}
    shared = spark.createDataFrame(list(held.items()), "node long, held array<struct<h:long,at:int,other:long,there:int>>")
    pairs = [(a, b, 900 + a, 800 + c) for a in range(20) for b in range(a) if rng.random() < 0.4 for c in range(2)]
    both = sd._with_seeds(spark.createDataFrame(pairs, "node long, other long, at int, there int"), shared)
    got = [(r.node, r.other, *m) for r in both.collect() for m in zip(r["at"], r.there, strict=True)]
    first = {node: {h: at for h, at, *_ in reversed(seeds_of)} for node, seeds_of in held.items()}
    want = [(a, b, at, first[b][h]) for a, b in {p[:2] for p in pairs} for h, at, *_ in held[a] if h in first[b]]
    assert sorted(got) == sorted(want + pairs) and want
    assert both.count() == len({p[:2] for p in pairs})
    assert "Generate" not in both._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.node, *m) for r in sd._gathered(both).collect() for m in r.matches) == sorted(got)


def test_chains_that_keep_to_a_diagonal_are_aligned_as_one_by_one(spark):
    rng = np.random.default_rng(16)
    rows, want = [], set()
    for node in range(60):
        b = rng.integers(0, 2**31, 260).astype(np.int32)
        shift = int(rng.integers(-40, 40))
        a = np.concatenate((rng.integers(0, 2**31, 40 + shift), b, rng.integers(0, 2**31, int(rng.integers(0, 50))))).astype(np.int32)
        lost = rng.random(len(a)) < 0.3 * rng.random()
        a[lost] = rng.integers(0, 2**31, int(lost.sum()))
        a = np.delete(a, rng.integers(0, len(a), int(rng.integers(0, 3))))
        start = int(rng.integers(0, 20))
        n = min(len(a), 180)
        every = [(p, h) for p in range(start, start + n - 6, 5) for h in range(255) if (a[p : p + 6] == b[h : h + 6]).all()]
        held = [c for c in sd.chains(every, 6)] + [[m] for m in every[::7]]
        for chain in held:
            lo, there = max(start, chain[0][0] - 64), max(0, chain[0][1] - 64)
            x, y = a[lo : min(start + n, chain[-1][0] + 70)], b[there : chain[-1][1] + 70]
            for s, e, so, eo, same in passages(x, y, [(p - lo, h - there) for p, h in chain], 6, 50, 0.8):
                want.add((node, 1000 + node, s + lo, e + lo, so + there, eo + there, same, same / max(e - s, eo - so)))
        if held:
            p, h = ([int(m[i]) for c in held for m in c] for i in (0, 1))
            rows.append((node, 1000 + node, start, [len(c) for c in held], p, h, a[start : start + n].tolist(), bytearray(b.tobytes())))
    got = sd._aligned(spark.createDataFrame(rows, sd.REGION + ", text binary"), 6, 50, 0.8).collect()
    assert {tuple(r) for r in got} == want and len(want) > 50


def test_runs_of_many_texts_are_those_of_each():
    rng = random.Random(17)
    texts = []
    for _ in range(40):
        at, found = 0, []
        for _ in range(rng.randrange(30)):
            at += rng.randrange(1, 22)
            found.append((at, rng.choice([5, rng.randrange(-9, 9)]), rng.randrange(2), rng.choice([at + 3, rng.randrange(200)])))
        texts.append(found)
    node = np.repeat(np.arange(40), [len(t) for t in texts])
    at, h, other, there = np.array([x for t in texts for x in t], np.int64).T.copy()
    begins, keys = sd._runs(node, at, h, other, there, 6, 16, 50)
    got = list(zip(node[begins].tolist(), keys.tolist(), at[begins].tolist(), strict=True))
    assert got == [(i, *x) for i, t in enumerate(texts) for x in runs(t, 6, 16, 50)] and got


def test_the_place_in_the_first_holder_is_its_first(spark):
    keys = [(node, h, at, at == min(a for n, g, a in places if (n, g) == (node, h))) for places in [[(n, g, a) for n in (3, 1, 2) for g in (7, 8 + n) for a in (50, 20, 90)]] for node, h, at in places]
    got = sd._met(spark.createDataFrame(keys, "node long, h long, at int, first boolean")).collect()
    assert sorted((r.node, r.h, r.at, r.other, r.there) for r in got) == sorted((n, 7, a, 1, 20) for n in (1, 2, 3) for a in (20, 50, 90))


def test_words_of_many_texts_are_hashed_as_those_of_each():
    rng = random.Random(18)
    texts = ["".join(rng.choice("ab é漢\t\n\x0b\x1c\xa0 ") for _ in range(rng.choice([0, 1, 9, 200]))) for _ in range(200)]
    texts += ["x" * n + " y" for n in (7, 8, 9, 16, 63, 64, 65, 200)] + [None, "a"]
    h, counts = sd._words(pa.array(texts, pa.string()).slice(1))
    split = [(t or "").encode().split() for t in texts[1:]]
    assert counts.tolist() == [len(x) for x in split]
    named = dict(zip([w for x in split for w in x], h.tolist(), strict=True))
    assert [named[w] for x in split for w in x] == h.tolist() and len(set(named.values())) == len(named)
    assert h.tolist() == [x for t in texts[1:] for x in sd.word_hashes(t).tolist()]
    assert len({x & 0xFFFFFFFF for x in named.values()}) == len(named)


def test_what_few_rows_reach_is_what_many_reach(monkeypatch):
    rng = np.random.default_rng(19)
    x, y = (rng.integers(0, 9, (20, 100)).astype(np.uint32) for _ in range(2))
    x[10:], y[10:] = rng.integers(1, 90, (10, 100)), rng.integers(1, 90, (10, 100))
    y[15:, 5:] = x[15:, :-5]
    few = [sd._reach(x[i : i + 1], y[i : i + 1]) for i in range(20)]
    monkeypatch.setattr(sd, "FEW", 0)
    assert (np.concatenate(few, axis=1) == sd._reach(x, y)).all()
