"""The native operators against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import exact_dedup
from tidemark.llm.exact_dedup import drop_copies, exact_copies
from tidemark.llm.line_dedup import dedup_blocks, dedup_lines
from tidemark.llm.url_filter import judge_urls

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("hash", T.StringType())])


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("told_apart_by", ["hash", "comparison"])
@pytest.mark.parametrize("shares", [2, 10_000])
def test_exact_copies_match_a_dictionary(spark, monkeypatch, told_apart_by, shares):
    monkeypatch.setattr(exact_dedup, "SHARES", shares)
    if told_apart_by == "comparison":  # all texts collide
        monkeypatch.setattr(exact_dedup, "_fingerprint", lambda norm: F.when(norm.isNotNull(), F.lit(7)).cast("long"))
    rng = random.Random(1)
    texts = ["", None, " ", "a b", "a\tb", "a \n b", "A b", "a\u00a0b", "x" * 50000, "x" * 50000 + "y"] + [
        " ".join(rng.choices("abc", k=rng.randint(0, 4))) for _ in range(60)
    ]
    rows = list(enumerate(rng.sample(texts, len(texts)))) + [(i, "hot  text") for i in range(100, 400)]
    rng.shuffle(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    got = {r.doc_id: r for r in exact_copies(docs(spark, rows), salts=8).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        g, r = groups[norm(t)], got[i]
        assert (r.keep_id, r.group_size, r.kept) == (min(g), len(g), i == min(g)), (i, t)
        assert r.text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest()


def test_exact_copies_edges(spark):
    assert exact_copies(docs(spark, [])).count() == 0
    got = exact_copies(docs(spark, [(None, "a"), (5, "a"), (5, "a"), (7, "a"), (None, "b"), (None, "b")])).collect()
    a = [r for r in got if r.group_size == 4]
    assert {r.keep_id for r in a} == {5} and sum(r.kept for r in a) == 1
    b = [r for r in got if r.group_size == 2]
    assert len(b) == 2 and sum(r.kept for r in b) == 1 and {r.keep_id for r in b} == {None}
    left = drop_copies(docs(spark, [(1, "a b"), (2, "a  b"), (3, "c"), (None, "d")]))
    assert sorted((r.doc_id or 0, r.text, r.hash) for r in left.collect()) == [(0, "d", "x"), (1, "a b", "x"), (3, "c", "x")]


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/en/12/x", "allow"), ("org", "", "block"),
]


def judged(url, rules=RULES):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2])
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_url_rules_match_a_scan(spark):
    rng = random.Random(2)
    hosts = ["org", "ORG", "example.org", "a.example.org", "b.a.Example.org", "notexample.org", "com", "x.com", "com.x", "", "..org", "org."]
    paths = ["", "/", "/es", "/es/", "/es/x?y", "/en/1", "/en/12/x#z", "/fr/", "/de/1", "/en/1\u0000x", "//", "?q://org/", "/en/\U0010ffff"]
    urls = [f"{s}://{h}{p}" for s in ("http", "", "x://y") for h in hosts for p in paths] + [None, "", "org/", "/es/"]
    urls += ["http://hot.example.org/es/1"] * 300
    rows = [(i, u, "old") for i, u in enumerate(urls)]
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge_urls(pages, rules, ranges=16, sample_per_range=4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(urls[r.page_id]), urls[r.page_id]


def test_url_rules_nested_deep_and_empty(spark):
    rules = [("h", "/" + "a" * n, "block" if n % 2 else "allow") for n in range(40)]
    pages = spark.createDataFrame([(i, "http://h/" + "a" * i + "b") for i in range(60)], "page_id long, url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    for x in judge_urls(pages, r, ranges=8, sample_per_range=2).collect():
        assert (x.rule, x.verdict) == judged(x.url, rules)[2:]
    assert judge_urls(pages.limit(0), r).count() == 0
    assert {x.verdict for x in judge_urls(pages, r.limit(0)).collect()} == {"allow"}


def brute_lines(rows, window, divisor, spark):
    from pyspark.sql import functions as F

    lines = sorted({x for _, t in rows if t is not None for x in t.split("\n")})
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", F.xxhash64("x").alias("h"))
    h = {r.x: r.h for r in df.collect()}
    P, B = 2147483647, 1000003
    cut, seen = {}, {}
    for i, t in rows:
        ls, out, cur = (t or "").split("\n"), [], []
        for k, x in enumerate(ls):
            cur.append(x)
            roll = sum((h[ls[k - j]] % P) * pow(B, j, P) % P for j in range(window) if k - j >= 0) % P if t is not None else 0
            if k == len(ls) - 1 or roll % divisor == 0:
                out.append(cur)
                cur = []
        cut[i] = out
    result = {}
    for i, t in sorted(rows):
        left = []
        for c in cut[i]:
            if sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in c) >= 2:
                if "\n".join(c) in seen:
                    continue
                seen["\n".join(c)] = i
            left += c
        result[i] = None if t is None else "\n".join(left)
    return result


@pytest.mark.parametrize("window,divisor", [(1, 2), (2, 2), (3, 3)])
def test_line_dedup_matches_a_scan(spark, window, divisor):
    rng = random.Random(3)
    pool = [f"line {i}" for i in range(12)] + ["", " ", "\t"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 14)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one"), (103, "\n" * 50), (104, "same\nsame\n" * 40), (105, rows[3][1])]
    want = brute_lines(rows, window, divisor, spark)
    assert any(want[i] != t for i, t in rows)
    got = dedup_lines(docs(spark, rows), window=window, divisor=divisor).collect()
    assert {r.doc_id: r.text for r in got} == want
    for r in got:
        n = 0 if r.text is None and r.n_lines == 0 else dict(rows)[r.doc_id].count("\n") + 1
        assert r.n_lines == n
        if r.n_removed_lines < n:
            assert (r.text is None) or r.text.count("\n") + 1 == n - r.n_removed_lines


def test_line_dedup_edges(spark):
    assert dedup_lines(docs(spark, [])).count() == 0
    p = "".join(f"this is line {i}\n" for i in range(24))
    rows = [(1, p + "own tail"), (1, p + "own tail"), (2, "head\n" + p + "x"), (None, p), (3, p + "y")]
    got = dedup_lines(docs(spark, rows)).collect()
    assert len(got) == 5
    assert [r.text for r in got if r.doc_id == 1] == [p + "own tail"] * 2
    assert all(r.n_removed_lines > 0 for r in got if r.doc_id in (2, 3, None))
    assert Row(*got[0]) and set(got[0].asDict()) == {"doc_id", "text", "hash", "n_lines", "n_removed_lines"}


def test_repeated_blocks_of_two_lines_and_more_go(spark):
    rng = random.Random(16)
    rows, want = [], {}
    own = iter(range(10**6))
    for m in (2, 3, 4, 6, 20) * 12:  # a block in two texts, among lines of their own
        block = [f"block {next(own)}" for _ in range(m)]
        if m == 4:
            block[2:2] = ["", " "]
        for again in (False, True):
            head, tail = ([f"own {next(own)}" for _ in range(rng.randint(1, 5))] for _ in range(2))
            want[len(rows)] = "\n".join(head + [] if again else head + block) + "\n" + "\n".join(tail)
            rows.append((len(rows), "\n".join(head + block + tail)))
    hot = ["hot a", "hot b"]
    for i in range(200):
        want[1000 + i] = "\n".join([f"x{i}"] + hot * (i == 0) + [f"y{i}"])
        rows.append((1000 + i, "\n".join([f"x{i}", *hot, f"y{i}"])))
    rows += [(2000, "lone\nz1"), (2001, "lone\nz2"), (2002, None), (2003, ""), (2004, "s\ns\n" * 20), (None, "hot a\nhot b")]
    want |= {2000: "lone\nz1", 2001: "lone\nz2", 2002: None, 2003: "", 2004: "s\ns\n", None: ""}
    got = dedup_blocks(docs(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(rows)
    by = dict(rows)
    for r in got:
        assert r.n_lines == (0 if by[r.doc_id] is None else by[r.doc_id].count("\n") + 1)
        assert r.n_removed_lines == (r.n_lines - r.text.count("\n") - 1 if r.text else r.n_lines * (r.doc_id is None))
    assert dedup_blocks(docs(spark, [])).count() == 0
