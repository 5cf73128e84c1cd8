"""Revisit resolution against a scan in time order."""

import random

import pytest
from pyspark.sql import types as T

from tidemark.llm.warc import PERMITTED, canonical_url, resolve_revisits

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("ts", T.LongType()),
        T.StructField("kind", T.StringType()), T.StructField("digest", T.StringType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.StringType()),
        T.StructField("state", T.StringType()),
    ]
)


def test_canonical_urls(spark):
    cases = {
        "HTTP://Ex.ORG:80": "http://ex.org/", "https://a.b:443/X?Y#z": "https://a.b/X?Y", "http://a:8080/p": "http://a:8080/p",
        "http://a?q": "http://a/?q", "mailto:x#y": "mailto:x", "https://a:80/": "https://a:80/", None: None, "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", canonical_url(df.u).alias("c")).collect()} == cases


def scan(rows):
    out = {}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for rid, url, ts, kind, digest, headers, _, _ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and None not in (url, ts, r[2]) and r[1] == url and r[2] < ts]
        if not before:
            out[rid] = (None, "missing", None, None)
            continue
        ref = max(before, key=lambda r: (r[2], r[0]))
        a, b = low(headers), low(ref[5])
        weak = lambda x: x and x.removeprefix("W/")
        pairs = [(weak(a.get("etag")), weak(b.get("etag"))), (a.get("last-modified"), b.get("last-modified")), (digest, ref[4])]
        both = [x == y for x, y in pairs if x is not None and y is not None]
        state = "unverified" if not both else "resolved" if both[0] else "mismatch"
        merged = {**b, **{k: v for k, v in a.items() if k in PERMITTED}} if state != "mismatch" else None
        out[rid] = (ref[0], state, merged, ref[6] if state != "mismatch" else None)
    return out


@pytest.mark.parametrize("width", [1, 10, 100000])
def test_revisits_match_a_scan(spark, width):
    rng = random.Random(12)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = {k: rng.choice(["1", "2"]) for k in ("ETag", "Last-Modified", "Content-Length", "vary") if rng.random() < 0.5}
        if "ETag" in headers and rng.random() < 0.5:
            headers["ETag"] = "W/" + headers["ETag"]
        url = rng.choice(["http://hot/", "http://hot/", "http://b/x", None])
        ts = rng.choice([None, *range(60)]) if i % 9 else rng.randint(0, 60)
        rows.append((i, url, ts, kind, rng.choice([None, "d1", "d2"]), rng.choice([None, headers, headers]), f"body {i}", "x"))
    got = resolve_revisits(spark.createDataFrame(rows, RECORDS), slot_width=width).collect()
    want = scan(rows)
    assert len(got) == len(want)
    assert {r.record_id: (r.refers_to, r.state, r.headers, r.payload) for r in got} == want


def test_no_records(spark):
    assert resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0
