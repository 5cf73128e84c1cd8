"""The registered queries as they are: those with SQL against it, the others against plain Python."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken

from tidemark.llm import queries
from tidemark.llm.bpe import read_ranks
from tidemark.llm.quality import Ftrl, features

from .test_ngram_join import brute

DIR = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]+"


def run(spark, name):
    return queries.QUERIES[name](spark, DIR).toPandas()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DIR}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = con.execute(queries.ORACLE_SQL[name]).df(), run(spark, name)
    key = want.columns[0]
    cells = lambda df: sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in df[sorted(want)].itertuples(index=False))
    assert key in got and cells(got) == cells(want)


def test_op2(spark, docs):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = run(spark, "op2_byte_bpe").set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        ids = lib.encode_ordinary(r.text or "")
        row = got.loc[r.doc_id]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_op3(spark, docs):
    got = run(spark, "op3_mixing")
    size = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in docs.itertuples()}
    assert dict(zip(got.doc_id, got["size"], strict=True)) == size and (got.taken <= 3 * got["size"]).all()
    source = dict(zip(docs.doc_id, docs.source.where(docs.source.notna(), None), strict=True))
    total, taken = Counter(), Counter()
    for r in got.itertuples():
        total[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    for r in got.itertuples():
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target <= 3 * total[s] + 1e-6 and abs(taken[s] - r.target) <= 1
    assert abs(sum({source[r.doc_id]: r.target for r in got.itertuples()}.values()) - sum(total.values())) < 1e-3


def test_op4(spark, docs):
    got = run(spark, "op4_quality_rules").set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        w, row = re.findall(WORD, r.text or ""), got.loc[r.doc_id]
        lines, seen, dup = (r.text or "").split("\n"), set(), 0
        for x in lines:
            dup += bool(re.search(WORD, x)) and x in seen
            seen.add(x)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        symbols = sum(c in "#*$%&|<>" for c in r.text or "")
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (
            len(w), sum(map(len, w)), symbols, dup, len(again),
        )
        assert row.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and not (row.base_failed and row.kept)


def test_op6(spark, docs):
    got = run(spark, "op6_ngram_jaccard")
    want = brute(list(zip(docs.doc_id, docs.text, strict=True)), 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want


def test_op9_and_op1(spark, docs):
    texts = dict(zip(docs.doc_id, docs.text.fillna(""), strict=True))
    found = run(spark, "op9_substring_dedup")
    for r in found.itertuples():  # each passage has the words that it says it has
        a, b = (re.findall(WORD, texts[i])[s:e] for i, s, e in ((r.doc_id, r.start, r.end), (r.other_id, r.other_start, r.other_end)))
        assert min(len(a), len(b)) >= 50 and r.identity >= 0.8 and r.doc_id != r.other_id
        assert sum((Counter(a) & Counter(b)).values()) >= r.n_words >= 0.8 * max(len(a), len(b)) - 1e-6
    assert set(run(spark, "op1_line_dedup").doc_id) == set(texts)


def test_op10_is_a_plain_ftrl_that_sees_no_held_out_label(spark, docs, tmp_path):
    got = run(spark, "op10_quality_classifier").set_index("doc_id")
    labels = pd.read_parquet(f"{DIR}/labels.parquet")
    held = {i: crc32(str(i).encode()) % 3 == 1 for i in docs.doc_id}
    assert {i: bool(v) for i, v in got.held_out.items()} == held
    # labels of held-out rows turned over change nothing
    turned = labels.assign(quality=[1 - y if held[i] else y for i, y in zip(labels.doc_id, labels.quality, strict=True)])
    turned.to_parquet(tmp_path / "labels.parquet")
    docs.to_parquet(tmp_path / "documents.parquet")
    again = queries.QUERIES["op10_quality_classifier"](spark, str(tmp_path)).toPandas().set_index("doc_id")
    assert (again.score.sort_index() == got.score.sort_index()).all()
    # update by update, over dictionaries
    import xxhash

    def order(i):  # xxhash64 of a long as the operator's sample is ordered
        h = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
        return h - (h >> 63 << 64)

    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    train = sorted((order(i), i, y) for i, y in zip(labels.doc_id, labels.quality, strict=True) if not held[i])
    rate = Ftrl(18)
    z, n = Counter(), Counter()

    def weight(j):
        if abs(z[j]) <= rate.l1:
            return 0.0
        return -(z[j] - np.sign(z[j]) * rate.l1) / ((rate.beta + n[j] ** 0.5) / rate.alpha + rate.l2)

    rows = [([*zip(*(c.tolist() for c in features(texts[i], 18)), strict=True), (-1, 1.0)], y) for _, i, y in train]
    for _ in range(6):
        for x, y in rows:
            w = {j: weight(j) for j, _ in x}
            p = 1 / (1 + np.exp(-sum(w[j] * v for j, v in x)))
            for j, v in x:
                g = (p - y) * v
                z[j] += g - ((n[j] + g * g) ** 0.5 - n[j] ** 0.5) / rate.alpha * w[j]
                n[j] += g * g
    for i, t in texts.items():
        s = sum(weight(j) * v for j, v in zip(*(c.tolist() for c in features(t, 18)), strict=True)) + weight(-1)
        assert abs(1 / (1 + np.exp(-s)) - got.score[i]) < 1e-3
