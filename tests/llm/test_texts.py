"""BPE, repetition and quality against their definitions."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.bpe import EditableText, Encoder, PrefixTable, decode_ids, encode_texts, read_ranks
from tidemark.llm.quality import features, fit_quality, keep_quality, score_quality
from tidemark.llm.repetition import covered, longest_repeats, measure_repetition, repetition_rules

RANKS = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
ENCODER = Encoder(RANKS, P.PATTERN, space_starts=True)
PLAIN = Encoder(RANKS, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.text(st.sampled_from("aabcdetionsh'  \n\t é世🙂12#!\r\x0b") | st.characters(exclude_categories=["Cs"]), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_encoding_is_the_librarys(text):
    want = TIKTOKEN.encode_ordinary(text)
    assert ENCODER.encode(text) == want and PLAIN.encode(text) == want
    column = ENCODER.encode_column(pa.array([text, None, "a " + text, text]))
    assert column.to_pylist() == [want, [], TIKTOKEN.encode_ordinary("a " + text), want]
    assert ENCODER.decode_column(column.slice(2)).to_pylist() == [("a " + text).encode(), text.encode()]
    assert ENCODER.decode(want) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXT, st.data())
def test_edits_equal_encoding_anew(text, data):
    held = EditableText(ENCODER, text)
    for _ in range(2):
        n = len(held.text)
        start = data.draw(st.integers(0, n))
        stop = data.draw(st.integers(start, n))
        held.edit(start, stop, data.draw(TEXT.map(lambda t: t[:9])))
        assert held.tokens() == TIKTOKEN.encode_ordinary(held.text)
    held.append("'re  x")
    assert held.tokens() == TIKTOKEN.encode_ordinary(held.text)


def test_prefix_tables_append_edit_and_long_runs():
    rng = random.Random(7)
    v = ENCODER.vocabulary
    data = bytes(rng.choices(b"abcdet ion\xc3\xa9", k=4000))
    table = PrefixTable(v, data[:1000])
    table.append(data[1000:])
    assert table.last == PrefixTable(v, data).last
    assert table.edit(500, 503, b"zz") < 2000
    assert table.tokens() == PrefixTable(v, data[:500] + b"zz" + data[503:]).tokens()
    for text in ("a" * 30000, "ab" * 9000, "\n" * 5000, "=" * 3000):
        assert ENCODER.encode(text) == TIKTOKEN.encode_ordinary(text)
    for a, b in (rng.choices(range(len(v.bytes)), k=2) for _ in range(3000)):
        assert v.follows(a, b) == (v.merged(v.bytes[a] + v.bytes[b]) == [a, b])


def test_texts_round_trip_on_spark(spark):
    rows = [(1, "It's  a test\n\nof words", "x"), (2, None, "y"), (3, "", None), (None, "é" * 2000, "z"), (1, "dup", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode_ids(encode_texts(df, RANKS, P.PATTERN, space_starts=True), RANKS).collect()
    assert len(out) == 5
    for r in out:
        assert r.ids == TIKTOKEN.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert encode_texts(df.limit(0), RANKS, P.PATTERN).count() == 0
    both = encode_texts(df, RANKS, P.PATTERN, space_starts=True, decoded_col="decoded", carry=["doc_id"])
    assert both.columns == ["doc_id", "ids", "decoded"]
    assert sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in both.collect()) == sorted(
        (r.doc_id or 0, r.ids, bytes(r.decoded)) for r in out
    )


def test_every_code_point_is_classed_as_the_library_does():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for before, after in (("", ""), ("", "'re"), (" ", ""), ("a", "1"), ("'", "")):
        for i in range(0, len(points), 1 << 14):
            text = "\n".join(before + c + after for c in points[i : i + (1 << 14)])
            assert ENCODER.encode(text) == TIKTOKEN.encode_ordinary(text)


def brute_repeats(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


def test_longest_repeats_match_a_scan():
    rng = random.Random(8)
    texts = [[rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(0, 50))] for _ in range(60)] + [[1] * 40, [], [2]]
    ends = np.cumsum([len(t) for t in texts])
    got = longest_repeats(np.array([w for t in texts for w in t], np.int64), np.repeat(ends, [len(t) for t in texts]))
    want = [x for t in texts for x in brute_repeats(t)]
    assert got.tolist() == want
    assert covered(np.array([0, 2, 1, 0, 3, 2, 1]), 2).tolist() == [False, True, True, False, True, True, True]


def brute_measures(text, least):
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    seen, marked = {}, set()
    for size, out in ((5, marked),):
        for i in range(n - size + 1):
            seen.setdefault(tuple(words[i : i + size]), []).append(i)
        for at in seen.values():
            if len(at) > 1:
                out.update(k for i in at for k in range(i, i + size))
    longest = brute_repeats(words)
    spans = {k for i, x in enumerate(longest) if x >= least for k in range(i, i + x)}
    lines, dup = set(), 0
    for x in data.split(b"\n"):
        if x.split():
            dup += x in lines
            lines.add(x)
    return n, len(b"".join(words).decode()), sum(data.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")), dup, len(marked), len(spans), max(longest, default=0)


def test_repetition_matches_a_scan(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["a", "b", "c", "é#", "|"]) + rng.choice([" ", " ", "\n", " ", "\t"]) for _ in range(rng.randint(0, 70)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one two three four five six\n" * 30), (103, " \n \n")]
    got = repetition_rules(spark.createDataFrame(rows, "doc_id long, text string"), min_words=6).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        want = brute_measures(text, 6)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat) == want, text
        assert sum(s.end - s.start for s in r.spans) == r.covered_words and all(0 <= s.start < s.end <= r.n_words for s in r.spans)
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and (not r.kept or not failed)
    assert measure_repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(10)
    good, bad = "the of and in to is was for on by".split(), "BUY!! $$$ ### win||| free click now".split()
    rows = [(i, " ".join(rng.choices(bad if i % 3 == 0 else good, k=20) + rng.choices(good, k=5)), i) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, "x", 0), (900, None, 0), (901, "", 0)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, quality int")
    return docs, labels


def test_quality_learns_and_is_the_same_again(spark, corpus):
    docs, labels = corpus
    w = fit_quality(docs, labels, bits=14)
    assert (w == fit_quality(docs.repartition(5), labels, bits=14)).all()
    got = score_quality(docs, w).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None and 200 <= r.doc_id < 300]
    assert sum(right) / len(right) > 0.97
    kept = keep_quality(docs, w)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= 0.5}
    bounded = fit_quality(docs, labels, bits=14, max_rows=20)
    assert np.count_nonzero(bounded) < np.count_nonzero(w)


def test_quality_without_labels_or_rows(spark, corpus):
    docs, labels = corpus
    w = fit_quality(docs, labels.limit(0), bits=10)
    assert {r.score for r in score_quality(docs, w).collect()} == {0.5}
    assert score_quality(docs.limit(0), w).count() == 0
    at, x = features("a b c", 12)
    assert len(at) == 5 and abs(x @ x - 1) < 1e-9 and len(features(None, 12)[0]) == 0
    assert hashlib.sha256(fit_quality(docs, labels, bits=10).tobytes()).digest()
