"""Every stage of the pipeline on the smallest tables, against plain Python or its rules."""

import re

import public_tokenizers as P
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tidemark.llm.bpe import read_ranks

from .test_ngram_join import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), {}
    out["documents"] = docs
    for name, f in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, DIR).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return {k: v.toPandas() for k, v in out.items()}


def test_all_but_the_last_keep_the_columns(stages):
    for name, _ in pipeline.STAGES[:-1]:
        assert list(stages[name].columns) == list(stages["documents"].columns)


def test_quality_keeps_good_documents(spark, stages):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(stages["quality"].doc_id)
    good = set(labels[labels == 1].index)
    assert len(good & kept) >= 0.97 * len(good)
    texts = stages["documents"].set_index("doc_id").text
    assert all(texts[r.doc_id] == r.text for r in stages["quality"].itertuples())


def test_line_dedup_only_cuts_repeats(stages):
    before, after = (stages[k].set_index("doc_id").text for k in ("quality", "line_dedup"))
    assert set(before.index) == set(after.index)
    lines = {}
    for t in before:
        for x in set(t.split("\n")):
            lines[x] = lines.get(x, 0) + 1
    for i, t in after.items():
        gone = [x for x in before[i].split("\n") if x not in t.split("\n")]
        assert all(lines[x] > 1 or before[i].split("\n").count(x) > 1 for x in gone)


def test_one_of_each_group_of_near_duplicates_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["line_dedup"].itertuples()]
    want = {d for d, (_, c) in brute(rows, 5, 80).items() if d == c}
    assert set(stages["near_duplicates"].doc_id) == want


def test_the_mix_is_near_its_targets(stages):
    words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    before, after = stages["near_duplicates"], stages["mixing"]
    total = before.text.map(words).sum()
    assert abs(after.text.map(words).sum() - total) < 0.02 * total
    assert (after.n_chars == after.text.str.len()).all()


def test_ids_are_the_librarys(stages):
    enc = tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    got = sorted((r.doc_id, list(r.ids)) for r in stages["token_ids"].itertuples())
    assert got == sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in stages["mixing"].itertuples())
    assert stages["token_ids"].round_trip.all() and (stages["token_ids"].n_tokens == stages["token_ids"].ids.map(len)).all()


def test_run_gives_the_rows_of_the_stages(spark, stages):
    got = entry.queries()["pipeline"](spark, DIR).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(zip(stages["token_ids"].doc_id, stages["token_ids"].n_tokens, strict=True))


def test_every_stage_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, f in pipeline.STAGES:
        assert f(spark, docs, DIR).count() == 0
