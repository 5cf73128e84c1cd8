"""The corpus pipeline: quality, line dedup, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode_texts, read_ranks
from tidemark.llm.line_dedup import dedup_blocks
from tidemark.llm.mixing import mix, mixed_texts
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.quality import fit_quality, keep_quality
from tidemark.llm.shared import discard, settled, table

#: Text encoded at once; less than the operator's default, as the workers have served four stages before.
BATCH_BYTES = 2 << 20


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from ``labels``."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines are cut out; documents stay, perhaps with an empty text."""
    return _with_length(dedup_blocks(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (5 words, 0.8) the document with the smallest id stays.

    Rows that repeat the id that stays all stay; so do rows without an id where
    a component has no other, or where they have no words.
    """
    found = jaccard_components(docs, k=5, percent=80)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["kept_id"]), "left_semi")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes; a document taken more than once has a row for each pass."""
    return _with_length(mixed_texts(mix(docs)).select(*docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = encode_texts(
        docs, ranks, public_tokenizers.PATTERN, space_starts=True, decoded_col="decoded", carry=["doc_id", "source", "text"], batch_bytes=BATCH_BYTES
    )
    text = F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == text).alias("round_trip")
    )


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: SQL expresses neither the classifier nor the min-hash keys; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = None
    for name, stage in STAGES[:-1]:
        docs = settled(partial(stage, spark, docs, sf_dir), f"stage-{name}")
        if done is not None:
            discard(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
