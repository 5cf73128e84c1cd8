"""Exact dedup by content sort [native].

Sampled splitters range-partition the normalised text, an external sort inside
each partition puts equal texts next to each other, and a full comparison of
neighbours tells where a run of equal texts starts; a run is a group of copies.
The splitters see a bounded prefix of the text and a hash of all of it, so the
sample does not grow with the texts.

A text that more than one in ``SHARES`` of the rows hold is hot; there are fewer
than ``SHARES`` of them, so they are broadcast.  Its rows are spread over salts,
and the first rows of its runs, one for each salt, are sorted and compared once
more.  Text is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, materialize, q


def normalised(text):
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


#: A text is hot if more than one in so many rows hold it.
SHARES = 10_000


def _fingerprint(norm):
    """Places texts; equal texts have equal ones, and others that do are told apart by comparing."""
    return F.xxhash64(norm)


def exact_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 64,
    prefix_chars: int = 32,
) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    Defined cases: a null text is the empty text; a null id sorts after all
    others and is never a ``keep_id`` unless a group has no other; of rows that
    repeat an id and a text exactly one is kept; an empty table gives an empty
    result; a text of any length is compared whole; other columns of ``df`` are
    not read.
    """
    rows = df.select(q(id_col).alias("id"), normalised(q(text_col)).alias("norm"))
    counted = rows.groupBy(_fingerprint(F.col("norm")).alias("hash")).agg(F.count(F.lit(1)).alias("held"))
    counted = materialize(counted.where("held > 1"), "exact-held")
    total = df.count()
    hot = counted.where(F.col("held") * SHARES > total).select("hash", F.lit(True).alias("hot"))
    keyed = (
        rows.withColumn("prefix", F.substring("norm", 1, prefix_chars))
        .withColumn("hash", _fingerprint(F.col("norm")))
        .join(F.broadcast(hot), "hash", "left")
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    )
    place = ["prefix", "hash", "salt"]
    order = Window.partitionBy(*place).orderBy("norm", F.col("id").asc_nulls_last())
    before = F.lag("norm").over(order)
    head = before.isNull() | (before != F.col("norm"))
    placed = materialize(
        keyed.repartitionByRange(*place)
        .withColumn("head", head)
        .select(
            *place,
            "id",
            "head",
            F.sum(F.col("head").cast("long")).over(order).alias("run"),
            F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"),
            F.when(F.col("hot") & F.col("head"), F.col("norm")).alias("norm"),
        ),
        "exact",
    )
    # the runs of hot texts, by their first rows: no more than one a salt and text
    across = Window.partitionBy("prefix", "hash").orderBy("norm", "salt")
    last = F.lag("norm").over(across)
    met = (
        placed.where("norm is not null")
        .withColumn("first", last.isNull() | (last != F.col("norm")))
        .select(*place, "run", F.sum(F.col("first").cast("long")).over(across).alias("text"))
    )
    key = [*place, "run"]
    runs = placed.groupBy(*key).agg(F.min("id").alias("run_min"), F.count(F.lit(1)).alias("run_size"))
    named = runs.join(met, key, "left").withColumn("text", F.coalesce("text", "run"))
    groups = named.groupBy("prefix", "hash", "text").agg(
        F.min("run_min").alias("keep_id"),
        F.sum("run_size").alias("group_size"),
        # the one run that holds the row to keep; an all-null group takes its first salt
        F.min(F.struct(F.col("run_min").isNull(), "run_min", "salt")).alias("winner"),
    )
    decided = named.join(groups, ["prefix", "hash", "text"]).select(
        *key, "keep_id", "group_size", (F.col("winner.salt") == F.col("salt")).alias("wins")
    )
    return placed.join(decided, key).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("head") & F.col("wins")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay.  Rows repeating both id and text all go or all stay."""
    decided = exact_copies(df, id_col, text_col, **options)
    kept = decided.where("kept").select(
        F.col(id_col).alias("kept_id"), F.unhex("text_sha256").alias("kept_digest")
    )
    digest = F.unhex(F.sha2(normalised(q(text_col)).cast("binary"), 256))
    return df.join(kept, q(id_col).eqNullSafe(kept["kept_id"]) & (digest == kept["kept_digest"]), "left_semi")
