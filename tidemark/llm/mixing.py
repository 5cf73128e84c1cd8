"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets come from the weights by water-filling.  The sum of the targets is given
out in equal blocks of ``unit_words`` words: to the sources by their targets,
and within a source to its shards by their sizes, each by highest quotients
votes / (2 seats + 1).  So every shard has an integer quota before anything is
selected.  The words of a shard are laid out in stretches of ``block_words``; a
quota of q of its n words takes each word q // n times, and q % n words once
more: stretches chosen by a seeded permutation, the last one cut to what is left.

Everything is expressed over DataFrames.  Texts are shuffled once at most, by
(source, bucket), where a bucket is a hash of the id: a source that holds a
third of all rows is spread over ``BUCKETS`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, let, materialize, q

#: Hash buckets of a source; shards are runs of buckets.
BUCKETS = 65536
#: Multipliers of the seeded permutations: primes above any number of blocks in a shard.
PRIMES = [2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], votes: str, seats: str) -> DataFrame:
    """``parties`` plus ``quota``: each group's ``seats`` (the same in all its rows) by highest quotients.

    Quotas start as votes over the natural divisor, rounded; what is then
    missing (or too much) is given to the highest (taken from the lowest)
    quotients.  A party can gain or lose no more than its share of the number
    of parties, rounded up, plus one, so that many quotients of each are
    enough and their number stays below three a party.  Ties go by ``key``.
    Parties without votes get nothing.
    """
    whole = Window.partitionBy(*group)
    votes_, seats_ = F.col(votes).cast("double"), F.col(seats)
    first = parties.withColumn("_all", F.sum(votes_).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole))
    start = F.when(F.col("_all") > 0, F.floor(votes_ * seats_ / F.col("_all") + 0.5)).otherwise(F.lit(0)).cast("long")
    first = first.withColumn("_start", start).withColumn("_short", seats_ - F.sum("_start").over(whole))
    room = (F.ceil(F.when(F.col("_all") > 0, votes_ * F.col("_n") / F.col("_all")).otherwise(F.lit(0.0))) + 1).cast("int")
    steps = first.where(votes_ > 0).select(
        *group, *key, "_start", "_short", votes_.alias("_v"), F.explode(F.sequence(F.lit(0), room)).alias("_j")
    )
    gains = steps.where("_short > 0").select(
        *group, *key, "_short", F.lit(1).alias("_by"), (-F.col("_v") / (2 * (F.col("_start") + F.col("_j")) + 1)).alias("_cost")
    )
    losses = steps.where("_short < 0 and _start > _j").select(
        *group, *key, "_short", F.lit(-1).alias("_by"), (F.col("_v") / (2 * (F.col("_start") - F.col("_j")) - 1)).alias("_cost")
    )
    by_key = Window.partitionBy(*group)
    ranked = gains.withColumn("_k", F.row_number().over(by_key.orderBy("_cost", *key))).unionByName(
        losses.withColumn("_k", F.row_number().over(by_key.orderBy("_cost", *[F.desc(k) for k in key])))
    )
    moved = (
        ranked.where(F.col("_k") <= F.abs("_short")).groupBy(*group, *key).agg(F.sum("_by").alias("_change"))
    )
    names = parties.columns
    return first.join(moved, [*group, *key], "left").select(
        *names, (F.col("_start") + F.coalesce("_change", F.lit(0))).cast("long").alias("quota")
    )


def water_fill(sources: DataFrame, size: str, weight: str, limit: float) -> DataFrame:
    """``sources`` plus ``target``: all sizes shared by weight, none above ``limit`` times its own size.

    Resharing the excess until none is above ends where each target is the
    smaller of its limit and a common level times its weight.  In order of
    limit over weight the sources at their limit come first, so the level
    follows from running sums.
    """
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy((F.col(size) / F.col(weight)), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    staged = (
        sources.withColumn("_total", F.sum(size).over(everything))
        .withColumn("_weights", F.sum(weight).over(everything))
        .withColumn("_full", F.coalesce(F.sum(size).over(before), F.lit(0)) * F.lit(limit))
        .withColumn("_used", F.coalesce(F.sum(weight).over(before), F.lit(0)))
        # the level if all before are at their limit and none from here on is
        .withColumn("_level", (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_used")))
        .withColumn("_holds", F.col("_level") * F.col(weight) <= F.col(size) * F.lit(limit))
        .withColumn("_common", F.min(F.when(F.col("_holds"), F.col("_used"))).over(everything))
        .withColumn("_at", F.min(F.when(F.col("_used") == F.col("_common"), F.col("_level"))).over(everything))
    )
    target = F.least(F.col(size) * F.lit(limit), F.coalesce(F.col("_at"), F.lit(float("inf"))) * F.col(weight))
    return staged.select(*sources.columns, target.cast("double").alias("target"))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` (src, null last by ``no_src``) plus ``weight``: the cycle along the sources in code point order."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("no_src", "src")) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in cycle]), (rank % len(cycle)).cast("int")))


def _place(block: Column, blocks: Column) -> Column:
    """The turn at which a stretch of a shard is chosen: a prime times its number, plus a shift, modulo their number."""
    return F.pmod(F.pmod(F.col("_prime"), blocks) * block + F.pmod(F.col("_shift"), blocks), blocks)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=cyclic_weights,
    limit: int = 3,
    block_words: int = 32,
    unit_words: int = 1,
    shard_words: int = 1 << 20,
    seed: int = 17,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per input row: the ``carry`` columns (all by default), size, source_size, target, taken, spans.

    ``spans`` is an array of (from, to, times): word positions of the text,
    ``to`` excluded, and how often the mix takes them; ``taken`` is their sum.
    ``weights`` gets a table (src, no_src, source_size) and adds ``weight``.

    Defined cases: a null text has size 0, is never taken and has no spans; a
    null source is a source of its own, ordered last; rows that repeat an id
    lie next to each other, by size and a hash of the text; rows alike in all of
    these are alike in the mix up to order; an empty table gives an empty result;
    a text of any length is cut like any other; carried columns named like a
    result are replaced.
    """
    results = ["size", "source_size", "target", "taken", "spans"]
    names = [c for c in (carry if carry is not None else df.columns) if c not in results]
    rec, sid = "_rec", "_id"
    rows = df.select(
        F.struct(*[q(c) for c in names]).alias(rec),
        q(id_col).alias(sid),
        F.coalesce(q(source_col), F.lit("")).alias("src"),
        q(source_col).isNull().cast("int").alias("no_src"),
        F.pmod(F.xxhash64(q(id_col), F.lit(seed)), F.lit(BUCKETS)).cast("int").alias("bucket"),
        word_count(q(text_col)).alias("size"),
        F.xxhash64(q(text_col)).alias("_text"),
    )
    place = ["no_src", "src"]
    fine = materialize(rows.groupBy(*place, "bucket").agg(F.sum("size").alias("bucket_words")), "mix-buckets")

    sources = weights(fine.groupBy(*place).agg(F.sum("bucket_words").alias("source_size")))
    aimed = water_fill(sources.withColumn("weight", F.col("weight").cast("long")), "source_size", "weight", limit)
    total = Window.partitionBy(F.lit(0))
    seated = sainte_lague(
        aimed.withColumn("_one", F.lit(0)).withColumn(
            "_seats", F.round(F.sum("target").over(total) / F.lit(unit_words)).cast("long")
        ),
        ["_one"],
        place,
        "target",
        "_seats",
    ).select(*place, "source_size", "target", F.col("quota").alias("seats"))

    count = F.least(F.greatest(F.ceil(F.col("source_size") / F.lit(shard_words)), F.lit(1)), F.lit(BUCKETS))
    sharded = fine.join(seated.withColumn("shards", count.cast("long")), place).withColumn(
        "shard", F.floor(F.col("bucket") * F.col("shards") / F.lit(BUCKETS)).cast("long")
    )
    of_shard = Window.partitionBy(*place, "shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    laid = sharded.withColumn("bucket_start", F.coalesce(F.sum("bucket_words").over(of_shard), F.lit(0)))
    shards = laid.groupBy(*place, "shard").agg(
        F.sum("bucket_words").alias("shard_size"), F.first("seats").alias("seats")
    )
    quotas = sainte_lague(shards, place, ["shard"], "shard_size", "seats").select(
        *place,
        "shard",
        "shard_size",
        (F.col("quota") * unit_words).alias("quota"),
    )
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES])
    draw = F.xxhash64("src", "no_src", "shard", F.lit(seed))
    buckets = materialize(
        laid.join(quotas, [*place, "shard"]).select(
            *place,
            "bucket",
            "bucket_start",
            "source_size",
            "target",
            "shard_size",
            F.least("quota", F.col("shard_size") * limit).alias("_quota"),
            F.get(primes, F.pmod(draw, F.lit(len(PRIMES))).cast("int")).alias("_prime"),
            F.pmod(F.shiftright(draw, 8), F.lit(PRIMES[0])).alias("_shift"),
        ),
        "mix-quotas",
    )

    in_bucket = Window.partitionBy(*place, "bucket").orderBy(sid, "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(buckets, [*place, "bucket"]).withColumn(
        "_start", F.col("bucket_start") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0))
    )
    b = F.lit(block_words).cast("long")
    start, end, words = F.col("_start"), F.col("_start") + F.col("size"), F.greatest(F.col("shard_size"), F.lit(1))
    blocks = F.ceil(words / b).cast("long")
    times, more = F.floor(F.col("_quota") / words).cast("long"), F.pmod(F.col("_quota"), words)
    short = blocks * b - words  # what the last stretch of a shard lacks

    def spans_of(k: Column) -> Column:
        """The words of stretch k that are taken once more than the others, and those others, as spans of the row."""
        turn = _place(k, blocks)
        before = turn * b - F.when(turn > _place(blocks - 1, blocks), short).otherwise(F.lit(0))
        at, to = k * b, F.least((k + 1) * b, words)
        cut = at + F.greatest(F.least(more - before, to - at), F.lit(0))

        def span(s: Column, e: Column, n: Column) -> Column:
            return F.struct(
                F.greatest(s - start, F.lit(0)).cast("long").alias("from"),
                F.least(e - start, F.col("size")).cast("long").alias("to"),
                n.cast("long").alias("times"),
            )

        return F.array(span(at, cut, times + 1), span(cut, to, times))

    first, last = F.floor(start / b).cast("long"), F.floor((end - 1) / b).cast("long")
    spans = F.filter(
        F.flatten(F.transform(F.sequence(first, last), spans_of)), lambda s: (s["times"] > 0) & (s["to"] > s["from"])
    )
    none = F.expr("cast(array() as array<struct<from:bigint,to:bigint,times:bigint>>)")
    chosen = placed.withColumn("spans", F.when(F.col("size") > 0, spans).otherwise(none))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["to"] - s["from"]) * s["times"])
    return chosen.select(
        *[F.col(f"{rec}.`{c.replace('`', '``')}`").alias(c) for c in names],
        "size",
        "source_size",
        "target",
        taken.alias("taken"),
        "spans",
    )


def mixed_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of a mix as texts: one row per pass over a document that takes any of its words.

    Pass k holds, in order and with the white space before each word, the words
    taken at least k times; a document taken whole once is its own text again.
    Rows of which nothing is taken go.
    """
    passes = mixed.where("taken > 0").withColumn(
        "_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("spans", lambda s: s["times"]))))
    )
    words = F.regexp_extract_all(q(text_col), F.lit("(?s)[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0))
    # let: the words are found once a row, not once a span
    text = let(
        words,
        lambda held: F.array_join(
            F.flatten(
                F.transform(
                    F.filter("spans", lambda s: s["times"] >= F.col("_pass")),
                    lambda s: F.slice(held, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")),
                )
            ),
            "",
        ),
    )
    whole = F.forall("spans", lambda s: s["times"] >= F.col("_pass")) & (
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"]) == F.col("size")
    )
    return passes.withColumn(text_col, F.when(whole, q(text_col)).otherwise(text)).drop("_pass")
