"""Line dedup by repeated blocks of lines, and by content-defined chunks [native].

``dedup_blocks`` cuts every line that lies in a block of two or more lines with
words which occurs at an earlier place too, wherever the block stands.  Such a
block is made of units of two neighbouring lines with words (and the blank lines
between); units are grouped over the whole corpus by SHA-256.

``dedup_lines`` cuts whole chunks only and so misses short or shifted blocks.  A text is cut into lines; a rolling polynomial hash over the hashes of the last
``window`` lines decides after which lines a chunk ends, so that inserting or
deleting lines moves only the boundaries nearby.  Chunks of two or more lines
with words are grouped over the whole corpus by a 128-bit hash; a group counts
as repeated only if the smallest and the largest of its texts are the same
bytes, which compares every member.  All but the first occurrence (smallest id,
then position) are cut out.

The hot case, one passage in a third of all texts, is combined before the
shuffle (count, first occurrence, smallest and largest text); the rows that
look their group up again are narrow and of one plain join, whose large
partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, WORD, fresh, let, q

#: Modulus and base of the rolling hash; products stay below 2**62.
MODULUS, BASE = 2147483647, 1000003


def _rolling(hashes: Column, i: Column, window: int) -> Column:
    """Of the hashes at the 1-based position ``i`` and the ``window - 1`` before it (0 where there is none)."""
    total = F.lit(0).cast("long")
    for j in range(window):
        term = F.pmod(F.coalesce(F.get(hashes, i - 1 - j), F.lit(0)), F.lit(MODULUS)) if j == 0 else F.when(
            i - 1 - j >= 0, F.pmod(F.coalesce(F.get(hashes, F.greatest(i - 1 - j, F.lit(0))), F.lit(0)), F.lit(MODULUS))
        ).otherwise(F.lit(0))
        total = total + F.pmod(term * F.lit(pow(BASE, j, MODULUS)), F.lit(MODULUS))
    return F.pmod(total, F.lit(MODULUS))


def chunks_of(text: Column, window: int, divisor: int) -> Column:
    """array<array<string>>: the lines of each chunk of a text; joined they give the text again."""

    def cut(lines: Column) -> Column:
        def bounds(hashes: Column) -> Column:
            n = F.size(hashes)
            return F.filter(
                F.sequence(F.lit(1), n),
                lambda i: (i == n) | (F.pmod(_rolling(hashes, i, window), F.lit(divisor)) == 0),
            )

        def slices(ends: Column) -> Column:
            return F.transform(
                ends,
                lambda e, k: let(
                    F.when(k == 0, F.lit(0)).otherwise(F.get(ends, F.greatest(k - 1, F.lit(0)))),
                    lambda start: F.slice(lines, start + 1, e - start),
                ),
            )

        return let(bounds(F.transform(lines, lambda x: F.xxhash64(x))), slices)

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), cut)


def _described(text: Column, window: int, divisor: int, with_text: bool) -> Column:
    """Structs of the multi-line chunks: number, two hashes, perhaps the text."""

    def describe(chunk: Column, no: Column) -> Column:
        def of(joined: Column) -> Column:
            found = [
                no.cast("int").alias("no"),
                (F.size(F.filter(chunk, lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)) >= 2).alias("multi"),
                F.xxhash64(joined).alias("h1"),
                F.xxhash64(F.lit(7), joined).alias("h2"),
            ]
            return F.struct(*found, *[joined.alias("body")] * with_text)

        return let(F.array_join(chunk, "\n"), of)

    return F.filter(F.transform(chunks_of(text, window, divisor), describe), lambda c: c["multi"])


def repeated_chunks(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 2
) -> DataFrame:
    """The occurrences to cut: id, fp (hash of the text) and no (number of the chunk in it)."""
    at = [q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("fp")]
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "no")

    def occurrences(with_text: bool) -> DataFrame:
        return df.where(F.instr(q(text_col), "\n") > 0).select(
            *at, F.inline(_described(q(text_col), window, divisor, with_text))
        )

    groups = (
        occurrences(True)
        .groupBy("h1", "h2")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(place).alias("first"),
            F.min("body").alias("least"),
            F.max("body").alias("most"),
        )
        .where("n > 1 and least = most")
        .select("h1", "h2", "first")
    )
    return (
        occurrences(False)
        .join(groups, ["h1", "h2"])
        .where(place != F.col("first"))
        .select("id", "fp", "no")
    )


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 2
) -> DataFrame:
    """Every row of ``df`` with the repeated chunks cut from its text, plus n_lines and n_removed_lines.

    Defined cases: a null text stays null with 0 lines; the empty text has one
    line and nothing to remove; a text may end up empty, its row stays; rows
    that repeat an id and a text get the same cuts, and the first occurrence in
    them stays in all; a null id sorts after all others; columns named
    n_lines or n_removed_lines are replaced; an empty table gives an empty one.
    """
    base = df.drop("n_lines", "n_removed_lines")
    fp, rid, rfp, gone = fresh(base, "fp", "rid", "rfp", "gone")
    cuts = (
        repeated_chunks(df, id_col, text_col, window, divisor)
        .groupBy("id", "fp")
        .agg(F.collect_set("no").alias("nos"))
        .select(F.col("id").alias(rid), F.col("fp").alias(rfp), F.col("nos").alias(gone))
    )
    joined = base.withColumn(fp, F.xxhash64(q(text_col))).join(
        cuts, q(id_col).eqNullSafe(F.col(rid)) & (F.col(fp) == F.col(rfp)), "left"
    )
    chunks = chunks_of(q(text_col), window, divisor)
    kept = let(
        F.filter(chunks, lambda c, no: ~F.array_contains(F.col(gone), no.cast("int"))),
        lambda left: F.struct(
            F.array_join(F.flatten(left), "\n").alias("text"), F.size(F.flatten(left)).cast("long").alias("lines")
        ),
    )
    whole = F.struct(q(text_col).alias("text"), F.size(F.split(q(text_col), "\n", -1)).cast("long").alias("lines"))
    result = F.when(F.col(gone).isNull(), whole).otherwise(kept)
    n = F.when(q(text_col).isNull(), F.lit(0)).otherwise(F.size(F.split(q(text_col), "\n", -1))).cast("long")
    (done,) = fresh(joined, "done")
    staged = joined.select(*[q(c) for c in base.columns], result.alias(done), n.alias("n_lines"))
    return staged.select(
        *[F.col(f"{done}.text").alias(c) if c == text_col else q(c) for c in base.columns],
        "n_lines",
        F.when(q(text_col).isNull(), F.lit(0))
        .otherwise(F.col("n_lines") - F.col(f"{done}.lines"))
        .cast("long")
        .alias("n_removed_lines"),
    )


def _units(text: Column) -> Column:
    """Structs of the lines with words but the last: its number, how many lines on the next one is, and the SHA-256 of both and what is between."""

    def of(lines: Column, at: Column) -> Column:
        def unit(i: Column, k: Column) -> Column:
            return let(
                F.get(at, k + 1) - i,
                lambda more: F.struct(
                    i.alias("no"),
                    more.alias("more"),
                    F.unhex(F.sha2(F.array_join(F.slice(lines, i + 1, more + 1), "\n").cast("binary"), 256)).alias("key"),
                ),
            )

        return F.transform(F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))), unit)

    def worded(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        return let(F.filter(every, lambda i: F.get(lines, i).rlike(WORD)), lambda at: of(lines, at))

    return let(F.split(F.coalesce(text, F.lit("")), "\n", -1), worded)


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to cut: id, fp (hash of the text) and the numbers start to end, both included."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "fp", "no")
    units = df.where(F.instr(q(text_col), "\n") > 0).select(
        q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("fp"), F.inline(_units(q(text_col)))
    )
    groups = (
        units.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("key", "first")
    )
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("fp") == F.col("first.fp"))
    # where a text repeats itself with an overlap, the lines of the first occurrence stay
    start = F.when(own, F.greatest(F.col("no"), F.col("first.no") + F.col("more") + 1)).otherwise(F.col("no"))
    return (
        units.join(groups, "key")
        .where(place != F.col("first"))
        .select("id", "fp", start.alias("start"), (F.col("no") + F.col("more")).alias("end"))
    )


def dedup_blocks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``df`` without the lines of repeated blocks, plus n_lines and n_removed_lines.

    A line goes if two or more neighbouring lines with words that hold it occur,
    byte by byte, at an earlier place too (by id, hash of the text, line).  The
    first occurrence of a line never goes.  Defined cases are as in ``dedup_lines``.
    """
    base = df.drop("n_lines", "n_removed_lines")
    fp, rid, rfp, gone, done = fresh(base, "fp", "rid", "rfp", "gone", "done")
    cuts = (
        repeated_lines(df, id_col, text_col)
        .groupBy("id", "fp")
        .agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", "end")))).alias("nos"))
        .select(F.col("id").alias(rid), F.col("fp").alias(rfp), F.col("nos").alias(gone))
    )
    joined = base.withColumn(fp, F.xxhash64(q(text_col))).join(
        cuts, q(id_col).eqNullSafe(F.col(rid)) & (F.col(fp) == F.col(rfp)), "left"
    )
    kept = let(
        F.split(q(text_col), "\n", -1),
        lambda lines: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i)), "\n"
        ),
    )
    text = F.when(F.col(gone).isNull(), q(text_col)).otherwise(kept)
    n = F.when(q(text_col).isNull(), F.lit(0)).otherwise(F.size(F.split(q(text_col), "\n", -1))).cast("long")
    removed = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone))
    staged = joined.select(*[q(c) for c in base.columns], text.alias(done), n.alias("n_lines"), removed.cast("long").alias("n_removed_lines"))
    return staged.select(
        *[q(done).alias(c) if c == text_col else q(c) for c in base.columns], "n_lines", "n_removed_lines"
    )
