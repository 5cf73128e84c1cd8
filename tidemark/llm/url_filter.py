"""URL filters by a sort-merge range join [native].

A rule is a host and a path prefix.  Its key is the host with its labels
reversed, a slash and the path: every key that starts with it lies in one
interval of the sorted keys.  A url stands at one point for each ancestor of
its host (``org``, ``org.example`` ...).  Rules and points are merged in key
order; each rule carries the stack of rules that were open when it opened, so
at a point the last rule passed names all that can still be open, and the
innermost one that contains the point fits.

Points are range-partitioned by splitters from a bounded sample; the last rule
before each splitter is carried into its range, so ranges are swept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, q

SPLITTER_CHARS = 128


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """Per distinct rule key: itself and all rules whose key is a prefix of it, shortest first."""
    keyed = (
        rules.where(q("host").isNotNull() & q("path").isNotNull())
        .select(
            F.concat(_reversed(F.split("host", "\\.")), F.lit("/"), "path").alias("key"),
            F.concat("host", "path").alias("rule"),
            F.length("host").alias("host_len"),
            _reversed(F.split("host", "\\.")).alias("rev"),
            "verdict",
        )
        .groupBy("key")
        .agg(
            F.max("verdict").alias("verdict"),  # of equal rules, block wins over allow
            F.first("rule").alias("rule"),
            F.first("host_len").alias("host_len"),
            F.first("rev").alias("rev"),
        )
    )
    prefixes = keyed.select(
        F.col("key").alias("of"), F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")
    ).select("of", F.expr("substring(of, 1, n)").alias("key"))
    entry = F.struct(
        F.length("key").alias("len"), "key", "host_len", F.length("rule").alias("rule_len"), "rule", "verdict"
    )
    stacks = prefixes.join(keyed, "key").groupBy("of").agg(F.array_sort(F.collect_list(entry)).alias("stack"))
    return stacks.join(keyed.select(F.col("key").alias("of"), "rev"), "of").select(
        F.col("of").alias("key"), "rev", "stack"
    )


def _bucket(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or below ``key``, by binary search."""
    if not splitters:
        return F.lit(0)
    held = F.array(*[F.lit(s) for s in splitters])
    jumps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(j) for j in jumps]),
        F.lit(0),
        lambda at, j: F.when(
            (at + j <= len(splitters)) & (F.get(held, F.least(at + j, F.lit(len(splitters))) - 1) <= key), at + j
        ).otherwise(at),
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url_col: str = "url",
    default: str = "allow",
    ranges: int = 128,
    sample_per_range: int = 64,
) -> DataFrame:
    """Every row of ``pages`` with host, path, rule and verdict.

    ``rules`` has host, path and verdict.  A rule fits its host and all
    subdomains if the url's path starts with its path; the longest rule (host
    and path together, then host) wins; without one rule is null and verdict is
    ``default``.  A null url, or one without ``://``, has empty host and path;
    rules with a null host or path never fit; columns of ``pages`` named like
    the four results are replaced.
    """
    out = ["host", "path", "rule", "verdict"]
    base = pages.drop(*out)
    located = base.select("*", host_of(q(url_col)).alias("host"), path_of(q(url_col)).alias("path"))
    urls = located.select("host", "path").distinct()
    stacks = _rule_stacks(rules)

    labels = F.split("host", "\\.")
    points = (
        urls.select("host", "path", labels.alias("labels"))
        .select("host", "path", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"))
        .select("host", "path", _reversed(F.expr("slice(labels, size(labels) - k + 1, k)")).alias("rev"))
        .join(stacks.select("rev").distinct(), "rev", "left_semi")
        .select("host", "path", F.concat("rev", F.lit("/"), "path").alias("key"))
        # ties of one key are told apart by the host, so no key is too large for a range
        .withColumn("at", F.concat("key", F.lit("\0"), F.hex(F.xxhash64("host"))))
    )
    taken = (
        points.select(F.xxhash64("at").alias("h"), F.substring("at", 1, SPLITTER_CHARS).alias("s"))
        .orderBy("h", "s")
        .limit(ranges * sample_per_range)
        .select("s")
        .collect()
    )  # at most ranges * sample_per_range strings of SPLITTER_CHARS characters
    sample = sorted((r.s for r in taken), key=lambda s: s.encode("utf-8", "surrogatepass"))
    per = max(1, len(sample) // ranges)
    splitters = list(dict.fromkeys(sample[per::per]))

    opened = stacks.select("key", "stack", _bucket(F.col("key"), splitters).alias("range"))
    last = opened.groupBy("range").agg(F.max_by("stack", "key").alias("last"))
    bounds = opened.sparkSession.range(len(splitters) + 1).select(F.col("id").cast("int").alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        bounds.join(last, "range", "left")  # one row a range
        .select("range", F.last("last", ignorenulls=True).over(before).alias("stack"))
        .where("stack is not null")
    )
    none = F.lit(None).cast("string")
    events = (
        carried.select("range", F.lit("").alias("at"), F.lit(0).alias("kind"), none.alias("key"), none.alias("host"), none.alias("path"), "stack")
        .unionByName(opened.select("range", F.col("key").alias("at"), F.lit(0).alias("kind"), none.alias("key"), none.alias("host"), none.alias("path"), "stack"))
        .unionByName(
            points.select(
                _bucket(F.col("at"), splitters).alias("range"), "at", F.lit(1).alias("kind"), "key", "host", "path",
                F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"),
            )
        )
    )
    sweep = Window.partitionBy("range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = swept.select(
        "host", "path", F.expr("get(reverse(filter(open, s -> startswith(key, s.key))), 0)").alias("fit")
    ).where("fit is not null")
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct("fit.rule_len", "fit.host_len", "fit.rule", "fit.verdict")).alias("best")
    )
    return located.join(best, ["host", "path"], "left").select(
        *[q(c) for c in base.columns],
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
