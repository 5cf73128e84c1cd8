"""Buckets, ranges and context groups of movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson
from ..schema import DataValidationError
from .movements import movements


def bucket_labels(targets: list[float]) -> list[tuple[str, float, float | None]]:
    """(label, low, high) of the half-open buckets of |move|; labels that come out alike fall together."""
    if not targets or any(t < 0 for t in targets):
        raise DataValidationError("targets must be given and not negative")
    out, low = {}, 0.0
    for t in sorted(set(targets)):
        out[f"{low:.1f}-{t:.1f}"] = (low, t)
        low = t
    out[f"{low:.1f}+"] = (low, None)
    return [(k, lo, hi) for k, (lo, hi) in out.items()]


def bucketize(moves: DataFrame, targets: list[float]) -> DataFrame:
    """``moves`` with bucket, by |move|: [previous target, target), the last open."""
    label = F.lit(None).cast("string")
    for name, lo, hi in reversed(bucket_labels(targets)):
        inside = F.abs("move") >= lo if hi is None else (F.abs("move") >= lo) & (F.abs("move") < hi)
        label = F.when(inside, name).otherwise(label)
    return moves.withColumn("bucket", label)


def bucket_counts(moves: DataFrame, targets: list[float]) -> DataFrame:
    """bucket, n and avg_move of every bucket, empty ones with 0."""
    names = moves.sparkSession.createDataFrame([(b,) for b, _, _ in bucket_labels(targets)], "bucket string")
    found = bucketize(moves, targets).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("move").alias("avg_move"))
    return names.join(found, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("avg_move", F.lit(0.0)).alias("avg_move")
    )


def bucketize_signed(moves: DataFrame, targets: list[float]) -> DataFrame:
    """``moves`` with the signed bucket; a move exactly on a target belongs below it."""
    if not targets:
        raise DataValidationError("targets must be given")
    ts = sorted(targets)
    size = F.abs("move")
    sign = F.when(F.col("move") >= 0, "+").otherwise("-")
    label = F.lit(f"> {ts[-1]:g}")
    for below, t in reversed(list(zip(ts, ts[1:], strict=False))):
        label = F.when(size <= t, F.concat(F.lit(f"{below:.1f}"), sign, F.lit(" ATR"))).otherwise(label)
    return moves.withColumn("bucket", F.when(size <= ts[0], f"< {ts[0]:g}").otherwise(label))


def range_analysis(moves: DataFrame, ranges: list[tuple[float, float]]) -> DataFrame:
    """Per range of the measurement: n, p_up, p_down, avg, min and max move.

    Ranges are half open, the last one closed; a row counts in each range that
    holds it; empty ranges stay with zeros.
    """
    if any(lo >= hi for lo, hi in ranges):
        raise DataValidationError("a range's low must be below its high")
    spark = moves.sparkSession
    rows = [(i, f"{lo:g}-{hi:g}", float(lo), float(hi), i == len(ranges) - 1) for i, (lo, hi) in enumerate(ranges)]
    table = spark.createDataFrame(rows, "ord int, range string, lo double, hi double, closed boolean")
    # a row finds its ranges by an expression over the request's list, so movements are read once and never multiplied by a join
    hits = F.array_compact(
        F.array(*[F.when((F.col("value") >= lo) & ((F.col("value") < hi) | (F.lit(last) & (F.col("value") == hi))), F.lit(i)) for i, _, lo, hi, last in rows])
    )
    found = (
        moves.select("move", F.explode(hits).alias("ord"))
        .groupBy("ord")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("move") > 0).cast("double")).alias("p_up"),
            F.avg((F.col("move") < 0).cast("double")).alias("p_down"),
            F.avg("move").alias("avg_move"),
            F.min("move").alias("min_move"),
            F.max("move").alias("max_move"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return table.join(found, "ord", "left").select(
        "range", F.coalesce("n", F.lit(0)).alias("n"), *[zero(c) for c in ("p_up", "p_down", "avg_move", "min_move", "max_move")]
    )


def overall_stats(moves: DataFrame) -> DataFrame:
    """One row over the movements whose measurement isn't 0; std is that of the population."""
    m = F.col("move")
    return moves.where("value <> 0").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(m), F.lit(0.0)).alias("mean_move"),
        F.coalesce(F.stddev_pop(m), F.lit(0.0)).alias("std_move"),
        F.coalesce(F.min(m), F.lit(0.0)).alias("min_move"),
        F.coalesce(F.max(m), F.lit(0.0)).alias("max_move"),
        F.coalesce(F.avg((m > 0).cast("double")) * 100, F.lit(0.0)).alias("pct_up"),
    )


COMPARISONS = {
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, "=": lambda a, b: a == b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
}


def context_filter(rows: DataFrame, name: str, op: str, threshold: float) -> DataFrame:
    """Rows whose context has ``name`` and where it compares so."""
    return rows.where(COMPARISONS[op](F.try_element_at("context", F.lit(name)), F.lit(float(threshold))))


def context_group(variable: Column, thresholds: list[float]) -> Column:
    """``<t1``, ``t1-t2`` ... ``>tn``; the last one holds its own threshold too."""
    ts = sorted(thresholds)
    label = F.lit(f">{ts[-1]:g}")
    for lo, hi in reversed(list(zip(ts, ts[1:], strict=False))):
        label = F.when(variable < hi, f"{lo:g}-{hi:g}").otherwise(label)
    return F.when(variable.isNull(), None).otherwise(F.when(variable < ts[0], f"<{ts[0]:g}").otherwise(label))


def contextual_groups(points: DataFrame, variable: str, thresholds: list[float], horizon: int, chunk: int | None = None) -> DataFrame:
    """Per context group: the as-of join among the group's own points, then n, r, avg_move and p_up; effect is max r - min r."""
    grouped = points.withColumn("grp", context_group(F.try_element_at("context", F.lit(variable)), thresholds)).where("grp is not null")
    found = movements(grouped, [horizon], by=["grp"], **({"chunk": chunk} if chunk else {}))
    out = found.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        pearson("value", "move").alias("r"),
        F.avg("move").alias("avg_move"),
        F.avg((F.col("move") > 0).cast("double")).alias("p_up"),
    )
    effect = out.agg((F.max("r") - F.min("r")).alias("effect"))
    return out.crossJoin(F.broadcast(effect))  # one row


def statistics(points: DataFrame) -> DataFrame:
    """One row: points, distinct times and measurements, first and last time, least and greatest price; zeros if empty."""
    zero = lambda c, k: F.coalesce(c, F.lit(0).cast(k))
    return points.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("us").alias("n_times"),
        F.count_distinct("measurement_id").alias("n_measurements"),
        zero(F.min("us"), "long").alias("first_us"),
        zero(F.max("us"), "long").alias("last_us"),
        zero(F.min("price"), "double").alias("min_price"),
        zero(F.max("price"), "double").alias("max_price"),
    )
