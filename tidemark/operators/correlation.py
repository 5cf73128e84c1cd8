"""Correlation of measurement and movement with its significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson, significance, significance_level, strength
from ..schema import DEFAULTS as D
from ..schema import CorrelationKind, InsufficientDataError, OutlierHandling
from .outliers import ensemble, handle, iqr
from .segments import bucket_counts, context_filter, overall_stats, range_analysis


def described(rows: DataFrame, corrected: bool = False) -> DataFrame:
    """Rows with n and r get p_value, t_stat, df, std_error, ci_low, ci_high, significant, strength and level."""
    out = rows.withColumn("_s", significance(F.col("r"), F.col("n"), corrected))
    out = out.select(*rows.columns, F.inline(F.array("_s")))  # inline keeps the struct computed once
    return out.withColumn("strength", strength(F.col("r"))).withColumn("level", significance_level(F.col("p_value")))


def ranked(moves: DataFrame, by: list[str] | None = None) -> DataFrame:
    """value and move replaced by their average ranks.

    Ranks come from the counts of distinct values: values that repeat are
    combined first, and without groups the running count goes by ranges of the
    value, so no task sorts all rows.
    """
    keys = by or []
    out = moves
    for c in ("value", "move"):
        counts = out.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_c"))
        slot = F.floor(F.coalesce(F.log2(F.abs(c) + 1), F.lit(0.0)) * F.signum(c) * 16)
        cut = counts.withColumn("_slot", slot)
        per = cut.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_s"))
        before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        offset = per.select(*keys, "_slot", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
        inside = Window.partitionBy(*keys, "_slot").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        rank = (
            cut.withColumn("_b", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
            .join(offset, [*keys, "_slot"])
            .select(*keys, c, (F.col("_off") + F.col("_b") + (F.col("_c") + 1) / 2).alias(f"_r_{c}"))
        )
        out = out.join(rank, [*keys, c])
    return out.select(
        *[F.col(f"_r_{c}").alias(c) if c in ("value", "move") else F.col(c) for c in moves.columns], F.col("move").alias("_raw")
    )


def correlate(
    moves: DataFrame, kind: CorrelationKind = CorrelationKind.PEARSON, by: list[str] | None = None, corrected: bool = False
) -> DataFrame:
    """One row (per group): n, r, avg_move and the significance; no outlier handling.

    Rank kinds work on average ranks; Kendall is served by them too.  A
    constant side gives r = 0, and so do fewer than two rows.
    """
    rows = moves.withColumn("_raw", F.col("move")) if kind is CorrelationKind.PEARSON else ranked(moves, by)
    n = F.count(F.lit(1))
    got = rows.groupBy(*(by or [])).agg(
        n.alias("n"),
        F.when(n >= 2, pearson("value", "move")).otherwise(0.0).alias("r"),
        F.coalesce(F.avg("_raw"), F.lit(0.0)).alias("avg_move"),
    )
    return described(got, corrected)


def outlier_handled(moves: DataFrame) -> DataFrame:
    """What correlation works on: capped if enough rows and any outlier (ensemble from 100 rows on, quartile fences below)."""
    n = moves.count()
    if n < D.minimum_detection:
        return moves
    flagged = (ensemble if n >= D.ensemble_from else iqr)(moves)
    return handle(flagged, OutlierHandling.CAP, moves).drop("flag", "score")


def correlate_handled(moves: DataFrame, kind: CorrelationKind = CorrelationKind.PEARSON) -> DataFrame:
    """``correlate`` after outlier handling; n is that of all rows, n_processed what is left."""
    done = outlier_handled(moves)
    n = moves.agg(F.count(F.lit(1)).alias("n"))
    part = correlate(done, kind).select("r", "avg_move", F.col("n").alias("n_processed"))
    return described(part.crossJoin(F.broadcast(n)))  # one row each


def lite_correlation(moves: DataFrame) -> DataFrame:
    """The variant without outlier step: significant above 0.3, p linear in t and held within 0 and 1."""
    out = moves.agg(F.count(F.lit(1)).alias("n"), pearson("value", "move").alias("r"))
    t = F.abs("r") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-12), 1 - F.col("r") * F.col("r")))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - t / F.sqrt((F.col("n") - 2).cast("double")))))
    return out.withColumn("p_value", F.when(F.col("n") > 2, p).otherwise(1.0)).withColumn("significant", F.abs("r") > 0.3)


def contextual(moves: DataFrame, name: str, op: str, threshold: float) -> DataFrame:
    """Correlation of the rows that pass a context filter."""
    return correlate(context_filter(moves, name, op, threshold))


def by_horizon(moves: DataFrame, least: int = 20) -> DataFrame:
    """Correlation per horizon; horizons with fewer movements give none."""
    return correlate(moves, by=["horizon"]).where(F.col("n") >= least)


def full_analysis(moves: DataFrame, horizons: list[int], ranges: list[tuple[float, float]], targets: list[float]) -> dict[str, DataFrame]:
    """correlations per horizon over measurements other than 0; ranges, buckets and overall on the first horizon."""
    if not horizons:
        raise InsufficientDataError("no horizon")
    live = moves.where("value <> 0")
    first = live.where(F.col("horizon") == horizons[0])
    return {
        "correlations": correlate(live, by=["horizon"]),
        "ranges": range_analysis(first, ranges),
        "buckets": bucket_counts(first, targets),
        "overall": overall_stats(first),
    }


def measurement_weights(moves: DataFrame, least: float = 0.1) -> DataFrame:
    """Per measurement: n, r, weight (|r|, at least ``least``, to a sum of 1), importance; the combined r of all.

    ``importance`` is weight times |r| to a sum of 1; ``importance_boosted``
    raises the largest to 0.40 and scales the others where it is below 0.35;
    ``combined_floored`` is at least 0.12.
    """
    every = Window.partitionBy(F.lit(0))
    r = F.abs("r")
    out = (
        moves.groupBy("measurement_id")
        .agg(F.count(F.lit(1)).alias("n"), pearson("value", "move").alias("r"))
        .withColumn("_raw", F.greatest(r, F.lit(least)))
        .withColumn("weight", F.col("_raw") / F.sum("_raw").over(every))
        .withColumn("combined_r", F.sum(F.col("_raw") * F.col("weight")).over(every))
        .withColumn("combined_floored", F.greatest("combined_r", F.lit(0.12)))
        .withColumn("_i", F.col("weight") * r)
        .withColumn("importance", F.coalesce(F.try_divide(F.col("_i"), F.sum("_i").over(every)), F.lit(0.0)))
        .withColumn("_top", F.max("importance").over(every))
    )
    boosted = F.when(F.col("_top") >= 0.35, F.col("importance")).when(F.col("importance") == F.col("_top"), 0.40).otherwise(
        F.coalesce(F.try_divide(F.col("importance") * 0.60, 1 - F.col("_top")), F.lit(0.0))
    )
    return out.withColumn("importance_boosted", boosted).drop("_raw", "_i", "_top")


def measurement_calc(moves: DataFrame, least: int = 20) -> DataFrame:
    """Per measurement: r (0 with fewer than ``least`` rows), p, importance |r| halved unless p < 0.05, weight, combined r."""
    every = Window.partitionBy(F.lit(0))
    got = moves.groupBy("measurement_id").agg(F.count(F.lit(1)).alias("n"), pearson("value", "move").alias("r"))
    got = got.withColumn("r", F.when(F.col("n") >= least, F.col("r")).otherwise(0.0))
    got = got.withColumn("p_value", F.when(F.col("n") >= least, significance(F.col("r"), F.col("n"))["p_value"]).otherwise(1.0))
    got = got.withColumn("importance", F.abs("r") * F.when(F.col("p_value") < D.alpha, 1.0).otherwise(0.5))
    equal = F.lit(1.0) / F.count(F.lit(1)).over(every)
    got = got.withColumn("weight", F.coalesce(F.try_divide(F.col("importance"), F.sum("importance").over(every)), equal))
    return got.withColumn("combined_r", F.sum(F.abs("r") * F.col("weight")).over(every))
