"""Outlier detection, handling and data quality of movements.

Statistics come first, as one-row tables that are joined to the rows; flags are
columns.  Below 30 rows nothing is flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import median_of, order_statistics, positional
from ..schema import DEFAULTS as D
from ..schema import OutlierHandling, OutlierMethod

FLAGS = {
    OutlierMethod.IQR: "iqr",
    OutlierMethod.ZSCORE: "zscore",
    OutlierMethod.MODIFIED_ZSCORE: "mad",
    OutlierMethod.ISOLATION: "isolation",
}


def _one(df: DataFrame, row: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(row))  # one row


def iqr(moves: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``moves`` with flag and score: the distance beyond the nearest fence over the quartile range."""
    q = order_statistics(moves if base is None else base, "value", {"q1": positional(0.25), "q3": positional(0.75)}).withColumnRenamed("n", "_n")
    rows = _one(moves, q)
    width = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - D.iqr_multiplier * width, F.col("q3") + D.iqr_multiplier * width
    flag = (F.col("_n") >= D.minimum_detection) & ((F.col("value") < low) | (F.col("value") > high))
    beyond = F.least(F.abs(F.col("value") - low), F.abs(F.col("value") - high))
    score = F.when(width == 0, F.lit(float("inf"))).otherwise(F.try_divide(beyond, width))
    return rows.withColumn("flag", flag).withColumn("score", F.when(F.col("flag"), score)).drop("q1", "q3", "_n")


def _moments(moves: DataFrame) -> DataFrame:
    return moves.agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg("value").alias("_mv"),
        F.stddev_samp("value").alias("_sv"),
        F.avg("move").alias("_mm"),
        F.stddev_samp("move").alias("_sm"),
    )


def _z(x: str, mean: str, sd: str) -> Column:
    return F.abs(F.try_divide(F.col(x) - F.col(mean), F.col(sd)))


def zscore(moves: DataFrame, base: DataFrame | None = None) -> DataFrame:
    rows = _one(moves, _moments(moves if base is None else base))
    z = _z("value", "_mv", "_sv")
    flag = (F.col("_n") >= D.minimum_detection) & F.coalesce(z > D.z_threshold, F.lit(False))
    return rows.withColumn("flag", flag).withColumn("score", F.when(F.col("flag"), z)).drop("_n", "_mv", "_sv", "_mm", "_sm")


def modified_zscore(moves: DataFrame, base: DataFrame | None = None) -> DataFrame:
    base = moves if base is None else base
    middle = median_of(base, "value", "_med")
    spread = _one(base, middle).select(F.abs(F.col("value") - F.col("_med")).alias("_d"))
    n = base.agg(F.count(F.lit(1)).alias("_n"))
    rows = _one(_one(_one(moves, middle), median_of(spread, "_d", "_mad")), n)
    z = F.when(F.col("_mad") >= 1e-10, F.try_divide(0.6745 * F.abs(F.col("value") - F.col("_med")), F.col("_mad")))
    flag = (F.col("_n") >= D.minimum_detection) & F.coalesce(z > D.modified_z_threshold, F.lit(False))
    return rows.withColumn("flag", flag).withColumn("score", F.when(F.col("flag"), z)).drop("_med", "_mad", "_n")


def isolation(moves: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The mean of both |z| above 2; if more than a tenth of the rows pass, the highest tenth (ties by id).

    The tenth is cut at the score of that rank, found without a global sort;
    only rows at exactly that score are numbered.
    """
    base = moves if base is None else base
    stats = _moments(base)
    score = (F.coalesce(_z("value", "_mv", "_sv"), F.lit(0.0)) + F.coalesce(_z("move", "_mm", "_sm"), F.lit(0.0))) / 2
    scored = lambda rows: _one(rows, stats).withColumn("_s", score).drop("_mv", "_sv", "_mm", "_sm")
    top = order_statistics(scored(base), "_s", {"_cut": lambda n: n - F.greatest(F.floor(n * F.lit(D.contamination)), F.lit(1))}).drop("n")
    passed = _one(scored(base), top).agg(F.sum((F.col("_s") > 2.0).cast("long")).alias("_hits"), F.sum((F.col("_s") > F.col("_cut")).cast("long")).alias("_above"))
    ranked = _one(_one(scored(moves), top), passed).withColumn(
        "_tie", F.when(F.col("_s") == F.col("_cut"), F.row_number().over(Window.partitionBy("_s").orderBy("id")))
    )
    most = F.floor(F.col("_n") * F.lit(D.contamination))
    kept = (F.col("_s") > F.col("_cut")) | F.coalesce(F.col("_tie") <= most - F.col("_above"), F.lit(False))
    flag = (F.col("_n") >= D.minimum_detection) & (F.col("_s") > 2.0) & ((F.col("_hits") <= most) | kept)
    return ranked.withColumn("flag", flag).withColumn("score", F.when(F.col("flag"), F.col("_s"))).drop("_s", "_n", "_cut", "_hits", "_above", "_tie")


def voted(moves: DataFrame) -> DataFrame:
    """``moves`` with one flag column per method (iqr, zscore, mad, isolation) and votes.

    Each detector adds its flag to the rows it got and takes its statistics from
    the movements themselves, so rows are never joined to each other and plans stay flat.
    """
    rows = moves
    base = moves.select("id", "value", "move")
    for name, f in (("iqr", iqr), ("zscore", zscore), ("mad", modified_zscore), ("isolation", isolation)):
        rows = f(rows, base).withColumnRenamed("flag", name).drop("score")
    return rows.withColumn("votes", sum(F.col(c).cast("int") for c in FLAGS.values()))


def ensemble(moves: DataFrame) -> DataFrame:
    rows = voted(moves)
    share = F.col("votes") / len(FLAGS)
    return rows.withColumn("flag", share >= D.consensus).withColumn("score", F.when(F.col("votes") > 0, share)).drop(*FLAGS.values(), "votes")


DETECTORS = {
    OutlierMethod.IQR: iqr,
    OutlierMethod.ZSCORE: zscore,
    OutlierMethod.MODIFIED_ZSCORE: modified_zscore,
    OutlierMethod.ISOLATION: isolation,
    OutlierMethod.ENSEMBLE: ensemble,
}


def detect(moves: DataFrame, method: OutlierMethod) -> DataFrame:
    return DETECTORS[method](moves)


def handle(flagged: DataFrame, how: OutlierHandling, base: DataFrame | None = None) -> DataFrame:
    """Rows with ``flag`` after handling; without any flagged row they come back as they were.

    ``base``: the movements before detection, from which quantiles and medians
    are the same and cheaper.
    """
    base = flagged if base is None else base
    any_ = flagged.agg(F.coalesce(F.max("flag"), F.lit(False)).alias("_any"))
    rows = _one(flagged, any_)
    if how is OutlierHandling.REMOVE:
        return rows.where(~F.col("flag")).drop("_any")
    if how is OutlierHandling.FLAG:
        old = F.map_filter(F.coalesce("context", F.expr("cast(map() as map<string,double>)")), lambda k, _: k != "IsOutlier")
        new = F.map_concat(old, F.create_map(F.lit("IsOutlier"), F.col("flag").cast("double")))
        return rows.withColumn("context", F.when(F.col("_any"), new).otherwise(F.col("context"))).drop("_any")
    if how is OutlierHandling.LOG:
        value = F.log1p(F.greatest(F.lit(0.0), F.col("value")))
        move = F.signum("move") * F.log1p(F.abs("move"))
    elif how is OutlierHandling.CAP:
        for c in ("value", "move"):
            bounds = order_statistics(base, c, {f"_lo_{c}": positional(D.capping), f"_hi_{c}": positional(1.0 - D.capping)})
            rows = _one(rows, bounds.drop("n"))
        value, move = (F.greatest(F.col(f"_lo_{c}"), F.least(F.col(f"_hi_{c}"), F.col(c))) for c in ("value", "move"))
    else:
        rows = _one(_one(rows, median_of(base, "value", "_med_value")), median_of(base, "move", "_med_move"))
        value, move = (F.when(F.col("flag"), F.col(f"_med_{c}")).otherwise(F.col(c)) for c in ("value", "move"))
    done = rows.withColumn("_v", F.when(F.col("_any"), value).otherwise(F.col("value"))).withColumn(
        "_m", F.when(F.col("_any"), move).otherwise(F.col("move"))
    )
    return done.select(*[F.col({"value": "_v", "move": "_m"}.get(c, c)).alias(c) for c in flagged.columns])


def movement_stats(moves: DataFrame) -> DataFrame:
    """One row: count, mean, sample std, min and max of measurement and move."""
    out = [F.count(F.lit(1)).alias("n")]
    for c in ("value", "move"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return moves.agg(*out)


def outlier_analysis(moves: DataFrame) -> DataFrame:
    """One row: rows flagged by each method and by consensus, the impact of dropping those, its severity, the advised handling."""
    rows = voted(moves).withColumn("_c", F.col("votes") / len(FLAGS) >= D.consensus)
    clean = ~F.col("_c")
    got = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c).cast("long")).alias(f"n_{c}") for c in FLAGS.values()],
        F.sum(F.col("_c").cast("long")).alias("n_consensus"),
        F.avg("value").alias("_mean"),
        F.stddev_samp("value").alias("_std"),
        F.avg(F.when(clean, F.col("value"))).alias("_mean2"),
        F.stddev_samp(F.when(clean, F.col("value"))).alias("_std2"),
    )
    none = F.col("n_consensus") == 0
    impact = lambda a, b: F.when(none, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.abs(F.col(b) - F.col(a)), F.col(a)), F.lit(0.0)))
    share = F.try_divide(F.col("n_consensus"), F.col("n"))
    worst = F.greatest("mean_impact", "std_impact")
    return (
        got.withColumn("mean_impact", impact("_mean", "_mean2"))
        .withColumn("std_impact", impact("_std", "_std2"))
        .withColumn("severity", F.when(worst > 0.2, "Critical").when(worst > 0.1, "High").when(worst > 0.05, "Medium").otherwise("Low"))
        .withColumn(
            "strategy", F.when(share > 0.15, "LogTransform").when(share > 0.1, "Cap").when(share > 0.05, "ReplaceWithMedian").otherwise("Flag")
        )
        .drop("_mean", "_std", "_mean2", "_std2")
    )


def sample_skewness(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.sqrt((n * (n - 1)).cast("double")) / F.when(n > 2, n - 2) * F.skewness(c))


def sample_kurtosis(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def data_quality(moves: DataFrame) -> DataFrame:
    """One row: score from 0 to 100, the issues' impacts, skewness and kurtosis."""
    shape = moves.agg(
        F.sum((F.col("value") == 0).cast("long")).alias("zero_values"),
        F.sum((F.col("move") == 0).cast("long")).alias("zero_moves"),
        sample_skewness("value").alias("value_skew"),
        sample_kurtosis("value").alias("value_kurt"),
        sample_skewness("move").alias("move_skew"),
        sample_kurtosis("move").alias("move_kurt"),
    )
    rows = _one(outlier_analysis(moves).select("n", "n_consensus"), shape)
    share = F.try_divide(F.col("n_consensus"), F.col("n"))
    zero = F.try_divide(F.col("zero_values"), F.col("n"))
    skew = F.abs("value_skew")
    cost_zero = F.when(F.col("zero_values") > 0, F.when(zero > 0.1, F.lit(20.0)).otherwise(10.0) * zero).otherwise(0.0)
    cost_out = F.when(share > D.max_outlier_share, 10.0 * F.least(F.lit(1.0), share / D.max_outlier_share)).otherwise(0.0)
    cost_skew = F.when(skew > 2, 5.0 * F.least(F.lit(1.0), skew / 3)).otherwise(0.0)
    score = F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - cost_zero - cost_out - cost_skew))
    issues = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("zero_values") > 0, "Invalid Measurements"),
                F.when(share > D.max_outlier_share, "Excessive Outliers"),
                F.when(skew > 2, "Skewed Distribution"),
            )
        ),
        "; ",
    )
    return rows.select(
        "n", "zero_values", "zero_moves", share.alias("outlier_share"), "value_skew", "value_kurt", "move_skew", "move_kurt",
        issues.alias("issues"), score.alias("score"),
    )
