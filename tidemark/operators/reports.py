"""Reports on boundaries and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOWER_EDGE, UPPER_EDGE = 10.0, 90.0


def report_table(boundaries: DataFrame) -> DataFrame:
    """Range label, probability up, average move, samples and confidence, the most confident first."""
    label = F.format_string("%.0f-%.0f", F.col("low"), F.col("high"))
    return boundaries.select(label.alias("measurement_range"), "p_up", "expected", "n", "confidence").orderBy(F.desc("confidence"), "measurement_range")


def predictive_model(boundaries: DataFrame, correlations: DataFrame) -> DataFrame:
    """One row: accuracy (mean confidence), number of boundaries, |r| by horizon."""
    acc = boundaries.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n_boundaries"))
    weight = correlations.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", F.abs("r"))))).alias("importance"))
    return acc.crossJoin(F.broadcast(weight))  # one row each


def predict(points: DataFrame) -> DataFrame:
    """The rule of thumb: 1 % of the measurement, half more above 70, turned and a fifth more below 30."""
    v = F.col("value")
    move = v * 0.01 * F.when(v > 70, 1.5).when(v < 30, -1.2).otherwise(1.0)
    return points.withColumn("_m", move).select(
        *points.columns,
        F.abs("_m").alias("expected_move"),
        F.when(F.col("_m") > 0, "Up").when(F.col("_m") < 0, "Down").otherwise("Flat").alias("predicted"),
    )


def statistical_report(pearson: DataFrame, spearman: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Per horizon r, rank r, p and n; the best horizon, mean |r|, all samples and the boundaries' span in each row."""
    rank = spearman.select("horizon", F.col("r").alias("rank_r"))
    rows = pearson.select("horizon", "r", "p_value", "n").join(rank, "horizon")
    every = rows.agg(
        F.max_by("horizon", F.abs("r")).alias("best_horizon"),
        F.max_by("r", F.abs("r")).alias("max_r"),
        F.avg(F.abs("r")).alias("mean_abs_r"),
        F.sum("n").alias("total_n"),
    )
    span = boundaries.agg(F.coalesce(F.min("low"), F.lit(0.0)).alias("range_low"), F.coalesce(F.max("high"), F.lit(0.0)).alias("range_high"))
    return rows.withColumn("significant", F.abs("r") > 0.1).crossJoin(F.broadcast(every)).crossJoin(F.broadcast(span))  # one row each


def _kind(move: Column) -> Column:
    return (
        F.when(move > 1.5, "Strong Bullish").when(move > 0.5, "Bullish").when(move > -0.5, "Neutral").when(move > -1.5, "Bearish").otherwise("Strong Bearish")
    )


def interpolation_segments(boundaries: DataFrame) -> DataFrame:
    """Boundaries as bias segments, with an edge down to 10 and one up to 90 where they leave room."""
    move = F.col("expected")
    main = boundaries.select(
        "low", "high",
        F.when(move > 1, 50).when(move > 0, 0).otherwise(-50).alias("bias_low"),
        F.when(move > 2, 100).when(move > 1, 50).otherwise(0).alias("bias_high"),
        _kind(move).alias("kind"),
    )
    edges = boundaries.agg(F.min("low").alias("first"), F.max_by("high", F.struct("low", "high")).alias("last"))
    below = edges.where(F.col("first") > LOWER_EDGE).select(
        F.lit(LOWER_EDGE).alias("low"), F.col("first").alias("high"), F.lit(-100).alias("bias_low"), F.lit(-75).alias("bias_high"), F.lit("Strong Bearish").alias("kind")
    )
    above = edges.where(F.col("last") < UPPER_EDGE).select(
        F.col("last").alias("low"), F.lit(UPPER_EDGE).alias("high"), F.lit(75).alias("bias_low"), F.lit(100).alias("bias_high"), F.lit("Strong Bullish").alias("kind")
    )
    return below.unionByName(main).unionByName(above).orderBy("low", "high")


def live_expectation(values: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``values`` (with value) plus expected_move, bias, confidence, signal and samples.

    The first boundary by ord that holds the value, else the one with the
    nearest end, else a rule of thumb.  Works on streams: boundaries are one
    packed row, at most max_ranges long.
    """
    packed = boundaries.agg(F.array_sort(F.collect_list(F.struct("ord", "low", "high", "expected", "confidence", "n"))).alias("_b"))
    rows = values.crossJoin(F.broadcast(packed))
    v = F.col("value")
    inside = F.get(F.filter("_b", lambda x: (v >= x["low"]) & (v <= x["high"])), F.lit(0))
    near = F.get(
        F.array_sort(F.transform("_b", lambda x: F.struct(F.least(F.abs(v - x["low"]), F.abs(v - x["high"])).alias("d"), x["ord"].alias("o"), x.alias("b")))), F.lit(0)
    )["b"]
    rows = rows.withColumn("_hit", F.coalesce(inside, near))
    rule = F.when(v > 70, 1.2).when(v < 30, -0.8).otherwise(0.3)
    move = F.coalesce("_hit.expected", rule)
    signal = F.when(move > 1.5, "Strong Buy").when(move > 0.5, "Buy").when(move > -0.5, "Neutral").when(move > -1.5, "Sell").otherwise("Strong Sell")
    thumb = F.when(move > 0.5, "Buy").when(move < -0.5, "Sell").otherwise("Neutral")
    return rows.select(
        *values.columns,
        move.alias("expected_move"),
        (move * 25).alias("bias"),
        F.coalesce("_hit.confidence", F.lit(0.5)).alias("confidence"),
        F.when(F.col("_hit").isNull(), thumb).otherwise(signal).alias("signal"),
        F.coalesce("_hit.n", F.lit(50)).alias("samples"),
    )


def default_boundaries(spark) -> DataFrame:
    """The three stand-in rows; only for callers that ask for them."""
    # Low, high, confidence, expected move, samples, hit rate, probability up.
    rows = [
        (0, 20.0, 45.0, 0.65, -1.2, 150, 0.60, 0.30, "Default"),
        (1, 45.0, 70.0, 0.55, 0.8, 200, 0.58, 0.58, "Default"),
        (2, 70.0, 85.0, 0.75, 1.8, 120, 0.72, 0.75, "Default"),
    ]
    return spark.createDataFrame(
        rows, "ord int, low double, high double, confidence double, expected double, n long, hit double, p_up double, method string"
    )


def with_probability_up(boundaries: DataFrame, moves: DataFrame) -> DataFrame:
    up = (
        moves.join(F.broadcast(boundaries.select("low", "high")), F.col("value").between(F.col("low"), F.col("high")))
        .groupBy("low", "high")
        .agg(F.avg((F.col("move") > 0).cast("double")).alias("p_up"))
    )
    return boundaries.join(up, ["low", "high"], "left")


def ordered(boundaries: DataFrame) -> DataFrame:
    """Boundaries numbered by falling confidence."""
    return boundaries.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("confidence"), "low", "high")))
