"""Structured Streaming: validated ingestion, windowed statistics, live expectation, alerts.

These are additions; the batch operators are the reference for results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import deviation_severity
from ..operators.reports import live_expectation
from ..sources.store import validated


def valid_points(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Points that pass validation, with ts as event time; a repeated id within ``late`` comes once."""
    rows = validated(stream).where("problem is null").drop("problem")
    return rows.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def windowed_statistics(points: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per window of event time and measurement: n, mean value, least and greatest price; late rows go by the watermark."""
    return (
        points.groupBy(F.window("ts", width).alias("w"), "measurement_id")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))
        .select(F.col("w.start").alias("start"), "measurement_id", "n", "mean_value", "min_price", "max_price")
    )


def expectations(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Each point with what the boundaries, a static table, expect."""
    return live_expectation(points, boundaries)


def alerts(points: DataFrame, boundaries: DataFrame, typical: float = 1.0) -> DataFrame:
    """Expectations that deviate from ``typical``, with a severity."""
    deviation = F.abs(F.abs("expected_move") - F.lit(typical)) / F.lit(typical)
    return expectations(points, boundaries).withColumn("deviation", deviation).withColumn("severity", deviation_severity(F.col("deviation"))).where("severity <> 'Low'")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame], None], checkpoint: str):
    """Start a query that hands every micro-batch to ``handle``; its progress is kept in ``checkpoint``."""
    return stream.writeStream.foreachBatch(lambda batch, _: handle(batch)).option("checkpointLocation", checkpoint).start()
