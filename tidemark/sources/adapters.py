"""Tables on disk as data points and movements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data points: events with k of props as measurement value, user_id % 8 as ATR."""
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("double")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        micros("ts").alias("us"),
        F.col("event_type").alias("measurement_id"),
        k.alias("value"),
        F.col("value").alias("price"),
        (F.col("user_id") % 8).cast("double").alias("atr"),
        F.create_map(F.lit("user"), F.col("user_id").cast("double"), F.lit("k"), k).alias("context"),
    )


def multi_points(points: DataFrame) -> DataFrame:
    """Points with several named measurements in a map."""
    return points.select(
        "id",
        "us",
        F.create_map(F.col("measurement_id"), F.col("value"), F.lit("price"), F.col("price")).alias("measurements"),
        "price",
        "atr",
        "context",
    )


def line_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements: line items with quantity as measurement and a price-driven move."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"),
        micros("l_shipdate").alias("us"),
        F.col("l_quantity").alias("value"),
        ((F.col("l_extendedprice") - 52500) / 30000 + (F.col("l_quantity") - 25) / 25).alias("move"),
        F.col("l_returnflag").alias("flag"),
    )
