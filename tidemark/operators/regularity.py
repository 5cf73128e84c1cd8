"""Time step and regularity of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAY


def regularity(points: DataFrame, chunk: int = DAY) -> DataFrame:
    """One row: n, time_step_us (the first interval) and is_regular (all intervals equal).

    Intervals inside a chunk come from lag; that to the chunk before from the
    chunks' last times, so a long series isn't one task.
    """
    cut = points.select("us", "id", F.floor(F.col("us") / F.lit(chunk)).alias("c"))
    ends = cut.groupBy("c").agg(F.max("us").alias("last_us"))
    before = ends.select("c", F.lag("last_us").over(Window.orderBy("c")).alias("prev"))
    inside = Window.partitionBy("c").orderBy("us", "id")
    gaps = (
        cut.withColumn("p", F.lag("us").over(inside))
        .join(before, "c")
        .select("us", "id", (F.col("us") - F.coalesce("p", "prev")).alias("d"))
    )
    got = gaps.agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("d", F.when(F.col("d").isNotNull(), F.struct("us", "id"))).alias("step"),
        (F.min("d") == F.max("d")).alias("same"),
    )
    return got.select(
        "n",
        F.coalesce("step", F.lit(0)).cast("long").alias("time_step_us"),
        F.when(F.col("n") <= 1, True).otherwise(F.coalesce("same", F.lit(True))).alias("is_regular"),
    )
