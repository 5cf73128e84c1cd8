"""Forward as-of self-join: the price at a horizon, in units of ATR.

Per series and horizon the first point at or after ``us + horizon`` is taken.
Points and targets are dealt by (series, chunk of time) and swept in falling
time, so that the last point passed is the first at or after the target; where
a chunk has none, the head of the next chunk that has points is.  An un-keyed
series thus spreads over its chunks; only one row per chunk meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAY, MINUTE, DataValidationError


def direction(move: Column) -> Column:
    return F.when(move > 0, "Up").when(move < 0, "Down").otherwise("Flat")


def forward_asof(
    points: DataFrame, horizons: list[int], by: list[str] | None = None, chunk: int = DAY, time: Column | None = None
) -> DataFrame:
    """A row for each point and horizon that has a later point: the columns of ``points``, horizon, next_us, next_id, next_price.

    ``time`` is what horizons count in (``us`` by default).  Of points at one
    time the smallest id is first; horizons that repeat count once.
    """
    if not horizons or any(h <= 0 for h in horizons):
        raise DataValidationError("horizons must be positive")
    keys = by or []
    at = F.col("us") if time is None else time
    slot = lambda t: F.floor(t / F.lit(chunk))
    base = points.withColumn("_t", at.cast("long"))
    point = F.struct(F.col("us").alias("next_us"), F.col("id").alias("next_id"), F.col("price").alias("next_price"))
    heads = base.groupBy(*keys, slot(F.col("_t")).alias("_slot")).agg(F.min(F.struct("_t", "us", "id", "price")).alias("_h"))
    targets = base.select("*", F.explode(F.array(*[F.lit(h) for h in sorted(set(horizons))])).alias("horizon")).withColumn(
        "_t", F.col("_t") + F.col("horizon")
    )
    rec = F.struct(*[F.col(c) for c in points.columns], F.col("horizon"))
    none = F.lit(None)
    kind_of = targets.select(rec.alias("r")).schema["r"].dataType
    events = base.select(
        *keys, slot(F.col("_t")).alias("_slot"), "_t", F.col("us").alias("_us"), F.lit(0).alias("_kind"), F.col("id").alias("_id"),
        point.alias("_p"), none.cast(kind_of).alias("_r"),
    ).unionByName(
        targets.select(
            *keys, slot(F.col("_t")).alias("_slot"), "_t", F.col("us").alias("_us"), F.lit(1).alias("_kind"), F.col("id").alias("_id"),
            none.cast(base.select(point.alias("p")).schema["p"].dataType).alias("_p"), rec.alias("_r"),
        )
    )
    sweep = (
        Window.partitionBy(*keys, "_slot")
        .orderBy(F.desc("_t"), "_kind", F.desc("_us"), F.desc("_id"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    later = Window.partitionBy(*keys).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    slots = events.select(*keys, "_slot").distinct().join(heads, [*keys, "_slot"], "left")
    after = slots.select(*keys, "_slot", F.last("_h", ignorenulls=True).over(later).alias("_next"))
    swept = (
        events.withColumn("_p", F.last("_p", ignorenulls=True).over(sweep)).where("_kind = 1").select(*keys, "_slot", "_p", "_r")
    )
    following = F.struct(F.col("_next.us").alias("next_us"), F.col("_next.id").alias("next_id"), F.col("_next.price").alias("next_price"))
    found = F.coalesce("_p", F.when(F.col("_next").isNotNull(), following))
    return swept.join(after, [*keys, "_slot"]).withColumn("_f", found).where("_f is not null").select("_r.*", "_f.*")


def movements(
    points: DataFrame, horizons: list[int], by: list[str] | None = None, chunk: int = DAY, time: Column | None = None
) -> DataFrame:
    """As-of rows with an ATR other than 0, plus move = (next price - price) / ATR and its direction."""
    found = forward_asof(points, horizons, by, chunk, time).where("atr <> 0")
    move = (F.col("next_price") - F.col("price")) / F.col("atr")
    return found.withColumn("move", move).withColumn("direction", direction(F.col("move")))


def minute_movements(points: DataFrame, minutes: list[int], by: list[str] | None = None) -> DataFrame:
    """The variant on times cut to whole minutes; horizons count minutes."""
    return movements(points, minutes, by, chunk=DAY // MINUTE, time=F.floor(F.col("us") / F.lit(MINUTE)))


def combined(moves: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The i-th movement of each measurement, weighted and summed, for positions that all have.

    Time is that of the first measurement by name; value, the weighted
    measurement, is an addition.
    """
    names = sorted(weights)
    place = F.row_number().over(Window.partitionBy("measurement_id").orderBy("us", "id"))
    w = F.coalesce(*[F.when(F.col("measurement_id") == m, F.lit(float(weights[m]))) for m in names])
    placed = moves.where(F.col("measurement_id").isin(names)).withColumn("position", place).withColumn("_w", w)
    return (
        placed.groupBy("position")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.when(F.col("measurement_id") == names[0], F.col("us"))).alias("us"),
            F.sum(F.col("move") * F.col("_w")).alias("move"),
            F.sum(F.col("value") * F.col("_w")).alias("value"),
        )
        .where(F.col("_n") == len(names))
        .drop("_n")
    )
