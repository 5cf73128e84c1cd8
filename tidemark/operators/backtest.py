"""Backtest of boundaries on movements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAY, DataValidationError
from ..schema import DEFAULTS as D


def trades(moves: DataFrame, boundaries: DataFrame, match_on: str = "move") -> DataFrame:
    """Movements with the first boundary (by ord) that holds them: expected, ret and win.

    Boundaries are at most max_ranges rows.  They match the movement itself by
    default, as the compatible behaviour; ``match_on='value'`` matches the measurement.
    """
    b = boundaries.select("ord", "low", "high", "expected")
    packed = b.agg(F.array_sort(F.collect_list(F.struct("ord", "low", "high", "expected"))).alias("_b"))  # one row
    first = F.get(F.filter("_b", lambda x: (F.col(match_on) >= x["low"]) & (F.col(match_on) <= x["high"])), F.lit(0))["expected"]
    got = moves.crossJoin(F.broadcast(packed)).withColumn("expected", first).drop("_b").where("expected is not null")
    return got.withColumn("ret", F.col("move") / F.greatest(F.abs("expected"), F.lit(D.minimum_expected))).withColumn(
        "win", F.signum("expected") == F.signum("move")
    )


def equity_curve(done: DataFrame, chunk: int = DAY) -> DataFrame:
    """Trades with equity (compounded 1 + ret / 100 in order of time and id) and drawdown from the peak so far, 1 at least.

    Products and peaks run within chunks of time; those of the chunks before
    come from one row each.
    """
    cut = done.withColumn("_c", F.floor(F.col("us") / F.lit(chunk))).withColumn("_f", 1 + F.col("ret") * D.trade_scale)
    inside = Window.partitionBy("_c").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    run = cut.withColumn("_e", F.product("_f").over(inside))
    # a chunk's own product and the highest and lowest point on its way
    per = run.groupBy("_c").agg(F.max("_e").alias("_top"), F.min("_e").alias("_bottom"), F.product("_f").alias("_p"))
    start = per.withColumn("_start", F.coalesce(F.product("_p").over(earlier), F.lit(1.0)))
    reached = F.greatest(F.col("_start") * F.col("_top"), F.col("_start") * F.col("_bottom"))
    start = start.select("_c", "_start", F.greatest(F.lit(1.0), F.coalesce(F.max(reached).over(earlier), F.lit(1.0))).alias("_peak"))
    joined = run.join(start, "_c").withColumn("equity", F.col("_start") * F.col("_e"))
    peak = F.greatest("_peak", F.max("equity").over(inside))
    return joined.withColumn("peak", peak).withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak")).drop("_c", "_f", "_e", "_start", "_peak")


def backtest(moves: DataFrame, boundaries: DataFrame, target: float, match_on: str = "move", chunk: int = DAY) -> DataFrame:
    """One row: trades, hit rate, mean return, volatility, Sharpe, maximum drawdown, mean win and loss; zeros without trades."""
    if target <= 0:
        raise DataValidationError("target must be positive")
    r = F.col("ret")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    got = equity_curve(trades(moves, boundaries, match_on), chunk).agg(
        F.count(F.lit(1)).alias("trades"),
        zero(F.avg(F.col("win").cast("double"))).alias("hit_rate"),
        zero(F.avg(r)).alias("avg_return"),
        zero(F.stddev_samp(r)).alias("volatility"),
        zero(F.max("drawdown")).alias("max_drawdown"),
        zero(F.avg(F.when(r > 0, r))).alias("avg_win"),
        zero(F.avg(F.when(r < 0, r))).alias("avg_loss"),
    )
    return got.withColumn("sharpe", F.when(F.col("volatility") > 0, F.col("avg_return") / F.col("volatility")).otherwise(0.0))


def check_configuration(train: float, test: float, windows: int) -> None:
    """Window shares lie within 0 and 1 and leave none over 1."""
    if not 0 < train < 1 or not 0 < test < 1 or train + test > 1:
        raise DataValidationError("window shares must lie within 0 and 1 and sum to at most 1")
    if not 0 < windows <= D.max_windows:
        raise DataValidationError(f"window count must be within 1 and {D.max_windows}")
