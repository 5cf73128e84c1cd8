"""Folds, walk-forward windows and cross-validation as grouped plans: folds are a column, never a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import numbered, pearson
from ..schema import DAY, DataValidationError
from ..schema import DEFAULTS as D
from .boundaries import histogram, sliding, validation_summary
from .movements import movements


def hash_fold(id_: Column, k: int) -> Column:
    """A fold from 0 to k - 1 by a hash of the id: the same at every run."""
    return (F.conv(F.substring(F.md5(id_.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % k).cast("int")


def _held_against(boundaries: DataFrame, rows: DataFrame) -> DataFrame:
    """Per fold and boundary the hit rate on the fold's rows at the boundary's expected move."""
    b = boundaries.select("fold", "low", "high", "expected", "n", "hit")
    held = (
        rows.join(F.broadcast(b.select("fold", "low", "high", "expected")), "fold")  # folds times k rows
        .where(F.col("value").between(F.col("low"), F.col("high")))
        .groupBy("fold", "low", "high")
        .agg(F.avg((F.abs("move") >= F.col("expected")).cast("double")).alias("oos_hit"))
    )
    out = b.join(held, ["fold", "low", "high"], "left").withColumn("oos_hit", F.coalesce("oos_hit", F.lit(0.0)))
    worse = F.when(F.col("hit") > 0, F.abs(F.col("hit") - F.col("oos_hit")) / F.col("hit")).otherwise(1.0)
    return out.withColumn("stable", worse < D.degradation)


def kfold(moves: DataFrame, k: int = 5, target: float = 1.5, ranges: int = 5) -> DataFrame:
    """Per fold: performance in and out of sample of the ranges found on the other folds.

    What a fold trains on is the histogram of all rows less its own, so rows
    are never copied to k - 1 folds.
    """
    if k <= 1:
        raise DataValidationError("k must be above 1")
    rows = moves.withColumn("fold", hash_fold(F.col("id"), k))
    own = histogram(rows, target, ["fold"])
    folds = moves.sparkSession.range(k).select(F.col("id").cast("int").alias("fold"))
    every = own.groupBy("value").agg(*[F.sum(c).alias(c) for c in ("c", "hits", "total")]).join(F.broadcast(folds))  # k rows
    held = own.select("fold", "value", *[F.col(c).alias(f"o_{c}") for c in ("c", "hits", "total")])
    train = every.join(held, ["fold", "value"], "left").select(
        "fold", "value", *[(F.col(c) - F.coalesce(f"o_{c}", F.lit(0))).alias(c) for c in ("c", "hits", "total")]
    )
    found = sliding(train.where("c > 0"), ranges, ["fold"])
    return validation_summary(_held_against(found, rows), ["fold"], plain_in_sample=True).select(
        "fold", "in_sample", "out_of_sample", "degradation", "overfitted", "n_boundaries"
    )


def _folds(moves: DataFrame, initial: float, step: float, chunk: int, rolling: bool, target: float, ranges: int) -> DataFrame:
    if not 0 < initial < 1 or not 0 < step < 1:
        raise DataValidationError("initial and step must lie within 0 and 1")
    placed = numbered(moves, "us", ["id"], chunk)
    n = F.col("n")
    size = F.floor(n * F.lit(initial))
    few = F.least(F.lit(10), F.floor(n / (3 if rolling else 2)))
    train = F.when(size < 10, few).otherwise(size).cast("long")
    stride = F.greatest(F.lit(1), F.floor(n * F.lit(step))).cast("long")
    last = F.floor((n - train - stride) / stride).cast("long")
    rows = placed.select("id", "us", "value", "move", (F.col("rn") - 1).alias("i"), train.alias("t"), stride.alias("s"), last.alias("last")).where(
        "last >= 0"
    )
    # fold f trains on [f * s if rolling else 0, t + f * s) and is held against the s rows that follow
    held_fold = F.floor((F.col("i") - F.col("t")) / F.col("s")).cast("int")
    held = rows.where("i >= t").withColumn("fold", held_fold).where("fold <= last")
    first = F.greatest(F.lit(0), F.floor((F.col("i") - F.col("t")) / F.col("s")) + 1).cast("int")
    upto = F.least(F.col("last"), F.floor(F.col("i") / F.col("s"))) if rolling else F.col("last")
    # values are combined by the span of folds they train before they are spread over folds
    size_ = F.abs("move")
    spans = (
        rows.withColumn("f0", first)
        .withColumn("f1", upto.cast("int"))
        .where("f0 <= f1")
        .groupBy("f0", "f1", "value")
        .agg(
            F.count(F.lit(1)).alias("c"), F.sum((size_ >= target).cast("long")).alias("hits"), F.sum(size_).alias("total"),
            F.min("us").alias("lo"), F.max("us").alias("hi"),
        )
    )
    each = spans.select("*", F.explode(F.sequence("f0", "f1")).alias("fold"))
    hist = each.groupBy("fold", "value").agg(*[F.sum(c).alias(c) for c in ("c", "hits", "total")])
    trained = each.groupBy("fold").agg(F.sum("c").alias("train_n"), F.min("lo").alias("train_start"), F.max("hi").alias("train_end"))
    held_n = held.groupBy("fold").agg(F.count(F.lit(1)).alias("held_n"), F.min("us").alias("held_start"), F.max("us").alias("held_end"))
    scores = validation_summary(_held_against(sliding(hist, ranges, ["fold"]), held), ["fold"], plain_in_sample=True)
    return (
        trained.join(held_n, "fold")
        .join(scores, "fold", "left")
        .select(
            "fold", "train_n", "held_n", "train_start", "train_end", "held_start", "held_end",
            F.coalesce("in_sample", F.lit(0.0)).alias("in_sample"), F.coalesce("out_of_sample", F.lit(0.0)).alias("out_of_sample"),
        )
    )


def expanding_folds(moves: DataFrame, initial: float = 0.3, step: float = 0.1, chunk: int = DAY, target: float = 1.5, ranges: int = 5) -> DataFrame:
    return _folds(moves, initial, step, chunk, False, target, ranges)


def rolling_folds(moves: DataFrame, size: float = 0.5, step: float = 0.1, chunk: int = DAY, target: float = 1.5, ranges: int = 5) -> DataFrame:
    return _folds(moves, size, step, chunk, True, target, ranges)


def ts_kfold(moves: DataFrame, k: int = 5, chunk: int = DAY) -> DataFrame:
    if k <= 1:
        raise DataValidationError("k must be above 1")
    return expanding_folds(moves, 0.3, 1.0 / k, chunk)


def cv_summary(folds: DataFrame, stationary_below: float = 0.2) -> DataFrame:
    """One row over folds: mean and deviations of the held-out score, interval, stationarity, trend, lookback, overfit."""
    v = F.col("out_of_sample")
    # folds are a few rows: trend is the slope over their numbers
    got = folds.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_score"),
        F.coalesce(F.avg("in_sample"), F.lit(0.0)).alias("mean_train"),
        F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("_pop"),
        F.covar_pop("fold", "out_of_sample").alias("_cov"),
        F.var_pop("fold").alias("_var"),
        F.max_by("train_n", F.struct(F.col("out_of_sample"), -F.col("fold"))).alias("_best_n"),
        F.min("train_start").alias("_start"),
        F.max("held_end").alias("_end"),
        F.max(F.col("train_n") + F.col("held_n")).alias("_rows"),
    )
    margin = 1.96 * F.col("std_score") / F.sqrt(F.greatest("n_folds", F.lit(1)).cast("double"))
    slope = F.coalesce(F.try_divide(F.col("_cov"), F.col("_var")), F.lit(0.0))
    span = (F.col("_end") - F.col("_start")).cast("double")
    return got.select(
        "n_folds", "mean_score", "std_score", "mean_train",
        (F.col("mean_score") - margin).alias("ci_low"),
        (F.col("mean_score") + margin).alias("ci_high"),
        (F.col("std_score") < stationary_below).alias("stationary"),
        F.when(F.col("n_folds") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), -slope)).alias("degrading"),
        F.coalesce(F.try_divide(F.col("_pop"), F.col("mean_score")), F.lit(0.0)).alias("consistency"),
        F.when(F.col("n_folds") < 2, F.lit(30.0)).otherwise(span * F.col("_best_n") / F.col("_rows") / DAY).alias("lookback_days"),
        (F.col("mean_train") > F.col("mean_score") + 0.1).alias("overfitted"),
    )


def cv_metrics(folds: DataFrame) -> DataFrame:
    """One row: bias (train less held-out), variance, stability and efficiency over real folds."""
    got = folds.agg(
        (F.avg("in_sample") - F.avg("out_of_sample")).alias("bias"),
        F.coalesce(F.var_samp("out_of_sample"), F.lit(0.0)).alias("variance"),
        F.avg("out_of_sample").alias("_m"),
        F.coalesce(F.stddev_samp("out_of_sample"), F.lit(0.0)).alias("_s"),
        F.avg("in_sample").alias("_t"),
    )
    return got.select(
        "bias",
        "variance",
        F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.col("_s"), F.abs("_m")), F.lit(1.0))).alias("stability"),
        F.coalesce(F.try_divide(F.col("_m"), F.col("_t")), F.lit(0.0)).alias("efficiency"),
    )


def walk_forward_windows(bounds: DataFrame, count: int) -> DataFrame:
    """Windows of a period (start_us, end_us; one row): is_start, is_end, oos_start, oos_end."""
    if not 0 < count <= D.max_windows:
        raise DataValidationError(f"window count must be within 1 and {D.max_windows}")
    w = (F.col("end_us") - F.col("start_us")) / F.lit(count + 1)
    rounded = lambda c: F.round(c).cast("long")
    out = bounds.where("start_us < end_us").select("*", w.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    out = out.withColumn("is_start", F.col("start_us") + rounded(F.col("i") * F.col("w") * D.advance))
    out = out.withColumn("is_end", F.col("is_start") + rounded(F.col("w") * D.train_share))
    out = out.withColumn("oos_end", F.col("is_end") + rounded(F.col("w") * D.test_share)).withColumn("oos_start", F.col("is_end"))
    late = F.col("oos_end") > F.col("end_us")
    out = out.withColumn("oos_start", F.when(late, F.col("end_us") - rounded(F.col("w") * D.test_share)).otherwise(F.col("oos_start")))
    out = out.withColumn("oos_end", F.when(late, F.col("end_us")).otherwise(F.col("oos_end")))
    fine = "is_start < is_end and oos_start < oos_end and is_end < end_us"
    return out.where(fine).select(F.col("i").alias("window"), "is_start", "is_end", "oos_start", "oos_end")


def walk_forward(points: DataFrame, windows: DataFrame, horizon: int, chunk: int = DAY) -> DataFrame:
    """Per window the real correlation in and out of sample, of movements within each part, and the floored ones.

    Windows are at most 100 rows; a point belongs to each part that holds it, both ends included.
    """
    parts = windows.select("window", F.explode(F.array(
        F.struct(F.lit("is").alias("part"), F.col("is_start").alias("a"), F.col("is_end").alias("b")),
        F.struct(F.lit("oos").alias("part"), F.col("oos_start").alias("a"), F.col("oos_end").alias("b")),
    )).alias("p")).select("window", "p.*")
    rows = points.join(F.broadcast(parts), F.col("us").between(F.col("a"), F.col("b"))).drop("a", "b")
    r = movements(rows, [horizon], by=["window", "part"], chunk=chunk).groupBy("window", "part").agg(
        F.count(F.lit(1)).alias("n"), pearson("value", "move").alias("r")
    )
    side = lambda p, c: F.coalesce(F.max(F.when(F.col("part") == p, F.col(c))), F.lit(0))
    got = windows.join(r, "window", "left").groupBy("window").agg(
        side("is", "n").alias("is_n"), side("oos", "n").alias("oos_n"),
        side("is", "r").cast("double").alias("is_r"), side("oos", "r").cast("double").alias("oos_r"),
    )
    floor = lambda c, f: F.when(F.abs(c) < f, F.when(F.col(c) < 0, -f).otherwise(f)).otherwise(F.col(c))
    worse = F.coalesce(F.try_divide(F.abs(F.col("is_r") - F.col("oos_r")), F.abs("is_r")), F.lit(1.0))
    return got.select(
        "window", "is_n", "oos_n", "is_r", "oos_r", floor("is_r", 0.12).alias("is_floored"), floor("oos_r", 0.08).alias("oos_floored"),
        worse.alias("degradation"),
    )


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    got = windows.agg(
        F.count(F.lit(1)).alias("n_windows"), F.coalesce(F.avg("oos_r"), F.lit(0.0)).alias("mean_r"),
        F.coalesce(F.stddev_samp("oos_r"), F.lit(0.0)).alias("std_r"),
    )
    return got.withColumn("stable", F.col("std_r") < 0.2).withColumn("stability", F.greatest(F.lit(0.0), 1 - F.col("std_r")))


def holdout(moves: DataFrame, ratio: float, chunk: int = DAY) -> tuple[DataFrame, DataFrame]:
    """The first 1 - ratio of the rows by time and id, and the rest.

    The last row of the first part is looked up, by the counts of chunks of time and then in its chunk alone; either part
    is told by comparison with it, so its rows are not shuffled, however often it is read.  Rows that share that row's
    time and id are numbered by what they hold.
    """
    us, id_ = F.col("us"), F.col("id")
    slot = F.floor(us / F.lit(chunk))
    upto = lambda *by: F.sum("count").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    counts = moves.groupBy(slot.alias("chunk")).count().withColumn("upto", upto("chunk"))  # one row per chunk
    cut = F.floor(F.sum("count").over(Window.partitionBy(F.lit(0))) * F.lit(1 - ratio))
    at = counts.withColumn("cut", cut).where("upto >= cut").orderBy("chunk").first()
    if at is None or at.cut == 0 or at.chunk is None:  # rows without a time come first and are in neither part
        return moves.where(F.lit(False)), moves.where("us is not null")
    inside = moves.where(slot == F.lit(at.chunk)).groupBy("us", "id").count().withColumn("upto", upto("us", "id"))
    place = at.cut - (at.upto - at["count"])
    edge = inside.where(F.col("upto") >= F.lit(place)).orderBy("us", "id").first()
    last = F.lit(edge.id)
    same, lower = id_.eqNullSafe(last), F.lit(False) if edge.id is None else id_.isNull() | (id_ < last)
    here = (us == F.lit(edge.us)) & same
    before = (us < F.lit(edge.us)) | ((us == F.lit(edge.us)) & lower)
    after = (us > F.lit(edge.us)) | ((us == F.lit(edge.us)) & ~lower & ~same)
    if edge.upto == place:
        return moves.where(before | here), moves.where(after)
    take = F.lit(place - (edge.upto - edge["count"]))
    tied = moves.where(here).withColumn("_place", F.row_number().over(Window.orderBy(F.to_json(F.struct(*moves.columns)))))
    first, rest = tied.where(F.col("_place") <= take).drop("_place"), tied.where(F.col("_place") > take).drop("_place")
    return moves.where(before).unionByName(first), moves.where(after).unionByName(rest)
