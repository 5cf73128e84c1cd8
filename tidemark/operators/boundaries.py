"""Boundary discovery and evaluation on movements.

Movements are first combined by measurement value (and group): candidate ranges
are then tried against that histogram, not against rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import numbered, order_statistics, positional
from ..schema import DAY, DataValidationError, Objective
from ..schema import DEFAULTS as D

CELLS = 15


def histogram(moves: DataFrame, target: float, by: list[str] | None = None) -> DataFrame:
    """Per (group and) measurement value: rows, those of |move| >= target, sum of |move|."""
    size = F.abs("move")
    return moves.groupBy(*(by or []), "value").agg(
        F.count(F.lit(1)).alias("c"), F.sum((size >= target).cast("long")).alias("hits"), F.sum(size).alias("total")
    )


def grid(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Candidate ranges (low, high) on a grid of 15 steps, two steps wide or more; a step is 1 at least."""
    span = F.col("hi") - F.col("lo")
    wide = span >= CELLS
    edge = lambda i: F.col("lo") + F.when(wide, F.col(i) * span / CELLS).otherwise(F.col(i).cast("double"))
    ends = values.groupBy(*(by or [])).agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo is not null")
    cells = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 2)))
    upper = F.explode(F.sequence(F.col("i") + 2, F.lit(CELLS)))
    return (
        ends.select("*", cells.alias("i"))
        .select("*", upper.alias("j"))
        .where(wide | (F.col("j") <= span + 1e-9))
        .select(*(by or []), edge("i").alias("low"), edge("j").alias("high"))
    )


def over_ranges(hist: DataFrame, ranges: DataFrame, by: list[str] | None = None, sums: tuple[str, ...] = ("c", "hits", "total")) -> DataFrame:
    """``ranges`` with the sums of the histogram rows inside, both ends included; at most 105 ranges a group."""
    keys = by or []
    joined = hist.join(ranges, keys) if keys else hist.join(F.broadcast(ranges))
    inside = joined.where(F.col("value").between(F.col("low"), F.col("high")))
    return inside.groupBy(*keys, "low", "high").agg(*[F.sum(s).alias(s) for s in sums])


def sliding(hist: DataFrame, k: int, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """The k best ranges of (each group of) a histogram by confidence = hit rate * sqrt(n) / 3; ties by low, high."""
    if not 0 < k <= D.max_ranges:
        raise DataValidationError(f"k must be within 1 and {D.max_ranges}")
    keys = by or []
    found = over_ranges(hist, grid(hist, by), by).where(F.col("c") >= least)
    hit = F.col("hits") / F.col("c")
    scored = found.select(
        *keys, "low", "high",
        (hit * F.sqrt(F.col("c").cast("double")) / 3).alias("confidence"),
        (F.col("total") / F.col("c")).alias("expected"),
        F.col("c").alias("n"),
        hit.alias("hit"),
    )
    best = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(F.round("confidence", 12)), "low", "high")
    return scored.withColumn("ord", F.row_number().over(best)).where(F.col("ord") <= k)


def optimal_boundaries(moves: DataFrame, target: float, k: int = 5, by: list[str] | None = None) -> DataFrame:
    return sliding(histogram(moves, target, by), k, by)


# ---- splits ----


def gap_splits(moves: DataFrame, least: float = 5.0) -> DataFrame:
    """Midpoints of gaps of more than ``least`` between neighbouring measurement values.

    Values are combined first; a gap inside a cell of the value axis comes from
    lag, one between cells from the cells' ends.
    """
    values = moves.select("value").distinct().withColumn("_cell", F.floor(F.col("value") / F.lit(100.0)))
    ends = values.groupBy("_cell").agg(F.max("value").alias("_hi"))
    before = ends.select("_cell", F.lag("_hi").over(Window.orderBy("_cell")).alias("_before"))
    inside = values.withColumn("_prev", F.lag("value").over(Window.partitionBy("_cell").orderBy("value")))
    prev = F.coalesce("_prev", "_before")
    return (
        inside.join(before, "_cell")
        .withColumn("_p", prev)
        .where(F.col("value") - F.col("_p") > least)
        .select(((F.col("value") + F.col("_p")) / 2).alias("split"))
    )


def behavior_splits(moves: DataFrame, change: float = 1.0) -> DataFrame:
    """Midpoints where the mean move of the w rows before and the w rows from here differ by more than ``change``.

    Rows are ordered by value, ties by id; w is 2, less below 8 rows; below 4
    rows there are none.  Rows are numbered within cells of the value axis and
    see w rows of the neighbouring cells, so no task sorts all rows.
    """
    n = moves.agg(F.count(F.lit(1)).alias("_n"))
    rows = moves.select("value", "move", "id")
    placed = numbered(rows, "value", ["id"], 1).drop("n").crossJoin(F.broadcast(n))  # one row
    w = F.least(F.lit(2), F.floor(F.col("_n") / 4))
    # a row is the left end, or part of either window, of at most 2w places: each place collects its rows by number
    spread = placed.select(
        "value", "move", "rn", "_n", w.cast("int").alias("w"), F.explode(F.sequence(1 - w, w)).alias("d")
    ).withColumn("place", F.col("rn") + F.col("d"))
    at = spread.where("w > 0").groupBy("place", "w", "_n").agg(
        F.avg(F.when(F.col("rn") < F.col("place"), F.col("move"))).alias("left"),
        F.avg(F.when(F.col("rn") >= F.col("place"), F.col("move"))).alias("right"),
        F.max(F.when(F.col("rn") == F.col("place") - 1, F.col("value"))).alias("a"),
        F.max(F.when(F.col("rn") == F.col("place"), F.col("value"))).alias("b"),
    )
    inside = (F.col("place") > F.col("w")) & (F.col("place") <= F.col("_n") - F.col("w"))
    return at.where(inside & (F.abs(F.col("left") - F.col("right")) > change)).select(((F.col("a") + F.col("b")) / 2).alias("split"))


def tree_splits(moves: DataFrame, depth: int) -> DataFrame:
    """Gap splits if there are two or more (the first ``depth``), else also behaviour splits 5 or more away from them.

    More than ``depth`` are cut to those with the largest difference of mean
    move below and above.  Where neither finds any and there are more than 10
    rows, splits of a decision tree on |move| >= 1 stand in (see ``ml``).
    """
    if not 0 < depth <= D.max_depth:
        raise DataValidationError(f"depth must be within 1 and {D.max_depth}")
    gaps = [r.split for r in gap_splits(moves).orderBy("split").limit(depth).collect()]  # at most depth numbers
    spark = moves.sparkSession
    if len(gaps) >= 2:
        return spark.createDataFrame([(g,) for g in gaps], "split double")
    behavior = behavior_splits(moves).distinct()
    for g in gaps:
        behavior = behavior.where(F.abs(F.col("split") - g) >= 5)
    splits = behavior.unionByName(spark.createDataFrame([(g,) for g in gaps], "split double")).distinct()
    if splits.isEmpty() and len(moves.limit(11).take(11)) > 10:
        from .ml import tree_thresholds  # ml imports this module

        splits = spark.createDataFrame([(float(t),) for t in tree_thresholds(moves, 1.0, depth)], "split double")
    hist = moves.groupBy("value").agg(F.sum("move").alias("s"), F.count(F.lit(1)).alias("c"))
    all_ = hist.agg(F.sum("s").alias("_s"), F.sum("c").alias("_c"))
    upto = Window.partitionBy(F.lit(0)).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    # the sums below a split are those of the last value below it; splits lie between values, so they join by the value before
    sums = hist.select("value", F.sum("s").over(upto).alias("sb"), F.sum("c").over(upto).alias("cb"))
    scored = (
        splits.join(sums, F.col("value") < F.col("split"))
        .groupBy("split")
        .agg(F.max_by(F.struct("sb", "cb"), "value").alias("b"))
        .crossJoin(F.broadcast(all_))  # one row
        .withColumn("score", F.abs(F.col("b.sb") / F.col("b.cb") - F.coalesce(F.try_divide(F.col("_s") - F.col("b.sb"), F.col("_c") - F.col("b.cb")), F.lit(0.0))))
    )
    return scored.orderBy(F.desc("score"), "split").limit(depth).select("split")


def splits_to_boundaries(moves: DataFrame, splits: DataFrame, target: float, least: int = 3) -> DataFrame:
    """Half-open ranges between neighbouring splits with their hit rate; a handful of splits."""
    ranges = splits.distinct().select(
        F.col("split").alias("low"), F.lead("split").over(Window.partitionBy(F.lit(0)).orderBy("split")).alias("high")
    ).where("high is not null")
    return (
        histogram(moves, target)
        .join(F.broadcast(ranges), (F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))
        .groupBy("low", "high")
        .agg(F.sum("c").alias("n"), (F.sum("hits") / F.sum("c")).alias("hit"), (F.sum("total") / F.sum("c")).alias("expected"))
        .where(F.col("n") >= least)
    )


# ---- evaluation ----


def _in_boundaries(hist: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Boundaries are at most max_ranges rows; a value may lie in several."""
    return hist.join(F.broadcast(boundaries), F.col("value").between(F.col("low"), F.col("high")))


def evaluate(boundaries: DataFrame, moves: DataFrame, target: float) -> DataFrame:
    """One row: the mean hit rate over boundaries that hold rows, plain and weighted by sqrt(n)."""
    per = _in_boundaries(histogram(moves, target), boundaries.select("low", "high")).groupBy("low", "high").agg(
        (F.sum("hits") / F.sum("c")).alias("hit"), F.sqrt(F.sum("c").cast("double")).alias("w")
    )
    return per.agg(
        F.coalesce(F.avg("hit"), F.lit(0.0)).alias("score"),
        F.coalesce(F.try_divide(F.sum(F.col("hit") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("weighted_score"),
    )


def validate(boundaries: DataFrame, moves: DataFrame) -> DataFrame:
    """Per boundary: hit rate then and now (|move| >= its expected move), degradation, stability."""
    b = boundaries.select("low", "high", "expected", "n", "hit")
    now = (
        moves.join(F.broadcast(b.select("low", "high", "expected")), F.col("value").between(F.col("low"), F.col("high")))
        .groupBy("low", "high")
        .agg(F.avg((F.abs("move") >= F.col("expected")).cast("double")).alias("oos_hit"))
    )
    out = b.join(now, ["low", "high"], "left").withColumn("oos_hit", F.coalesce("oos_hit", F.lit(0.0)))
    worse = F.when(F.col("hit") > 0, F.abs(F.col("hit") - F.col("oos_hit")) / F.col("hit")).otherwise(1.0)
    return out.withColumn("degradation", worse).withColumn("stable", F.col("degradation") < D.degradation).withColumn(
        "stability", F.greatest(F.lit(0.0), 1 - F.col("degradation"))
    )


def validation_summary(per: DataFrame, by: list[str] | None = None, plain_in_sample: bool = False) -> DataFrame:
    """Performance in and out of sample, weighted by sqrt(n), and whether it is overfitted (degradation above 0.5)."""
    w = F.sqrt(F.col("n").cast("double"))
    inside = F.avg("hit") if plain_in_sample else F.sum(F.col("hit") * w) / F.sum(w)
    out = (per.groupBy(*by) if by else per.groupBy()).agg(
        F.coalesce(inside, F.lit(0.0)).alias("in_sample"),
        F.coalesce(F.sum(F.col("oos_hit") * w) / F.sum(w), F.lit(0.0)).alias("out_of_sample"),
        F.coalesce(F.avg(F.col("stable").cast("double")), F.lit(0.0)).alias("stable_share"),
        F.count(F.lit(1)).alias("n_boundaries"),
    )
    d = F.when(F.col("in_sample") > 0, F.abs(F.col("in_sample") - F.col("out_of_sample")) / F.col("in_sample")).otherwise(1.0)
    return out.withColumn("degradation", d).withColumn("overfitted", F.col("degradation") > 0.5)


def training_validation(moves: DataFrame, target: float, least: int = 40) -> DataFrame:
    """One row: rows, distinct values, rows at the target, and the first reason not to train on them, or null."""
    got = moves.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"), F.sum((F.abs("move") >= target).cast("long")).alias("n_hits")
    )
    problem = (
        F.when(F.col("n") < least, "too few rows")
        .when(F.col("n_values") == 1, "one value only")
        .when(F.col("n_values") < 3, "too few values")
        .when((F.col("n_hits") == 0) | (F.col("n_hits") == F.col("n")), "one class only")
    )
    return got.withColumn("problem", problem)


# ---- windows, objectives, Pareto ----


def dynamic_boundaries(moves: DataFrame, size: int, step: int, chunk: int = DAY, target: float = 1.5) -> DataFrame:
    """Best sliding range of each window of ``size`` rows by time; regime change and stability against the window before."""
    placed = numbered(moves, "us", ["id"], chunk)
    # window s holds rows s * step + 1 ... s * step + size
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - size) / step)).cast("long")
    last = F.least(F.floor((F.col("rn") - 1) / step), F.floor((F.col("n") - size) / step)).cast("long")
    rows = placed.where((F.col("n") >= size) & (first <= last)).select(
        "us", "value", "move", "rn", F.explode(F.sequence(first, last)).alias("window")
    )
    ends = rows.groupBy("window").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    best = sliding(histogram(rows, target, ["window"]), 1, ["window"]).select("window", "low", "high", "confidence")
    before = Window.partitionBy(F.lit(0)).orderBy("window")  # one row a window
    lo, hi = F.lag("low").over(before), F.lag("high").over(before)
    moved = F.abs(F.col("low") - lo) + F.abs(F.col("high") - hi)
    width = (F.col("high") - F.col("low") + hi - lo) / 2
    out = best.withColumn("_change", F.when(width > 0, moved / width))
    return out.join(ends, "window").select(
        "window", "start_us", "end_us", "low", "high", "confidence",
        F.coalesce(F.col("_change") > 0.5, F.lit(False)).alias("regime_change"),
        F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("_change")), F.lit(1.0)).alias("stability"),
    )


def objective_sums(moves: DataFrame, min_move: float) -> DataFrame:
    """The histogram from which all objectives follow."""
    size = F.abs("move")
    return moves.groupBy("value").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum((F.col("move") > 0).cast("long")).alias("wins"),
        F.sum((size >= min_move).cast("long")).alias("hits"),
        F.sum(size).alias("total"),
        F.sum(size * size).alias("squares"),
    )


OBJECTIVE_SUMS = ("c", "wins", "hits", "total", "squares")


def objective(kind: Objective) -> Column:
    """Of the sums over a range."""
    c = F.col("c")
    mean = F.col("total") / c
    if kind is Objective.HIGHEST_WIN_RATE:
        return F.col("wins") / c
    if kind is Objective.LARGE_MOVE:
        return F.col("hits") / c
    if kind is Objective.CONSISTENT:
        return 1.0 / (1.0 + F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / c - mean * mean)))
    return mean


def objective_values(moves: DataFrame, ranges: DataFrame, min_move: float, kinds: list[Objective] | None = None) -> DataFrame:
    """Every range with the value of each objective; 0 where it holds no row.  ``ranges`` is a request's list, at most hundreds."""
    kinds = kinds or list(Objective)
    sums = over_ranges(objective_sums(moves, min_move), ranges.select("low", "high").distinct(), sums=OBJECTIVE_SUMS)
    scored = sums.select("low", "high", *[objective(k).alias(k.value) for k in kinds])
    return ranges.join(scored, ["low", "high"], "left").select(
        *ranges.columns, *[F.coalesce(k.value, F.lit(0.0)).alias(k.value) for k in kinds]
    )


def quantile_ranges(moves: DataFrame) -> DataFrame:
    """The tertile ranges and the inner quartile range of the measurement: one row each."""
    at = order_statistics(
        moves, "value", {"lo": positional(0.0), "t1": positional(0.33), "t2": positional(0.66), "hi": lambda n: n - 1, "q1": positional(0.25), "q3": positional(0.75)}
    )
    return at.select(F.inline(F.array(*[F.struct(F.col(a).alias("low"), F.col(b).alias("high")) for a, b in (("lo", "t1"), ("t1", "t2"), ("t2", "hi"), ("q1", "q3"))])))


def pareto_candidates(moves: DataFrame) -> DataFrame:
    """The three best sliding ranges for targets 1, 1.5 and 2, and the quantile ranges with five rows or more."""
    slid = None
    for t in (1.0, 1.5, 2.0):
        part = optimal_boundaries(moves, t, 3).select("low", "high")
        slid = part if slid is None else slid.unionByName(part)
    held = over_ranges(histogram(moves, 1.5), quantile_ranges(moves).distinct()).where("c >= 5").select("low", "high")
    return slid.unionByName(held).distinct()


def pareto_front(candidates: DataFrame, moves: DataFrame, objectives: list[tuple[Objective, float]], min_move: float, top: int = 10) -> DataFrame:
    """Candidates that no other beats, by sum of weighted objectives; candidates are a few dozen rows."""
    names = [k.value for k, _ in objectives]
    scored = objective_values(moves, candidates, min_move, [k for k, _ in objectives])
    scored = scored.select("low", "high", *[F.round(F.col(k.value) * w, 9).alias(k.value) for k, w in objectives])
    other = F.broadcast(scored.select(*[F.col(c).alias(f"o_{c}") for c in scored.columns]))
    no_worse, better = F.lit(True), F.lit(False)
    for n in names:
        no_worse, better = no_worse & (F.col(f"o_{n}") >= F.col(n)), better | (F.col(f"o_{n}") > F.col(n))
    front = scored.join(other, no_worse & better, "left_anti")
    return front.withColumn("total", sum(F.col(n) for n in names)).orderBy(F.desc("total"), "low", "high").limit(top)


def hill_climb(moves: DataFrame, kind: Objective, start: tuple[float, float], min_move: float = 1.0) -> dict:
    """Unit steps of either end, or both, to the best neighbour until the gain is below the threshold.

    The histogram is reduced once to unit cells of the value axis around which
    the ends move, and kept on the driver; its size is the span of the
    measurement in units.  Raises if it does not converge.
    """
    from ..schema import ConvergenceError

    base = start[0] - int(start[0])
    # ends stand on base + integers: a value on an end is told apart from those inside a cell
    side = F.col("value") - F.lit(base)
    cell = F.when(side == F.floor(side), F.floor(side) * 2).otherwise(F.floor(side) * 2 + 1).cast("long")
    sums = objective_sums(moves, min_move).withColumn("cell", cell).groupBy("cell").agg(*[F.sum(s).alias(s) for s in OBJECTIVE_SUMS])
    cells = {r.cell: tuple(r[s] for s in OBJECTIVE_SUMS) for r in sums.collect()}  # one row per half unit of the value axis
    if not cells:
        return {"low": 0.0, "high": 0.0, "value": 0.0, "iterations": 0, "converged": False}
    keys = sorted(cells)
    run, acc = {keys[0] - 1: (0,) * 5}, [0.0] * 5
    for k in range(keys[0], keys[-1] + 1):
        acc = [a + b for a, b in zip(acc, cells.get(k, (0,) * 5), strict=True)]
        run[k] = tuple(acc)

    def value(low: float, high: float) -> float:
        a, b = round((low - base) * 2) - 1, round((high - base) * 2)
        clip = lambda k: run[max(keys[0] - 1, min(keys[-1], k))]
        c, wins, hits, total, squares = (y - x for x, y in zip(clip(a), clip(b), strict=True))
        if not c:
            return 0.0
        if kind is Objective.HIGHEST_WIN_RATE:
            return wins / c
        if kind is Objective.LARGE_MOVE:
            return hits / c
        if kind is Objective.CONSISTENT:
            return 1 / (1 + max(0.0, squares / c - (total / c) ** 2) ** 0.5)
        return total / c

    low, high = (float(x) for x in start)
    if (high - base) != int(high - base):
        high = base + round(high - base)
    now = value(low, high)
    for i in range(D.max_iterations):
        steps = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, 1), (1, -1)]
        options = [(value(low + a, high + b), -k, low + a, high + b) for k, (a, b) in enumerate(steps) if low + a < high + b]
        best = max(options)
        if best[0] <= now or best[0] - now < D.convergence:
            return {"low": low, "high": high, "value": now, "iterations": i, "converged": True}
        now, _, low, high = best
    raise ConvergenceError(f"{kind.value}: no convergence in {D.max_iterations} iterations")
