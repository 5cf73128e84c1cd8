"""Boundary strategies on Spark ML: trees, clusters and local search, and their combination.

Models see the histogram of measurement values with row counts as weights
where the model allows it, so training data does not grow with the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import numbered
from ..schema import DAY, ConvergenceError, DataValidationError, InsufficientDataError, Objective
from .boundaries import evaluate, hill_climb, histogram, optimal_boundaries, splits_to_boundaries, training_validation, tree_splits
from .validation import holdout

EMPTY = "low double, high double, confidence double, expected double, n long, hit double"


#: Rows that a task reads in a step of a model over rows; a model keeps a row in some 100 bytes.
TASK_ROWS = 1_000_000


def spread(rows: DataFrame) -> DataFrame:
    """More than ``TASK_ROWS`` rows are dealt evenly, so that tasks get more and not larger as rows do."""
    n = rows.count()
    if n <= TASK_ROWS:
        return rows
    return rows.repartition(max(-(-n // TASK_ROWS), rows.sparkSession.sparkContext.defaultParallelism))


def clusters(moves: DataFrame, k: int = 3, seed: int = 7) -> DataFrame:
    """k-means on (value, move): centre, mean move, members, variance of the value and the range of 1.5 deviations around it."""
    if not 0 < k <= 50:
        raise DataValidationError("k must be within 1 and 50")
    points = VectorAssembler(inputCols=["value", "move"], outputCol="features").transform(spread(moves.select("value", "move")))
    model = KMeans(k=k, seed=seed, maxIter=40, initSteps=4, solver="block").fit(points)
    return _cluster_rows(model.transform(points).withColumnRenamed("prediction", "cluster"))


def _cluster_rows(rows: DataFrame) -> DataFrame:
    got = rows.groupBy("cluster").agg(
        F.avg("value").alias("center"), F.avg("move").alias("avg_move"), F.count(F.lit(1)).alias("n"),
        F.var_pop("value").alias("variance"),
    )
    spread = 1.5 * F.sqrt("variance")
    return got.withColumn("low", F.greatest(F.lit(0.0), F.col("center") - spread)).withColumn("high", F.col("center") + spread)


def cluster_chunks(moves: DataFrame, k: int) -> DataFrame:
    """The fallback: k runs of equally many rows in order of value, the last with the rest."""
    placed = numbered(moves.select("value", "move", "id"), "value", ["id"], 1)
    size = F.greatest(F.lit(1), F.floor(F.col("n") / k))
    return _cluster_rows(placed.withColumn("cluster", F.least(F.floor((F.col("rn") - 1) / size), F.lit(k - 1)).cast("int")).drop("n"))


def tree_thresholds(moves: DataFrame, target: float, depth: int = 5, leaf: int = 10) -> list[float]:
    """Split values of an entropy tree that tells |move| >= target from the rest, in rising order."""
    hist = histogram(moves, target)
    cases = hist.select("value", F.lit(1.0).alias("label"), F.col("hits").cast("double").alias("w")).unionByName(
        hist.select("value", F.lit(0.0).alias("label"), (F.col("c") - F.col("hits")).cast("double").alias("w"))
    )
    data = VectorAssembler(inputCols=["value"], outputCol="features").transform(cases.where("w > 0"))
    tree = DecisionTreeClassifier(maxDepth=depth, impurity="entropy", weightCol="w", minWeightFractionPerNode=0.0, maxBins=64).fit(data)
    found: set[float] = set()

    def walk(node) -> None:
        if node.subtreeDepth() > 0:
            found.add(node.split().threshold())
            walk(node.leftChild())
            walk(node.rightChild())

    walk(tree._java_obj.rootNode())
    return sorted(found)


def tree_strategy(moves: DataFrame, target: float, depth: int = 5, leaf: int = 10) -> DataFrame:
    """Ranges between neighbouring tree splits with ``leaf`` rows or more and hits above 0.1."""
    problem = training_validation(moves, target, 4 * leaf).first()
    if problem.problem:
        raise InsufficientDataError(problem.problem)
    ends = moves.agg(F.min("value"), F.max("value")).first()
    edges = [ends[0], *tree_thresholds(moves, target, depth, leaf), ends[1] + 1e-9]
    splits = moves.sparkSession.createDataFrame([(float(e),) for e in edges], "split double")
    found = splits_to_boundaries(moves, splits, target, leaf).where("hit > 0.1")
    confidence = (F.least(F.lit(1.0), F.col("n") / 100) + F.greatest(F.col("hit"), F.lit(0.5))) / 2
    return found.withColumn("confidence", confidence).select("low", "high", "confidence", "expected", "n", "hit")


def cluster_strategy(moves: DataFrame, target: float, k: int = 5, seed: int = 7) -> DataFrame:
    """Ranges of 1-D clusters of the measurement with hits above 0.1."""
    hist = histogram(moves, target)
    total = hist.agg(F.sum("c")).first()[0] or 0
    if total < 5 * k:
        raise InsufficientDataError(f"{total} rows are too few for {k} clusters")
    k = max(2, min(k, 10, total // 5))
    data = VectorAssembler(inputCols=["value"], outputCol="features").transform(hist)
    model = KMeans(k=k, seed=seed, weightCol="c").fit(data)
    centers = [float(c[0]) for c in model.clusterCenters()]
    center = F.get(F.array(*[F.lit(c) for c in centers]), F.col("prediction"))
    got = (
        model.transform(data)
        .withColumn("_d", F.abs(F.col("value") - center) * F.col("c"))
        .groupBy("prediction")
        .agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.sum("c").alias("n"),
            (F.sum("hits") / F.sum("c")).alias("hit"), (F.sum("total") / F.sum("c")).alias("expected"), (F.sum("_d") / F.sum("c")).alias("_d"),
        )
    )
    density = F.col("n") / F.greatest(F.col("high") - F.col("low"), F.lit(1.0))
    confidence = (
        0.4 * F.least(F.lit(1.0), F.col("n") / 50)
        + 0.3 * F.least(F.lit(1.0), 2 * F.col("hit"))
        + 0.2 * F.greatest(F.lit(0.1), 1 / (1 + F.col("_d")))
        + 0.1 * F.least(F.lit(1.0), density / 10)
    )
    return got.where("hit > 0.1").withColumn("confidence", confidence).select("low", "high", "confidence", "expected", "n", "hit")


def search_strategy(moves: DataFrame, target: float, starts: int = 5) -> DataFrame:
    """Local search for the hit rate from overlapping starts over the value range; of overlapping results the better stays.

    The compatible numeric gradient of a step function is 0 almost everywhere;
    unit steps of the same objective are used instead.
    """
    n, lo, hi = moves.agg(F.count(F.lit(1)), F.min("value"), F.max("value")).first()
    count = max(1, min(starts, n // 20))
    width = (hi - lo) / count if hi > lo else 1.0
    found = []
    for i in range(count):  # at most five starts; each reads the histogram once
        start = (float(round(lo + i * width * 0.8)), float(round(lo + i * width * 0.8 + max(2.0, width))))
        try:
            r = hill_climb(moves, Objective.LARGE_MOVE, start, target)
        except ConvergenceError:
            continue
        if r["value"] > 0.1:
            found.append(r)
    kept: list[dict] = []
    for r in sorted(found, key=lambda r: -r["value"]):
        if all(r["high"] < o["low"] or r["low"] > o["high"] for o in kept):
            kept.append(r)
    spark = moves.sparkSession
    ranges = spark.createDataFrame([(r["low"], r["high"]) for r in kept], "low double, high double")
    got = (
        histogram(moves, target)
        .join(F.broadcast(ranges), F.col("value").between(F.col("low"), F.col("high")))
        .groupBy("low", "high")
        .agg(F.sum("c").alias("n"), (F.sum("hits") / F.sum("c")).alias("hit"), (F.sum("total") / F.sum("c")).alias("expected"))
    )
    return got.withColumn("confidence", F.col("hit") * F.least(F.lit(1.0), F.col("n") / 30)).select("low", "high", "confidence", "expected", "n", "hit")


STRATEGIES = {"decisiontree": tree_strategy, "clustering": cluster_strategy, "gradientsearch": search_strategy}


def strategy(name: str):
    """By name, in any case."""
    if (found := STRATEGIES.get(name.lower())) is None:
        raise DataValidationError(f"no strategy {name}")
    return found


def combined_optimization(moves: DataFrame, target: float, names: list[str], ratio: float = 0.2, chunk: int = DAY) -> DataFrame:
    """Every strategy's ranges, found on the first rows by time and scored on the rest; the best strategy is marked.

    A strategy that lacks the rows it needs is left out; of equal scores the strategy named first is the best.
    """
    train, held = holdout(moves, ratio, chunk)
    parts = []
    for place, name in enumerate(names):
        try:
            got = strategy(name)(train, target)
            score = evaluate(got, held, target).select("score")
            parts.append(got.crossJoin(F.broadcast(score)).withColumn("strategy", F.lit(name)).withColumn("_place", F.lit(place)))  # one row
        except InsufficientDataError:
            continue
    if not parts:
        empty = moves.sparkSession.createDataFrame([], EMPTY)
        return empty.withColumn("score", F.lit(0.0)).withColumn("strategy", F.lit("")).withColumn("best", F.lit(False))
    all_ = reduce(DataFrame.unionByName, parts)
    first = F.max_by("_place", F.struct("score", -F.col("_place"))).over(Window.partitionBy(F.lit(0)))  # a few dozen rows
    return all_.withColumn("best", F.col("_place") == first).drop("_place")


def tiered_optimization(moves: DataFrame, k: int = 5) -> DataFrame:
    """Sliding ranges at target 2; from 100 rows the best of tree, clusters (over 200) and search (over 500) if it finds any."""
    n = moves.count()
    slid = optimal_boundaries(moves, 2.0, k).select("low", "high", "confidence", "expected", "n", "hit")
    if n < 100:
        return slid.withColumn("method", F.lit("SlidingWindow"))
    names = ["DecisionTree"] + ["Clustering"] * (n > 200) + ["GradientSearch"] * (n > 500)
    best = combined_optimization(moves, 2.0, names).where("best")
    if best.isEmpty():
        return slid.withColumn("method", F.lit("SlidingWindow"))
    return best.select("low", "high", "confidence", "expected", "n", "hit", F.col("strategy").alias("method"))


def split_boundaries(moves: DataFrame, target: float, depth: int = 5) -> DataFrame:
    return splits_to_boundaries(moves, tree_splits(moves, depth), target)
