"""Statistical expressions over columns; none needs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULTS

# Two-tailed critical values of Student's t at 5 % by degrees of freedom.
T_CRITICAL = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    15: 2.131, 20: 2.086, 25: 2.060, 30: 2.042, 40: 2.021, 50: 2.009, 60: 2.000, 80: 1.990, 100: 1.984,
}
# Abramowitz and Stegun 7.1.26, p and the coefficients from the first power on.
ERF_P = 0.3275911
ERF = [0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]


def normal_cdf(x: Column) -> Column:
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    half = 0.5 * (1 - poly * F.exp(-z * z))
    return F.when(x < 0, 0.5 - half).otherwise(0.5 + half)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written once into the expression, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def t_p_value(t: Column, df: Column) -> Column:
    """Stepwise two-tailed p of |t|: normal from 100 degrees on, else steps around the nearest tabled critical value."""
    keys = sorted(T_CRITICAL)
    upto = [(a + b) / 2 for a, b in zip(keys, keys[1:], strict=False)] + [float("inf")]  # a tie goes to the smaller
    table = F.array(*[F.struct(F.lit(u).alias("upto"), F.lit(T_CRITICAL[k]).alias("c")) for k, u in zip(keys, upto, strict=True)])

    def steps(x: Column) -> Column:
        t, df, c = x["t"], x["df"], x["c"]
        near = (
            F.when(t >= c * 2, 0.001)
            .when(t >= c * 1.5, 0.01)
            .when(t >= c, 0.05)
            .when(t >= c * 0.8, 0.10)
            .when(t >= c * 0.6, 0.20)
            .otherwise(F.least(F.lit(1.0), 0.20 + 0.80 * (1 - t / (c * 0.6))))
        )
        return F.when(df < 1, F.lit(1.0)).when(df >= 100, 2 * (1 - normal_cdf(t))).otherwise(near)

    found = lambda d: F.get(F.filter(table, lambda k: d <= k["upto"]), F.lit(0))["c"]
    first = bound(df.cast("double"), lambda d: F.struct(d.alias("df"), found(d).alias("c")))
    return bound(F.struct(t.alias("t"), first["df"].alias("df"), first["c"].alias("c")), steps)


def z_critical(level: float, corrected: bool = False) -> float:
    """By binary arithmetic 1 - 0.95 lies above 0.05 and selects 1.645; ``corrected`` gives 1.96."""
    a = 1 - level - (1e-12 if corrected else 0)
    return 2.576 if a <= 0.01 else 1.96 if a <= 0.05 else 1.645


def significance(r: Column, n: Column, corrected: bool = False) -> Column:
    """Struct of p_value, t_stat, df, std_error, ci_low, ci_high and significant of a correlation r of n pairs."""
    d = DEFAULTS
    z = z_critical(d.confidence_level, corrected)
    back = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.exp(2 * v) - 1) / (F.exp(2 * v) + 1)))

    def of(x: Column) -> Column:
        r, n = x["r"], x["n"]
        few, full = n < 3, F.abs(r) >= 0.99999
        strong = F.abs(r) > d.minimum_correlation

        def pick(of_few: Column, of_full: Column, usual: Column) -> Column:
            return F.when(few, of_few).when(full, of_full).otherwise(usual)

        return F.struct(
            pick(F.lit(1.0), F.lit(0.0001), x["p"]).alias("p_value"),
            pick(F.lit(0.0), F.signum(r) * 100, x["t"]).alias("t_stat"),
            F.greatest(n - 2, F.lit(0)).alias("df"),
            pick(F.lit(None).cast("double"), F.lit(0.001), x["se"]).alias("std_error"),
            pick(F.lit(0.0), r - 0.001, F.when(n < 4, F.greatest(F.lit(-1.0), r - 0.5)).otherwise(back(x["z"] - x["m"]))).alias("ci_low"),
            pick(F.lit(0.0), r + 0.001, F.when(n < 4, F.least(F.lit(1.0), r + 0.5)).otherwise(back(x["z"] + x["m"]))).alias("ci_high"),
            pick(F.lit(False), strong, (x["p"] < d.alpha) & strong).alias("significant"),
        )

    def tested(x: Column) -> Column:
        return F.struct(
            x["r"].alias("r"), x["n"].alias("n"), x["se"].alias("se"), x["t"].alias("t"),
            t_p_value(F.abs(x["t"]), x["n"] - 2).alias("p"),
            (0.5 * F.ln((1 + x["safe"]) / (1 - x["safe"]))).alias("z"),
            (F.lit(z) / F.sqrt(F.greatest(x["n"] - 3, F.lit(1)))).alias("m"),
        )

    def erred(x: Column) -> Column:
        se = F.sqrt((1 - x["safe"] * x["safe"]) / F.greatest(x["n"] - 2, F.lit(1)))
        return F.struct(x["r"].alias("r"), x["n"].alias("n"), x["safe"].alias("safe"), se.alias("se"), (x["safe"] / se).alias("t"))

    safe = F.when((n < 3) | (F.abs(r) >= 0.99999), F.lit(0.0)).otherwise(r)
    start = F.struct(r.alias("r"), n.alias("n"), safe.alias("safe"))
    return bound(bound(bound(start, erred), tested), of)


def pearson(x: str | Column, y: str | Column) -> Column:
    """0 where either side is constant; unlike corr() it never divides by zero."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.coalesce(r, F.lit(0.0))


def strength(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(a >= 0.8, "Very Strong").when(a >= 0.6, "Strong").when(a >= 0.4, "Moderate").when(a >= 0.2, "Weak").otherwise("Very Weak")
    )


def significance_level(p: Column) -> Column:
    return (
        F.when(p < 0.001, "Highly Significant")
        .when(p < 0.01, "Very Significant")
        .when(p < 0.05, "Significant")
        .when(p < 0.10, "Marginally Significant")
        .otherwise("Not Significant")
    )


def order_statistics(df: DataFrame, column: str, ranks: dict[str, Callable[[Column], Column]], grid: int = 200) -> DataFrame:
    """One row: n and, by name, the value at a 0-based rank of the sorted column.

    A sketch of quantiles brackets each rank; rows outside the brackets are only
    counted, those inside are counted by value and walked through.  So no task
    sorts more than a few hundredths of the rows, and values that repeat are combined first.
    """
    points = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    sketch = df.agg(
        F.count(column).alias("n"), F.percentile_approx(column, points, 20 * grid).alias("_at"), F.min(column).alias("_lo"), F.max(column).alias("_hi")
    )
    for name, rank in ranks.items():
        r = F.greatest(F.lit(0), F.least(rank(F.col("n")), F.col("n") - 1)).cast("long")
        i = F.floor(r * grid / F.greatest("n", F.lit(1))).cast("int")
        sketch = sketch.withColumn(
            name,
            F.struct(
                r.alias("rank"),
                F.when(i < 1, F.col("_lo")).otherwise(F.get("_at", F.greatest(i - 1, F.lit(0)))).alias("lo"),
                F.when(i + 2 > grid, F.col("_hi")).otherwise(F.get("_at", F.least(i + 2, F.lit(grid)))).alias("hi"),
            ),
        )
    sketch = sketch.drop("_at", "_lo", "_hi")
    seen = df.select(F.col(column).alias("x")).where("x is not null").crossJoin(F.broadcast(sketch))  # one row
    below = seen.agg(*[F.sum((F.col("x") < F.col(f"{k}.lo")).cast("long")).alias(k) for k in ranks])
    inside = (
        seen.select(
            "x",
            F.explode(
                F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"{k}.rank").alias("rank"), F.col(f"{k}.lo").alias("lo"), F.col(f"{k}.hi").alias("hi")) for k in ranks])
            ).alias("b"),
        )
        .where("x between b.lo and b.hi")
        .groupBy("b.name", "b.rank", "x")
        .count()
    )
    walk = Window.partitionBy("name").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(*[F.when(F.col("name") == k, F.col(f"below.{k}")) for k in ranks])
    found = (
        inside.withColumn("upto", F.sum("count").over(walk))
        .crossJoin(F.broadcast(below.select(F.struct(*ranks).alias("below"))))
        .where((before + F.col("upto") > F.col("rank")) & (before + F.col("upto") - F.col("count") <= F.col("rank")))
        .agg(*[F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in ranks])
    )
    return sketch.select("n").crossJoin(F.broadcast(found))


def positional(p: float) -> Callable[[Column], Column]:
    """Rank of sorted[(int)(n * p)]."""
    return lambda n: F.floor(n * F.lit(p))


def median_of(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the mean of the two middle values."""
    both = order_statistics(df, column, {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2)})
    return both.select(((F.col("a") + F.col("b")) / 2).alias(name))


def numbered(df: DataFrame, us: str, ties: list[str], chunk_us: int) -> DataFrame:
    """``df`` plus rn, its 1-based place by time and ties, and n, the number of rows.

    Rows are numbered within chunks of time; a chunk's offset is the running
    sum of chunk counts, so only one row per chunk meets in one task.
    """
    cut = df.withColumn("_chunk", F.floor(F.col(us) / F.lit(chunk_us)))
    counts = cut.groupBy("_chunk").count()
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    offsets = counts.select("_chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_off"), F.sum("count").over(every).alias("n"))
    inside = Window.partitionBy("_chunk").orderBy(us, *ties)
    return (
        cut.withColumn("_in", F.row_number().over(inside))
        .join(offsets, "_chunk")
        .withColumn("rn", F.col("_off") + F.col("_in"))
        .drop("_chunk", "_off", "_in")
    )
