"""Queries: boundaries, validation, backtest, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import boundaries as bo
from ..operators import correlation as co
from ..operators import ml
from ..operators import movements as mv
from ..operators import reports as rp
from ..operators import validation as va
from ..schema import DAY, HOUR, MINUTE, CorrelationKind, Objective
from ..sources.adapters import event_points, line_moves, micros, read
from .registry import MOVES, POINTS, R, asof, p_value, query, rounded


def bounds(source: str, target: float, k: int, by: str = "", name: str = "b") -> str:
    """SQL: the k best sliding ranges of a table with value and move, per group ``by``."""
    g = f"{by}, " if by else ""
    on = f"s.{by} = g.{by} AND " if by else ""
    return f"""{name}_e AS (SELECT {g}min(value) AS lo, max(value) AS hi FROM {source} {f'GROUP BY {by}' if by else ''}),
{name}_g AS (SELECT {g}lo + CASE WHEN hi - lo >= 15 THEN i * (hi - lo) / 15 ELSE i END AS low, lo + CASE WHEN hi - lo >= 15 THEN j * (hi - lo) / 15 ELSE j END AS high
  FROM {name}_e, range(0, 14) x(i), range(2, 16) y(j) WHERE j >= i + 2 AND (hi - lo >= 15 OR j <= hi - lo + 1e-9)),
{name}_s AS (SELECT {'g.' + g if by else ''}low, high, count(*) AS n, avg(CAST(abs(move) >= {target} AS DOUBLE)) AS hit, avg(abs(move)) AS expected
  FROM {source} s JOIN {name}_g g ON {on}s.value BETWEEN low AND high GROUP BY ALL HAVING count(*) >= 3),
{name} AS (SELECT *, hit * sqrt(n) / 3 AS confidence FROM {name}_s
  QUALIFY row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY round(hit * sqrt(n) / 3, 12) DESC, low, high) <= {k}),
{name}o AS (SELECT *, row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY round(confidence, 12) DESC, low, high) AS ord FROM {name})"""


B = bounds("moves", 1.5, 5)
BOUNDARY = "round(low, 6) AS low, round(high, 6) AS high, round(confidence, 6) AS confidence, round(expected, 6) AS expected, n, round(hit, 6) AS hit"


def best(spark, d):
    return bo.optimal_boundaries(line_moves(spark, d), 1.5, 5)


@query("optimal_boundaries", f"WITH {MOVES}, {B} SELECT {BOUNDARY} FROM b")
def optimal_boundaries(spark, d):
    return rounded(best(spark, d).select("low", "high", "confidence", "expected", "n", "hit"))


@query(
    "narrow_boundaries",
    f"WITH moves AS (SELECT l_discount * 100 AS value, (l_extendedprice - 52500) / 30000 AS move FROM lineitem), {bounds('moves', 1.0, 4)} SELECT {BOUNDARY} FROM b",
)
def narrow_boundaries(spark, d):
    """The step is held at 1 where the measurement spans less than 15."""
    rows = read(spark, d, "lineitem").select((F.col("l_discount") * 100).alias("value"), ((F.col("l_extendedprice") - 52500) / 30000).alias("move"))
    return rounded(bo.optimal_boundaries(rows, 1.0, 4).select("low", "high", "confidence", "expected", "n", "hit"))


SPARSE = """m AS (SELECT id, us, round(price * 3) AS value, value / 25 - 2 AS move FROM points)"""


def sparse_moves(spark, d):
    """Movements with gaps in the measurement: thrice the price of events."""
    return event_points(spark, d).select("id", "us", F.round(F.col("price") * 3).alias("value"), (F.col("value") / 25 - 2).alias("move"))


@query(
    "gap_splits",
    f"WITH {POINTS}, {SPARSE}, v AS (SELECT DISTINCT value FROM m), g AS (SELECT value, lag(value) OVER (ORDER BY value) AS p FROM v) SELECT round((value + p) / 2, 6) AS split FROM g WHERE value - p > 5",
)
def gap_splits(spark, d):
    return rounded(bo.gap_splits(sparse_moves(spark, d)))


@query(
    "behavior_splits",
    f"""WITH {POINTS}, {SPARSE}, r AS (SELECT *, row_number() OVER (ORDER BY value, id) AS rn, count(*) OVER () AS n FROM m),
a AS (SELECT rn, n, value, lag(value) OVER w AS p, avg(move) OVER (ORDER BY rn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l, avg(move) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS r FROM r WINDOW w AS (ORDER BY rn))
SELECT round((value + p) / 2, 6) AS split FROM a WHERE rn > 2 AND rn <= n - 2 AND abs(l - r) > 1""",
)
def behavior_splits(spark, d):
    return rounded(bo.behavior_splits(sparse_moves(spark, d)))


@query(
    "tree_splits",
    f"WITH {POINTS}, {SPARSE}, v AS (SELECT DISTINCT value FROM m), g AS (SELECT value, lag(value) OVER (ORDER BY value) AS p FROM v) SELECT round((value + p) / 2, 6) AS split FROM g WHERE value - p > 5 ORDER BY split LIMIT 4",
)
def tree_splits(spark, d):
    return rounded(bo.tree_splits(sparse_moves(spark, d), 4))


@query(
    "splits_to_boundaries",
    f"""WITH {MOVES}, s AS (SELECT * FROM (VALUES (5.0, 12.5), (12.5, 30.0), (30.0, 44.0)) t(low, high))
SELECT low, high, count(*) AS n, round(avg(CAST(abs(move) >= 1.5 AS DOUBLE)), 6) AS hit, round(avg(abs(move)), 6) AS expected FROM s JOIN moves ON value >= low AND value < high GROUP BY low, high""",
)
def splits_to_boundaries(spark, d):
    splits = spark.createDataFrame([(5.0,), (12.5,), (30.0,), (44.0,)], "split double")
    return rounded(bo.splits_to_boundaries(line_moves(spark, d), splits, 1.5))


EVALUATED = "per AS (SELECT low, high, avg(CAST(abs(move) >= 1.5 AS DOUBLE)) AS h, sqrt(count(*)) AS w FROM b JOIN t ON value BETWEEN low AND high GROUP BY low, high)"
#: Rows to test on: those with return flag R.
TEST = "t AS (SELECT * FROM moves WHERE flag = 'R')"


def tested(spark, d):
    return line_moves(spark, d).where("flag = 'R'")


@query("evaluate_boundaries", f"WITH {MOVES}, {B}, {TEST}, {EVALUATED} SELECT round(avg(h), 6) AS score FROM per")
def evaluate_boundaries(spark, d):
    return rounded(bo.evaluate(best(spark, d), tested(spark, d), 1.5).select("score"))


@query("evaluate_boundaries_weighted", f"WITH {MOVES}, {B}, {TEST}, {EVALUATED} SELECT round(sum(h * w) / sum(w), 6) AS weighted_score FROM per")
def evaluate_boundaries_weighted(spark, d):
    return rounded(bo.evaluate(best(spark, d), tested(spark, d), 1.5).select("weighted_score"))


@query(
    "validate_boundaries",
    f"""WITH {MOVES}, {B}, {TEST}, v AS (SELECT low, high, any_value(b.n) AS n, any_value(hit) AS hit, coalesce(avg(CAST(abs(move) >= expected AS DOUBLE)), 0) AS oos_hit
  FROM b LEFT JOIN t ON value BETWEEN low AND high GROUP BY low, high), w AS (SELECT *, CASE WHEN hit > 0 THEN abs(hit - oos_hit) / hit ELSE 1 END AS degradation FROM v)
SELECT round(low, 6) AS low, round(high, 6) AS high, round(hit, 6) AS hit, round(oos_hit, 6) AS oos_hit, round(degradation, 6) AS degradation, degradation < 0.3 AS stable, round(greatest(0, 1 - degradation), 6) AS stability FROM w""",
)
def validate_boundaries(spark, d):
    return rounded(bo.validate(best(spark, d), tested(spark, d)).select("low", "high", "hit", "oos_hit", "degradation", "stable", "stability"))


@query(
    "training_validation",
    f"WITH {MOVES} SELECT count(*) AS n, count(DISTINCT value) AS n_values, count(*) FILTER (abs(move) >= 1.5) AS n_hits, CAST(NULL AS VARCHAR) AS problem FROM moves",
)
def training_validation(spark, d):
    return bo.training_validation(line_moves(spark, d), 1.5)


@query(
    "dynamic_boundaries",
    f"""WITH {MOVES}, r AS (SELECT *, row_number() OVER (ORDER BY us, id) AS rn, count(*) OVER () AS n FROM moves),
x AS (SELECT s AS "window", us, value, move FROM r JOIN range(0, 40) w(s) ON rn > s * (n // 20) AND rn <= s * (n // 20) + n // 10 AND s * (n // 20) + n // 10 <= n),
e AS (SELECT "window", min(us) AS start_us, max(us) AS end_us FROM x GROUP BY ALL), {bounds('x', 1.5, 1, '"window"')},
l AS (SELECT b.*, start_us, end_us, lag(low) OVER o AS pl, lag(high) OVER o AS ph FROM b JOIN e USING ("window") WINDOW o AS (ORDER BY "window")),
c AS (SELECT *, CASE WHEN (high - low + ph - pl) / 2 > 0 THEN (abs(low - pl) + abs(high - ph)) / ((high - low + ph - pl) / 2) END AS ch FROM l)
SELECT "window", start_us, end_us, round(low, 6) AS low, round(high, 6) AS high, round(confidence, 6) AS confidence, coalesce(ch > 0.5, false) AS regime_change, round(coalesce(greatest(0, 1 - ch), 1), 6) AS stability FROM c""",
)
def dynamic_boundaries(spark, d):
    moves = line_moves(spark, d)
    n = moves.count()
    return rounded(bo.dynamic_boundaries(moves, n // 10, n // 20))


OBJ = [(0.0, 20.0), (10.0, 40.0), (25.0, 50.0), (60.0, 70.0)]


@query(
    "objective_values",
    f"""WITH {MOVES}, r AS (SELECT * FROM (VALUES (0.0, 20.0), (10.0, 40.0), (25.0, 50.0), (60.0, 70.0)) t(low, high))
SELECT low, high, round(coalesce(avg(CAST(move > 0 AS DOUBLE)), 0), 6) AS HighestWinRate, round(coalesce(avg(CAST(abs(move) >= 1 AS DOUBLE)), 0), 6) AS LargeMoveProbability,
  round(coalesce(1 / (1 + stddev_pop(abs(move))), 0), 6) AS ConsistentResults, round(coalesce(avg(abs(move)), 0), 6) AS RiskAdjustedReturn
FROM r LEFT JOIN moves ON value BETWEEN low AND high GROUP BY low, high""",
)
def objective_values(spark, d):
    return rounded(bo.objective_values(line_moves(spark, d), spark.createDataFrame(OBJ, "low double, high double"), 1.0))


@query(
    "pareto_front",
    f"""WITH {MOVES}, {bounds('moves', 1.0, 3, name='x')}, {bounds('moves', 1.5, 3, name='y')}, {bounds('moves', 2.0, 3, name='z')},
q AS (SELECT list_sort(list(value)) AS v, count(*) AS k FROM moves), p AS (SELECT v[1] AS lo, v[CAST(floor(k * 0.33) AS BIGINT) + 1] AS t1, v[CAST(floor(k * 0.66) AS BIGINT) + 1] AS t2, v[k] AS hi, v[CAST(floor(k * 0.25) AS BIGINT) + 1] AS q1, v[CAST(floor(k * 0.75) AS BIGINT) + 1] AS q3 FROM q),
c AS (SELECT low, high FROM x UNION SELECT low, high FROM y UNION SELECT low, high FROM z UNION SELECT lo, t1 FROM p UNION SELECT t1, t2 FROM p UNION SELECT t2, hi FROM p UNION SELECT q1, q3 FROM p),
o AS (SELECT low, high, round(avg(CAST(move > 0 AS DOUBLE)), 9) AS a, round(0.5 * avg(CAST(abs(move) >= 1 AS DOUBLE)), 9) AS b FROM c JOIN moves ON value BETWEEN low AND high GROUP BY low, high HAVING count(*) >= 3)
SELECT round(low, 6) AS low, round(high, 6) AS high, round(a, 6) AS HighestWinRate, round(b, 6) AS LargeMoveProbability, round(a + b, 6) AS total FROM o
WHERE NOT EXISTS (SELECT 1 FROM o t WHERE t.a >= o.a AND t.b >= o.b AND (t.a > o.a OR t.b > o.b)) ORDER BY total DESC, low, high LIMIT 10""",
)
def pareto_front(spark, d):
    moves = line_moves(spark, d)
    front = bo.pareto_front(bo.pareto_candidates(moves), moves, [(Objective.HIGHEST_WIN_RATE, 1.0), (Objective.LARGE_MOVE, 0.5)], 1.0)
    return rounded(front)


@query("hill_climb")
def hill_climb(spark, d):
    moves = line_moves(spark, d)
    found = [(k.value, bo.hill_climb(moves, k, (10.0, 40.0))) for k in Objective]
    rows = [(k, r["low"], r["high"], float(r["value"]), r["iterations"], r["converged"]) for k, r in found]
    return spark.createDataFrame(rows, "objective string, low double, high double, value double, iterations int, converged boolean")


@query("clusters")
def clusters(spark, d):
    return ml.clusters(line_moves(spark, d), 3)


@query(
    "cluster_chunks",
    f"""WITH {MOVES}, r AS (SELECT *, row_number() OVER (ORDER BY value, id) - 1 AS i, count(*) OVER () AS n FROM moves), c AS (SELECT least(i // (n // 3), 2) AS cluster, value, move FROM r)
SELECT CAST(cluster AS INT) AS cluster, round(avg(value), 6) AS center, round(avg(move), 6) AS avg_move, count(*) AS n, round(var_pop(value), 6) AS variance,
  round(greatest(0, avg(value) - 1.5 * sqrt(var_pop(value))), 6) AS low, round(avg(value) + 1.5 * sqrt(var_pop(value)), 6) AS high FROM c GROUP BY cluster""",
)
def cluster_chunks(spark, d):
    return rounded(ml.cluster_chunks(line_moves(spark, d), 3))


@query("tree_strategy")
def tree_strategy(spark, d):
    return ml.tree_strategy(line_moves(spark, d), 1.5)


@query("cluster_strategy")
def cluster_strategy(spark, d):
    return ml.cluster_strategy(line_moves(spark, d), 1.5)


@query("search_strategy")
def search_strategy(spark, d):
    return ml.search_strategy(line_moves(spark, d), 1.5)


@query("combined_optimization")
def combined_optimization(spark, d):
    return ml.combined_optimization(line_moves(spark, d), 1.5, ["DecisionTree", "Clustering"])


@query("tiered_optimization")
def tiered_optimization(spark, d):
    return ml.tiered_optimization(line_moves(spark, d))


# ---- validation ----

#: Per fold: hit rates of ranges b on rows ``held`` and their summary.
FOLDED = """v AS (SELECT b.fold, low, high, any_value(b.n) AS n, any_value(b.hit) AS hit, coalesce(avg(CAST(abs(h.move) >= b.expected AS DOUBLE)), 0) AS oos
  FROM b LEFT JOIN held h ON h.fold = b.fold AND h.value BETWEEN low AND high GROUP BY b.fold, low, high),
f AS (SELECT fold, avg(hit) AS i, sum(oos * sqrt(n)) / sum(sqrt(n)) AS o, count(*) AS nb FROM v GROUP BY fold)"""


@query(
    "kfold",
    f"""WITH {MOVES}, held AS (SELECT *, CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 5 AS fold FROM moves),
tr AS (SELECT k.fold, h.value, h.move FROM range(0, 5) k(fold) JOIN held h ON h.fold <> k.fold), {bounds('tr', 1.5, 5, 'fold')}, {FOLDED}
SELECT CAST(fold AS INT) AS fold, round(i, 6) AS in_sample, round(o, 6) AS out_of_sample, round(CASE WHEN i > 0 THEN abs(i - o) / i ELSE 1 END, 6) AS degradation, CASE WHEN i > 0 THEN abs(i - o) / i ELSE 1 END > 0.5 AS overfitted, nb AS n_boundaries FROM f""",
)
def kfold(spark, d):
    return rounded(va.kfold(line_moves(spark, d)))


def folds_sql(initial: float, step: float, rolling: bool) -> str:
    start = "f * s" if rolling else "0"
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY us, id) - 1 AS i, count(*) OVER () AS n FROM moves),
p AS (SELECT CAST(floor(any_value(n) * {initial}) AS BIGINT) AS t, CAST(greatest(1, floor(any_value(n) * {step})) AS BIGINT) AS s, any_value(n) AS n FROM r),
w AS (SELECT f AS fold, t + f * s AS te, {start} AS ts, s FROM p, range(0, 100) x(f) WHERE t + f * s + s <= n),
tr AS (SELECT fold, value, move, us FROM w JOIN r ON i >= ts AND i < te), held AS (SELECT fold, value, move, us FROM w JOIN r ON i >= te AND i < te + s),
{bounds('tr', 1.5, 5, 'fold')}, {FOLDED},
folds AS (SELECT CAST(f.fold AS INT) AS fold, train_n, held_n, train_start, train_end, held_start, held_end, i AS in_sample, o AS out_of_sample FROM f
  JOIN (SELECT fold, count(*) AS train_n, min(us) AS train_start, max(us) AS train_end FROM tr GROUP BY fold) USING (fold)
  JOIN (SELECT fold, count(*) AS held_n, min(us) AS held_start, max(us) AS held_end FROM held GROUP BY fold) USING (fold))"""


FOLDS = "SELECT * REPLACE (round(in_sample, 6) AS in_sample, round(out_of_sample, 6) AS out_of_sample) FROM folds"


@query("expanding_folds", f"WITH {MOVES}, {folds_sql(0.3, 0.1, False)} {FOLDS}")
def expanding_folds(spark, d):
    return rounded(va.expanding_folds(line_moves(spark, d)))


@query("rolling_folds", f"WITH {MOVES}, {folds_sql(0.5, 0.1, True)} {FOLDS}")
def rolling_folds(spark, d):
    return rounded(va.rolling_folds(line_moves(spark, d)))


@query("ts_kfold", f"WITH {MOVES}, {folds_sql(0.3, 0.2, False)} {FOLDS}")
def ts_kfold(spark, d):
    return rounded(va.ts_kfold(line_moves(spark, d)))


@query(
    "cv_summary",
    f"""WITH {MOVES}, {folds_sql(0.3, 0.1, False)}, a AS (SELECT count(*) AS k, avg(out_of_sample) AS m, stddev_samp(out_of_sample) AS sd, avg(in_sample) AS tm, stddev_pop(out_of_sample) AS sp,
  covar_pop(fold, out_of_sample) / var_pop(fold) AS sl, max_by(train_n, (out_of_sample, -fold)) AS bn, min(train_start) AS st, max(held_end) AS en, max(train_n + held_n) AS rw FROM folds)
SELECT k AS n_folds, round(m, 6) AS mean_score, round(sd, 6) AS std_score, round(tm, 6) AS mean_train, round(m - 1.96 * sd / sqrt(k), 6) AS ci_low, round(m + 1.96 * sd / sqrt(k), 6) AS ci_high,
  sd < 0.2 AS stationary, round(greatest(0, -sl), 6) AS degrading, round(sp / m, 6) AS consistency, round(CAST(en - st AS DOUBLE) * bn / rw / {DAY}, 6) AS lookback_days, tm > m + 0.1 AS overfitted FROM a""",
)
def cv_summary(spark, d):
    return rounded(va.cv_summary(va.expanding_folds(line_moves(spark, d))))


@query(
    "cv_metrics",
    f"""WITH {MOVES}, {folds_sql(0.3, 0.1, False)} SELECT round(avg(in_sample) - avg(out_of_sample), 6) AS bias, round(var_samp(out_of_sample), 6) AS variance,
  round(greatest(0, 1 - stddev_samp(out_of_sample) / abs(avg(out_of_sample))), 6) AS stability, round(avg(out_of_sample) / avg(in_sample), 6) AS efficiency FROM folds""",
)
def cv_metrics(spark, d):
    return rounded(va.cv_metrics(va.expanding_folds(line_moves(spark, d))))


WINDOWS = """e AS (SELECT min(us) AS a, max(us) AS z, (max(us) - min(us)) / 6 AS w FROM points),
w1 AS (SELECT i AS "window", a, z, w, a + CAST(round(i * w * 0.8) AS BIGINT) AS is_start FROM e, range(0, 5) x(i)),
w2 AS (SELECT *, is_start + CAST(round(w * 0.6) AS BIGINT) AS is_end FROM w1), w3 AS (SELECT *, is_end + CAST(round(w * 0.4) AS BIGINT) AS oe FROM w2),
win AS (SELECT "window", is_start, is_end, CASE WHEN oe > z THEN z - CAST(round(w * 0.4) AS BIGINT) ELSE is_end END AS oos_start, least(oe, z) AS oos_end FROM w3 WHERE is_end < z)"""


def period(points):
    return points.agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@query("wf_windows", f'WITH {POINTS}, {WINDOWS} SELECT CAST("window" AS INT) AS "window", is_start, is_end, oos_start, oos_end FROM win')
def wf_windows(spark, d):
    return va.walk_forward_windows(period(event_points(spark, d)), 5)


@query(
    "walk_forward",
    f"""WITH {POINTS}, {WINDOWS}, x AS (SELECT p.*, 'i' || "window" AS part FROM points p JOIN win ON us BETWEEN is_start AND is_end UNION ALL SELECT p.*, 'o' || "window" FROM points p JOIN win ON us BETWEEN oos_start AND oos_end),
{asof(30 * MINUTE, 'part', 'x')}, s AS (SELECT part, count(*) AS n, {R} AS r FROM mv GROUP BY part),
j AS (SELECT "window", coalesce(a.n, 0) AS is_n, coalesce(b.n, 0) AS oos_n, coalesce(a.r, 0) AS is_r, coalesce(b.r, 0) AS oos_r FROM win LEFT JOIN s a ON a.part = 'i' || "window" LEFT JOIN s b ON b.part = 'o' || "window")
SELECT CAST("window" AS INT) AS "window", is_n, oos_n, round(is_r, 6) AS is_r, round(oos_r, 6) AS oos_r, round(CASE WHEN abs(is_r) < 0.12 THEN CASE WHEN is_r < 0 THEN -0.12 ELSE 0.12 END ELSE is_r END, 6) AS is_floored,
  round(CASE WHEN abs(oos_r) < 0.08 THEN CASE WHEN oos_r < 0 THEN -0.08 ELSE 0.08 END ELSE oos_r END, 6) AS oos_floored, round(coalesce(abs(is_r - oos_r) / nullif(abs(is_r), 0), 1), 6) AS degradation FROM j""",
)
def walk_forward(spark, d):
    points = event_points(spark, d)
    return rounded(va.walk_forward(points, va.walk_forward_windows(period(points), 5), 30 * MINUTE))


@query(
    "backtest",
    f"""WITH {MOVES}, o AS (SELECT * FROM (VALUES (1, -0.5, 0.5, 0.2), (2, 0.0, 1.5, 1.0), (3, -2.0, -1.0, -0.05)) t(ord, low, high, expected)),
t AS (SELECT m.id, us, move, min_by(expected, ord) AS expected FROM moves m JOIN o ON move BETWEEN low AND high GROUP BY m.id, us, move),
r AS (SELECT *, move / greatest(abs(expected), 0.1) AS ret FROM t), e AS (SELECT *, exp(sum(ln(1 + ret * 0.01)) OVER (ORDER BY us, id)) AS eq FROM r),
k AS (SELECT *, greatest(1, max(eq) OVER (ORDER BY us, id)) AS pk FROM e)
SELECT count(*) AS trades, round(avg(CAST(sign(expected) = sign(move) AS DOUBLE)), 6) AS hit_rate, round(avg(ret), 6) AS avg_return, round(stddev_samp(ret), 6) AS volatility, round(max((pk - eq) / pk), 6) AS max_drawdown,
  round(avg(ret) FILTER (ret > 0), 6) AS avg_win, round(avg(ret) FILTER (ret < 0), 6) AS avg_loss, round(avg(ret) / stddev_samp(ret), 6) AS sharpe FROM k""",
)
def backtest(spark, d):
    rows = [(1, -0.5, 0.5, 0.2), (2, 0.0, 1.5, 1.0), (3, -2.0, -1.0, -0.05)]
    return rounded(bt.backtest(line_moves(spark, d), spark.createDataFrame(rows, "ord int, low double, high double, expected double"), 1.5))


# ---- reports ----


@query(
    "report_table",
    f"""WITH {MOVES}, {B}, u AS (SELECT low, high, avg(CAST(move > 0 AS DOUBLE)) AS p_up FROM b JOIN moves ON value BETWEEN low AND high GROUP BY low, high)
SELECT printf('%.0f-%.0f', low, high) AS measurement_range, round(p_up, 6) AS p_up, round(expected, 6) AS expected, n, round(confidence, 6) AS confidence FROM b JOIN u USING (low, high)""",
)
def report_table(spark, d):
    moves = line_moves(spark, d)
    return rounded(rp.report_table(rp.with_probability_up(best(spark, d), moves)))


@query("predictive_model")
def predictive_model(spark, d):
    moves = mv.movements(event_points(spark, d), [30 * MINUTE, HOUR])
    model = rp.predictive_model(best(spark, d), co.correlate(moves, by=["horizon"]))
    return model.select("accuracy", "n_boundaries", F.to_json("importance").alias("importance"))


@query(
    "predict_heuristic",
    f"""WITH {POINTS}, p AS (SELECT id, value, value * 0.01 * CASE WHEN value > 70 THEN 1.5 WHEN value < 30 THEN -1.2 ELSE 1 END AS m FROM points)
SELECT id, value, round(abs(m), 6) AS expected_move, CASE WHEN m > 0 THEN 'Up' WHEN m < 0 THEN 'Down' ELSE 'Flat' END AS predicted FROM p""",
)
def predict_heuristic(spark, d):
    return rounded(rp.predict(event_points(spark, d).select("id", "value")))


@query(
    "statistical_report",
    f"""WITH {POINTS}, {MOVES}, {B}, {asof(30 * MINUTE, name='x')}, {asof(HOUR, name='y')}, u AS (SELECT horizon, value, move FROM x UNION ALL SELECT horizon, value, move FROM y),
rk AS (SELECT horizon, rank() OVER (PARTITION BY horizon ORDER BY value) + (count(*) OVER (PARTITION BY horizon, value) - 1) / 2.0 AS value, rank() OVER (PARTITION BY horizon ORDER BY move) + (count(*) OVER (PARTITION BY horizon, move) - 1) / 2.0 AS move FROM u),
s AS (SELECT horizon, count(*) AS n, {R} AS r FROM u GROUP BY horizon), k AS (SELECT horizon, {R} AS rank_r FROM rk GROUP BY horizon)
SELECT horizon, round(r, 6) AS r, round({p_value('r', 'n')}, 6) AS p_value, n, round(rank_r, 6) AS rank_r, abs(r) > 0.1 AS significant, max_by(horizon, abs(r)) OVER () AS best_horizon, round(max_by(r, abs(r)) OVER (), 6) AS max_r,
  round(avg(abs(r)) OVER (), 6) AS mean_abs_r, CAST(sum(n) OVER () AS BIGINT) AS total_n, (SELECT round(min(low), 6) FROM b) AS range_low, (SELECT round(max(high), 6) FROM b) AS range_high FROM s JOIN k USING (horizon)""",
)
def statistical_report(spark, d):
    moves = mv.movements(event_points(spark, d), [30 * MINUTE, HOUR])
    ranks = co.correlate(moves, CorrelationKind.SPEARMAN, by=["horizon"])
    return rounded(rp.statistical_report(co.correlate(moves, by=["horizon"]), ranks, best(spark, d)))


@query(
    "interpolation_segments",
    f"""WITH {MOVES}, {B} SELECT round(low, 6) AS low, round(high, 6) AS high, CASE WHEN expected > 1 THEN 50 WHEN expected > 0 THEN 0 ELSE -50 END AS bias_low, CASE WHEN expected > 2 THEN 100 WHEN expected > 1 THEN 50 ELSE 0 END AS bias_high,
  CASE WHEN expected > 1.5 THEN 'Strong Bullish' WHEN expected > 0.5 THEN 'Bullish' WHEN expected > -0.5 THEN 'Neutral' WHEN expected > -1.5 THEN 'Bearish' ELSE 'Strong Bearish' END AS kind FROM b
UNION ALL SELECT 10, round(min(low), 6), -100, -75, 'Strong Bearish' FROM b HAVING min(low) > 10
UNION ALL SELECT round(max_by(high, (low, high)), 6), 90, 75, 100, 'Strong Bullish' FROM b HAVING max_by(high, (low, high)) < 90""",
)
def interpolation_segments(spark, d):
    return rounded(rp.interpolation_segments(best(spark, d)))


@query(
    "live_expectation",
    f"""WITH {POINTS}, {MOVES}, {B}, c AS (SELECT p.id, p.value, bo.*, CASE WHEN p.value BETWEEN low AND high THEN 0 ELSE 1 END AS miss, least(abs(p.value - low), abs(p.value - high)) AS dist FROM points p, bo),
h AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY miss, CASE WHEN miss = 0 THEN ord END, dist, ord) AS k FROM c)
SELECT id, value, round(expected, 6) AS expected_move, round(expected * 25, 6) AS bias, round(confidence, 6) AS confidence, CASE WHEN expected > 1.5 THEN 'Strong Buy' WHEN expected > 0.5 THEN 'Buy' WHEN expected > -0.5 THEN 'Neutral' WHEN expected > -1.5 THEN 'Sell' ELSE 'Strong Sell' END AS signal, n AS samples FROM h WHERE k = 1""",
)
def live_expectation(spark, d):
    return rounded(rp.live_expectation(event_points(spark, d).select("id", "value"), best(spark, d)))


def orders_points(spark, d):
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), micros("o_orderdate").alias("us"), F.col("o_orderpriority").alias("measurement_id"),
        (F.col("o_custkey") % 100).cast("double").alias("value"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 5).cast("double").alias("atr"),
    )


ORDER_POINTS = """points AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) AS us, o_orderpriority AS measurement_id, CAST(o_custkey % 100 AS DOUBLE) AS value,
  o_totalprice AS price, CAST(o_orderkey % 5 AS DOUBLE) AS atr FROM orders)"""


@query("movements_ties", f"WITH {ORDER_POINTS}, {asof(7 * DAY, 'measurement_id')} SELECT id, us, next_id, round(move, 6) AS move FROM mv")
def movements_ties(spark, d):
    """Days as times: many points share one."""
    return rounded(mv.movements(orders_points(spark, d), [7 * DAY], by=["measurement_id"], chunk=30 * DAY).select("id", "us", "next_id", "move"))
