"""Queries: correlation and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import significance_level, strength, t_p_value
from ..operators import correlation as co
from ..operators import movements as mv
from ..operators import outliers as ou
from ..schema import HOUR, MINUTE, CorrelationKind, OutlierHandling, OutlierMethod
from ..sources.adapters import event_points, line_moves
from .basic import RANGES, TARGETS
from .registry import MOVES, POINTS, R, asof, p_value, query, rounded


def _described(source: str) -> str:
    """SQL: significance of a table with n, r and avg_move."""
    z = "0.5 * ln((1 + r) / (1 - r))"
    back = lambda s: f"greatest(-1, least(1, (exp(2 * ({z} {s} 1.645 / sqrt(n - 3))) - 1) / (exp(2 * ({z} {s} 1.645 / sqrt(n - 3))) + 1)))"
    return f"""SELECT n, round(r, 6) AS r, round(avg_move, 6) AS avg_move, round({p_value('r', 'n')}, 6) AS p_value,
  round(r / sqrt((1 - r * r) / (n - 2)), 6) AS t_stat, round({back('-')}, 6) AS ci_low, round({back('+')}, 6) AS ci_high,
  {p_value('r', 'n')} < 0.05 AND abs(r) > 0.1 AS significant FROM {source}"""


SHOWN = ["n", "r", "avg_move", "p_value", "t_stat", "ci_low", "ci_high", "significant"]
RANKS = """rk AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS value,
  rank() OVER (ORDER BY move) + (count(*) OVER (PARTITION BY move) - 1) / 2.0 AS move, move AS raw FROM moves)"""


@query("correlation_pearson", f"WITH {MOVES}, s AS (SELECT count(*) AS n, {R} AS r, avg(move) AS avg_move FROM moves) {_described('s')}")
def correlation_pearson(spark, d):
    return rounded(co.correlate(line_moves(spark, d)).select(*SHOWN))


SPEARMAN = f"WITH {MOVES}, {RANKS}, s AS (SELECT count(*) AS n, {R} AS r, avg(raw) AS avg_move FROM rk) {_described('s')}"


@query("correlation_spearman", SPEARMAN)
def correlation_spearman(spark, d):
    return rounded(co.correlate(line_moves(spark, d), CorrelationKind.SPEARMAN).select(*SHOWN))


@query("correlation_kendall_compat", SPEARMAN)
def correlation_kendall_compat(spark, d):
    return rounded(co.correlate(line_moves(spark, d), CorrelationKind.KENDALL).select(*SHOWN))


@query("p_value_table", f"WITH t AS (SELECT l_linenumber AS ln, n + 2 AS n, r / 40.0 AS r FROM (SELECT DISTINCT l_linenumber FROM lineitem), range(1, 130) a(n), range(0, 40) b(r)) SELECT ln, n, round(r, 6) AS r, round({p_value('r', 'n')}, 6) AS p FROM t")
def p_value_table(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("ln")).distinct()
    rows = lines.select("ln", F.explode(F.sequence(F.lit(3), F.lit(131))).alias("n")).select(
        "ln", F.col("n").cast("long").alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: i / 40)).alias("r")
    )
    t = F.col("r") / F.sqrt((1 - F.col("r") * F.col("r")) / (F.col("n") - 2))
    return rounded(rows.select("ln", "n", "r", t_p_value(t, F.col("n") - 2).alias("p")))


@query(
    "correlation_labels",
    f"""WITH {POINTS} SELECT id, CASE WHEN abs(value / 100) >= 0.8 THEN 'Very Strong' WHEN abs(value / 100) >= 0.6 THEN 'Strong' WHEN abs(value / 100) >= 0.4 THEN 'Moderate'
  WHEN abs(value / 100) >= 0.2 THEN 'Weak' ELSE 'Very Weak' END AS strength,
  CASE WHEN value / 500 < 0.001 THEN 'Highly Significant' WHEN value / 500 < 0.01 THEN 'Very Significant' WHEN value / 500 < 0.05 THEN 'Significant'
  WHEN value / 500 < 0.10 THEN 'Marginally Significant' ELSE 'Not Significant' END AS level FROM points""",
)
def correlation_labels(spark, d):
    v = F.col("value")
    return event_points(spark, d).select("id", strength(v / 100).alias("strength"), significance_level(v / 500).alias("level"))


#: Flags of all four detectors, for SQL over a table m (id, value, move, ...).
FLAGS = """n AS (SELECT count(*) AS n, avg(value) AS mv, stddev_samp(value) AS sv, avg(move) AS mm, stddev_samp(move) AS sm, median(value) AS med,
  list_sort(list(value)) AS vs FROM m),
q AS (SELECT *, vs[CAST(floor(n * 0.25) AS BIGINT) + 1] AS q1, vs[CAST(floor(n * 0.75) AS BIGINT) + 1] AS q3 FROM n),
a AS (SELECT median(abs(value - med)) AS mad FROM m, n),
s AS (SELECT m.*, n, q1, q3, mad, med, abs(value - mv) / sv AS z, 0.6745 * abs(value - med) / nullif(mad, 0) AS mz,
  (abs(value - mv) / sv + abs(move - mm) / sm) / 2 AS iso FROM m, q, a),
i AS (SELECT *, row_number() OVER (ORDER BY iso DESC, id) AS ik, count(*) FILTER (iso > 2) OVER () AS ih FROM s),
f AS (SELECT *, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS iqr, z > 2.5 AS zscore, coalesce(mz > 3.5, false) AS mad_,
  iso > 2 AND (ih <= floor(n * 0.1) OR ik <= floor(n * 0.1)) AS isolation FROM i)"""
#: Orders as movements with heavy tails: price cubed, quantity of days.
HEAVY = """m AS (SELECT event_id AS id, epoch_us(ts) AS us, value, (value - 50) / 40 + (CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) - 50) / 25 AS move FROM events)"""


def heavy_moves(spark, d):
    """Movements with outliers: price of events as measurement, a mix of price and k as move."""
    return event_points(spark, d).select(
        "id", "us", F.col("price").alias("value"), ((F.col("price") - 50) / 40 + (F.col("value") - 50) / 25).alias("move"), "context"
    )


for _name, _method, _flag, _score in (
    ("outliers_iqr", OutlierMethod.IQR, "iqr", "least(abs(value - (q1 - 1.5 * (q3 - q1))), abs(value - (q3 + 1.5 * (q3 - q1)))) / (q3 - q1)"),
    ("outliers_zscore", OutlierMethod.ZSCORE, "zscore", "z"),
    ("outliers_mad", OutlierMethod.MODIFIED_ZSCORE, "mad_", "mz"),
    ("outliers_isolation", OutlierMethod.ISOLATION, "isolation", "iso"),
    (
        "outliers_ensemble", OutlierMethod.ENSEMBLE, "CAST(iqr AS INT) + CAST(zscore AS INT) + CAST(mad_ AS INT) + CAST(isolation AS INT) >= 2",
        "(CAST(iqr AS INT) + CAST(zscore AS INT) + CAST(mad_ AS INT) + CAST(isolation AS INT)) / 4",
    ),
):

    def _outliers(spark, d, method=_method):
        return rounded(ou.detect(heavy_moves(spark, d), method).where("flag").select("id", "value", "move", "score"))

    query(_name, f"WITH {HEAVY}, {FLAGS} SELECT id, round(value, 6) AS value, round(move, 6) AS move, round({_score}, 6) AS score FROM f WHERE {_flag}")(_outliers)


@query("outlier_stats", f"""WITH {HEAVY} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max' for c in ('value', 'move'))} FROM m""")
def outlier_stats(spark, d):
    return rounded(ou.movement_stats(heavy_moves(spark, d)))


CAPS = """c AS (SELECT list_sort(list(value)) AS v, list_sort(list(move)) AS w, count(*) AS k FROM m),
b AS (SELECT v[CAST(floor(k * 0.05) AS BIGINT) + 1] AS vl, v[least(CAST(floor(k * (1.0 - 0.05)) AS BIGINT), k - 1) + 1] AS vh,
  w[CAST(floor(k * 0.05) AS BIGINT) + 1] AS ml, w[least(CAST(floor(k * (1.0 - 0.05)) AS BIGINT), k - 1) + 1] AS mh FROM c)"""
HANDLED = {
    OutlierHandling.REMOVE: ("handle_remove", "SELECT id, round(value, 6) AS value, round(move, 6) AS move FROM f WHERE NOT iqr"),
    OutlierHandling.CAP: ("handle_cap", "SELECT id, round(greatest(vl, least(vh, value)), 6) AS value, round(greatest(ml, least(mh, move)), 6) AS move FROM f, b"),
    OutlierHandling.MEDIAN: ("handle_median", "SELECT id, round(CASE WHEN iqr THEN med ELSE value END, 6) AS value, round(CASE WHEN iqr THEN (SELECT median(move) FROM m) ELSE move END, 6) AS move FROM f"),
    OutlierHandling.LOG: ("handle_log", "SELECT id, round(ln(1 + greatest(0, value)), 6) AS value, round(sign(move) * ln(1 + abs(move)), 6) AS move FROM f"),
    OutlierHandling.FLAG: ("handle_flag", "SELECT id, round(value, 6) AS value, round(move, 6) AS move, CAST(iqr AS DOUBLE) AS is_outlier FROM f"),
}
for _how, (_name, _sql) in HANDLED.items():

    def _handled(spark, d, how=_how):
        moves = heavy_moves(spark, d)
        out = ou.handle(ou.iqr(moves), how, moves)
        more = [F.try_element_at("context", F.lit("IsOutlier")).alias("is_outlier")] if how is OutlierHandling.FLAG else []
        return rounded(out.select("id", "value", "move", *more))

    query(_name, f"WITH {HEAVY}, {FLAGS}, {CAPS} {_sql}")(_handled)

ANALYSIS = """v AS (SELECT *, CAST(iqr AS INT) + CAST(zscore AS INT) + CAST(mad_ AS INT) + CAST(isolation AS INT) >= 2 AS cons FROM f),
o AS (SELECT count(*) AS n, count(*) FILTER (iqr) AS n_iqr, count(*) FILTER (zscore) AS n_zscore, count(*) FILTER (mad_) AS n_mad,
  count(*) FILTER (isolation) AS n_isolation, count(*) FILTER (cons) AS n_consensus, avg(value) AS a1, stddev_samp(value) AS s1,
  avg(value) FILTER (NOT cons) AS a2, stddev_samp(value) FILTER (NOT cons) AS s2 FROM v),
o2 AS (SELECT *, CASE WHEN n_consensus = 0 THEN 0 ELSE abs(a2 - a1) / a1 END AS mean_impact, CASE WHEN n_consensus = 0 THEN 0 ELSE abs(s2 - s1) / s1 END AS std_impact FROM o)"""


@query(
    "outlier_analysis",
    f"""WITH {HEAVY}, {FLAGS}, {ANALYSIS} SELECT n, n_iqr, n_zscore, n_mad, n_isolation, n_consensus, round(mean_impact, 6) AS mean_impact, round(std_impact, 6) AS std_impact,
  CASE WHEN greatest(mean_impact, std_impact) > 0.2 THEN 'Critical' WHEN greatest(mean_impact, std_impact) > 0.1 THEN 'High' WHEN greatest(mean_impact, std_impact) > 0.05 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN n_consensus / n > 0.15 THEN 'LogTransform' WHEN n_consensus / n > 0.1 THEN 'Cap' WHEN n_consensus / n > 0.05 THEN 'ReplaceWithMedian' ELSE 'Flag' END AS strategy FROM o2""",
)
def outlier_analysis(spark, d):
    return rounded(ou.outlier_analysis(heavy_moves(spark, d)))


@query(
    "data_quality",
    f"""WITH {HEAVY}, {FLAGS}, {ANALYSIS}, h AS (SELECT count(*) FILTER (value = 0) AS zero_values, count(*) FILTER (move = 0) AS zero_moves, skewness(value) AS vs, kurtosis(value) AS vk,
  skewness(move) AS ms, kurtosis(move) AS mk FROM m)
SELECT n, zero_values, zero_moves, round(n_consensus / n, 6) AS outlier_share, round(vs, 6) AS value_skew, round(vk, 6) AS value_kurt, round(ms, 6) AS move_skew, round(mk, 6) AS move_kurt,
  concat_ws('; ', CASE WHEN zero_values > 0 THEN 'Invalid Measurements' END, CASE WHEN n_consensus / n > 0.15 THEN 'Excessive Outliers' END, CASE WHEN abs(vs) > 2 THEN 'Skewed Distribution' END) AS issues,
  round(greatest(0, 100 - CASE WHEN zero_values > 0 THEN CASE WHEN zero_values / n > 0.1 THEN 20 ELSE 10 END * zero_values / n ELSE 0 END
    - CASE WHEN n_consensus / n > 0.15 THEN 10 * least(1, n_consensus / n / 0.15) ELSE 0 END - CASE WHEN abs(vs) > 2 THEN 5 * least(1, abs(vs) / 3) ELSE 0 END), 6) AS score FROM o2, h""",
)
def data_quality(spark, d):
    return rounded(ou.data_quality(heavy_moves(spark, d)))


@query(
    "correlation_outlier_capped",
    f"""WITH {HEAVY}, {CAPS}, p AS (SELECT greatest(vl, least(vh, value)) AS value, greatest(ml, least(mh, move)) AS move FROM m, b),
s AS (SELECT count(*) AS n, {R} AS r, avg(move) AS avg_move FROM p) {_described('s')}""",
)
def correlation_outlier_capped(spark, d):
    return rounded(co.correlate_handled(heavy_moves(spark, d)).select(*SHOWN))


@query("contextual_filter", f"WITH {POINTS}, {asof(HOUR)}, s AS (SELECT count(*) AS n, {R} AS r, avg(move) AS avg_move FROM mv WHERE value > 60) {_described('s')}")
def contextual_filter(spark, d):
    return rounded(co.contextual(mv.movements(event_points(spark, d), [HOUR]), "k", ">", 60).select(*SHOWN))


HORIZONS = [30 * MINUTE, HOUR, 4 * HOUR]
THREE = f"{asof(HORIZONS[0], name='a')}, {asof(HORIZONS[1], name='b')}, {asof(HORIZONS[2], name='c')}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"


@query(
    "correlation_by_horizon",
    f"WITH {POINTS}, {THREE}, s AS (SELECT horizon, count(*) AS n, {R} AS r FROM u GROUP BY horizon HAVING count(*) >= 20) SELECT horizon, n, round(r, 6) AS r, round({p_value('r', 'n')}, 6) AS p_value FROM s",
)
def correlation_by_horizon(spark, d):
    return rounded(co.by_horizon(mv.movements(event_points(spark, d), HORIZONS)).select("horizon", "n", "r", "p_value"))


@query(
    "full_analysis_corr",
    f"""WITH {POINTS}, {THREE}, s AS (SELECT horizon, count(*) AS n, {R} AS r FROM u WHERE value <> 0 GROUP BY horizon),
g AS (SELECT * FROM u WHERE value <> 0 AND horizon = {HORIZONS[0]})
SELECT 'correlation' AS part, CAST(horizon AS VARCHAR) AS key, n, round(r, 6) AS x FROM s
UNION ALL SELECT 'range', range, count(move), round(coalesce(avg(move), 0), 6) FROM (VALUES ('0-10', 0, 10, false), ('10-25', 10, 25, false), ('20-40', 20, 40, false), ('40-50', 40, 50, false), ('60-70', 60, 70, true)) t(range, lo, hi, closed)
  LEFT JOIN g ON value >= lo AND (value < hi OR (closed AND value = hi)) GROUP BY range
UNION ALL SELECT 'bucket', bucket, count(move), round(coalesce(avg(move), 0), 6) FROM (VALUES ('0.0-0.5', 0, 0.5), ('0.5-1.0', 0.5, 1), ('1.0-1.5', 1, 1.5), ('1.5-2.0', 1.5, 2), ('2.0+', 2, 1e300)) t(bucket, lo, hi)
  LEFT JOIN g ON abs(move) >= lo AND abs(move) < hi GROUP BY bucket
UNION ALL SELECT 'overall', 'all', count(*), round(avg(move), 6) FROM g""",
)
def full_analysis_corr(spark, d):
    got = co.full_analysis(mv.movements(event_points(spark, d), HORIZONS), HORIZONS, RANGES, TARGETS)
    parts = [
        got["correlations"].select(F.lit("correlation").alias("part"), F.col("horizon").cast("string").alias("key"), "n", F.col("r").alias("x")),
        got["ranges"].select(F.lit("range").alias("part"), F.col("range").alias("key"), "n", F.col("avg_move").alias("x")),
        got["buckets"].select(F.lit("bucket").alias("part"), F.col("bucket").alias("key"), "n", F.col("avg_move").alias("x")),
        got["overall"].select(F.lit("overall").alias("part"), F.lit("all").alias("key"), "n", F.col("mean_move").alias("x")),
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))


@query(
    "multi_measurement_weights",
    f"""WITH {POINTS}, {asof(HOUR, 'measurement_id')}, s AS (SELECT measurement_id, count(*) AS n, {R} AS r FROM mv GROUP BY measurement_id),
w AS (SELECT *, greatest(abs(r), 0.1) / sum(greatest(abs(r), 0.1)) OVER () AS weight FROM s),
x AS (SELECT *, sum(greatest(abs(r), 0.1) * weight) OVER () AS combined_r, weight * abs(r) / sum(weight * abs(r)) OVER () AS importance FROM w),
y AS (SELECT *, max(importance) OVER () AS top FROM x)
SELECT measurement_id, n, round(r, 6) AS r, round(weight, 6) AS weight, round(combined_r, 6) AS combined_r, round(greatest(combined_r, 0.12), 6) AS combined_floored,
  round(importance, 6) AS importance, round(CASE WHEN top >= 0.35 THEN importance WHEN importance = top THEN 0.40 ELSE importance * 0.60 / (1 - top) END, 6) AS importance_boosted FROM y""",
)
def multi_measurement_weights(spark, d):
    return rounded(co.measurement_weights(mv.movements(event_points(spark, d), [HOUR], by=["measurement_id"])))


@query(
    "multi_measurement_calc",
    f"""WITH {POINTS}, {asof(15 * MINUTE, 'measurement_id')}, s AS (SELECT measurement_id, count(*) AS n, {R} AS r FROM mv GROUP BY measurement_id),
p AS (SELECT *, {p_value('r', 'n')} AS p_value FROM s), i AS (SELECT *, abs(r) * CASE WHEN p_value < 0.05 THEN 1.0 ELSE 0.5 END AS importance FROM p),
w AS (SELECT *, importance / sum(importance) OVER () AS weight FROM i)
SELECT measurement_id, n, round(r, 6) AS r, round(p_value, 6) AS p_value, round(importance, 6) AS importance, round(weight, 6) AS weight,
  round(sum(abs(r) * weight) OVER (), 6) AS combined_r FROM w""",
)
def multi_measurement_calc(spark, d):
    return rounded(co.measurement_calc(mv.movements(event_points(spark, d), [15 * MINUTE], by=["measurement_id"])))
