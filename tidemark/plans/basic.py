"""Queries: scans, filters, movements, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import movements as mv
from ..operators import predicates as pr
from ..operators import segments as sg
from ..operators.regularity import regularity
from ..schema import HOUR, MINUTE
from ..sources import store
from ..sources.adapters import event_points, line_moves, micros, multi_points, read
from .registry import MOVES, POINTS, asof, query, rounded

START, END = 1704672000000000, 1705536000000000  # 2024-01-08 and 2024-01-18
PLAIN = ["id", "us", "measurement_id", "value", "price", "atr"]


@query(
    "ingest_validate",
    """SELECT problem, count(*) AS n FROM (
  SELECT CASE WHEN trim(coalesce(o_orderpriority, '')) = '' THEN 'blank measurement id'
    WHEN o_totalprice - 100000 < 0 THEN 'negative price' WHEN o_custkey % 5 - 1 < 0 THEN 'negative ATR' END AS problem FROM orders
) GROUP BY problem""",
)
def ingest_validate(spark, d):
    rows = read(spark, d, "orders").select(
        F.col("o_orderpriority").alias("measurement_id"), (F.col("o_totalprice") - 100000).alias("price"), (F.col("o_custkey") % 5 - 1).alias("atr")
    )
    return store.validated(rows).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("multi_ingest")
def multi_ingest(spark, d):
    return store.validated_multi(multi_points(event_points(spark, d))).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("scan_ordered", f"WITH {POINTS} SELECT id, us, measurement_id, value, price, atr FROM points ORDER BY us, id")
def scan_ordered(spark, d):
    return store.scan(event_points(spark, d).select(*PLAIN))


@query("multi_scan", f"WITH {POINTS} SELECT id, us, price, atr, 2 AS n_measurements FROM points ORDER BY us, id")
def multi_scan(spark, d):
    rows = multi_points(event_points(spark, d))
    return store.scan(rows).select("id", "us", "price", "atr", F.size("measurements").alias("n_measurements"))


@query("multi_contains", f"WITH {POINTS} SELECT id, us, price FROM points WHERE measurement_id = 'purchase'")
def multi_contains(spark, d):
    return store.containing(multi_points(event_points(spark, d)), "purchase").select("id", "us", "price")


@query("get_by_id", f"WITH {POINTS} SELECT id, us, measurement_id, value, price, atr FROM points WHERE id = 77 ORDER BY us LIMIT 1")
def get_by_id(spark, d):
    return store.by_id(event_points(spark, d).select(*PLAIN), 77)


@query("exists", "SELECT EXISTS (SELECT 1 FROM events WHERE event_id = 77) AS found")
def exists(spark, d):
    return store.exists(event_points(spark, d), 77)


@query("history", "SELECT o_orderkey AS id, epoch_us(o_orderdate) AS us, o_totalprice AS value FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY us DESC, id")
def history(spark, d):
    rows = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("measurement_id"), micros("o_orderdate").alias("us"), F.col("o_totalprice").alias("value")
    )
    return store.history(rows, "measurement_id", "us", "1-URGENT").select("id", "us", "value")


@query("filter_measurement", f"WITH {POINTS} SELECT id, us, value FROM points WHERE measurement_id = 'click' ORDER BY us, id")
def filter_measurement(spark, d):
    return store.by_measurement(event_points(spark, d), "click").select("id", "us", "value")


@query("filter_time_range", f"WITH {POINTS} SELECT id, us, value FROM points WHERE us BETWEEN {START} AND {END} ORDER BY us, id")
def filter_time_range(spark, d):
    return store.by_time(event_points(spark, d), START, END).select("id", "us", "value")


@query("filter_meas_time", f"WITH {POINTS} SELECT id, us, value FROM points WHERE measurement_id = 'click' AND us BETWEEN {START} AND {END} ORDER BY us, id")
def filter_meas_time(spark, d):
    return store.by_measurement_and_time(event_points(spark, d), "click", START, END).select("id", "us", "value")


@query("filter_predicate", f"WITH {POINTS} SELECT id, us, value FROM points WHERE value > 50 AND price < 20 ORDER BY us, id")
def filter_predicate(spark, d):
    return store.by_predicate(event_points(spark, d), "value > 50 and price < 20").select("id", "us", "value")


@query(
    "scalar_predicates",
    f"""WITH {POINTS} SELECT id, value BETWEEN 20 AND 80 AS within, value / 1000 < 0.05 AS significant, abs(value / 100 - 0.5) > 0.3 AS strong,
  value / 100 >= 0.5 AS meets, value >= 10 AS sufficient, value >= 100 AS adequate, value / 100 <= 0.3 AS acceptable, price > 0 AS priced, atr > 0 AS ranged
FROM points""",
)
def scalar_predicates(spark, d):
    v = F.col("value")
    return event_points(spark, d).select(
        "id",
        pr.within(v, 20, 80).alias("within"),
        pr.is_significant(v / 1000).alias("significant"),
        pr.is_strong(v / 100 - 0.5).alias("strong"),
        pr.meets_correlation(v / 100).alias("meets"),
        pr.sufficient(v, 10).alias("sufficient"),
        pr.adequate(v).alias("adequate"),
        pr.acceptable_degradation(v / 100).alias("acceptable"),
        (F.col("price") > 0).alias("priced"),
        (F.col("atr") > 0).alias("ranged"),
    )


@query(
    "trading_signals",
    f"""WITH {POINTS} SELECT id, value BETWEEN 60 AND 70 AND price > 0 AND atr > 0 AS bullish, value BETWEEN 30 AND 40 AND price > 0 AND atr > 0 AS bearish,
  NOT (value / 100 >= 0.5) OR NOT (ctx_user >= 100) OR NOT (atr / 10 <= 0.3) AS optimize,
  (value BETWEEN 60 AND 70 OR value BETWEEN 30 AND 40) AND price > 0 AND atr > 0 AND abs(value / 100) > 0.3 AND ctx_user >= 100 AS tradable,
  abs(value / 100) > 0.3 AND atr / 100 < 0.05 AS related, ctx_user >= 30 AND price > 0 AS usable,
  value / 100 >= 0.6 AND atr / 100 < 0.05 AS alert, NOT (value BETWEEN 10 AND 90) AS outside,
  NOT (atr / 10 <= 0.3) OR value >= 30 AS rebalance,
  CASE WHEN value / 100 > 0.5 THEN 'Critical' WHEN value / 100 > 0.2 THEN 'High' WHEN value / 100 > 0.1 THEN 'Medium' ELSE 'Low' END AS severity
FROM points""",
)
def trading_signals(spark, d):
    v, p, a, u = F.col("value"), F.col("price"), F.col("atr"), F.try_element_at("context", F.lit("user"))
    return event_points(spark, d).select(
        "id",
        pr.bullish_signal(v, p, a).alias("bullish"),
        pr.bearish_signal(v, p, a).alias("bearish"),
        pr.requires_optimization(v / 100, u, a / 10).alias("optimize"),
        pr.tradable(v, p, a, v / 100, u).alias("tradable"),
        pr.significant_correlation(v / 100, a / 100).alias("related"),
        pr.valid_input(u, p).alias("usable"),
        pr.alert(v / 100, 0.6, a / 100).alias("alert"),
        pr.out_of_bounds(v, 10, 90).alias("outside"),
        pr.requires_rebalancing(a / 10, v).alias("rebalance"),
        pr.deviation_severity(v / 100).alias("severity"),
    )


DIRECTION = "CASE WHEN move > 0 THEN 'Up' WHEN move < 0 THEN 'Down' ELSE 'Flat' END AS direction"


@query("movements_h60", f"WITH {POINTS}, {asof(HOUR)} SELECT id, us, value, next_id, round(move, 6) AS move, {DIRECTION} FROM mv")
def movements_h60(spark, d):
    return rounded(mv.movements(event_points(spark, d), [HOUR]).select("id", "us", "value", "next_id", "move", "direction"))


@query(
    "movements_keyed",
    f"WITH {POINTS}, {asof(HOUR, 'measurement_id')} SELECT id, measurement_id, next_id, round(move, 6) AS move FROM mv",
)
def movements_keyed(spark, d):
    return rounded(mv.movements(event_points(spark, d), [HOUR], by=["measurement_id"]).select("id", "measurement_id", "next_id", "move"))


@query(
    "movements_multi",
    f"""WITH {POINTS}, {asof(30 * MINUTE, name='a')}, {asof(HOUR, name='b')}, {asof(4 * HOUR, name='c')}
SELECT horizon, id, next_id, round(move, 6) AS move FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""",
)
def movements_multi(spark, d):
    rows = mv.movements(event_points(spark, d), [30 * MINUTE, HOUR, 4 * HOUR, HOUR])
    return rounded(rows.select("horizon", "id", "next_id", "move"))


@query(
    "movements_minute",
    f"""WITH {POINTS}, m AS (SELECT *, us // {MINUTE} AS mi FROM points),
f AS (SELECT mi, min_by(id, (us, id)) AS next_id, min_by(price, (us, id)) AS next_price FROM m GROUP BY mi)
SELECT m.id, f.next_id, round((f.next_price - m.price) / m.atr, 6) AS move FROM m ASOF JOIN f ON m.mi + 60 <= f.mi WHERE m.atr <> 0""",
)
def movements_minute(spark, d):
    return rounded(mv.minute_movements(event_points(spark, d), [60]).select("id", "next_id", "move"))


@query(
    "combined_movements",
    f"""WITH {POINTS}, {asof(HOUR, 'measurement_id')},
p AS (SELECT *, row_number() OVER (PARTITION BY measurement_id ORDER BY us, id) AS position FROM mv WHERE measurement_id IN ('click', 'purchase', 'view'))
SELECT position, min(us) FILTER (measurement_id = 'click') AS us,
  round(sum(move * CASE measurement_id WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 0.3 ELSE 0.2 END), 6) AS move
FROM p GROUP BY position HAVING count(*) = 3""",
)
def combined_movements(spark, d):
    rows = mv.movements(event_points(spark, d), [HOUR], by=["measurement_id"])
    return rounded(mv.combined(rows, {"click": 0.5, "purchase": 0.3, "view": 0.2}).select("position", "us", "move"))


@query(
    "statistics",
    f"""WITH {POINTS} SELECT count(*) AS n, count(DISTINCT us) AS n_times, count(DISTINCT measurement_id) AS n_measurements, min(us) AS first_us,
  max(us) AS last_us, min(price) AS min_price, max(price) AS max_price FROM points""",
)
def statistics(spark, d):
    return sg.statistics(event_points(spark, d))


@query(
    "time_series_regularity",
    f"""WITH {POINTS}, g AS (SELECT us, id, us - lag(us) OVER (ORDER BY us, id) AS d FROM points)
SELECT count(*) AS n, CAST(min_by(d, (us, id)) FILTER (d IS NOT NULL) AS BIGINT) AS time_step_us, min(d) = max(d) AS is_regular FROM g""",
)
def time_series_regularity(spark, d):
    return regularity(event_points(spark, d))


TARGETS = [0.5, 1.0, 1.5, 2.0]


@query(
    "bucketize",
    f"""WITH {MOVES}, b AS (SELECT move, CASE WHEN abs(move) < 0.5 THEN '0.0-0.5' WHEN abs(move) < 1 THEN '0.5-1.0' WHEN abs(move) < 1.5 THEN '1.0-1.5'
  WHEN abs(move) < 2 THEN '1.5-2.0' ELSE '2.0+' END AS bucket FROM moves)
SELECT bucket, count(*) AS n, round(avg(move), 6) AS avg_move FROM b GROUP BY bucket""",
)
def bucketize(spark, d):
    return rounded(sg.bucket_counts(line_moves(spark, d), TARGETS))


@query(
    "bucketize_signed",
    f"""WITH {MOVES}, b AS (SELECT move, CASE WHEN abs(move) <= 0.5 THEN '< 0.5' WHEN abs(move) > 2 THEN '> 2'
  WHEN abs(move) <= 1 THEN '0.5' WHEN abs(move) <= 1.5 THEN '1.0' ELSE '1.5' END AS k FROM moves)
SELECT CASE WHEN length(k) = 3 AND k NOT LIKE '>%' THEN k || CASE WHEN move >= 0 THEN '+' ELSE '-' END || ' ATR' ELSE k END AS bucket, count(*) AS n FROM b GROUP BY bucket""",
)
def bucketize_signed(spark, d):
    return sg.bucketize_signed(line_moves(spark, d), TARGETS).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


RANGES = [(0.0, 10.0), (10.0, 25.0), (20.0, 40.0), (40.0, 50.0), (60.0, 70.0)]


@query(
    "range_analysis",
    f"""WITH {MOVES}, r AS (SELECT * FROM (VALUES ('0-10', 0, 10, false), ('10-25', 10, 25, false), ('20-40', 20, 40, false), ('40-50', 40, 50, false),
  ('60-70', 60, 70, true)) t(range, lo, hi, closed))
SELECT range, count(move) AS n, round(coalesce(avg(CAST(move > 0 AS DOUBLE)), 0), 6) AS p_up, round(coalesce(avg(CAST(move < 0 AS DOUBLE)), 0), 6) AS p_down,
  round(coalesce(avg(move), 0), 6) AS avg_move, round(coalesce(min(move), 0), 6) AS min_move, round(coalesce(max(move), 0), 6) AS max_move
FROM r LEFT JOIN moves ON value >= lo AND (value < hi OR (closed AND value = hi)) GROUP BY range""",
)
def range_analysis(spark, d):
    return rounded(sg.range_analysis(line_moves(spark, d), RANGES))


OVERALL = """count(*) AS n, round(avg(move), 6) AS mean_move, round(stddev_pop(move), 6) AS std_move, round(min(move), 6) AS min_move,
  round(max(move), 6) AS max_move, round(avg(CAST(move > 0 AS DOUBLE)) * 100, 6) AS pct_up"""


@query("overall_stats", f"WITH {MOVES} SELECT {OVERALL} FROM moves WHERE value <> 0")
def overall_stats(spark, d):
    return rounded(sg.overall_stats(line_moves(spark, d)))


@query(
    "contextual_groups",
    f"""WITH {POINTS}, g AS (SELECT *, CASE WHEN value < 40 THEN '<40' WHEN value < 60 THEN '40-60' WHEN value < 80 THEN '60-80' ELSE '>80' END AS grp FROM points),
{asof(HOUR, 'grp', 'g')}, s AS (SELECT grp, count(*) AS n, coalesce(covar_pop(value, move) / nullif(stddev_pop(value) * stddev_pop(move), 0), 0) AS r,
  avg(move) AS avg_move, avg(CAST(move > 0 AS DOUBLE)) AS p_up FROM mv GROUP BY grp)
SELECT grp, n, round(r, 6) AS r, round(avg_move, 6) AS avg_move, round(p_up, 6) AS p_up, round(max(r) OVER () - min(r) OVER (), 6) AS effect FROM s""",
)
def contextual_groups(spark, d):
    return rounded(sg.contextual_groups(event_points(spark, d), "k", [40, 60, 80], HOUR))
