"""Worked examples and invariants of the signal engine."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.api import Engine
from tidemark.functions.stats import order_statistics, positional
from tidemark.operators import boundaries as bo
from tidemark.operators import correlation as co
from tidemark.operators import ml
from tidemark.operators import movements as mv
from tidemark.operators import outliers as ou
from tidemark.operators import segments as sg
from tidemark.operators import validation as va
from tidemark.operators.regularity import regularity
from tidemark.schema import DATA_POINTS, MINUTE, AnalysisRequest, CorrelationKind, DataValidationError, OutlierHandling
from tidemark.sources.store import ResultStore


def points(spark, rows):
    """(minute, value, price, atr[, context])"""
    full = [(str(i), r[0] * MINUTE, "m", float(r[1]), float(r[2]), float(r[3]), r[4] if len(r) > 4 else {}) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, DATA_POINTS)


def moves(spark, rows):
    return spark.createDataFrame([(str(i), i * 5 * MINUTE, float(v), float(m)) for i, (v, m) in enumerate(rows)], "id string, us long, value double, move double")


def test_asof_takes_the_first_point_at_or_after_the_horizon(spark):
    df = points(spark, [(0, 62, 100, 10), (30, 58, 125, 10), (60, 55, 150, 10), (90, 52, 140, 10)])
    got = mv.movements(df, [30 * MINUTE, 60 * MINUTE], chunk=45 * MINUTE).collect()
    by = {h: sorted((r.us // MINUTE, r.move) for r in got if r.horizon == h * MINUTE) for h in (30, 60)}
    assert by[30] == [(0, 2.5), (30, 2.5), (60, -1.0)] and by[60] == [(0, 5.0), (30, 1.5)]
    assert mv.movements(points(spark, [(0, 1, 5, 0), (30, 1, 6, 1)]), [MINUTE]).count() == 0
    with pytest.raises(DataValidationError):
        mv.movements(df, [0])


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_asof_does_not_depend_on_chunks(spark, chunk):
    rows = [((i * 37) % 101, i, 100 + (i * 53) % 17, 1 + i % 3) for i in range(60)]
    want = {}
    order = sorted(range(60), key=lambda i: (rows[i][0], str(i)))
    for i in order:
        later = [j for j in order if rows[j][0] >= rows[i][0] + 10]
        if later:
            want[str(i)] = str(later[0])
    got = mv.movements(points(spark, rows), [10 * MINUTE], chunk=chunk * MINUTE).collect()
    assert {r.id: r.next_id for r in got} == want


def test_correlation_of_perfect_lines(spark):
    up = co.correlate(moves(spark, [(40, 0.5), (50, 1), (60, 1.5), (70, 2), (80, 2.5)])).first()
    assert up.r == pytest.approx(1) and up.p_value < 0.05 and up.n == 5 and up.significant and up.strength == "Very Strong"
    down = co.correlate(moves(spark, [(40, 2), (50, 1.5), (60, 1), (70, 0.5), (80, 0)]), CorrelationKind.SPEARMAN).first()
    assert down.r == pytest.approx(-1)
    flat = co.correlate(moves(spark, [(1, 2), (1, 3), (1, 4)])).first()
    assert flat.r == 0 and flat.p_value == 1.0
    assert co.correlate(moves(spark, [(1, 2)]).limit(0)).first().n == 0


def test_buckets_and_ranges(spark):
    df = moves(spark, [(1, 0.3), (1, 0.7), (1, 1.2), (1, 1.8), (1, 2.5)])
    got = {r.bucket: r.n for r in sg.bucket_counts(df, [0.5, 1, 1.5, 2]).collect()}
    assert got == {"0.0-0.5": 1, "0.5-1.0": 1, "1.0-1.5": 1, "1.5-2.0": 1, "2.0+": 1}
    df = moves(spark, [(45, -1), (50, -0.5), (62, 1.5), (65, 2), (68, 1.8), (75, 0.5), (80, -0.3)])
    r = {x.range: x for x in sg.range_analysis(df, [(40, 60), (60, 70), (70, 80)]).collect()}
    assert [r[k].n for k in ("40-60", "60-70", "70-80")] == [2, 3, 2]
    assert [r[k].p_up for k in ("40-60", "60-70", "70-80")] == [0, 1, 0.5]
    assert r["40-60"].avg_move == -0.75 and r["60-70"].avg_move == pytest.approx(5.3 / 3)


def test_regularity_and_context(spark):
    df = points(spark, [(0, 1, 1, 1), (30, 1, 1, 1), (60, 1, 1, 1)])
    r = regularity(df, chunk=40 * MINUTE).first()
    assert (r.n, r.time_step_us, r.is_regular) == (3, 30 * MINUTE, True)
    assert not regularity(points(spark, [(0, 1, 1, 1), (30, 1, 1, 1), (61, 1, 1, 1)])).first().is_regular
    rows = points(spark, [(0, 65, 1, 1, {"s": 30.0}), (1, 65, 2, 1, {"s": 70.0}), (2, 65, 2, 1)])
    assert [x.id for x in sg.context_filter(rows, "s", ">", 60).collect()] == ["1"]


def test_gap_and_tree_splits(spark):
    df = moves(spark, [(30, -2), (35, -1.8), (45, -1), (62, 2), (65, 2.5), (68, 2.2), (82, 0.1), (85, -0.1)])
    assert [r.split for r in bo.tree_splits(df, 3).orderBy("split").collect()] == [40, 53.5, 75]


def test_a_tree_stands_in_where_no_split_is_found(spark):
    df = moves(spark, [(i, i * 0.05) for i in range(60)])
    got = [r.split for r in bo.tree_splits(df, 3).collect()]
    assert 1 <= len(got) <= 3 and any(19 <= x <= 20 for x in got)
    assert bo.tree_splits(moves(spark, [(i, i * 0.05) for i in range(10)]), 3).count() == 0


def test_of_equal_strategies_the_first_is_best(spark, monkeypatch):
    same = lambda moves, target: spark.createDataFrame([(0.0, 100.0, 1.0, 1.0, 9, 0.5)], ml.EMPTY)
    monkeypatch.setattr(ml, "STRATEGIES", {"a": same, "b": same})
    got = ml.combined_optimization(moves(spark, [(i, i % 3) for i in range(30)]), 1.0, ["b", "a"]).collect()
    assert {(r.strategy, r.best) for r in got} == {("b", True), ("a", False)}


def test_order_statistics_are_exact(spark):
    values = [(i * 7919) % 1009 / 4 for i in range(700)] + [5.0] * 300
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    want = sorted(values)
    got = order_statistics(df, "x", {f"p{p}": positional(p / 100) for p in (0, 5, 25, 50, 95, 100)}).first()
    assert got.n == 1000
    for p in (0, 5, 25, 50, 95, 100):
        assert got[f"p{p}"] == want[min(999, math.floor(1000 * p / 100))]


def test_outliers_are_flagged_and_capped(spark):
    df = moves(spark, [(50 + i % 10, 0.1 * (i % 7)) for i in range(60)] + [(500, 9), (-400, -9)])
    assert {r.value for r in ou.iqr(df).where("flag").collect()} == {500, -400}
    assert {r.value for r in ou.ensemble(df).where("flag").collect()} == {500, -400}
    capped = ou.handle(ou.iqr(df), OutlierHandling.CAP).agg({"value": "max"}).first()[0]
    assert capped <= 60
    assert ou.iqr(df.limit(20)).where("flag").count() == 0
    same = ou.handle(ou.iqr(df.where("value between 0 and 100")), OutlierHandling.LOG)
    assert same.where("flag").count() == 0 and same.agg({"value": "max"}).first()[0] == 59


def test_folds_and_windows(spark):
    df = moves(spark, [(30 + (i * 7) % 60, ((i * 13) % 40) / 10 - 2) for i in range(200)])
    folds = va.kfold(df, 5).collect()
    assert len(folds) == 5 and all(0 <= f.in_sample <= 1 and 0 <= f.out_of_sample <= 1 for f in folds)
    grown = sorted(va.expanding_folds(df, 0.3, 0.1, chunk=60 * MINUTE).collect(), key=lambda f: f.fold)
    assert [f.train_n for f in grown] == [60 + 20 * i for i in range(7)] and {f.held_n for f in grown} == {20}
    assert all(f.train_end < f.held_start for f in grown)
    rolled = va.rolling_folds(df, 0.5, 0.1, chunk=60 * MINUTE).collect()
    assert {f.train_n for f in rolled} == {100}
    for bad in (0, 1):
        with pytest.raises(DataValidationError):
            va.kfold(df, bad)
        with pytest.raises(DataValidationError):
            va.expanding_folds(df, bad, 0.1)


def test_holdout_tells_rows_by_the_last_of_the_first_part(spark):
    rows = [(None if i % 9 == 0 else str(i % 40), (i * 37) % 50 * MINUTE, float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, us long, value double").repartition(5)
    plain = sorted((r[1], r[0] is not None, r[0] or "") for r in rows)
    for ratio in (0.0, 0.01, 0.2, 0.37, 0.5, 0.75, 0.999):
        for chunk in (MINUTE, 7 * MINUTE, 1000 * MINUTE):
            train, held = va.holdout(df, ratio, chunk)
            got, rest = ([(r.us, r.id is not None, r.id or "", r.value) for r in part.collect()] for part in (train, held))
            n = math.floor(100 * (1 - ratio))
            assert sorted(g[:3] for g in got) == plain[:n] and sorted(g[:3] for g in rest) == plain[n:]
            assert sorted(g[3] for g in got + rest) == [float(i) for i in range(100)]
    assert [part.count() for part in va.holdout(df.limit(0), 0.2)] == [0, 0]
    same = spark.createDataFrame([("a", 5, float(i)) for i in range(10)], "id string, us long, value double")
    first, rest = va.holdout(same, 0.3)
    assert first.count() == 7 and rest.count() == 3 and first.union(rest).distinct().count() == 10


def test_parts_of_a_holdout_are_not_shuffled(spark):
    df = moves(spark, [(i % 7, i % 5) for i in range(50)])
    for part in va.holdout(df, 0.2):
        assert "Exchange" not in part._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_model_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ml, "TASK_ROWS", 20)
    df = moves(spark, [(i % 3 * 100 + i % 2, i % 3) for i in range(150)]).coalesce(1)
    sizes = [r["count"] for r in ml.spread(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 150 and max(sizes) <= 20
    got = sorted((r.center, r.avg_move, r.n) for r in ml.clusters(df, 3).collect())
    assert got == [(0.5, 0, 50), (100.5, 1, 50), (200.5, 2, 50)]


def test_engine_round_trip(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "points"))
    engine.add_points(points(spark, [(i, 40 + 30 * math.sin(0.1 * i), 100 + i % 11, 10 + i % 3, {"d": 1.0}) for i in range(120)]))
    with pytest.raises(DataValidationError):
        engine.add_point(0, " ", 1, 1, 1)
    assert engine.statistics().first().n == 120
    got = engine.analyse(AnalysisRequest("m", [5 * MINUTE, 10 * MINUTE], [0.3], windows=3))
    assert got["correlations"].count() == 2 and got["boundaries"].count() > 0 and got["walk_forward"].count() == 3
    assert AnalysisRequest("", [0], windows=0).problems()
    results = ResultStore(spark, str(tmp_path / "results"))
    results.save("a", "m", 5, {"x": 1})
    results.save("a", "m", 6, {"x": 2})
    results.save("b", "m", 7, {})
    results.delete("b")
    assert [(r.id, r.completed_us) for r in results.history("m").collect()] == [("a", 6)]
