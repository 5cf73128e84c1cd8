"""One object over a point store: ingestion, lookups, analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import boundaries as bo
from .operators import correlation as co
from .operators import movements as mv
from .operators import outliers as ou
from .operators import reports as rp
from .operators import segments as sg
from .operators import validation as va
from .schema import DATA_POINTS, AnalysisRequest, CorrelationKind, DataValidationError, InsufficientDataError
from .sources import store


class Engine:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, store.PointStore(spark, path)

    # ---- ingestion and lookups ----

    def add_point(self, us: int, measurement_id: str, value: float, price: float, atr: float, context: dict | None = None) -> None:
        row = (None, us, measurement_id, float(value), float(price), float(atr), {k: float(v) for k, v in (context or {}).items()})
        refused = self.store.add(self.spark.createDataFrame([row], DATA_POINTS)).first()
        if refused:
            raise DataValidationError(refused.problem)

    def add_points(self, points: DataFrame) -> DataFrame:
        """Returns the refused rows."""
        return self.store.add(points)

    def clear(self) -> None:
        self.store.clear()

    def points(self) -> DataFrame:
        return store.scan(self.store.points())

    def by_measurement(self, measurement_id: str) -> DataFrame:
        return store.by_measurement(self.store.points(), measurement_id)

    def by_time(self, start_us: int, end_us: int) -> DataFrame:
        return store.by_time(self.store.points(), start_us, end_us)

    def statistics(self) -> DataFrame:
        return sg.statistics(self.store.points())

    # ---- analysis ----

    def movements(self, horizons: list[int], by: list[str] | None = None) -> DataFrame:
        return mv.movements(self.store.points(), horizons, by)

    def correlation(self, horizons: list[int], kind: CorrelationKind = CorrelationKind.PEARSON) -> DataFrame:
        return co.correlate(self.movements(horizons), kind, by=["horizon"])

    def boundaries(self, horizon: int, target: float, k: int = 5) -> DataFrame:
        return bo.optimal_boundaries(self.movements([horizon]), target, k)

    def quality(self, horizon: int) -> DataFrame:
        return ou.data_quality(self.movements([horizon]))

    def analyse(self, request: AnalysisRequest) -> dict[str, DataFrame]:
        """correlations per horizon, boundaries on the first horizon and target, walk-forward over the in-sample range, report tables."""
        request.check()
        points = self.store.points()
        moves = mv.movements(points, request.horizons_us)
        first = moves.where(F.col("horizon") == request.horizons_us[0])
        if first.isEmpty():
            raise InsufficientDataError("no movement at the first horizon")
        correlations = co.correlate(moves, by=["horizon"])
        found = rp.with_probability_up(bo.optimal_boundaries(first, request.atr_targets[0], 5), first)
        if request.in_sample:
            period = self.spark.createDataFrame([request.in_sample], "start_us long, end_us long")
        else:
            period = points.agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
        forward = va.walk_forward(points, va.walk_forward_windows(period, request.windows), request.horizons_us[0])
        return {
            "correlations": correlations,
            "boundaries": found,
            "walk_forward": forward,
            "walk_forward_summary": va.walk_forward_summary(forward),
            "table": rp.report_table(found),
            "segments": rp.interpolation_segments(found),
            "report": rp.statistical_report(correlations, co.correlate(moves, CorrelationKind.SPEARMAN, by=["horizon"]), found),
        }
