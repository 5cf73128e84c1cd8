"""Stores of points and results over Parquet folders, and their lookups."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DATA_POINTS, MULTI_POINTS, DataValidationError


def validated(points: DataFrame) -> DataFrame:
    """``points`` plus ``problem``: null, or why ingestion refuses the row."""
    checks = [
        (F.trim(F.coalesce("measurement_id", F.lit(""))) == "", "blank measurement id"),
        (F.col("price") < 0, "negative price"),
        (F.col("atr") < 0, "negative ATR"),
    ]
    problem = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        problem = F.when(bad, why).otherwise(problem)
    return points.withColumn("problem", problem)


def validated_multi(points: DataFrame) -> DataFrame:
    empty = F.col("measurements").isNull() | (F.size("measurements") == 0)
    return points.withColumn(
        "problem",
        F.when(empty, "no measurements").when(F.col("price") < 0, "negative price").when(F.col("atr") < 0, "negative ATR"),
    )


def with_ids(points: DataFrame) -> DataFrame:
    """Rows without an id get one of measurement, time and a random part."""
    made = F.concat_ws("_", "measurement_id", F.date_format(F.timestamp_micros("us"), "yyyyMMddHHmmss"), F.uuid())
    return points.withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", made).otherwise(F.col("id")))


def scan(points: DataFrame) -> DataFrame:
    return points.orderBy("us", "id")


def by_measurement(points: DataFrame, measurement_id: str) -> DataFrame:
    return scan(points.where(F.col("measurement_id") == measurement_id))


def by_time(points: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Both ends included."""
    if start_us > end_us:
        raise DataValidationError("start is after end")
    return scan(points.where(F.col("us").between(start_us, end_us)))


def by_measurement_and_time(points: DataFrame, measurement_id: str, start_us: int, end_us: int) -> DataFrame:
    return by_time(points.where(F.col("measurement_id") == measurement_id), start_us, end_us)


def by_predicate(points: DataFrame, predicate: Column | str) -> DataFrame:
    return scan(points.where(predicate))


def containing(points: DataFrame, name: str) -> DataFrame:
    return scan(points.where(F.map_contains_key("measurements", F.lit(name))))


def by_id(points: DataFrame, id_) -> DataFrame:
    return points.where(F.col("id") == id_).orderBy("us").limit(1)


def exists(points: DataFrame, id_) -> DataFrame:
    """One row, ``found``."""
    return points.where(F.col("id") == id_).agg((F.count(F.lit(1)) > 0).alias("found"))


def history(results: DataFrame, key: str, at: str, value: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Results of one key, the newest first; the bounds, both included, may be open."""
    out = results.where(F.col(key) == value)
    out = out if start_us is None else out.where(F.col(at) >= start_us)
    out = out if end_us is None else out.where(F.col(at) <= end_us)
    return out.orderBy(F.desc(at), "id")


class PointStore:
    """Data points in a Parquet folder, partitioned by measurement."""

    schema = DATA_POINTS
    partitions = ["measurement_id"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _check(self, points: DataFrame) -> DataFrame:
        return validated(points)

    def add(self, points: DataFrame) -> DataFrame:
        """Append the valid rows; returns the refused ones with ``problem``."""
        checked = self._check(points.select(*self.schema.names))
        good = checked.where("problem is null").drop("problem")
        good = with_ids(good) if "measurement_id" in good.columns else good
        good.withColumn("context", F.coalesce("context", F.expr("cast(map() as map<string,double>)"))).write.mode(
            "append"
        ).partitionBy(*self.partitions).parquet(self.path)
        return checked.where("problem is not null")

    def points(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def delete(self, id_) -> None:
        raise NotImplementedError("points are append-only")

    def clear(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)


class MultiPointStore(PointStore):
    schema = MULTI_POINTS
    partitions: list[str] = []

    def _check(self, points: DataFrame) -> DataFrame:
        return validated_multi(points)


class ResultStore:
    """Analysis results by id: a later save of an id replaces it."""

    schema = "id string, measurement_id string, completed_us long, body string, version long, gone boolean"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(self.path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _version(self) -> int:
        try:
            return (self._all().agg(F.max("version")).first()[0] or 0) + 1
        except Exception as e:  # nothing is saved yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 1

    def save(self, id_: str, measurement_id: str, completed_us: int, body: dict) -> None:
        self._append([(id_, measurement_id, completed_us, json.dumps(body, sort_keys=True), self._version(), False)])

    def delete(self, id_: str) -> None:
        self._append([(id_, None, None, None, self._version(), True)])

    def results(self) -> DataFrame:
        latest = self._all().groupBy("id").agg(F.max_by(F.struct("measurement_id", "completed_us", "body", "gone"), "version").alias("r"))
        return latest.where("not r.gone").select("id", "r.measurement_id", "r.completed_us", "r.body")

    def history(self, measurement_id: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        return history(self.results(), "measurement_id", "completed_us", measurement_id, start_us, end_us)
