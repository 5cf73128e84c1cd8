"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import correlation, movements
from ..schema import HOUR, MINUTE
from ..sources.adapters import event_points
from . import basic, modelling, statistical  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of movements per measurement and horizon, correlated, with significance."""
    moves = movements.movements(event_points(spark, sf_dir), [30 * MINUTE, HOUR, 4 * HOUR], by=["measurement_id"])
    return correlation.correlate(moves, by=["measurement_id", "horizon"])


def engine_queries():
    return dict(QUERIES)


def engine_sql():
    return dict(SQL)
