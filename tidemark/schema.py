"""Schemas, defaults and requests of the signal engine."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

DATA_POINTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("us", T.LongType()),
        T.StructField("measurement_id", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("atr", T.DoubleType()),
        T.StructField("context", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
MULTI_POINTS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("us", T.LongType()),
        T.StructField("measurements", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("price", T.DoubleType()),
        T.StructField("atr", T.DoubleType()),
        T.StructField("context", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
BOUNDARIES = "low double, high double, confidence double, expected double, n long, hit double, p_up double, method string"

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


class EngineError(Exception):
    """Base of the engine's errors."""


class DataValidationError(EngineError):
    pass


class InsufficientDataError(EngineError):
    pass


class ConvergenceError(EngineError):
    pass


class ConfigurationError(EngineError):
    pass


class CorrelationKind(Enum):
    PEARSON = "pearson"
    SPEARMAN = "spearman"
    KENDALL = "kendall"  # served by rank correlation, as the compatible behaviour


class OutlierMethod(Enum):
    IQR = "iqr"
    ZSCORE = "zscore"
    MODIFIED_ZSCORE = "mad"
    ISOLATION = "isolation"
    ENSEMBLE = "ensemble"


class OutlierHandling(Enum):
    REMOVE = "remove"
    CAP = "cap"
    MEDIAN = "median"
    LOG = "log"
    FLAG = "flag"


class Objective(Enum):
    HIGHEST_WIN_RATE = "HighestWinRate"
    LARGE_MOVE = "LargeMoveProbability"
    CONSISTENT = "ConsistentResults"
    RISK_ADJUSTED = "RiskAdjustedReturn"


@dataclass(frozen=True)
class Defaults:
    """Fixed values that results depend on."""

    alpha: float = 0.05
    confidence_level: float = 0.95
    minimum_correlation: float = 0.1
    z_threshold: float = 2.5
    modified_z_threshold: float = 3.5
    iqr_multiplier: float = 1.5
    contamination: float = 0.1
    consensus: float = 0.5
    capping: float = 0.05
    max_outlier_share: float = 0.15
    minimum_detection: int = 30
    ensemble_from: int = 100
    max_ranges: int = 100
    max_depth: int = 20
    max_iterations: int = 1000
    convergence: float = 1e-3
    degradation: float = 0.3
    max_windows: int = 100
    train_share: float = 0.6
    test_share: float = 0.4
    advance: float = 0.8
    trade_scale: float = 0.01
    minimum_expected: float = 0.1


DEFAULTS = Defaults()


@dataclass
class AnalysisRequest:
    """What one analysis of a measurement asks for; ``problems`` keeps the messages of failed checks."""

    measurement_id: str
    horizons_us: list[int] = field(default_factory=lambda: [30 * MINUTE])
    atr_targets: list[float] = field(default_factory=lambda: [1.0])
    thresholds: list[float] = field(default_factory=list)
    weights: dict[str, float] = field(default_factory=dict)
    windows: int = 10
    in_sample: tuple[int, int] | None = None
    out_of_sample: tuple[int, int] | None = None

    def problems(self) -> list[str]:
        out = []
        if not (self.measurement_id or "").strip():
            out.append("measurement id is blank")
        if not self.horizons_us:
            out.append("no time horizon")
        if any(not MINUTE <= h <= 365 * DAY for h in self.horizons_us):
            out.append("a time horizon is outside 1 minute to 365 days")
        if len(set(self.horizons_us)) < len(self.horizons_us):
            out.append("a time horizon repeats")
        if any(t < 0 for t in self.atr_targets):
            out.append("an ATR target is negative")
        if len(set(self.thresholds)) < len(self.thresholds):
            out.append("a context threshold repeats")
        if any(not 0 <= w <= 1 for w in self.weights.values()):
            out.append("a weight is outside 0 to 1")
        if self.weights and abs(sum(self.weights.values()) - 1) > 0.01:
            out.append("weights do not sum to 1")
        if not 0 < self.windows <= DEFAULTS.max_windows:
            out.append(f"window count is outside 1 to {DEFAULTS.max_windows}")
        for name, r in (("in-sample", self.in_sample), ("out-of-sample", self.out_of_sample)):
            if r and r[0] >= r[1]:
                out.append(f"{name} range is empty")
        if self.in_sample and self.out_of_sample and self.in_sample[0] <= self.out_of_sample[1] and self.out_of_sample[0] <= self.in_sample[1]:
            out.append("in-sample and out-of-sample ranges overlap")
        return out

    def check(self) -> None:
        if found := self.problems():
            raise DataValidationError("; ".join(found))
