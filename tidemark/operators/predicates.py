"""Scalar predicates on measurements, prices and statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def within(v: Column, low, high) -> Column:
    return v.between(low, high)


def is_significant(p: Column, alpha: float = 0.05) -> Column:
    return p < alpha


def is_strong(r: Column, threshold: float = 0.3) -> Column:
    return F.abs(r) > threshold


def meets_correlation(r: Column, threshold: float = 0.5) -> Column:
    """Signed: a strong negative correlation doesn't meet it."""
    return r >= threshold


def sufficient(n: Column, least: int) -> Column:
    return n >= least


def adequate(n: Column, least: int = 100) -> Column:
    return n >= least


def acceptable_degradation(d: Column, most: float = 0.3) -> Column:
    return d <= most


def bullish_range(v: Column, low: float = 60, high: float = 70) -> Column:
    return v.between(low, high)


def bearish_range(v: Column, low: float = 30, high: float = 40) -> Column:
    return v.between(low, high)


def bullish_signal(v: Column, price: Column, atr: Column) -> Column:
    return bullish_range(v) & (price > 0) & (atr > 0)


def bearish_signal(v: Column, price: Column, atr: Column) -> Column:
    return bearish_range(v) & (price > 0) & (atr > 0)


def requires_optimization(r: Column, n: Column, degradation: Column) -> Column:
    return ~meets_correlation(r) | ~adequate(n) | ~acceptable_degradation(degradation)


def tradable(v: Column, price: Column, atr: Column, r: Column, n: Column) -> Column:
    return (bullish_range(v) | bearish_range(v)) & (price > 0) & (atr > 0) & is_strong(r) & adequate(n)


def significant_correlation(r: Column, p: Column, threshold: float = 0.3) -> Column:
    return is_strong(r, threshold) & is_significant(p)


def valid_input(n: Column, variance: Column) -> Column:
    return adequate(n, 30) & (variance > 0)


def alert(r: Column, threshold: float, p: Column) -> Column:
    return meets_correlation(r, threshold) & is_significant(p)


def out_of_bounds(v: Column, low, high) -> Column:
    return ~v.between(low, high)


def requires_rebalancing(degradation: Column, days: Column, most: int = 30) -> Column:
    return ~acceptable_degradation(degradation) | (days >= most)


def deviation_severity(d: Column) -> Column:
    """Of an alert: Critical above 0.5, High above 0.2, Medium above 0.1, else Low."""
    return F.when(d > 0.5, "Critical").when(d > 0.2, "High").when(d > 0.1, "Medium").otherwise("Low")
