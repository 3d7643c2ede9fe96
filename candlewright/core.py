"""Shared vocabulary: series key, bar sizes, period scaling, small Column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY = ["symbol", "timeframe"]

# Bar-size tokens and their minutes.
TIMEFRAME_MINUTES = {
    "1m": 1, "3m": 3, "5m": 5, "15m": 15, "30m": 30,
    "1h": 60, "2h": 120, "4h": 240, "6h": 360, "12h": 720,
    "1d": 1440, "3d": 4320, "1w": 10080,
}

BAR_SCHEMA = (
    "symbol string, timeframe string, ts timestamp, "
    "open double, high double, low double, close double, volume double"
)

EPS = 1e-10


def period_scale(timeframe: str, multiplier: float = 1.0) -> float:
    """Periods are stated for one-hour bars; this factor restates them for `timeframe`."""
    return 60.0 / TIMEFRAME_MINUTES.get(timeframe, 60) * multiplier


def scaled(period: int, scale: float, minimum: int = 2) -> int:
    return max(minimum, round(period * scale))


def timeframe_minutes(col: Column) -> Column:
    """Row-wise bar length in minutes; unknown tokens count as one hour."""
    pairs = [F.lit(x) for kv in TIMEFRAME_MINUTES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(60))


def ratio(a, b) -> Column:
    """a / b, NULL when b is zero."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.try_divide(a, b)


def flag(cond: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it is false or unknown."""
    return F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bounds a value and keeps NULL as NULL (greatest/least would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo))))
