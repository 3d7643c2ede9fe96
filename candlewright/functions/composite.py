"""Candle code, regime vote and the three composite scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from candlewright.core import EPS, clip, flag, scaled
from candlewright.functions.registry import Catalogue
from candlewright.functions.technical import zscore
from candlewright.operators.chunks import rolling

c = F.col


def candle_code() -> Column:
    body, atr = F.abs(c("close") - c("open")), c("atr_14")
    return F.concat(
        F.when(c("close") >= c("open"), "B").otherwise("S"),
        F.when(body < 0.3 * atr, "1").when(body < 0.8 * atr, "2").otherwise("3"),
        F.when(c("high") - c("low") < atr, "L").otherwise("H"),
    )


def regime() -> Column:
    """Majority of trend, range and chaos votes; ties go to chaos, then range."""
    trend = flag(c("adx") > 25) + flag(c("hurst_60") > 0.55) + flag(c("phase_regime") == 1)
    range_ = flag(c("adx") < 20) + flag(c("hurst_60") < 0.45)
    chaos = flag(c("phase_regime") == -1) + flag(c("entropy_20") > c("_entropy_mean") * 1.2)
    return (
        F.when((chaos >= trend) & (chaos >= range_), "CHAOS")
        .when(range_ >= trend, "RANGE")
        .otherwise("TREND")
    )


def define(cat: Catalogue, s: float) -> None:
    n50 = scaled(50, s)
    cat.column("dna_code", ["open", "close", "high", "low", "atr_14"], candle_code)
    cat.column("regime", ["adx", "hurst_60", "phase_regime", "entropy_20", "_entropy_mean"], regime)
    cat.column("trend_score", ["ema_alignment", "supertrend_dir", "adx", "di_delta", "ichi_above_cloud", "struct_score"],
               lambda: clip(
                   c("ema_alignment") + c("supertrend_dir") * 2
                   + F.signum("di_delta") * clip(c("adx") - 20, 0, 30) / 30 * 2
                   + (c("ichi_above_cloud") * 2 - 1) + clip(c("struct_score").cast("double"), -2, 2) * 0.5, -10, 10))
    cat.column("_macd_sd", ["macd_hist"], lambda: rolling(F.stddev_samp, "macd_hist", n50), n50)
    cat.column("momentum_score", ["rsi_14", "macd_hist", "_macd_sd", "stoch_k", "cci_20"],
               lambda: clip(
                   (c("rsi_14") - 50) / 10 + clip(c("macd_hist") / (c("_macd_sd") + EPS), -3, 3)
                   + (c("stoch_k") - 50) / 25 + clip(c("cci_20") / 100, -2, 2), -10, 10))
    cat.column("_cct_z", ["cct"], lambda: zscore("cct", n50), n50)
    cat.column("move_readiness", ["kc_squeeze", "entropy_squeeze", "_cct_z", "volume_dry_up", "atr_z", "hurst_60"],
               lambda: clip(
                   c("kc_squeeze").cast("double") * 2 + c("entropy_squeeze") * 2 + clip(c("_cct_z"), 0, 2)
                   + c("volume_dry_up") * 1.5 + clip(-c("atr_z"), 0, 2)
                   + clip(1 - F.abs(c("hurst_60") - 0.5) * 4, 0, 1), 0, 10))


# The names of the columns.
NAMES = ("dna_code", "regime", "trend_score", "momentum_score", "move_readiness")
