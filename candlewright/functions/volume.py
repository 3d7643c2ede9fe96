"""Volume flow, pressure and profile columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.core import EPS, flag, ratio, scaled
from candlewright.functions import kernels
from candlewright.functions.registry import Catalogue
from candlewright.functions.technical import divergence, zscore
from candlewright.operators.chunks import diff, lag, rolling

c = F.col


def define(cat: Catalogue, s: float) -> None:
    p = lambda n, m=2: scaled(n, s, m)
    col, close, high, low, open_, vol = cat.column, c("close"), c("high"), c("low"), c("open"), c("volume")

    cat.array("obv", kernels.signed_volume_total, ["close", "volume"], "obv", lookback=1)
    col("obv_slope", ["obv"], lambda: diff("obv", p(5)), p(5))
    col("obv_z", ["obv"], lambda: zscore("obv", p(20)), p(20))

    n20 = p(20)
    col("volume_ratio", ["volume"], lambda: vol / (rolling(F.avg, "volume", n20) + EPS), n20)
    col("volume_z", ["volume"], lambda: zscore("volume", n20), n20)
    col("volume_surge", ["volume_ratio"], lambda: flag(c("volume_ratio") > 2.0))
    col("volume_dry_up", ["volume_ratio"], lambda: flag(c("volume_ratio") < 0.5))
    col("vol_declining_3", ["volume"], lambda: flag(
        (vol < lag("volume")) & (lag("volume") < lag("volume", 2)) & (lag("volume", 2) < lag("volume", 3))), 3)

    cat.array("cvd", kernels.signed_volume_total, ["open", "close", "volume"], "cvd")
    col("cvd_slope", ["cvd"], lambda: diff("cvd", p(5)), p(5))
    col("cvd_divergence", ["cvd"], lambda: divergence("cvd", p(5)), p(5))
    col("vol_confirm", ["volume_ratio"], lambda: F.signum(close - open_) * c("volume_ratio"))

    cat.array("volume_entropy", kernels.histogram_entropy, ["volume"], "volume", n20, 8, True, lookback=n20)
    for n in (20, 50):
        cat.array(f"vol_poc_{n}", kernels.point_of_control, ["high", "low", "close", "volume"], p(n), 20, lookback=p(n))
        col(f"price_vs_poc_{n}", [f"vol_poc_{n}"], lambda n=n: ratio(close - c(f"vol_poc_{n}"), c(f"vol_poc_{n}") + EPS))
    col("mfi_divergence", ["mfi_14"], lambda: divergence("mfi_14", p(5)), p(5))

    col("buy_pressure", ["volume"], lambda: vol * ((close - low) / (high - low + EPS)))
    col("sell_pressure", ["volume"], lambda: vol * ((high - close) / (high - low + EPS)))
    col("pressure_ratio", ["buy_pressure", "sell_pressure"], lambda: c("buy_pressure") / (c("sell_pressure") + EPS))
    col("cum_pressure_slope", ["buy_pressure", "sell_pressure"],
        lambda: rolling(F.sum, c("buy_pressure") - c("sell_pressure"), p(10)), p(10))
    col("institutional_candle", ["volume_ratio"], lambda: flag(
        (c("volume_ratio") > 2.0) & (F.abs(close - open_) / (high - low + EPS) > 0.6)))
    col("vol_slope_5", ["volume"], lambda: diff("volume", p(5)), p(5))
    col("vol_slope_10", ["volume"], lambda: diff("volume", p(10)), p(10))


# The names of the columns.
NAMES = (
    "obv", "obv_slope", "obv_z", "volume_ratio", "volume_z", "volume_surge", "volume_dry_up", "vol_declining_3",
    "cvd", "cvd_slope", "cvd_divergence", "vol_confirm", "volume_entropy", "vol_poc_20", "price_vs_poc_20",
    "vol_poc_50", "price_vs_poc_50", "mfi_divergence", "buy_pressure", "sell_pressure", "pressure_ratio",
    "cum_pressure_slope", "institutional_candle", "vol_slope_5", "vol_slope_10",
)
