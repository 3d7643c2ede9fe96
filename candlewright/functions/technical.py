"""Trend, oscillator, channel and volatility columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F

from candlewright.core import EPS, flag, ratio, scaled
from candlewright.functions import kernels
from candlewright.functions.registry import Catalogue
from candlewright.operators.chunks import diff, lag, order, rolling

c = F.col


def zscore(name: str, n: int) -> Column:
    return ratio(c(name) - rolling(F.avg, name, n), rolling(F.stddev_samp, name, n) + EPS)


def divergence(indicator: str, n: int) -> Column:
    return F.signum(diff(indicator, n)) - F.signum(diff("close", n))


def weighted_mean(name: str, n: int) -> Column:
    """Linear weights 1..n, newest heaviest, from two plain sums over one frame.

    sum(k-th weight * x) = sum(x * pos) - (pos_now - n) * sum(x), with positions counted
    inside the chunk so that the products stay small.
    """
    pos = c("_pos")
    total = rolling(F.sum, c(name) * pos, n) - (pos - n) * rolling(F.sum, name, n)
    return total / (n * (n + 1) / 2.0)


def add_ema(cat: Catalogue, name: str, source: str, span: int) -> None:
    cat.scan(name, source, 1 - 2.0 / (span + 1), 2.0 / (span + 1), 1.0)


def define(cat: Catalogue, s: float) -> None:
    p = lambda n, m=2: scaled(n, s, m)
    col, close, high, low, open_, vol = cat.column, c("close"), c("high"), c("low"), c("open"), c("volume")

    col("_pos", [], lambda: (c("bar_idx") - F.min("bar_idx").over(order().rowsBetween(Window.unboundedPreceding, 0))).cast("double"))
    col("_tp", ["high", "low", "close"], lambda: (high + low + close) / 3)
    col("_range", ["high", "low"], lambda: high - low)
    col("_tr", ["high", "low", "close"], lambda: F.greatest(high - low, F.abs(high - lag("close")), F.abs(low - lag("close"))), 1)

    for n in (10, 20, 50, 100, 200):
        col(f"sma_{n}", ["close"], lambda n=n: rolling(F.avg, "close", p(n)), p(n))
    for n in (9, 10, 20, 21, 50, 100, 200):
        add_ema(cat, f"ema_{n}", "close", p(n))
    for n in (9, 21, 50, 200):
        col(f"dist_ema_{n}", [f"ema_{n}"], lambda n=n: ratio(close - c(f"ema_{n}"), c(f"ema_{n}") + EPS))
    pairs = (("ema_9", "ema_21"), ("ema_21", "ema_50"), ("ema_50", "ema_200"))
    col("ema_alignment", ["ema_9", "ema_21", "ema_50", "ema_200"],
        lambda: sum((F.signum(c(a) - c(b)) for a, b in pairs), F.lit(0.0)).cast("int"))

    n14 = p(14)
    col("wma_14", ["close", "_pos"], lambda: weighted_mean("close", n14), n14)
    col("_wma_half", ["close", "_pos"], lambda: weighted_mean("close", max(1, n14 // 2)), n14)
    col("_hma_raw", ["_wma_half", "wma_14"], lambda: 2 * c("_wma_half") - c("wma_14"))
    col("hma_14", ["_hma_raw", "_pos"], lambda: weighted_mean("_hma_raw", int(math.sqrt(n14))), n14)

    col("_gain", ["close"], lambda: F.when(lag("close").isNotNull(), F.greatest(diff("close"), F.lit(0.0))))
    col("_loss", ["close"], lambda: F.when(lag("close").isNotNull(), F.greatest(-diff("close"), F.lit(0.0))))
    for n in (7, 14, 21):
        col(f"rsi_{n}", ["_gain", "_loss"],
            lambda n=n: 100 - 100 / (1 + rolling(F.avg, "_gain", p(n)) / (rolling(F.avg, "_loss", p(n)) + EPS)), p(n))
    col("rsi_divergence", ["rsi_14"], lambda: divergence("rsi_14", p(5)), p(5))

    add_ema(cat, "_ema_fast", "close", p(12))
    add_ema(cat, "_ema_slow", "close", p(26))
    col("macd", ["_ema_fast", "_ema_slow"], lambda: c("_ema_fast") - c("_ema_slow"))
    add_ema(cat, "macd_signal", "macd", p(9))
    col("macd_hist", ["macd", "macd_signal"], lambda: c("macd") - c("macd_signal"))
    col("macd_hist_slope", ["macd_hist"], lambda: diff("macd_hist"))

    n20, n50 = p(20), p(50)
    col("_bb_mid", ["close"], lambda: rolling(F.avg, "close", n20), n20)
    col("_bb_sd", ["close"], lambda: rolling(F.stddev_samp, "close", n20), n20)
    col("bb_upper", ["_bb_mid", "_bb_sd"], lambda: c("_bb_mid") + 2 * c("_bb_sd"))
    col("bb_lower", ["_bb_mid", "_bb_sd"], lambda: c("_bb_mid") - 2 * c("_bb_sd"))
    col("bb_width", ["bb_upper", "bb_lower"], lambda: ratio(c("bb_upper") - c("bb_lower"), c("_bb_mid") + EPS))
    col("bb_position", ["bb_upper", "bb_lower"], lambda: ratio(close - c("bb_lower"), c("bb_upper") - c("bb_lower") + EPS))
    col("bb_squeeze", ["bb_width"], lambda: F.coalesce(c("bb_width") < rolling(F.avg, "bb_width", n50) * 0.8, F.lit(False)), n50)

    for n in (7, 14, 21):
        add_ema(cat, f"atr_{n}", "_tr", p(n))
    add_ema(cat, "_atr_10", "_tr", p(10))
    col("kc_upper", ["ema_20", "atr_14"], lambda: c("ema_20") + 1.5 * c("atr_14"))
    col("kc_lower", ["ema_20", "atr_14"], lambda: c("ema_20") - 1.5 * c("atr_14"))
    col("kc_squeeze", ["kc_upper", "kc_lower", "bb_upper", "bb_lower"],
        lambda: F.coalesce((c("bb_upper") < c("kc_upper")) & (c("bb_lower") > c("kc_lower")), F.lit(False)))
    col("atr_pct", ["atr_14"], lambda: ratio(c("atr_14"), close + EPS))
    col("atr_z", ["atr_14"], lambda: zscore("atr_14", n50), n50)

    # Equal moves keep the minus side, because it is compared with a plus side that has
    # already been zeroed.
    col("_up", ["high"], lambda: F.greatest(high - lag("high"), F.lit(0.0)), 1)
    col("_down", ["low"], lambda: F.greatest(lag("low") - low, F.lit(0.0)), 1)
    col("_dm_plus", ["_up", "_down"], lambda: F.when(c("_up") > c("_down"), c("_up")).otherwise(0.0))
    col("_dm_minus", ["_dm_plus", "_down"], lambda: F.when(c("_down") > c("_dm_plus"), c("_down")).otherwise(0.0))
    for side, out in (("_dm_plus", "di_plus"), ("_dm_minus", "di_minus")):
        add_ema(cat, f"{side}_ema", side, n14)
        col(out, [f"{side}_ema", "atr_14"], lambda side=side: 100 * c(f"{side}_ema") / (c("atr_14") + EPS))
    col("_dx", ["di_plus", "di_minus"], lambda: 100 * F.abs(c("di_plus") - c("di_minus")) / (c("di_plus") + c("di_minus") + EPS))
    add_ema(cat, "adx", "_dx", n14)
    col("di_delta", ["di_plus", "di_minus"], lambda: c("di_plus") - c("di_minus"))

    cat.array("_st_lower", kernels.band, ["high", "low", "close", "_atr_10"], "lower", lookback=1)
    cat.array("_st_upper", kernels.band, ["high", "low", "close", "_atr_10"], "upper", lookback=1)
    cat.array("supertrend_dir", kernels.band_side, ["_st_lower", "_st_upper"])
    col("supertrend", ["supertrend_dir", "_st_lower", "_st_upper"],
        lambda: F.when(c("bar_idx") > 0, F.when(c("supertrend_dir") == 1, c("_st_lower")).otherwise(c("_st_upper"))))

    def cci() -> Column:
        w = order().rowsBetween(-(n20 - 1), 0)
        mean = F.avg("_tp").over(w)
        dev = F.aggregate(F.collect_list("_tp").over(w), F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n20
        return F.when(F.count("_tp").over(w) == n20, (c("_tp") - mean) / (0.015 * dev + EPS))

    col("cci_20", ["_tp"], cci, n20)

    def hh(n: int) -> Column:
        return rolling(F.max, "high", n)

    def ll(n: int) -> Column:
        return rolling(F.min, "low", n)

    col("willr_14", ["high", "low"], lambda: -100 * (hh(n14) - close) / (hh(n14) - ll(n14) + EPS), n14)
    for n in (5, 10, 20):
        col(f"roc_{n}", ["close"], lambda n=n: (ratio(close, lag("close", p(n))) - 1) * 100, p(n))
    col("momentum_10", ["close"], lambda: diff("close", p(10)), p(10))

    col("donchian_high_20", ["high"], lambda: hh(n20), n20)
    col("donchian_low_20", ["low"], lambda: ll(n20), n20)
    dh, dl = c("donchian_high_20"), c("donchian_low_20")
    dch = ["donchian_high_20", "donchian_low_20"]
    col("donchian_mid_20", dch, lambda: (dh + dl) / 2)
    col("donchian_width", dch, lambda: ratio(dh - dl, (dh + dl) / 2 + EPS))
    col("donchian_pos", dch, lambda: (close - dl) / (dh - dl + EPS))
    col("at_donchian_high", dch, lambda: F.when(close >= lag("donchian_high_20"), 1).otherwise(0))
    col("at_donchian_low", dch, lambda: F.when(close <= lag("donchian_low_20"), 1).otherwise(0))

    col("stoch_k", ["high", "low"], lambda: 100 * (close - ll(n14)) / (hh(n14) - ll(n14) + EPS), n14)
    col("stoch_d", ["stoch_k"], lambda: rolling(F.avg, "stoch_k", p(3)), p(3))
    col("_stoch_sign", ["stoch_k", "stoch_d"], lambda: F.signum(c("stoch_k") - c("stoch_d")))
    col("stoch_cross", ["_stoch_sign"], lambda: c("_stoch_sign") - lag("_stoch_sign"))

    # NULL comparisons count as 0 here, as on the first bar
    col("_mf_pos", ["_tp"], lambda: F.when(c("_tp") > lag("_tp"), c("_tp") * vol).otherwise(0.0))
    col("_mf_neg", ["_tp"], lambda: F.when(c("_tp") < lag("_tp"), c("_tp") * vol).otherwise(0.0))
    col("mfi_14", ["_mf_pos", "_mf_neg"],
        lambda: 100 - 100 / (1 + rolling(F.sum, "_mf_pos", n14) / (rolling(F.sum, "_mf_neg", n14) + EPS)), n14)

    for n in (1, 3, 5, 10):
        k = 1 if n == 1 else p(n)
        col(f"log_return_{n}", ["close"], lambda k=k: F.ln(ratio(close, lag("close", k))), k)
    col("realized_vol_20", ["log_return_1"], lambda: rolling(F.stddev_samp, "log_return_1", n20) * math.sqrt(252), n20)

    col("body", ["open", "close"], lambda: F.abs(close - open_))
    col("body_ratio", ["body"], lambda: c("body") / (high - low + EPS))
    col("upper_wick", ["open", "close"], lambda: high - F.greatest(open_, close))
    col("lower_wick", ["open", "close"], lambda: F.least(open_, close) - low)
    col("candle_dir", ["open", "close"], lambda: F.signum(close - open_))
    cat.array("consec_bull", kernels.run_length, ["open", "close"], "bull")
    cat.array("consec_bear", kernels.run_length, ["open", "close"], "bear")

    a, b, d = p(9), p(26), p(52)
    col("ichi_tenkan", ["high", "low"], lambda: (hh(a) + ll(a)) / 2, a)
    col("ichi_kijun", ["high", "low"], lambda: (hh(b) + ll(b)) / 2, b)
    col("_senkou_a", ["ichi_tenkan", "ichi_kijun"], lambda: (c("ichi_tenkan") + c("ichi_kijun")) / 2)
    col("_senkou_b", ["high", "low"], lambda: (hh(d) + ll(d)) / 2, d)
    col("ichi_above_cloud", ["_senkou_a", "_senkou_b"],
        lambda: flag((close > lag("_senkou_a", b)) & (close > lag("_senkou_b", b))), b)
    col("_tk_sign", ["ichi_tenkan", "ichi_kijun"], lambda: F.signum(c("ichi_tenkan") - c("ichi_kijun")))
    col("ichi_tk_cross", ["_tk_sign"], lambda: c("_tk_sign") - lag("_tk_sign"))


# The names of the columns.
NAMES = (
    "sma_10", "ema_10", "sma_20", "ema_20", "sma_50", "ema_50", "sma_100", "ema_100", "sma_200", "ema_200", "wma_14",
    "hma_14", "ema_9", "dist_ema_9", "ema_21", "dist_ema_21", "dist_ema_50", "dist_ema_200", "ema_alignment", "rsi_7",
    "rsi_14", "rsi_21", "rsi_divergence", "macd", "macd_signal", "macd_hist", "macd_hist_slope", "bb_upper",
    "bb_lower", "bb_width", "bb_position", "bb_squeeze", "atr_14", "kc_upper", "kc_lower", "kc_squeeze", "atr_7",
    "atr_21", "atr_pct", "atr_z", "adx", "di_plus", "di_minus", "di_delta", "supertrend", "supertrend_dir", "cci_20",
    "willr_14", "roc_5", "roc_10", "roc_20", "momentum_10", "donchian_high_20", "donchian_low_20", "donchian_mid_20",
    "donchian_width", "donchian_pos", "at_donchian_high", "at_donchian_low", "stoch_k", "stoch_d", "stoch_cross",
    "mfi_14", "log_return_1", "log_return_3", "log_return_5", "log_return_10", "realized_vol_20", "body",
    "body_ratio", "upper_wick", "lower_wick", "candle_dir", "consec_bull", "consec_bear", "ichi_tenkan", "ichi_kijun",
    "ichi_above_cloud", "ichi_tk_cross",
)
