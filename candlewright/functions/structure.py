"""Swings, structure, gaps, breakouts, candle shapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from candlewright.core import EPS, flag, ratio, scaled
from candlewright.functions import kernels
from candlewright.functions.registry import Catalogue
from candlewright.operators.chunks import lag, order, rolling, trailing

c = F.col


def pivot(fn, name: str, k: int) -> Column:
    """The value is the extreme of the k bars on either side; False at the ends."""
    w = order().rowsBetween(-k, k)
    return F.coalesce((F.count(name).over(w) == 2 * k + 1) & (c(name) == fn(name).over(w)), F.lit(False))


def define(cat: Catalogue, s: float) -> None:
    p = lambda n, m=2: scaled(n, s, m)
    col, close, high, low, open_ = cat.column, c("close"), c("high"), c("low"), c("open")

    k = p(3, 1)
    col("swing_high", ["high"], lambda: pivot(F.max, "high", k), k, causal=False)
    col("swing_low", ["low"], lambda: pivot(F.min, "low", k), k, causal=False)
    # Price of the latest pivot once its right-hand bars have closed.
    cat.array("last_swing_high", kernels.latest_pivot, ["high"], "last_swing_high", k, lookback=2 * k)
    cat.array("last_swing_low", kernels.latest_pivot, ["low"], "last_swing_low", k, lookback=2 * k)

    n = p(10)
    half = max(1, n // 2)
    early = lambda fn: fn("close").over(order().rowsBetween(-n, -half - 1))
    late = lambda fn: fn("close").over(order().rowsBetween(-half, -1))
    full = lambda cond: flag((c("bar_idx") >= n) & cond)
    col("struct_hh", ["close"], lambda: full(late(F.max) > early(F.max)), n)
    col("struct_hl", ["close"], lambda: full(late(F.min) > early(F.min)), n)
    col("struct_ll", ["close"], lambda: full(late(F.min) < early(F.min)), n)
    col("struct_lh", ["close"], lambda: full(late(F.max) < early(F.max)), n)
    col("struct_score", ["struct_hh", "struct_hl", "struct_ll", "struct_lh"],
        lambda: (c("struct_hh") + c("struct_hl") - c("struct_ll") - c("struct_lh")).cast("int"))

    for name in ("dist_to_nearest_resistance", "dist_to_nearest_support"):
        cat.array(name, kernels.level_distance, ["high", "low", "close"], name, k, lookback=k, causal=False)

    col("fvg_bull", ["high", "low"], lambda: flag(lag("high", 2) < low), 2)
    col("fvg_bear", ["high", "low"], lambda: flag(lag("low", 2) > high), 2)
    col("in_fvg", ["fvg_bull", "fvg_bear"], lambda: F.greatest("fvg_bull", "fvg_bear"))

    for name in ("bull_ob", "bear_ob"):
        cat.array(name, kernels.order_block_retest, ["open", "high", "low", "close"], name, p(5), p(50), lookback=p(5))

    for n_ in (10, 20):
        col(f"breakout_up_{n_}", ["close"], lambda n_=n_: flag(close > trailing(F.max, "close", p(n_))), p(n_))
        col(f"breakout_down_{n_}", ["close"], lambda n_=n_: flag(close < trailing(F.min, "close", p(n_))), p(n_))

    col("gap_up", ["open", "close"], lambda: flag(open_ > lag("close") * 1.002))
    col("gap_down", ["open", "close"], lambda: flag(open_ < lag("close") * 0.998))
    col("gap_pct", ["open", "close"], lambda: ratio(open_ - lag("close"), lag("close") + EPS))

    n20 = p(20)
    col("vwap_20", ["_tp", "volume"],
        lambda: ratio(rolling(F.sum, c("_tp") * c("volume"), n20), rolling(F.sum, "volume", n20) + EPS), n20)
    col("price_vs_vwap", ["vwap_20"], lambda: ratio(close - c("vwap_20"), c("vwap_20") + EPS))
    for n_ in (10, 20):
        col(f"range_compression_{n_}", ["_range"], lambda n_=n_: c("_range") / (rolling(F.avg, "_range", p(n_)) + EPS), p(n_))
    col("inside_bar", ["high", "low"], lambda: flag((high < lag("high")) & (low > lag("low"))))
    col("outside_bar", ["high", "low"], lambda: flag((high > lag("high")) & (low < lag("low"))))
    wicks = ["body", "upper_wick", "lower_wick"]
    col("pin_bar_bull", wicks, lambda: flag(
        (c("lower_wick") > 2 * c("body")) & (c("lower_wick") > c("upper_wick") * 2) & (high - low > 0)))
    col("pin_bar_bear", wicks, lambda: flag(
        (c("upper_wick") > 2 * c("body")) & (c("upper_wick") > c("lower_wick") * 2) & (high - low > 0)))
    col("bull_engulf", ["open", "close"], lambda: flag(
        (close > open_) & (lag("close") < lag("open")) & (open_ < lag("close")) & (close > lag("open"))))
    col("bear_engulf", ["open", "close"], lambda: flag(
        (close < open_) & (lag("close") > lag("open")) & (open_ > lag("close")) & (close < lag("open"))))
    n50 = p(50)
    col("range_position_50", ["high", "low"], lambda: (close - rolling(F.min, "low", n50))
        / (rolling(F.max, "high", n50) - rolling(F.min, "low", n50) + EPS), n50)


# The names of the columns.
NAMES = (
    "swing_high", "swing_low", "struct_hh", "struct_hl", "struct_ll", "struct_lh", "struct_score",
    "dist_to_nearest_resistance", "dist_to_nearest_support", "fvg_bull", "fvg_bear", "in_fvg", "bull_ob", "bear_ob",
    "breakout_up_10", "breakout_down_10", "breakout_up_20", "breakout_down_20", "gap_up", "gap_down", "gap_pct",
    "vwap_20", "price_vs_vwap", "range_compression_10", "range_compression_20", "inside_bar", "outside_bar",
    "pin_bar_bull", "pin_bar_bear", "bull_engulf", "bear_engulf", "range_position_50",
)
