"""Stops and targets per strategy, liquidity targets, and position size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

c = F.col


def _side(up: Column) -> Column:
    return F.when(up, 1.0).otherwise(-1.0)


def _far_enough(price: Column, entry: Column, up: Column, toward: int, min_pct: float = 0.1) -> Column:
    """At least min_pct away and on the right side (toward = -1: stop, +1: target)."""
    gap = (price - entry) * _side(up) * toward
    return F.coalesce((F.abs(entry - price) / entry * 100 >= min_pct) & (gap > 0), F.lit(False))


def _plan(sl, tp, trailing, activation, pct, sl_source, tp_source) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        sl.alias("sl_price"), (none if tp is None else tp).alias("tp_price"), F.lit(trailing).alias("use_trailing"),
        (none if activation is None else activation).alias("trailing_activation_price"), F.lit(float(pct)).alias("trailing_pct"),
        (F.lit(sl_source) if isinstance(sl_source, str) else sl_source).alias("sl_source"), F.lit(tp_source).alias("tp_source") if isinstance(tp_source, str) else tp_source.alias("tp_source"))


def trade_levels(df: DataFrame) -> DataFrame:
    """Adds `plan` to rows with strategy, move_type, side ('long'/'short'), entry, sl_pct,
    tp_rr and the columns atr_14, vwap_20, vol_poc_20, ema_20, bb_upper, bb_lower,
    last_swing_low, last_swing_high.

    Swings enter as prices and the squeeze uses the band distance as a price.
    """
    e, up, slp, rr = c("entry"), c("side") == "long", c("sl_pct"), c("tp_rr")
    s = _side(up)

    def fixed(ratio):
        d = e * slp / 100
        return _plan(e - s * d, e + s * d * ratio, False, None, 0.0, "config", "config")

    swing = F.when(up, c("last_swing_low")).otherwise(c("last_swing_high"))

    def behind_swing(slack, extra):
        cand = swing * F.when(up, 1 - slack).otherwise(1 + slack)
        ok = _far_enough(cand, e, up, -1)
        return F.when(ok, cand).otherwise(e - s * e * slp * extra / 100), F.when(ok, "swing").otherwise("config")

    sl_b, src_b = behind_swing(0.002, 1.2)
    breakout = _plan(sl_b, None, True, e + s * F.abs(e - sl_b) * 1.5, 0.8, src_b, "trailing")

    atr_ok = F.coalesce(c("atr_14") > 0, F.lit(False))

    def by_atr(stop, target, source):
        sl, tp = e - s * stop * c("atr_14"), e + s * target * c("atr_14")
        return atr_ok & _far_enough(sl, e, up, -1) & _far_enough(tp, e, up, 1), _plan(sl, tp, False, None, 0.0, source, source)

    m_ok, m_plan = by_atr(1.5, 2.5, "atr")
    momentum = F.when(m_ok, m_plan).otherwise(fixed(rr))
    x_ok, x_plan = by_atr(2.0, 3.0, "atr")
    complexity = F.when(x_ok, x_plan).otherwise(fixed(F.least(rr, F.lit(1.5))))

    d = F.when(atr_ok, 1.5 * c("atr_14")).otherwise(e * slp / 100)
    sl_o = e - s * d
    magnet = liquidity_target(e, up, d)
    orderflow = F.when(
        _far_enough(sl_o, e, up, -1),
        _plan(sl_o, F.coalesce(magnet.getField("price"), e + s * d * 2), False, None, 0.0, F.when(atr_ok, "atr").otherwise("config"), F.coalesce(magnet.getField("name"), F.lit("2xSL"))),
    ).otherwise(fixed(rr))

    sl_m, src_m = behind_swing(0.003, 1.0)
    dist = F.abs(e - sl_m)
    to_mean = _far_enough(c("ema_20"), e, up, 1) & (F.abs(c("ema_20") - e) >= dist * 1.2)
    mean_rev = F.when(
        _far_enough(sl_m, e, up, -1),
        _plan(sl_m, F.when(to_mean, c("ema_20")).otherwise(e + s * dist * 1.5), False, None, 0.0, src_m, F.when(to_mean, "ema_20").otherwise("1.5xSL")),
    ).otherwise(fixed(rr))

    width = c("bb_upper") - c("bb_lower")
    sl_s, act_s = e - s * width * 0.5, e + s * width * 1.5
    w_ok = F.coalesce(width > 0, F.lit(False)) & _far_enough(sl_s, e, up, -1) & _far_enough(act_s, e, up, 1)
    sl_a = e - s * 1.5 * c("atr_14")
    a_ok = atr_ok & _far_enough(sl_a, e, up, -1)
    squeeze = (
        F.when(w_ok, _plan(sl_s, None, True, act_s, 1.0, "band", "trailing"))
        .when(a_ok, _plan(sl_a, None, True, e + s * 2.25 * c("atr_14"), 1.0, "atr", "trailing"))
        .otherwise(fixed(F.greatest(rr, F.lit(2.5)))))

    t = F.upper(F.coalesce("move_type", F.lit("")))
    named = F.upper(F.coalesce("strategy", F.lit("")))
    # A strategy without its own rule falls back to the one its event type implies.
    kind = (
        F.when(named.isin("BREAKOUT", "MOMENTUM", "ORDERFLOW", "MEAN_REV", "COMPLEXITY", "SQUEEZE"), named)
        .when(t.contains("BREAKOUT") | t.contains("BREAKDOWN"), "BREAKOUT").when(t.contains("IMPULSE") | t.contains("ACCELERATION"), "MOMENTUM")
        .when(t.contains("REVERSAL"), "MEAN_REV").when(t.contains("SQUEEZE"), "SQUEEZE").otherwise("FIXED"))
    plan = (
        F.when(kind == "BREAKOUT", breakout).when(kind == "MOMENTUM", momentum).when(kind == "ORDERFLOW", orderflow)
        .when(kind == "MEAN_REV", mean_rev).when(kind == "COMPLEXITY", complexity).when(kind == "SQUEEZE", squeeze).otherwise(fixed(rr)))
    return df.withColumn("plan", plan)


def liquidity_target(entry: Column, up: Column, stop_distance: Column) -> Column:
    """The nearer of vwap_20 and vol_poc_20 that lies 1.5 to 4 stop distances ahead."""
    names = ("vwap_20", "vol_poc_20")
    cands = F.array(*[F.struct((F.abs(c(n) - entry) / stop_distance).alias("ratio"), F.lit(i).alias("i"), c(n).alias("price"), F.lit(n).alias("name"), _far_enough(c(n), entry, up, 1).alias("ok")) for i, n in enumerate(names)])
    return F.get(F.array_sort(F.filter(cands, lambda x: x.ok & x.ratio.between(1.5, 4.0))), F.lit(0))


def position_size(df: DataFrame, min_notional: float = 5.0, margin_share: float = 0.99) -> DataFrame:
    """Contracts from risk and stop distance, at least the minimum, within the margin."""
    risk = c("balance") * c("risk_per_trade_pct") / 100
    want = F.greatest(F.coalesce(F.try_divide(risk, F.abs(c("entry") - c("sl_price"))), F.lit(0.0)), c("min_amount"))
    cap = c("balance") * margin_share * c("leverage") / c("entry")
    df = df.withColumn("contracts", F.least(want, cap)).withColumn("notional", c("contracts") * c("entry"))
    return df.where(c("notional") >= min_notional)
