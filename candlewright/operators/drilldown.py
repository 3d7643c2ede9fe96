"""Zooming from an event into finer bars: entry, stop, targets, precursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewright.core import KEY, TIMEFRAME_MINUTES
from candlewright.operators import joins

c = F.col

# Coarse-to-fine order, and which side each entry signal speaks for.
CHAIN = ("1d", "4h", "1h", "15m", "5m", "1m")
SIDE_OF_SIGNAL = {
    "rsi_divergence": "BOTH", "macd_hist": "BOTH", "ema_alignment": "BOTH", "supertrend_dir": "BOTH", "volume_surge": "BOTH", "entropy_squeeze": "BOTH",
    "kc_squeeze": "BOTH", "move_readiness": "BOTH", "struct_score": "BOTH", "obv_slope": "BOTH", "cvd_divergence": "BOTH", "wpi": "BOTH", "hurst_60": "BOTH",
    "adx": "BOTH", "bear_engulf": "DOWN", "pin_bar_bear": "DOWN", "breakout_down_20": "DOWN", "at_donchian_low": "DOWN", "bull_engulf": "UP",
    "pin_bar_bull": "UP", "breakout_up_20": "UP", "at_donchian_high": "UP",
}
BOTH, DOWN_ONLY, UP_ONLY = (tuple(k for k, v in SIDE_OF_SIGNAL.items() if v == side) for side in ("BOTH", "DOWN", "UP"))
ENTRY_SIGNALS = tuple(SIDE_OF_SIGNAL)
FIBONACCI = (0.618, 1.0, 1.272, 1.618, 2.618)
REWARDS = (1.5, 2.5, 4.0)


def focus_events(events: DataFrame, n: int = 5, near=None) -> DataFrame:
    """The n largest events of each series, or those nearest to a time."""
    by = F.desc(F.abs("magnitude_pct")) if near is None else F.abs(F.unix_micros("ts") - F.unix_micros(F.lit(near).cast("timestamp")))
    w = Window.partitionBy(*KEY).orderBy(by, "bar_idx")
    return events.withColumn("focus_rank", F.row_number().over(w)).where(c("focus_rank") <= n)


def _hit(name: str, up: Column) -> Column:
    v = c(name).cast("double")
    signed = lambda lim: F.when(up, v >= lim).otherwise(v <= -lim)
    if name == "rsi_divergence":
        return F.when(up, v > 1).otherwise(v < -1)
    if name in ("ema_alignment", "struct_score"):
        return signed(1)
    if name == "supertrend_dir":
        return F.when(up, v == 1).otherwise(v == -1)
    if name == "hurst_60":
        return v.isNotNull()
    if name == "adx":
        return v > 25
    if name in ("macd_hist", "obv_slope", "cvd_divergence", "wpi", "move_readiness"):
        return F.when(up, v > 0).otherwise(v < 0)
    side = ~up if name in DOWN_ONLY else up if name in UP_ONLY else F.lit(True)
    return (v >= 1) & side


def entry_score(df: DataFrame, direction: str = "direction", signals=ENTRY_SIGNALS) -> DataFrame:
    """Adds entry_signals (names that speak for the direction) and their capped count."""
    up = c(direction) == "UP"
    names = F.array_compact(F.array(*[F.when(F.coalesce(_hit(n, up), F.lit(False)), F.lit(n)) for n in signals]))
    return df.withColumn("entry_signals", names).withColumn("entry_confidence", F.least(F.size("entry_signals"), F.lit(10)))


def best_entry(events: DataFrame, features: DataFrame, signals=ENTRY_SIGNALS, scan: int = 20) -> DataFrame:
    """The best-scored bar among the event's bar and the 19 before; the latest wins ties.

    Events without any signal keep their own bar with score zero.
    """
    base = events.select(*KEY, "bar_idx", "direction")
    rows = entry_score(joins.at_offsets(base, features, range(0, scan), [s for s in signals]), signals=signals)
    best = rows.groupBy(*KEY, "bar_idx", "direction").agg(F.max_by(F.struct("entry_confidence", "entry_signals", "offset"), F.struct("entry_confidence", -c("offset"))).alias("_b"))
    return best.select(*KEY, "bar_idx", "direction", F.when(c("_b.entry_confidence") > 0, c("bar_idx") - c("_b.offset")).otherwise(c("bar_idx")).alias("entry_idx"),
                       c("_b.entry_confidence").alias("entry_confidence"), c("_b.entry_signals").alias("entry_signals"))


def look_back(entries: DataFrame, features: DataFrame, at: str, offsets, columns) -> DataFrame:
    """Adds `win`: the bars at the offsets before column `at`, oldest first."""
    ids = [x for x in entries.columns if x not in KEY]
    want = entries.withColumn("_o", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("_at", c(at) - c("_o"))
    j = want.join(features.select(*KEY, c("bar_idx").alias("_at"), *[c(x).alias(f"_w_{x}") for x in columns]), [*KEY, "_at"])
    row = F.struct((-c("_o")).alias("o"), *[c(f"_w_{x}").alias(x) for x in columns])
    return j.groupBy(*KEY, *ids).agg(F.array_sort(F.collect_list(row)).alias("win"))


def _inner(n: Column, k: int) -> Column:
    """Positions (1-based) with k neighbours on both sides."""
    return F.when(n >= 2 * k + 1, F.sequence(F.lit(k + 1), n - k)).otherwise(F.array().cast("array<int>"))


def pivot_stop(up: Column) -> Column:
    """Highest pivot low (long) or lowest pivot high (short), two bars on each side."""
    n = F.size("win")
    lows, highs = F.transform("win", lambda b: b.low), F.transform("win", lambda b: b.high)
    pl = F.filter(_inner(n, 2), lambda i: F.element_at(lows, i) == F.array_min(F.slice(lows, i - 2, 5)))
    ph = F.filter(_inner(n, 2), lambda i: F.element_at(highs, i) == F.array_max(F.slice(highs, i - 2, 5)))
    return F.when(n >= 5, F.when(up, F.array_max(F.transform(pl, lambda i: F.element_at(lows, i)))).otherwise(F.array_min(F.transform(ph, lambda i: F.element_at(highs, i)))))


def fibonacci_targets(up: Column, entry: Column) -> Column:
    hi, lo = F.array_max(F.transform("win", lambda b: b.high)), F.array_min(F.transform("win", lambda b: b.low))
    price = lambda f: F.when(up, lo + (hi - lo) * f).otherwise(hi - (hi - lo) * f)
    rows = F.array(*[F.struct(F.lit(f).alias("fib"), F.round(price(f), 6).alias("price"), F.round(F.abs(price(f) - entry) / entry * 100, 3).alias("pct")) for f in FIBONACCI])
    ahead = F.filter(rows, lambda r: F.when(up, price_of(r) > entry).otherwise(price_of(r) < entry))
    return F.when((F.size("win") >= 10) & (hi - lo >= 1e-10), F.slice(ahead, 1, 4)).otherwise(F.slice(ahead, 1, 0))


def price_of(r: Column) -> Column:
    return r.getField("price")


def support_resistance(up: Column, entry: Column, k: int = 3, keep: int = 4) -> Column:
    """Pivot closes ahead of the entry, merged within 0.3 %, nearest first."""
    n = F.size("win")
    closes = F.transform("win", lambda b: b.close)
    around = lambda i: F.slice(closes, i - k, 2 * k + 1)
    piv = F.filter(_inner(n, k), lambda i: F.when(up, (F.element_at(closes, i) == F.array_max(around(i))) & (F.element_at(closes, i) > entry))
                   .otherwise((F.element_at(closes, i) == F.array_min(around(i))) & (F.element_at(closes, i) < entry)))
    prices = F.array_sort(F.transform(piv, lambda i: F.round(F.element_at(closes, i), 6)))
    merged = F.aggregate(prices, F.array().cast("array<double>"), lambda acc, p: F.when(
        (F.size(acc) == 0) | (F.abs(p - F.try_element_at(acc, F.lit(-1))) / F.try_element_at(acc, F.lit(-1)) > 0.003), F.concat(acc, F.array(p))).otherwise(acc))
    return F.when(n >= 10, F.slice(F.when(up, merged).otherwise(F.reverse(merged)), 1, keep)).otherwise(F.array().cast("array<double>"))


def stops_and_targets(entries: DataFrame, features: DataFrame, atr_mult: float = 1.5) -> DataFrame:
    """Stop from ATR and pivots (the tighter one), reward targets, Fibonacci and S/R."""
    bars = look_back(entries, features, "entry_idx", range(0, 51), ["high", "low", "close", "atr_14"])
    last = F.element_at("win", -1)
    df = bars.withColumn("entry_price", last.getField("close")).withColumn("_atr", F.coalesce(last.getField("atr_14"), F.lit(0.0)))
    up, e = c("direction") == "UP", c("entry_price")
    df = df.withColumn("sl_atr", e - F.when(up, 1.0).otherwise(-1.0) * c("_atr") * atr_mult).withColumn("sl_swing", pivot_stop(up))
    tight = F.when(up, F.greatest("sl_atr", "sl_swing")).otherwise(F.least("sl_atr", "sl_swing"))
    df = df.withColumn("sl_price", F.coalesce(tight, c("sl_atr"))).withColumn("sl_method", F.when(c("sl_swing").isNull() | (c("sl_price") == c("sl_atr")), "ATR").otherwise("Struktur"))
    dist = F.abs(e - c("sl_price"))
    side = F.when(up, 1.0).otherwise(-1.0)
    df = df.withColumn("sl_pct", F.round(dist / e * 100, 3))
    df = df.withColumn("targets", F.array(*[F.struct(F.lit(r).alias("rr"), F.round(e + side * dist * r, 6).alias("price")) for r in REWARDS]))
    df = df.withColumn("fibonacci", fibonacci_targets(up, e)).withColumn("sr_levels", support_resistance(up, e))
    return df.where((e > 0) & (F.size("win") >= 5) & (dist >= 1e-10)).drop("win", "_atr")


PRECURSOR_COLUMNS = ("volume", "entropy_20", "hurst_60", "rsi_14", "kc_squeeze", "ema_alignment", "struct_score", "obv_slope", "close")


def precursors(events: DataFrame, features: DataFrame, lookback: int = 10) -> DataFrame:
    """Short codes for what the bars before an event showed."""
    df = look_back(events.select(*KEY, "bar_idx", "direction"), features, "bar_idx", range(1, lookback + 1), PRECURSOR_COLUMNS)
    col = lambda name: F.filter(F.transform("win", lambda b: b.getField(name).cast("double")), lambda v: v.isNotNull())
    first, last = (lambda x: F.try_element_at(x, F.lit(1))), (lambda x: F.try_element_at(x, F.lit(-1)))
    v, ent, h, r = col("volume"), col("entropy_20"), last(col("hurst_60")), last(col("rsi_14"))
    vs = (last(v) - first(v)) / (first(v) + 1e-10)
    es = last(ent) - first(ent)
    al, st, cl, obv = col("ema_alignment"), last(col("struct_score")), col("close"), col("obv_slope")
    mean = F.try_divide(F.aggregate(obv, F.lit(0.0), lambda a, x: a + x), F.size(obv))
    move = F.signum(last(cl) - first(cl))
    squeezed = F.aggregate(col("kc_squeeze"), F.lit(0.0), lambda a, x: a + x)
    codes = [
        F.when((F.size(v) >= 3) & (vs < -0.2), "volume_declining").when((F.size(v) >= 3) & (vs > 0.5), "volume_increasing"),
        F.when((F.size(ent) >= 3) & (es > 0.1), "entropy_rising").when((F.size(ent) >= 3) & (es < -0.1), "entropy_falling"),
        F.when(h < 0.45, "mean_reverting").when(h > 0.55, "trending"), F.when(r > 70, "overbought").when(r < 30, "oversold"),
        F.when(squeezed >= 3, "squeeze"), F.when(last(al) != first(al), "ema_alignment_changed"),
        F.when(st <= -1, "structure_bearish").when(st >= 1, "structure_bullish"),
        F.when((move != 0) & (F.signum(mean) != move), "obv_divergence"),
    ]
    return df.withColumn("precursors", F.array_compact(F.array(*codes))).drop("win")


def zoom(events: DataFrame, features_by_tf: dict[str, DataFrame], start_tf: str = "1d", enough: int = 8, signals=ENTRY_SIGNALS) -> DataFrame:
    """Per event and finer timeframe the best entry; nothing beyond the first good one.

    `features_by_tf` holds whole-history features per timeframe. The bar nearest to the
    event's time is found by an interval join on the time axis.
    """
    finer = [t for t in CHAIN[CHAIN.index(start_tf) + 1:] if t in features_by_tf]
    levels = None
    for depth, tf in enumerate(finer):
        f = features_by_tf[tf]
        secs = TIMEFRAME_MINUTES[tf] * 60
        ctr = events.select("symbol", F.lit(tf).alias("timeframe"), c("bar_idx").alias("event_idx"), "direction", F.unix_seconds("ts").alias("event_s"))
        pts = f.select(*KEY, "bar_idx", F.unix_seconds("ts").alias("_s"))
        near = joins.nearest(pts, ctr, "_s", "event_s", 60 * secs, 120 * secs, ["event_idx", "direction"])
        found = best_entry(near.select(*KEY, "bar_idx", "direction"), f, signals).join(near.select(*KEY, "bar_idx", "direction", "event_idx"), [*KEY, "bar_idx", "direction"])
        found = found.withColumn("depth", F.lit(depth))
        levels = found if levels is None else levels.unionByName(found)
    w = Window.partitionBy("symbol", "event_idx").orderBy("depth")
    done = F.max(F.when(c("entry_confidence") >= enough, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return levels.withColumn("_done", F.coalesce(done, F.lit(0))).where("_done = 0").drop("_done")


def trade_setups(levels: DataFrame, plans: DataFrame, events: DataFrame) -> DataFrame:
    """One row per event with its levels nested."""
    j = levels.join(plans.select(*KEY, "bar_idx", "entry_price", "sl_price", "sl_pct", "targets"), [*KEY, "bar_idx"])
    row = F.struct("depth", "timeframe", "entry_price", "entry_confidence", "sl_price", "sl_pct", "targets")
    nested = j.groupBy("symbol", "event_idx").agg(F.array_sort(F.collect_list(row)).alias("levels"))
    return events.select("symbol", c("bar_idx").alias("event_idx"), "move_type", "direction", "magnitude_pct").join(nested, ["symbol", "event_idx"])
