"""Movement events: twelve types, first match per bar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from candlewright.core import EPS, KEY, TIMEFRAME_MINUTES, ratio
from candlewright.operators import chunks
from candlewright.operators.chunks import lag, order
from candlewright.operators.ranks import exact_quantiles
from candlewright.sources.tables import written

# Detector settings per bar size (breakout bars, shortest reversal run).
TIMEFRAME_SETTINGS = {
    "1w": (10, 3), "3d": (12, 3), "1d": (20, 5), "12h": (24, 6), "6h": (28, 7), "4h": (30, 8),
    "2h": (36, 9), "1h": (48, 12), "30m": (60, 15), "15m": (80, 20), "5m": (96, 24), "1m": (120, 30),
}
# Impulse multiples and move sizes tried in turn.
ATR_LADDER = (1.5, 1.2, 1.0, 0.75, 0.5)
MOVE_LADDER = (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.5, 10.0)
MOVE_MULTIPLES = (0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
EVENTS_PER_YEAR_1H = 300

# Columns kept beside a movement.
CONTEXT_FIELDS = (
    "regime", "trend_score", "momentum_score", "move_readiness", "adx", "rsi_14",
    "entropy_20", "hurst_60", "atr_pct", "volume_ratio", "ema_alignment", "supertrend_dir",
)

# Rank of each type when several rules claim one bar; lower wins.
SPECIFICITY = {
    "SQUEEZE_RELEASE_DOWN": 0, "SQUEEZE_RELEASE_UP": 0, "BREAKDOWN": 1, "BREAKOUT_UP": 1,
    "REVERSAL_DOWN": 2, "REVERSAL_UP": 2, "IMPULSE_DOWN": 3, "IMPULSE_UP": 3,
    "ACCELERATION_DOWN": 4, "ACCELERATION_UP": 4, "GAP_DOWN": 5, "GAP_UP": 5,
}


@dataclass(frozen=True)
class DetectorSettings:
    atr_impulse: float = 2.0
    breakout_bars: int = 20
    reversal_min_run: int = 5
    squeeze_atr_z: float = -1.0
    gap_pct: float = 0.005
    lookback: int = 10

    @classmethod
    def for_timeframe(cls, timeframe: str, atr_impulse: float = 1.5) -> "DetectorSettings":
        bars, run = TIMEFRAME_SETTINGS.get(timeframe, (20, 5))
        return cls(atr_impulse=atr_impulse, breakout_bars=bars, reversal_min_run=run)


def direction_of(move_type: Column) -> Column:
    return F.when(move_type.contains("UP"), "LONG").otherwise("SHORT")


def target_events_per_year(timeframe: str) -> float:
    per_year = 365.25 * 1440 / TIMEFRAME_MINUTES.get(timeframe, 60)
    return max(20.0, per_year * EVENTS_PER_YEAR_1H / (365.25 * 24))


def _rules(have: set[str], s: DetectorSettings) -> dict[str, Column]:
    """Rule name -> condition, on columns prepared by `candidates`; `_k` rules first."""
    c = F.col
    move, prev, hi, lo = c("_move"), c("_prev"), c("_hi"), c("_lo")
    rules = {
        "BREAKOUT_UP": (c("close") > hi * 1.001) & (prev <= hi),
        "BREAKDOWN": (c("close") < lo * 0.999) & (prev >= lo),
    }
    if {"consec_bull", "consec_bear"} <= have:
        rules["REVERSAL_DOWN"] = (move < -0.005) & (c("_bull_run") >= s.reversal_min_run)
        rules["REVERSAL_UP"] = (move > 0.005) & (c("_bear_run") >= s.reversal_min_run)
    if "atr_z" in have:
        released = (c("_atr_z3") < s.squeeze_atr_z) & (c("atr_z") > 0.5)
        rules["SQUEEZE_RELEASE_UP"] = released & (move > 0.003)
        rules["SQUEEZE_RELEASE_DOWN"] = released & (move < -0.003)
    if "energy_z" in have:
        rules["ACCELERATION_UP"] = (c("energy_z") > 3.0) & (move > 0.01)
        rules["ACCELERATION_DOWN"] = (c("energy_z") > 3.0) & (move < -0.01)
    rules["GAP_UP"] = c("_gap") > s.gap_pct
    rules["GAP_DOWN"] = c("_gap") < -s.gap_pct
    return rules


def candidates(features: DataFrame, s: DetectorSettings) -> DataFrame:
    """Bars with the detector's inputs: `_other` is the first rule after the impulse test.

    The impulse multiple is the only setting that ladders vary, so one pass serves
    every multiple. Without atr_14 the 14-bar mean range stands in.
    """
    have = set(features.columns)
    keep = [c for c in (*KEY, "ts", "bar_idx", "open", "high", "low", "close", "atr_14", "atr_z", "energy_z", "consec_bull", "consec_bear", *CONTEXT_FIELDS) if c in have]
    df = chunks.with_halo(features.select(*dict.fromkeys(keep)), max(s.breakout_bars, 14) + 3)
    before = order().rowsBetween(-s.breakout_bars, -1)
    rng = F.col("high") - F.col("low")
    extra = []
    if "consec_bull" in have:
        extra += [lag("consec_bull").alias("_bull_run"), lag("consec_bear").alias("_bear_run")]
    if "atr_z" in have:
        extra.append(lag("atr_z", 3).alias("_atr_z3"))
    atr = F.col("atr_14") if "atr_14" in have else chunks.rolling(F.avg, rng, 14)
    df = df.select(
        "*", F.max("close").over(before).alias("_hi"), F.min("close").over(before).alias("_lo"),
        lag("close").alias("_prev"), F.coalesce(atr, F.lit(0.001)).alias("_atr"), *extra,
    )
    df = chunks.own_rows(df).where(F.col("bar_idx") >= max(s.lookback + s.breakout_bars, 50))
    df = df.select(
        "*", ratio(F.col("close") - F.col("_prev"), F.col("_prev") + EPS).alias("_move"),
        ratio(F.col("open") - F.col("_prev"), F.col("_prev") + EPS).alias("_gap"), rng.alias("_rng"),
    )
    other = F.lit(None).cast("string")
    for name, cond in reversed(list(_rules(have, s).items())):
        other = F.when(cond, name).otherwise(other)
    return df.withColumn("_other", other)


def _finish(df: DataFrame, k: Column) -> DataFrame:
    impulse = F.when(F.col("_move") > 0, "IMPULSE_UP").otherwise("IMPULSE_DOWN")
    typed = df.withColumn("move_type", F.when(F.col("_rng") > k * F.col("_atr"), impulse).otherwise(F.col("_other"))).where("move_type is not null")
    sided = F.when(F.col("move_type").startswith("IMPULSE"), F.when(F.col("_move") >= 0, "UP").otherwise("DOWN")).otherwise(
        F.when(F.col("move_type").contains("UP"), "UP").otherwise("DOWN"))
    return typed.select(
        "*", sided.alias("direction"),
        F.round(F.col("_move") * 100, 4).alias("magnitude_pct"),
        F.round(F.col("_rng") / (F.col("_atr") + EPS), 2).alias("atr_multiple"),
    )


def detect_movements(features: DataFrame, settings: DetectorSettings | None = None, context: bool = False) -> DataFrame:
    """At most one typed movement per bar."""
    s = settings or DetectorSettings()
    df = _finish(candidates(features, s), F.lit(s.atr_impulse))
    cols = [*KEY, "bar_idx", "ts", "move_type", "direction", "magnitude_pct", "atr_multiple"]
    if context:
        fields = [f for f in CONTEXT_FIELDS if f in features.columns]
        df = df.withColumn("context", F.struct(*[F.col(f) if f == "regime" else F.col(f).cast("double").alias(f) for f in fields]))
        cols.append("context")
    return df.select(*cols)


def rule_matches(features: DataFrame, settings: DetectorSettings | None = None) -> DataFrame:
    """Every rule that holds on a bar, one row each."""
    s = settings or DetectorSettings()
    df = candidates(features, s)
    impulse = F.when(F.col("_rng") > s.atr_impulse * F.col("_atr"), F.when(F.col("_move") > 0, "IMPULSE_UP").otherwise("IMPULSE_DOWN"))
    hits = [impulse] + [F.when(cond, F.lit(n)) for n, cond in _rules(set(features.columns), s).items()]
    return df.select(*KEY, "bar_idx", "ts", F.explode(F.array_compact(F.array(*hits))).alias("move_type"))


def most_specific(matches: DataFrame) -> DataFrame:
    """One row per bar: the most specific type, by a combinable min instead of a sort."""
    rank = F.create_map(*[F.lit(x) for kv in SPECIFICITY.items() for x in kv])[F.col("move_type")]
    return matches.groupBy(*KEY, "bar_idx", "ts").agg(F.min_by("move_type", F.struct(rank, "move_type")).alias("move_type"))


def series_years(bars: DataFrame) -> DataFrame:
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6 / (365.25 * 86400)
    return bars.groupBy(*KEY).agg(F.greatest(span, F.lit(0.1)).alias("years"), F.datediff(F.max("ts"), F.min("ts")).alias("span_days"))


def impulse_ladder(features: DataFrame, settings: DetectorSettings, events_per_year: float, ladder=ATR_LADDER) -> DataFrame:
    """Per series: the first multiple whose event count reaches the target, else the last."""
    rungs = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(float(k)).alias("k")) for i, k in enumerate(ladder)])
    tried = _finish(candidates(features, settings).withColumn("_r", F.explode(rungs)), F.col("_r.k"))
    counts = tried.groupBy(*KEY, F.col("_r.step").alias("step"), F.col("_r.k").alias("k")).agg(F.count("*").alias("n_events"))
    need = series_years(features).select(*KEY, F.floor(F.lit(events_per_year) * F.col("years")).alias("n_needed"))
    reached = F.col("n_events") >= F.col("n_needed")
    # first rung that reaches the target, else the last rung tried
    pick = F.struct(F.when(reached, F.col("step")).otherwise(len(ladder) * 2 - F.col("step")), "step")
    return counts.join(need, KEY).groupBy(*KEY, "n_needed").agg(
        F.min_by("k", pick).alias("atr_impulse"), F.min_by("n_events", pick).alias("n_events"))


def calibrate_min_move(events: DataFrame, features: DataFrame, events_per_year: float) -> DataFrame:
    """Per series: the highest move size that still leaves the target number of events."""
    years = series_years(features).select(*KEY, F.floor(F.lit(events_per_year) * F.greatest(F.col("span_days") / 365.25, F.lit(0.25))).alias("min_total"))
    med = exact_quantiles(features, KEY, {"median_atr": ("atr_pct", 0.5)})
    scaled_steps = F.transform(F.array(*[F.lit(m) for m in MOVE_MULTIPLES]), lambda m: F.round(F.col("median_atr") * m, 2))
    steps = F.array_distinct(F.concat(F.array(*[F.lit(x) for x in MOVE_LADDER]), F.coalesce(F.filter(scaled_steps, lambda x: (x >= 0.05) & (x <= 15.0)), F.array().cast("array<double>"))))
    # One row per series: its ladder, ascending. An event counts how many rungs it reaches, and only these counts are grouped.
    ladder = written(med.withColumn("steps", F.array_sort(steps)).join(years, KEY), "ladder")
    reach = F.size(F.filter("steps", lambda x: x <= F.abs("magnitude_pct")))
    counts = events.select(*KEY, "magnitude_pct").join(ladder, KEY).groupBy(*KEY, reach.alias("_k")).agg(F.count("*").alias("_n"))
    counts = counts.groupBy(*KEY).agg(F.collect_list(F.struct("_k", "_n")).alias("_h"))
    above = lambda i: F.aggregate(F.filter(F.coalesce("_h", F.array().cast("array<struct<_k:int,_n:bigint>>")), lambda h: h["_k"] > i), F.lit(0).cast("long"), lambda a, h: a + h["_n"])
    good = F.filter("steps", lambda x, i: above(i) >= F.col("min_total"))
    out = ladder.join(counts, KEY, "left")
    return out.select(*KEY, "median_atr", "min_total", F.coalesce(F.array_max(good), F.get("steps", F.lit(0))).alias("min_move_pct"))
