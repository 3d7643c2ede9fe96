"""Numbers behind the written reports: type statistics, bias, verdicts, spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewright.core import KEY, clip
from candlewright.operators.mining import TYPE_KEY
from candlewright.operators.ranks import exact_quantiles

c = F.col


def type_statistics(events: DataFrame) -> DataFrame:
    m = F.abs("magnitude_pct")
    r = lambda col, name: F.round(col, 2).alias(name)
    return events.groupBy(*TYPE_KEY).agg(
        F.count("*").alias("n_events"), r(F.min(m), "magnitude_min"), r(F.max(m), "magnitude_max"), r(F.avg(m), "magnitude_avg"),
        r(F.min("atr_multiple"), "atr_min"), r(F.max("atr_multiple"), "atr_max"), r(F.avg("atr_multiple"), "atr_avg"))


def regime_profile(events: DataFrame) -> DataFrame:
    """Regimes a type occurs in; `events` carries the context struct."""
    e = events.select(*TYPE_KEY, F.coalesce("context.regime", F.lit("UNKNOWN")).alias("regime"), *[c(f"context.{f}").alias(f) for f in ("rsi_14", "adx", "entropy_20", "hurst_60")])
    avg = e.groupBy(*TYPE_KEY).agg(
        F.count("*").alias("_n"), *[F.round(F.avg(f), 3).alias(f"avg_{f}") for f in ("rsi_14", "adx", "entropy_20", "hurst_60")])
    dist = e.groupBy(*TYPE_KEY, "regime").agg(F.count("*").alias("_k")).join(avg.select(*TYPE_KEY, "_n"), TYPE_KEY)
    shares = dist.groupBy(*TYPE_KEY).agg(
        F.max_by("regime", F.struct("_k", "regime")).alias("dominant_regime"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("regime", F.round(c("_k") / c("_n") * 100, 1).alias("pct"))))).alias("regime_distribution"))
    return shares.join(avg.drop("_n"), TYPE_KEY)


def series_status(events: DataFrame) -> DataFrame:
    return events.groupBy(*TYPE_KEY, "direction").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def up_down_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(*TYPE_KEY).agg(F.count_if(c("direction") == "UP").alias("n_up"), F.count_if(c("direction") == "DOWN").alias("n_down"))


def direction_bias(events: DataFrame) -> DataFrame:
    g = events.groupBy(*KEY).agg(
        F.count_if(c("direction") == "UP").alias("n_up"), F.count_if(c("direction") == "DOWN").alias("n_down"),
        F.round(F.avg(F.abs("magnitude_pct")), 2).alias("avg_magnitude"), F.round(F.max(F.abs("magnitude_pct")), 2).alias("max_magnitude"))
    ratio = c("n_up") / F.when(c("n_down") == 0, 1).otherwise(c("n_down"))
    # Class names are part of the data model.
    return g.withColumn("bias", F.when(ratio > 1.35, "LONG").when(ratio < 0.74, "SHORT").otherwise("NEUTRAL")).withColumn(
        "volatility", F.when(c("avg_magnitude") > 5, "HOCH").when(c("avg_magnitude") > 2.5, "MITTEL").otherwise("NIEDRIG"))


def best_signals(ranked: DataFrame, top: int = 8, min_t: float = 5.0, min_hit: float = 45.0) -> DataFrame:
    """The strongest (feature, type) pairs of a series by hit rate times |t|."""
    s = ranked.where((F.abs("t_statistic") >= min_t) & (c("predictive_pct") >= min_hit)).withColumn("strength", F.round(F.round("predictive_pct", 1) * F.abs(F.round("t_statistic", 2)), 4))
    w = Window.partitionBy(*KEY).orderBy(F.desc("strength"), "move_type", "feature")
    return s.withColumn("position", F.row_number().over(w)).where(c("position") <= top).select(*TYPE_KEY, "feature", "strength", "position")


def type_summary(ranked: DataFrame, events: DataFrame, top: int = 3, min_t: float = 4.0, min_hit: float = 40.0) -> DataFrame:
    n = events.groupBy(*TYPE_KEY).agg(F.count("*").alias("n_events"), F.round(F.avg(F.abs("magnitude_pct")), 2).alias("avg_magnitude")).where(c("n_events") >= 3)
    w = Window.partitionBy(*TYPE_KEY).orderBy("rank")
    s = ranked.where((F.abs("t_statistic") >= min_t) & (c("predictive_pct") >= min_hit)).withColumn("_p", F.row_number().over(w)).where(c("_p") <= top)
    g = s.groupBy(*TYPE_KEY).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("_p", "feature"))), lambda x: x.feature)).alias("signals"))
    side = F.when(c("move_type").contains("UP") | c("move_type").contains("BREAKOUT"), "LONG").otherwise("SHORT")
    return g.join(n, TYPE_KEY).withColumn("direction", side)


def validation_verdict(validation: DataFrame) -> DataFrame:
    g = validation.groupBy(*KEY).agg(
        F.count("*").alias("n_types"), F.count_if(c("label").isin("ROBUST", "STABIL")).alias("n_stable"), F.count_if(c("label") == "OVERFITTED").alias("n_overfitted"))
    return g.withColumn("verdict", F.when(c("n_stable") >= c("n_types") * 0.6, "generalised").when(c("n_overfitted") > c("n_types") * 0.5, "overfitting").otherwise("mixed"))


def dominance(strategies: DataFrame) -> DataFrame:
    r = F.when(c("second_score") > 0, c("best_score") / c("second_score")).otherwise(99.0)
    return strategies.withColumn("dominance", F.when(r >= 2.5, "clear").when(r >= 1.7, "strong").when(r >= 1.3, "ahead").otherwise("narrow")).withColumn(
        "confidence", F.least(F.lit(100), F.floor("best_score").cast("int")))


def fingerprints(ranked: DataFrame, top: int = 8, min_t: float = 1.5) -> DataFrame:
    """Lift of the leading predictors, squeezed to 0..1."""
    s = ranked.where(F.abs("t_statistic") >= min_t)
    enough = s.groupBy(*TYPE_KEY).agg(F.count("*").alias("_n")).where("_n >= 3").drop("_n")
    w = Window.partitionBy(*TYPE_KEY).orderBy("rank")
    return s.join(enough, TYPE_KEY, "left_semi").withColumn("position", F.row_number().over(w)).where(c("position") <= top).select(
        *TYPE_KEY, "position", "feature", F.round((clip(c("lift_factor"), -2, 2) / 2 + 1) / 2, 6).alias("value"))


def regime_spans(features: DataFrame, block: int = 4096) -> DataFrame:
    """Maximal runs of one regime.

    Runs are numbered inside blocks. A block hands on (first regime, last regime, number
    of runs); its first run carries on the last one before it where the regimes agree,
    so the blocks' offsets follow from these alone.
    """
    f = features.select(*KEY, "bar_idx", "ts", F.coalesce("regime", F.lit("RANGE")).alias("regime")).withColumn("_b", F.floor(c("bar_idx") / block))
    w = Window.partitionBy(*KEY, "_b").orderBy("bar_idx")
    f = f.withColumn("_new", F.when(c("regime") == F.lag("regime").over(w), 0).otherwise(1)).withColumn("_r", F.sum("_new").over(w))
    pieces = f.groupBy(*KEY, "_b", "_r", "regime").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_bars"))
    blocks = pieces.groupBy(*KEY, "_b").agg(F.min_by("regime", "_r").alias("_first"), F.max_by("regime", "_r").alias("_last"), F.max("_r").alias("_runs"))
    by_block = Window.partitionBy(*KEY).orderBy("_b")
    goes_on = F.when(c("_first") == F.lag("_last").over(by_block), 1).otherwise(0)
    blocks = blocks.withColumn("_on", goes_on).withColumn("_base", F.sum(c("_runs") - c("_on")).over(by_block) - c("_runs")).select(*KEY, "_b", "_base")
    spans = pieces.join(blocks, [*KEY, "_b"]).withColumn("span", c("_base") + c("_r"))
    return spans.groupBy(*KEY, "span", "regime").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n_bars").alias("n_bars"))


def robust_ranges(bars: DataFrame) -> DataFrame:
    g = exact_quantiles(bars, KEY, {"_lo": ("low", 0.005), "_hi": ("high", 0.995), "volume_p99": ("volume", 0.99)})
    pad = (c("_hi") - c("_lo")) * 0.05
    return g.select(*KEY, (c("_lo") - pad).alias("price_lo"), (c("_hi") + pad).alias("price_hi"), "volume_p99")


def parse_level(source) -> Column:
    """(name, value) from a trailing `name=number`."""
    pat = r"([A-Za-z_][A-Za-z0-9_]*)\s*=\s*([\d.]+)\s*$"
    name = F.regexp_extract(source, pat, 1)
    return F.when(name != "", F.struct(name.alias("name"), F.regexp_extract(source, pat, 2).try_cast("double").alias("value")))


def format_threshold(v: Column) -> Column:
    text = lambda d: F.format_string(f"%.{d}f", F.bround(v, d))
    return F.when(F.abs(v) >= 1000, text(0)).when(F.abs(v) >= 10, text(2)).otherwise(text(4))
