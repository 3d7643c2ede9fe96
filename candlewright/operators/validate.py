"""Hold-out validation of predictors and the entry conditions built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewright.core import KEY
from candlewright.operators import joins
from candlewright.operators.mining import TYPE_KEY, unpivot

c = F.col

# Feature families used to pick a strategy.
FAMILIES = {
    "MOMENTUM": (
        "momentum_score", "rsi_14", "rsi_7", "rsi_21", "stoch_k", "stoch_d", "willr_14", "cci_20", "roc_10", "roc_5",
        "roc_20", "macd_hist", "kalman_vel", "velocity", "dist_ema_9", "dist_ema_21",
    ),
    "ORDERFLOW": (
        "cvd", "cvd_slope", "obv_z", "obv_slope", "buy_pressure", "sell_pressure", "vol_confirm", "volume_z",
        "volume_ratio", "mfi_14", "cum_pressure_slope", "mfi_divergence",
    ),
    "BREAKOUT": (
        "struct_hh", "struct_hl", "struct_lh", "struct_ll", "breakout_up_10", "breakout_up_20", "breakout_down_10",
        "breakout_down_20", "donchian_pos", "bb_position", "range_position_50", "at_donchian_high",
        "at_donchian_low", "fvg_bull", "fvg_bear", "bull_ob", "bear_ob", "ichi_above_cloud",
    ),
    "COMPLEXITY": (
        "entropy_10", "entropy_20", "entropy_40", "hurst_30", "hurst_60", "hurst_100", "higuchi_fd", "dfa_alpha",
        "variance_ratio", "wpi", "memory_pressure", "cct", "lyapunov", "ear_entropy", "autocorr_1",
        "realized_vol_20", "atr_pct", "entropy_squeeze",
    ),
}
MEAN_REVERSION_FEATURES = ("hurst_30", "hurst_60", "variance_ratio", "autocorr_1")


def feature_family(feature: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, names in FAMILIES.items():
        out = F.when(feature.isin(*names), family).otherwise(out)
    return out


def split_time(df: DataFrame, fraction: float = 0.7, lengths: DataFrame | None = None) -> DataFrame:
    """Adds split_idx = floor(n * fraction) and is_train per series."""
    n = lengths if lengths is not None else df.groupBy(*KEY).agg((F.max("bar_idx") + 1).alias("n_bars"))
    out = df if "n_bars" in df.columns else df.join(n, KEY)
    return out.withColumn("split_idx", F.floor(c("n_bars") * F.lit(fraction))).withColumn("is_train", c("bar_idx") < c("split_idx"))


def leading_conditions(ranked: DataFrame, min_t: float = 3.0, min_hit: float = 30.0, top: int = 6) -> DataFrame:
    w = Window.partitionBy(*TYPE_KEY).orderBy("rank")
    ok = ranked.where((F.abs("t_statistic") >= min_t) & (c("predictive_pct") >= min_hit))
    return ok.withColumn("pos", F.row_number().over(w)).where(c("pos") <= top)


def condition_met(value: Column, t: Column, level: Column) -> Column:
    """Ten per cent slack around the level; the sign of t gives the side."""
    return F.when(t > 0, value > level * 0.9).otherwise(value < level * 1.1)


def condition_hits(features: DataFrame, events: DataFrame, conditions: DataFrame, names, lookback: int = 3) -> DataFrame:
    """Per event and condition: did it hold on any of the bars before?"""
    prior = joins.at_offsets(events.select(*TYPE_KEY, "bar_idx"), features, range(1, lookback + 1), names)
    long = unpivot(prior, [*TYPE_KEY, "bar_idx", "offset"], names)
    cond = conditions.select(*TYPE_KEY, "feature", "t_statistic", "mean_before")
    met = (
        long.join(cond, [*TYPE_KEY, "feature"]).groupBy(*TYPE_KEY, "bar_idx", "feature")
        .agg(F.max(condition_met(c("value"), c("t_statistic"), c("mean_before"))).alias("_met"))
    )
    grid = events.select(*TYPE_KEY, "bar_idx").join(conditions.select(*TYPE_KEY, "feature"), TYPE_KEY)
    return grid.join(met, [*TYPE_KEY, "bar_idx", "feature"], "left").withColumn("met", F.coalesce("_met", F.lit(False))).drop("_met")


def recall(hits: DataFrame) -> DataFrame:
    per_event = hits.groupBy(*TYPE_KEY, "bar_idx").agg(F.avg(F.when(c("met"), 1.0).otherwise(0.0)).alias("coverage"))
    return per_event.groupBy(*TYPE_KEY).agg(
        F.count("*").alias("n_test"), F.bround(F.avg(F.when(c("coverage") >= 0.5, 1.0).otherwise(0.0)) * 100, 0).cast("int").alias("recall_pct"))


def pack_values(names) -> Column:
    return F.array(*[c(n).cast("double") for n in names])


def feature_position(names) -> Column:
    pairs = [F.lit(x) for i, n in enumerate(names) for x in (n, i)]
    return F.create_map(*pairs)[c("feature")]


def precision(features: DataFrame, events: DataFrame, conditions: DataFrame, names, window: int = 2) -> DataFrame:
    """Bars where half the conditions hold, and how many see an event soon after.

    The few conditions of a type travel to the bars as one array, so bars are neither
    exploded by feature nor shuffled by bar.
    """
    names = list(names)
    packed = conditions.withColumn("_p", feature_position(names)).groupBy(*TYPE_KEY).agg(
        F.collect_list(F.struct(c("_p").alias("p"), c("t_statistic").alias("t"), c("mean_before").alias("m"))).alias("_conds"))
    bars = features.select(*KEY, "bar_idx", pack_values(names).alias("_v")).join(packed, KEY)
    n_met = F.size(F.filter("_conds", lambda x: F.coalesce(condition_met(F.get(c("_v"), x.p), x.t, x.m), F.lit(False))))
    fires = bars.where(n_met / F.size("_conds") >= 0.5).select(*TYPE_KEY, "bar_idx")
    ahead = events.select(*TYPE_KEY, F.explode(F.sequence(c("bar_idx") - window, c("bar_idx") - 1)).alias("bar_idx")).distinct().withColumn("_ok", F.lit(1))
    return fires.join(ahead, [*TYPE_KEY, "bar_idx"], "left").groupBy(*TYPE_KEY).agg(
        F.count("*").alias("signal_fires"), F.count("_ok").alias("signal_confirmed"))


def reliability(recall_pct: Column, degradation: Column, precision_pct: Column) -> Column:
    # Label names are part of the data model.
    return (
        F.when((recall_pct >= 60) & (precision_pct >= 50) & (degradation <= 10), "ROBUST")
        .when((recall_pct >= 45) & (precision_pct >= 35) & (degradation <= 20), "STABIL")
        .when((recall_pct >= 30) & (degradation <= 35), "SCHWACH")
        .otherwise("OVERFITTED")
    )


def validate(features: DataFrame, events: DataFrame, ranked: DataFrame, names, lookback: int = 3, window: int = 2, leading: dict | None = None) -> DataFrame:
    """One row per (series, type). `features` and `events` carry is_train."""
    cond = leading_conditions(ranked, **(leading or {}))
    test = events.where(~c("is_train"))
    rec = recall(condition_hits(features, test, cond, names, lookback))
    prec = precision(features.where(~c("is_train")), test, cond, names, window)
    base = cond.groupBy(*TYPE_KEY).agg(F.count("*").alias("n_conditions"), F.bround(F.avg("predictive_pct"), 0).cast("int").alias("insample_hit"))
    n_train = events.where("is_train").groupBy(*TYPE_KEY).agg(F.count("*").alias("n_train"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    out = base.join(rec, TYPE_KEY, "left").join(prec, TYPE_KEY, "left").join(n_train, TYPE_KEY, "left").select(
        *TYPE_KEY, "n_conditions", "insample_hit", zero("n_train"), zero("n_test"), zero("recall_pct"), zero("signal_fires"), zero("signal_confirmed"))
    out = out.withColumn("precision_pct", F.coalesce(F.bround(F.try_divide(c("signal_confirmed"), c("signal_fires")) * 100, 0).cast("int"), F.lit(0)))
    out = out.withColumn("degradation", c("insample_hit") - c("recall_pct"))
    return out.withColumn("label", reliability(c("recall_pct"), c("degradation"), c("precision_pct")))


def condition_performance(hits: DataFrame, conditions: DataFrame) -> DataFrame:
    test = hits.groupBy(*TYPE_KEY, "feature").agg(F.round(F.avg(F.when(c("met"), 1.0).otherwise(0.0)) * 100, 1).alias("test_hit"))
    return conditions.select(*TYPE_KEY, "feature", F.round("predictive_pct", 1).alias("train_hit"), F.round("t_statistic", 2).alias("t_statistic")).join(
        test, [*TYPE_KEY, "feature"], "left").withColumn("test_hit", F.coalesce("test_hit", F.lit(0.0)))


def usable(validation: DataFrame) -> DataFrame:
    """use_in_bot and the first reason against it."""
    good = c("label").isin("ROBUST", "STABIL")
    return validation.withColumn(
        "use_in_bot", good & (c("precision_pct") >= 10) & (c("n_train") >= 20) & (c("n_test") >= 20)
    ).withColumn(
        "excluded_reason",
        F.when(c("n_train") < 20, "n_train < 20").when(c("n_test") < 20, "n_test < 20").when(c("precision_pct") < 10, "precision < 10%"))


def tradeable(validation: DataFrame, labels=("ROBUST", "STABIL"), least: int = 20) -> DataFrame:
    """Types with one of the labels and at least so many events on either side of the split."""
    return validation.where(c("label").isin(*labels) & (c("n_train") >= least) & (c("n_test") >= least)).select(
        *TYPE_KEY, F.when(c("move_type").contains("UP"), "LONG").otherwise("SHORT").alias("direction"), "n_train", "n_test")


def entry_conditions(ranked: DataFrame, strong_t: float = 2.5, must=(5.0, 40.0), should=(3.0, 30.0)) -> DataFrame:
    """Predictors in three tiers with their entry thresholds."""
    w = Window.partitionBy(*TYPE_KEY).orderBy("rank")
    strong = ranked.where(F.abs("t_statistic") >= strong_t).withColumn("_s", F.row_number().over(w))
    tier = (
        F.when((F.abs("t_statistic") >= must[0]) & (c("predictive_pct") >= must[1]), "must_have")
        .when((F.abs("t_statistic") >= should[0]) & (c("predictive_pct") >= should[1]), "should_have").otherwise("supporting"))
    in_tier = Window.partitionBy(*TYPE_KEY, "tier").orderBy("_s")
    size = F.when(c("tier") == "must_have", 8).otherwise(10)
    return (
        strong.withColumn("tier", tier).withColumn("tier_rank", F.row_number().over(in_tier)).where(c("tier_rank") <= size)
        .select(
            *TYPE_KEY, "tier", "tier_rank", "feature",
            F.when(c("t_statistic") > 0, "above").otherwise("below").alias("direction"),
            F.round("mean_before", 6).alias("threshold"), F.round("mean_all", 6).alias("baseline_avg"),
            F.round(F.abs(c("mean_before") - c("mean_all")) / (F.abs("mean_all") + 1e-9) * 100, 1).alias("deviation_pct"),
            F.round("t_statistic", 3).alias("t_statistic"), F.round("predictive_pct", 1).alias("hit_rate_pct"))
    )


def strategy_scores(events: DataFrame, ranked: DataFrame, min_t: float = 4.0, min_hit: float = 35.0) -> DataFrame:
    """Score of each strategy per series: event shares plus evidence by family."""
    has = lambda *t: F.count_if(c("move_type").isin(*t))
    n = events.groupBy(*KEY).agg(
        F.count("*").alias("n"), has("IMPULSE_DOWN", "IMPULSE_UP", "ACCELERATION_DOWN", "ACCELERATION_UP").alias("MOMENTUM"),
        has("BREAKDOWN", "BREAKOUT_UP").alias("BREAKOUT"), has("REVERSAL_DOWN", "REVERSAL_UP").alias("MEAN_REV"),
        has("SQUEEZE_RELEASE_DOWN", "SQUEEZE_RELEASE_UP").alias("SQUEEZE"))
    share = n.select(
        *KEY, F.explode(F.array(
            *[F.struct(F.lit(s).alias("strategy"), (c(s) / c("n") * 100).alias("score")) for s in ("MOMENTUM", "BREAKOUT", "MEAN_REV", "SQUEEZE")],
            *[F.struct(F.lit(s).alias("strategy"), F.lit(0.0).alias("score")) for s in ("ORDERFLOW", "COMPLEXITY")],
            F.struct(F.lit("SQUEEZE").alias("strategy"), F.when(c("SQUEEZE") / c("n") > 0.10, c("SQUEEZE") * 2.0).otherwise(0.0).alias("score")),
        )).alias("_s")).select(*KEY, "_s.*")
    t = F.abs("t_statistic")
    family = ranked.where((t >= min_t) & (c("predictive_pct") >= min_hit)).select(
        *KEY, feature_family(c("feature")).alias("strategy"), (t * c("predictive_pct") / 100).alias("score")).where("strategy is not null")
    revert = ranked.where((c("rank") <= 15) & c("feature").isin(*MEAN_REVERSION_FEATURES)).select(
        *KEY, F.lit("MEAN_REV").alias("strategy"), (t * 0.5).alias("score"))
    return share.unionByName(family).unionByName(revert).groupBy(*KEY, "strategy").agg(F.sum("score").alias("score"))


def select_strategy(events: DataFrame, ranked: DataFrame, min_t: float = 4.0, min_hit: float = 35.0) -> DataFrame:
    scores = strategy_scores(events, ranked, min_t, min_hit)
    # order in which equal scores win
    order = F.array_position(F.array(*[F.lit(s) for s in ("MOMENTUM", "BREAKOUT", "MEAN_REV", "SQUEEZE", "ORDERFLOW", "COMPLEXITY")]), c("strategy"))
    top = scores.groupBy(*KEY).agg(
        F.max_by("strategy", F.struct("score", -order)).alias("leader"), F.max("score").alias("best_score"),
        F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(1)).alias("second_score"))
    hybrid = (c("best_score") > 0) & (c("second_score") / c("best_score") > 0.75)
    return top.withColumn("strategy", F.when(hybrid, "HYBRID").otherwise(c("leader")))


def signal_template(ranked: DataFrame, min_t: float = 4.0) -> DataFrame:
    w = Window.partitionBy(*TYPE_KEY).orderBy("rank")
    top = ranked.where(F.abs("t_statistic") >= min_t).withColumn("_p", F.row_number().over(w)).where(c("_p") <= 5)
    up = c("move_type").contains("UP") | c("move_type").contains("BREAKOUT")
    return top.groupBy(*TYPE_KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "feature"))), lambda x: x.feature).alias("key_features"),
        F.round(F.avg("predictive_pct"), 1).alias("estimated_hit_rate"),
        F.greatest(F.lit(2), F.count("*") - 1).alias("min_score"),
    ).withColumn("direction", F.when(up, "LONG").otherwise("SHORT"))


def timeframe_timing(levels: DataFrame) -> DataFrame:
    """Entry confidence per finer timeframe; `levels` has one row per event and timeframe."""
    t = levels.groupBy("symbol", "timeframe").agg(
        F.round(F.avg("entry_confidence"), 2).alias("avg_entry_confidence"), F.max("entry_confidence").alias("max_entry_confidence"), F.count("*").alias("n_events"))
    a = c("avg_entry_confidence")
    t = t.withColumn("recommendation", F.when(a >= 7, "STRONG ENTRY").when(a >= 5, "VALID ENTRY").when(a >= 3, "WEAK ENTRY").otherwise("SKIP"))
    best = t.groupBy("symbol").agg(F.max_by("timeframe", F.struct("avg_entry_confidence", "timeframe")).alias("best_entry_timeframe"))
    return t.join(best, "symbol")


def cluster_fingerprints(clusters: DataFrame) -> DataFrame:
    """Distinguishing features with direction, from an array of key-feature structs."""
    return clusters.withColumn("distinguishing_features", F.transform("key_features", lambda f: F.struct(
        f.feature.alias("feature"), F.round(f.cluster_mean, 4).alias("cluster_value"), F.round(f.global_mean, 4).alias("global_value"),
        F.round(f["diff"], 4).alias("diff"), F.when(f["diff"] > 0, "higher_than_avg").otherwise("lower_than_avg").alias("direction"))))


def edge_scan(validation: DataFrame) -> DataFrame:
    """Usable types per series; series without any are left out downstream."""
    return usable(validation).groupBy(*KEY).agg(F.count("*").alias("n_types"), F.count_if("use_in_bot").alias("n_usable"))
