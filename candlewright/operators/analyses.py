"""Studies of trade ledgers and of parameter neighbourhoods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from candlewright.core import KEY
from candlewright.operators import joins, ledger
from candlewright.operators.outcomes import DEFAULTS, RUN_KEY
from candlewright.operators.ranks import positions, ranged_positions

c = F.col
def won() -> Column:
    return c("pnl") > 0


# Levels each study visits.
FEE_LEVELS = (0.0, 0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 0.20)
RR_LEVELS = (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0)
REL_LEVELS = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0)
ATR_Z_LEVELS = (None, 1.0, 1.5, 2.0, 2.5, 3.0)
SPLIT_FRACTIONS = (0.60, 0.65, 0.70, 0.75, 0.80)
SENSITIVE = ("t_threshold", "min_score", "min_hit_rate", "sl_pct", "tp_rr", "max_hold_bars")
SESSIONS = (("Asien", 0, 8), ("Europa", 8, 16), ("US", 16, 24))


def win_rate() -> Column:
    return F.round(F.avg(F.when(won(), 100.0).otherwise(0.0)), 1).alias("win_rate")


def total_pnl() -> Column:
    return F.round(F.sum("pnl"), 4).alias("pnl")


# ── parameter neighbourhoods: rows for outcomes.grid ─────────────────────────


def level_rows(base: dict, name: str, levels, relative: bool = False) -> list[dict]:
    base = {**DEFAULTS, **base}
    return [{**base, name: round(base[name] * v, 4) if relative else v, "param_id": i} for i, v in enumerate(levels)]


def sensitivity_rows(base: dict, delta: float = 0.2) -> list[dict]:
    """Row 0 is the base; 2i+1 and 2i+2 lower and raise the i-th parameter."""
    base = {**DEFAULTS, **base}
    rows = [{**base, "param_id": 0}]
    for i, name in enumerate(SENSITIVE):
        for j, f in enumerate((1 - delta, 1 + delta)):
            v = base[name] * f
            rows.append({**base, name: int(v) if name == "max_hold_bars" else v, "param_id": 2 * i + 1 + j})
    return rows


def sensitivity(summary: DataFrame) -> DataFrame:
    """Low and high return per parameter, widest spread first."""
    base = summary.where("param_id = 0").select(*KEY, c("pnl_pct").alias("base_pnl"))
    names = F.array(*[F.lit(n) for n in SENSITIVE])
    s = summary.where("param_id > 0").withColumn("param", F.get(names, F.floor((c("param_id") - 1) / 2).cast("int")))
    low = c("param_id") % 2 == 1
    g = s.groupBy(*KEY, "param").agg(F.max(F.when(low, c("pnl_pct"))).alias("lo"), F.max(F.when(~low, c("pnl_pct"))).alias("hi"))
    g = g.join(base, KEY, "left").select(
        *KEY, "param", F.coalesce("lo", "base_pnl").alias("lo"), F.coalesce("hi", "base_pnl").alias("hi"))
    g = g.withColumn("spread", F.round(F.abs(c("hi") - c("lo")), 4))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("spread"), "param")))


def fee_break_even(summary: DataFrame, params: DataFrame) -> DataFrame:
    """Fee half-way between the last profitable level and the first that is not."""
    s = summary.join(params.select("param_id", c("fee_pct_per_side").alias("fee")), "param_id")
    w = Window.partitionBy(*KEY).orderBy("fee")
    s = s.withColumn("_np", F.lead("pnl_pct").over(w)).withColumn("_nf", F.lead("fee").over(w))
    turn = (c("pnl_pct") > 0) & (c("_np") <= 0)
    return s.groupBy(*KEY).agg(
        F.round(F.min(F.when(turn, (c("fee") + c("_nf")) / 2)), 4).alias("break_even_fee"), F.min_by("pnl_pct", "fee").alias("pnl_pct_without_fee"))


def best_level(summary: DataFrame, params: DataFrame, name: str) -> DataFrame:
    s = summary.join(params.select("param_id", c(name).alias("level")), "param_id")
    return s.groupBy(*KEY).agg(F.max_by("level", F.struct("pnl_pct", -c("param_id"))).alias("best_level"), F.max("pnl_pct").alias("best_pnl_pct"))


def kelly(summary: DataFrame, params: DataFrame, half: bool = True, cap: float = 10.0) -> DataFrame:
    s = summary.where("n_trades >= 5").join(params.select("param_id", "tp_rr", "risk_per_trade_pct"), "param_id")
    wr = c("win_rate") / 100
    k = F.when(c("tp_rr") > 0, F.greatest((wr - (1 - wr) / c("tp_rr")) * 100, F.lit(0.0))).otherwise(0.0)
    return s.withColumn("kelly_pct", F.round(F.least(k / (2 if half else 1), F.lit(cap)), 4))


# ── time slices: the same series cut into several runs ───────────────────────


def time_windows(features: DataFrame, weeks: int = 4) -> DataFrame:
    """Bars of consecutive k-week windows from each series' first bar.

    The last day of a window is included whole, so neighbouring windows share it, as the
    reference numbers do. The window number becomes part of the symbol.
    """
    first = features.groupBy(*KEY).agg(F.min("ts").alias("_t0"), F.max("ts").alias("_t1"))
    df = features.join(first, KEY)
    span = weeks * 7 * 86400
    own = F.floor((F.unix_seconds("ts") - F.unix_seconds("_t0")) / span)
    edge = lambda w: F.timestamp_seconds(F.unix_seconds("_t0") + w * span)
    df = df.withColumn("window", F.explode(F.sequence(F.greatest(own - 1, F.lit(0)), own)))
    w_end = F.least(edge(c("window") + 1), c("_t1"))
    day = lambda x: F.date_trunc("day", x)
    ok = (c("ts") >= day(edge(c("window")))) & (c("ts") < day(w_end) + F.expr("INTERVAL 1 DAY")) & (edge(c("window")) < c("_t1"))
    return df.where(ok).drop("_t0", "_t1").withColumn("base_symbol", c("symbol")).withColumn("symbol", F.concat_ws("@", "symbol", c("window").cast("string")))


def split_slices(features: DataFrame, fractions=SPLIT_FRACTIONS) -> DataFrame:
    """For each fraction the bars from the split bar's day on, as series of their own."""
    n = features.groupBy(*KEY).agg((F.max("bar_idx") + 1).alias("_n"))
    cuts = n.select(*KEY, F.explode(F.array(*[F.struct(F.lit(int(round(f * 100))).alias("split_pct"), F.floor(c("_n") * F.lit(f)).alias("_at")) for f in fractions])).alias("_s")).select(*KEY, "_s.*")
    days = cuts.join(features.select(*KEY, c("bar_idx").alias("_at"), F.date_trunc("day", "ts").alias("_from")), [*KEY, "_at"])
    df = features.join(days, KEY).where(c("ts") >= c("_from"))
    return df.drop("_at", "_from").withColumn("base_symbol", c("symbol")).withColumn("symbol", F.concat_ws("@", "symbol", c("split_pct").cast("string")))


def by_slice(summary: DataFrame, name: str) -> DataFrame:
    parts = F.split("symbol", "@")
    return summary.withColumn(name, F.get(parts, F.lit(1)).cast("int")).withColumn("symbol", F.get(parts, F.lit(0)))


def spread_over(summary: DataFrame) -> DataFrame:
    return summary.groupBy(*KEY).agg(F.round(F.max("pnl_pct") - F.min("pnl_pct"), 2).alias("spread"), F.count("*").alias("n_slices"))


def positive_share(summary: DataFrame) -> DataFrame:
    return summary.groupBy(*KEY).agg(
        F.count("*").alias("n_windows"), F.count_if(c("pnl_pct") > 0).alias("n_positive"),
        F.round(F.count_if(c("pnl_pct") > 0) / F.count("*") * 100, 1).alias("positive_pct"),
        F.min("pnl_pct").alias("worst_pnl_pct"), F.max("pnl_pct").alias("best_pnl_pct"))


# ── ledger studies ───────────────────────────────────────────────────────────


def _buckets(placed: DataFrame, n: int, min_per_bucket: int) -> DataFrame:
    t = placed.where(c("_n") >= n * min_per_bucket)
    return t.withColumn("bucket", F.least(F.floor(c("pos") / F.floor(c("_n") / n)), F.lit(n - 1)) + 1)


def _in_time(trades: DataFrame, keys, block: int = 4096) -> DataFrame:
    """Place of each trade in its run; one run's trades do not overlap, so a block of bars holds at most `block`."""
    return positions(trades, keys, F.floor(c("entry_idx") / block), ["entry_idx"])


def signal_decay(trades: DataFrame, n: int = 4, keys=tuple(RUN_KEY)) -> DataFrame:
    keys = list(keys)
    return _buckets(_in_time(trades, keys), n, 3).groupBy(*keys, "bucket").agg(F.count("*").alias("n_trades"), win_rate(), total_pnl())


def score_strength(trades: DataFrame, n: int = 4, keys=tuple(RUN_KEY)) -> DataFrame:
    keys = list(keys)
    return _buckets(ranged_positions(trades, keys, ["score", "entry_idx"]), n, 5).groupBy(*keys, "bucket").agg(
        F.count("*").alias("n_trades"), F.min("score").alias("score_lo"), F.max("score").alias("score_hi"), win_rate())


def by_confluence(trades: DataFrame, min_trades: int = 5, keys=tuple(RUN_KEY)) -> DataFrame:
    several = trades.groupBy(*keys).agg(F.max("n_types_signaling").alias("_m")).where("_m > 1").drop("_m")
    g = trades.join(several, list(keys), "left_semi").groupBy(*keys, "n_types_signaling").agg(F.count("*").alias("n_trades"), win_rate())
    return g.where(c("n_trades") >= min_trades)


def session_of(ts) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in SESSIONS:
        out = F.when((F.hour(ts) >= lo) & (F.hour(ts) < hi), name).otherwise(out)
    return out


def by_session(trades: DataFrame, min_trades: int = 5, keys=tuple(RUN_KEY)) -> DataFrame:
    return trades.groupBy(*keys, session_of("entry_ts").alias("session")).agg(F.count("*").alias("n_trades"), win_rate()).where(c("n_trades") >= min_trades)


def with_bar_value(trades: DataFrame, features: DataFrame, name: str, missing=None) -> DataFrame:
    """The value of a bar column at each trade's entry."""
    j = trades.join(features.select(*KEY, c("ts").alias("entry_ts"), name), [*KEY, "entry_ts"], "left")
    return j if missing is None else j.withColumn(name, F.coalesce(name, F.lit(missing)))


def by_regime(trades: DataFrame, features: DataFrame, min_trades: int = 10, keys=tuple(RUN_KEY)) -> DataFrame:
    t = with_bar_value(trades, features, "regime").where("regime is not null")
    return t.groupBy(*keys, "regime").agg(F.count("*").alias("n_trades"), win_rate(), total_pnl()).where(c("n_trades") >= min_trades)


def volatility_filter(trades: DataFrame, features: DataFrame, keys=tuple(RUN_KEY)) -> DataFrame:
    """Ledger figures when entries with a large |atr_z| are left out."""
    keys = list(keys)
    t = with_bar_value(trades, features, "atr_z", 0.0)
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(v) if v is not None else None).cast("double").alias("max_atr_z")) for i, v in enumerate(ATR_Z_LEVELS)])
    kept = t.withColumn("_l", F.explode(levels)).select("*", "_l.*").where(c("max_atr_z").isNull() | (F.abs("atr_z") <= c("max_atr_z")))
    run = [*keys, "level", "max_atr_z"]
    kept = kept.withColumn("max_atr_z", F.coalesce("max_atr_z", F.lit(-1.0)))
    eq = ledger.equity(kept, run, pnl="pnl")
    return eq.groupBy(*run).agg(
        F.count("*").alias("n_trades"), F.round(F.sum("pnl") / F.first("start_capital") * 100, 2).alias("pnl_pct"), F.round(F.max("drawdown_pct"), 2).alias("max_drawdown"), win_rate())


def regime_best_ratio(trades: DataFrame, features: DataFrame, params: DataFrame, min_trades: int = 5) -> DataFrame:
    """Per regime the target ratio with the highest return."""
    t = with_bar_value(trades, features, "regime").where("regime is not null").join(params.select("param_id", "tp_rr"), "param_id")
    g = t.groupBy(*KEY, "regime", "tp_rr").agg(F.count("*").alias("n"), F.round(F.sum("pnl") / F.first("start_capital") * 100, 4).alias("pnl_pct")).where(c("n") >= min_trades)
    return g.groupBy(*KEY, "regime").agg(F.max_by("tp_rr", F.struct("pnl_pct", -c("tp_rr"))).alias("best_rr"), F.max("pnl_pct").alias("best_pnl_pct"))


def confluence(trades: DataFrame, hours: float = 2.0) -> DataFrame:
    """Trades entered near another config's trade against isolated ones."""
    t = joins.confirmed_elsewhere(trades.withColumn("config", F.concat_ws(" ", *KEY, c("param_id").cast("string"))), hours)
    return t.groupBy("confirmed").agg(F.count("*").alias("n_trades"), win_rate(), F.round(F.avg("pnl"), 4).alias("avg_pnl"))


def significance(trades: DataFrame, min_trades: int = 10, alpha: float = 0.05, keys=tuple(RUN_KEY)) -> DataFrame:
    """Exact one-sided binomial test of the win rate against one half, per type."""
    g = trades.groupBy(*keys, "move_type").agg(F.count("*").alias("n"), F.count_if(won()).alias("wins")).where(c("n") >= min_trades)
    return g.withColumn("p_value", binomial_tail(c("wins"), c("n"))).withColumn("significant", c("p_value") < alpha)


@F.pandas_udf(T.DoubleType())
def _binomial_tail(wins: pd.Series, n: pd.Series) -> pd.Series:
    """P(X >= wins) for X ~ Binomial(n, 1/2), from logs of the coefficients, smallest terms first."""
    out = []
    for k, m in zip(wins.astype(int), n.astype(int), strict=True):
        i = np.arange(1, m + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log(m - i + 1.0) - np.log(i))]) - m * np.log(2.0)
        out.append(min(1.0, float(np.exp(logs[: max(k, 0) - 1 if k > 0 else None : -1]).sum())))
    return pd.Series(out)


def binomial_tail(wins: Column, n: Column) -> Column:
    return _binomial_tail(wins, n)


def weekly_correlation(trades: DataFrame) -> DataFrame:
    """Pearson r of weekly results for the pairs of configs that share a week with trades.

    Weeks start at midnight of the first entry overall; a week without trades counts
    as zero. Pairs arise from shared weeks only, and sums over weeks come from the
    sparse week totals, so neither a week-by-config grid nor all pairs are built. The r
    of a pair without a shared week follows from the two configs alone: its xy sum is 0.
    """
    t = trades.withColumn("config", F.concat_ws(" ", *KEY, c("param_id").cast("string")))
    bounds = t.agg(F.date_trunc("day", F.min("entry_ts")).alias("_t0"), F.max("entry_ts").alias("_t1"))
    week = 7 * 86400
    dur = F.unix_micros("_t1") / 1e6 - F.unix_seconds("_t0")
    b = bounds.withColumn("_weeks", F.ceil(dur / week))
    w = t.crossJoin(F.broadcast(b)).withColumn("_w", F.floor((F.unix_seconds("entry_ts") - F.unix_seconds("_t0")) / week)).where(c("_w") < c("_weeks"))
    tot = w.groupBy("config", "_w", "_weeks").agg(F.sum("pnl").alias("_p"))
    m = tot.groupBy("config", "_weeks").agg(F.sum("_p").alias("_s"), F.sum(c("_p") * c("_p")).alias("_ss"))
    x, y = tot.select(c("config").alias("a"), "_w", c("_p").alias("_x")), tot.select(c("config").alias("b"), "_w", c("_p").alias("_y"))
    xy = x.join(y, "_w").where(c("a") < c("b")).groupBy("a", "b").agg(F.sum(c("_x") * c("_y")).alias("_xy"))
    ma = m.select(c("config").alias("a"), c("_s").alias("_sa"), c("_ss").alias("_ssa"), c("_weeks").alias("n"))
    mb = m.select(c("config").alias("b"), c("_s").alias("_sb"), c("_ss").alias("_ssb"))
    pairs = xy.join(ma, "a").join(mb, "b")
    cov = c("n") * c("_xy") - c("_sa") * c("_sb")
    var = (c("n") * c("_ssa") - c("_sa") * c("_sa")) * (c("n") * c("_ssb") - c("_sb") * c("_sb"))
    return pairs.select(c("a").alias("config_a"), c("b").alias("config_b"), c("n").alias("n_weeks"), F.when(var > 0, cov / F.sqrt(var)).alias("r"))


def monte_carlo(trades: DataFrame, n_sims: int = 1000, keys=tuple(RUN_KEY)) -> DataFrame:
    """Bootstrap of the ledger: quantiles of return and drawdown, chance of ruin.

    Draw j of simulation s takes the trade at position hash(s, j) mod n, so any task
    can make any draw; a run's simulations are spread over tasks by simulation.
    """
    keys = list(keys)
    pos = _in_time(trades, keys)
    draws = pos.select(*keys, "pos", "_n", "start_capital").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))))
    pick = (c("sim").cast("long") * 7919 + c("pos").cast("long") * 104729 + c("sim").cast("long") * c("pos").cast("long") * 31) % 1000003 % c("_n")
    values = pos.select(*keys, c("pos").alias("_at"), c("pnl").alias("_v"))
    d = draws.withColumn("_at", pick.cast("int")).join(values, [*keys, "_at"])
    # A path is cut into blocks that hand on their sum and highest prefix.
    d = ledger.equity(d, [*keys, "sim"], pnl="_v", order="pos")
    sims = d.groupBy(*keys, "sim", "start_capital").agg(F.sum("_v").alias("_sum"), F.max("drawdown_pct").alias("_maxdd"))
    sims = sims.withColumn("_pct", F.round(c("_sum") / c("start_capital") * 100, 6)).withColumn("_maxdd", F.round("_maxdd", 6))
    r1 = F.row_number().over(Window.partitionBy(*keys).orderBy("_pct")) - 1
    r2 = F.row_number().over(Window.partitionBy(*keys).orderBy("_maxdd")) - 1
    s = sims.withColumn("_r1", r1).withColumn("_r2", r2)
    at = lambda r, q, v: F.max(F.when(c(r) == int(q * n_sims), c(v)))
    return s.groupBy(*keys).agg(
        at("_r1", 0.05, "_pct").alias("p5"), at("_r1", 0.5, "_pct").alias("p50"), at("_r1", 0.95, "_pct").alias("p95"), at("_r2", 0.95, "_maxdd").alias("dd_p95"),
        F.round(F.count_if(c("_pct") < -50) / n_sims * 100, 2).alias("ruin_pct"), F.round(F.count_if(c("_pct") > 0) / n_sims * 100, 2).alias("profitable_pct"))
