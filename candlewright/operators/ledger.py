"""Equity, drawdown and summaries of trade ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from candlewright.core import KEY
from candlewright.operators.outcomes import RUN_KEY
from candlewright.operators.ranks import positions, ranged_positions

c = F.col


def equity(trades: DataFrame, keys=tuple(RUN_KEY), pnl: str = "raw_pnl", order: str = "entry_idx", block: int = 4096) -> DataFrame:
    """Adds capital, peak and drawdown_pct after each trade.

    Running sums and maxima are taken inside blocks of the order column; every block
    hands its total and its highest prefix to the later ones.
    """
    keys = list(keys)
    run = Window.partitionBy(*keys, "_eb").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("_eb", F.floor(c(order) / block)).withColumn("_s", F.sum(pnl).over(run))
    t = t.withColumn("_m", F.max("_s").over(run))
    earlier = Window.partitionBy(*keys).orderBy("_eb").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(*keys, "_eb").agg(F.sum(pnl).alias("_tot"), F.max("_s").alias("_top"))
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_tot").over(earlier), F.lit(0.0)))
    blocks = blocks.withColumn("_high", F.max(c("_base") + c("_top")).over(earlier)).select(*keys, "_eb", "_base", "_high")
    j = t.join(blocks, [*keys, "_eb"])
    cap = c("start_capital") + c("_base") + c("_s")
    peak = F.greatest(c("start_capital"), c("start_capital") + c("_high"), c("start_capital") + c("_base") + c("_m"))
    return j.select(*trades.columns, cap.alias("capital"), peak.alias("peak")).withColumn("drawdown_pct", (c("peak") - c("capital")) / c("peak") * 100)


def summarize(trades: DataFrame, keys=tuple(RUN_KEY)) -> DataFrame:
    """Trades, win rate, return, drawdown, Sharpe, profit factor, averages, liquidations."""
    keys = list(keys)
    eq = equity(trades, keys)
    win = c("pnl") > 0
    g = eq.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.count_if(win).alias("n_wins"), F.sum("raw_pnl").alias("_total"), F.first("start_capital").alias("_start"),
        F.max("drawdown_pct").alias("_dd"), F.avg("pnl").alias("_mean"), F.stddev_pop("pnl").alias("_sd"),
        F.sum(F.when(win, c("pnl"))).alias("_win"), F.sum(F.when(~win, c("pnl"))).alias("_loss"), F.count_if(c("close_reason") == "LIQ").alias("n_liquidations"))
    calm = c("_sd") <= F.greatest(F.abs("_mean") * 1e-6, F.lit(1e-9))
    loss = F.abs(F.coalesce("_loss", F.lit(0.0)))
    wins = F.coalesce("_win", F.lit(0.0))
    return g.select(
        *keys, "n_trades", F.round(c("n_wins") / c("n_trades") * 100, 1).alias("win_rate"), # Sums of different order must not split a rounding tie; decimals round ties away from zero.
        F.round(F.round(c("_total") / c("_start") * 100, 8).cast("decimal(20,8)"), 2).cast("double").alias("pnl_pct"),
        F.round(F.greatest("_dd", F.lit(0.0)), 2).alias("max_drawdown"),
        F.round(F.when((c("n_trades") <= 1) | calm, 0.0).otherwise(F.try_divide(c("_mean"), c("_sd")) * F.sqrt("n_trades")), 3).alias("sharpe"),
        F.round(F.when(loss > 0, F.try_divide(wins, loss)).otherwise(999.0), 2).alias("profit_factor"),
        F.round(F.when(c("n_wins") > 0, F.try_divide(wins, c("n_wins"))).otherwise(0.0), 4).alias("avg_win"),
        F.round(F.when(c("n_trades") > c("n_wins"), F.try_divide(c("_loss"), c("n_trades") - c("n_wins"))).otherwise(0.0), 4).alias("avg_loss"),
        F.round(c("_start") + c("_total"), 4).alias("end_capital"), "n_liquidations")


def prune(summary: DataFrame, min_trades: int = 20, max_drawdown: float = 30.0, min_win_rate: float | None = None) -> DataFrame:
    """Summaries that survive the search limits."""
    ok = (c("n_trades") >= min_trades) & (c("max_drawdown") <= max_drawdown)
    return summary.where(ok if min_win_rate is None else ok & (c("win_rate") >= min_win_rate))


def best_parameters(summary: DataFrame) -> DataFrame:
    cols = [x for x in summary.columns if x not in KEY]
    return summary.groupBy(*KEY).agg(F.max_by(F.struct(*cols), F.struct("pnl_pct", -c("param_id"))).alias("_b")).select(*KEY, "_b.*")


def ranking(summary: DataFrame) -> DataFrame:
    """All runs by return: `position` from 1, from ranges of the order and their counts."""
    order = [F.desc("pnl_pct"), *[c(x) for x in RUN_KEY]]
    return ranged_positions(summary, [], order).withColumn("position", c("pos") + 1).drop("pos", "_n")


def merged_capital(trades: DataFrame, configs: DataFrame, block_seconds: int = 30 * 86400) -> DataFrame:
    """Sum of all separate capitals after each close.

    Summing the change of each trade gives the same line as carrying every config's
    last capital forward, without a column per config.
    """
    start = configs.agg(F.sum("start_capital").alias("start_total"))
    per_ts = trades.groupBy("close_ts").agg(F.sum("pnl").alias("_p"))
    t = per_ts.withColumn("_b", F.floor(F.unix_seconds("close_ts") / block_seconds))
    run = Window.partitionBy("_b").orderBy("close_ts").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = t.groupBy("_b").agg(F.sum("_p").alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0.0))).drop("_t")
    return t.withColumn("_s", F.sum("_p").over(run)).join(base, "_b").crossJoin(F.broadcast(start)).select(
        "close_ts", (c("start_total") + c("_base") + c("_s")).alias("total_capital"))


def rescale_capital(trades: DataFrame, new_capital) -> DataFrame:
    f = (new_capital if not isinstance(new_capital, (int, float)) else F.lit(float(new_capital))) / c("start_capital")
    return trades.withColumn("pnl", F.round(c("pnl") * f, 4)).withColumn("raw_pnl", c("raw_pnl") * f).withColumn("start_capital", c("start_capital") * f)


def share_capital(configs: DataFrame, total: float) -> DataFrame:
    """New start capitals that keep the old proportions and sum to `total`."""
    s = configs.agg(F.sum("start_capital").alias("_w"), F.count("*").alias("_n"))
    share = F.when(c("_w") > 0, c("start_capital") / c("_w")).otherwise(1.0 / c("_n"))
    return configs.crossJoin(F.broadcast(s)).withColumn("start_capital", F.round(share * total, 4)).drop("_w", "_n")


def drawdown_episodes(trades: DataFrame, keys=tuple(RUN_KEY), block: int = 4096) -> DataFrame:
    """Spells below the last peak: where they start and end, depth, length in trades.

    Position 0 is the start capital. A spell starts at its peak and ends at the trade
    that reaches it again, or at the last trade.
    """
    keys = list(keys)
    eq = equity(trades, keys, pnl="pnl")
    # The ledger of one run holds non-overlapping trades only, one row per trade.
    blk = F.floor(c("entry_idx") / block)
    t = positions(eq, keys, blk, ["entry_idx"]).withColumn("pos", c("pos") + 1).withColumn("_b", blk).withColumn("_new", c("capital") >= c("peak"))
    inside = Window.partitionBy(*keys, "_b").orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    # The latest peak of the block's own, else that of the blocks before.
    peak = F.max(F.when(c("_new"), c("pos")))
    tops = t.groupBy(*keys, "_b").agg(peak.alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_carried", F.max("_top").over(earlier)).drop("_top")
    t = t.join(tops, [*keys, "_b"]).withColumn("_peak_pos", F.coalesce(F.greatest(peak.over(inside), "_carried"), F.lit(0)))
    t = t.withColumn("_next", F.when(c("pos") < c("_n"), c("pos") + 1))
    below = t.where(~c("_new"))
    g = below.groupBy(*keys, c("_peak_pos").alias("start_pos")).agg(F.max("drawdown_pct").alias("depth_pct"), F.max(F.coalesce("_next", "pos")).alias("end_pos"))
    return g.withColumn("length", c("end_pos") - c("start_pos"))


def _ranked_lengths(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of the first episode of each length, and the number of episodes. Different lengths add up to the trades, so n trades have below sqrt(2 n) of them."""
    w = Window.partitionBy(*keys).orderBy("length")
    return sizes.withColumn("_at", F.sum("_c").over(w) - c("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))


def drawdown_summary(episodes: DataFrame, keys=tuple(RUN_KEY)) -> DataFrame:
    keys = list(keys)
    # The length in the middle; the upper one of two.
    sizes = episodes.groupBy(*keys, "length").agg(F.count("*").alias("_c"))
    mid = _ranked_lengths(sizes, keys).where((c("_at") <= F.floor(c("_n") / 2)) & (F.floor(c("_n") / 2) < c("_at") + c("_c"))).select(*keys, c("length").alias("median_length"))
    return episodes.groupBy(*keys).agg(
        F.count("*").alias("n_episodes"), F.max("length").alias("longest"), F.round(F.max("depth_pct"), 1).alias("deepest_pct"),
        F.max_by("length", F.struct("depth_pct", -c("start_pos"))).alias("deepest_length")).join(mid, keys)
