"""Signals, outcomes, ledgers and the ledger studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.core import KEY
from candlewright.operators import analyses as an, ledger, levels, outcomes
from candlewright.plans import inputs, sql_study
from candlewright.plans.inputs import BASE_PARAMS, STUDY
from candlewright.plans.sql_features import CTE, oracle
from candlewright.plans.sql_study import grid_sql
from candlewright.plans.study_queries import REG_EX, regime_frame

QUERIES, ORACLES = {}, {}
c = F.col
TK = ["symbol", "move_type"]


def query(name, sql=None, extra=None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, extra)
        return fn

    return put


@query("sg01_score_signals", "SELECT symbol, i AS bar_idx, move_type, round(score, 4) AS score, m AS n_met, tt AS n_total FROM sc")
def _(spark, sf):
    s = outcomes.score_signals(inputs.test_bars(spark, sf), inputs.conditions(spark, sf), STUDY, BASE_PARAMS["t_threshold"]).where("n_total > 0")
    return s.select("symbol", "bar_idx", "move_type", F.round("score", 4).alias("score"), c("n_met").cast("long").alias("n_met"), c("n_total").cast("long").alias("n_total"))


def base_grid(spark):
    return outcomes.grid(spark, [{**BASE_PARAMS, "param_id": 0}])


def base_signals(spark, sf):
    ladders = outcomes.signal_ladders(inputs.test_bars(spark, sf), inputs.conditions(spark, sf), STUDY)
    return outcomes.best_signals(ladders, base_grid(spark))


@query("sg02_best_signal", "SELECT symbol, i AS bar_idx, move_type, round(score, 4) AS score, round(hit_rate, 6) AS hit_rate, n_types_signaling FROM bs")
def _(spark, sf):
    return base_signals(spark, sf).select("symbol", "bar_idx", "move_type", F.round("score", 4).alias("score"), F.round("hit_rate", 6).alias("hit_rate"), c("n_types_signaling").cast("long").alias("n_types_signaling"))


@query("sg03_price_levels", "SELECT symbol, i AS bar_idx, round(sl + 1e-7, 5) AS sl, round(tp + 1e-7, 5) AS tp, round(liq_price + 1e-7, 5) AS liq_price, is_liq AS is_liquidation, round(stop + 1e-7, 5) AS effective_stop FROM lvl")
def _(spark, sf):
    s = outcomes.add_levels(base_signals(spark, sf))
    return s.select("symbol", "bar_idx", *[F.round(c(x) + 1e-7, 5).alias(x) for x in ("sl", "tp", "liq_price", "effective_stop")], "is_liquidation")


@query("sg04_size", "SELECT symbol, i AS bar_idx, round(risk, 6) AS risk_amount, round(risk / (sl_pct / 100), 6) AS notional, round(margin, 6) AS margin_required, round(risk / (sl_pct / 100) * (fee_pct_per_side / 100) * 2, 6) AS fee_cost FROM lvl")
def _(spark, sf):
    s = outcomes.add_levels(base_signals(spark, sf))
    return s.select("symbol", "bar_idx", *[F.round(x, 6).alias(x) for x in ("risk_amount", "notional", "margin_required", "fee_cost")])


HOLD = BASE_PARAMS["max_hold_bars"]


@query("out01_label_outcomes", "SELECT symbol, i AS bar_idx, exit_idx, close_reason, exit_idx - i AS bars_held FROM oc")
def _(spark, sf):
    o = outcomes.label_outcomes(outcomes.add_levels(base_signals(spark, sf)), inputs.test_bars(spark, sf), HOLD)
    return o.select("symbol", "bar_idx", "exit_idx", "close_reason", "bars_held")


@query("out02_non_overlapping", "SELECT symbol, entry_idx, exit_idx FROM tr")
def _(spark, sf):
    return inputs.base_trades(spark, sf).select("symbol", "entry_idx", "exit_idx")


TRADE = "symbol, param_id, entry_idx, move_type, direction, score, hit_rate, n_types_signaling, pnl, pnl_pct, close_reason, bars_held, leverage"


@query("out03_trade_pnl", f"SELECT {TRADE} FROM tr")
def _(spark, sf):
    return inputs.base_trades(spark, sf).select(*[c(x).cast("long").alias(x) if x == "n_types_signaling" else c(x) for x in TRADE.split(", ")])


@query("out04_equity", "SELECT symbol, entry_idx, round(capital, 6) AS capital, round(peak, 6) AS peak, round(dd, 6) AS drawdown_pct FROM eq")
def _(spark, sf):
    e = ledger.equity(inputs.base_trades(spark, sf))
    return e.select("symbol", "entry_idx", *[F.round(x, 6).alias(x) for x in ("capital", "peak", "drawdown_pct")])


SUMM = "symbol, param_id, n_trades, win_rate, pnl_pct, max_drawdown, sharpe, profit_factor, avg_win, avg_loss, end_capital, n_liquidations"


@query("out05_summary", f"SELECT {SUMM} FROM summ")
def _(spark, sf):
    return ledger.summarize(inputs.base_trades(spark, sf)).select(*SUMM.split(", "))


GRID = [
    {**BASE_PARAMS, "t_threshold": t, "min_score": m, "sl_pct": s, "leverage": lv, "max_hold_bars": h}
    for t in (0.5, 1.2) for m in (2.5, 5.0) for s, lv in ((10.0, 4.0), (30.0, 20.0), (90.0, 1.0)) for h in (3, 12)  # every kind of exit occurs
]


def grid_ex(rows):
    return {"g": grid_sql(rows)}


def grid_summary(spark, sf, name, rows, data=None):
    return inputs.once(spark, sf, f"summary_{name}", lambda: ledger.summarize(inputs.run_grid(spark, sf, name, rows, data)))


@query("out06_sweep", f"SELECT {SUMM} FROM summ", grid_ex(GRID))
def _(spark, sf):
    return grid_summary(spark, sf, "grid", GRID).select(*SUMM.split(", "))


QUERIES["jn08_series_by_grid"], ORACLES["jn08_series_by_grid"] = QUERIES["out06_sweep"], ORACLES["out06_sweep"]


@query("out07_prune", "SELECT symbol, first(param_id ORDER BY pnl_pct DESC, param_id) AS param_id, max(pnl_pct) AS pnl_pct, count(*) AS n_kept FROM summ WHERE n_trades >= 10 AND max_drawdown <= 50 GROUP BY ALL", grid_ex(GRID))
def _(spark, sf):
    kept = ledger.prune(grid_summary(spark, sf, "grid", GRID), 10, 50.0)
    n = kept.groupBy("symbol").agg(F.count("*").alias("n_kept"))
    return ledger.best_parameters(kept).select("symbol", "param_id", "pnl_pct").join(n, "symbol")


HOLD_OUT = {"tsrc": "SELECT symbol || CASE WHEN is_train THEN '@a' ELSE '@b' END AS symbol, sf.* EXCLUDE (symbol), symbol AS base FROM sf"}


@query("out07b_choose_then_hold_out", """
SELECT t.symbol, t.param_id, t.pnl_pct AS train_pnl_pct, s.n_trades, s.win_rate, s.pnl_pct FROM (
 SELECT split_part(symbol, '@', 1) AS symbol, first(param_id ORDER BY pnl_pct DESC, param_id) AS param_id, max(pnl_pct) AS pnl_pct FROM summ WHERE symbol LIKE '%@a' AND n_trades >= 10 AND max_drawdown <= 50 GROUP BY ALL) t
LEFT JOIN summ s ON s.symbol = t.symbol || '@b' AND s.param_id = t.param_id""", {**grid_ex(GRID), **HOLD_OUT})
def _(spark, sf):
    """The grid is swept on the training bars only; the set chosen there is reported on the hold-out."""
    found = grid_summary(spark, sf, "grid_train", GRID, inputs.study(spark, sf).where("is_train"))
    best = ledger.best_parameters(ledger.prune(found, 10, 50.0)).select(*KEY, "param_id", c("pnl_pct").alias("train_pnl_pct"))
    held = grid_summary(spark, sf, "grid", GRID).select(*KEY, "param_id", "n_trades", "win_rate", "pnl_pct")
    return best.join(held, [*KEY, "param_id"], "left").drop("timeframe")


LEVEL_FEATURES = ["atr_14", "vwap_20", "vol_poc_20", "ema_20", "bb_upper", "bb_lower", "last_swing_low", "last_swing_high"]


def level_frame(spark, sf):
    return inputs.once(spark, sf, "level_frame", lambda: inputs.features(spark, sf, LEVEL_FEATURES))


STRATEGIES = ("BREAKOUT", "MOMENTUM", "ORDERFLOW", "MEAN_REV", "COMPLEXITY", "SQUEEZE", "HYBRID")
LV = {
    # last pivot whose three right-hand bars have closed
    "swp": """SELECT symbol, i, last_value(CASE WHEN lag_h THEN ph3 END IGNORE NULLS) OVER w AS sh, last_value(CASE WHEN lag_l THEN pl3 END IGNORE NULLS) OVER w AS sl_ FROM (
 SELECT symbol, i, lag(h, 3) OVER v AS lag_h, lag(l, 3) OVER v AS lag_l, lag(high, 3) OVER v AS ph3, lag(low, 3) OVER v AS pl3 FROM sw WINDOW v AS (PARTITION BY symbol ORDER BY i)) WINDOW w AS (PARTITION BY symbol ORDER BY i)""",
    "lf0": "SELECT ema.symbol, ema.i, ema.close AS e, a14 AS atr, e20, bb_upper - bb_lower AS wd, p20 AS poc, sh, sl_, k.strategy, k.up, 2.0 AS slp, 2.0 AS rr, CASE WHEN k.up THEN 1 ELSE -1 END AS s FROM ema JOIN po3 USING (symbol, i) JOIN swp USING (symbol, i) CROSS JOIN (SELECT * FROM (VALUES ('BREAKOUT'), ('MOMENTUM'), ('ORDERFLOW'), ('MEAN_REV'), ('COMPLEXITY'), ('SQUEEZE'), ('HYBRID')) a(strategy), (VALUES (true), (false)) b(up)) k",
    "vwx": "SELECT symbol, i, CASE WHEN i >= 19 THEN sum(tp * volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / (sum(volume) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) + 1e-10) END AS vw FROM b",
    "lf": "SELECT lf0.*, vw, 1.5 * atr AS d, CASE WHEN up THEN sl_ * 0.998 ELSE sh * 1.002 END AS cb, CASE WHEN up THEN sl_ * 0.997 ELSE sh * 1.003 END AS cm FROM lf0 JOIN vwx USING (symbol, i)",
    "lg1": """SELECT *, coalesce(abs(e - cb) / e * 100 >= 0.1 AND (e - cb) * s > 0, false) AS okb, coalesce(abs(e - cm) / e * 100 >= 0.1 AND (e - cm) * s > 0, false) AS okm,
 coalesce(vw IS NOT NULL AND abs(vw - e) / e * 100 >= 0.1 AND (vw - e) * s > 0 AND abs(vw - e) / d BETWEEN 1.5 AND 4, false) AS okv, coalesce(abs(poc - e) / e * 100 >= 0.1 AND (poc - e) * s > 0 AND abs(poc - e) / d BETWEEN 1.5 AND 4, false) AS okp FROM lf""",
    "lg2": "SELECT *, CASE WHEN okb THEN cb ELSE e - s * e * slp * 1.2 / 100 END AS slb, CASE WHEN okm THEN cm ELSE e - s * e * slp / 100 END AS slm FROM lg1",
    "lout": """SELECT symbol, i, strategy, up, CASE strategy WHEN 'BREAKOUT' THEN slb WHEN 'MOMENTUM' THEN e - s * 1.5 * atr WHEN 'ORDERFLOW' THEN e - s * d WHEN 'MEAN_REV' THEN slm WHEN 'COMPLEXITY' THEN e - s * 2 * atr WHEN 'SQUEEZE' THEN CASE WHEN wd > 0 THEN e - s * wd * 0.5 ELSE e - s * 1.5 * atr END ELSE e - s * e * slp / 100 END AS sl,
 CASE strategy WHEN 'MOMENTUM' THEN e + s * 2.5 * atr WHEN 'COMPLEXITY' THEN e + s * 3 * atr WHEN 'ORDERFLOW' THEN CASE WHEN okv AND (NOT okp OR abs(vw - e) <= abs(poc - e)) THEN vw WHEN okp THEN poc ELSE e + s * d * 2 END
  WHEN 'MEAN_REV' THEN CASE WHEN abs(e20 - e) / e * 100 >= 0.1 AND (e20 - e) * s > 0 AND abs(e20 - e) >= abs(e - slm) * 1.2 THEN e20 ELSE e + s * abs(e - slm) * 1.5 END WHEN 'HYBRID' THEN e + s * e * slp / 100 * rr END AS tp,
 CASE strategy WHEN 'BREAKOUT' THEN e + s * abs(e - slb) * 1.5 WHEN 'SQUEEZE' THEN CASE WHEN wd > 0 THEN e + s * wd * 1.5 ELSE e + s * 2.25 * atr END END AS act FROM lg2""",
}
from candlewright.plans.feature_queries import EXTRA as FEATURE_EX  # noqa: E402


def plans(spark, sf):
    kinds = F.array(*[F.lit(s) for s in STRATEGIES])
    f = level_frame(spark, sf).withColumn("strategy", F.explode(kinds)).withColumn("side", F.explode(F.array(F.lit("long"), F.lit("short"))))
    f = f.select("*", c("close").alias("entry"), F.lit(2.0).alias("sl_pct"), F.lit(2.0).alias("tp_rr"), F.lit("UNTYPED").alias("move_type"))
    return levels.trade_levels(f)


@query("out08_strategy_levels", "SELECT symbol, i AS bar_idx, strategy, up, round(sl + 1e-7, 5) AS sl, round(tp + 1e-7, 5) AS tp, round(act + 1e-7, 5) AS act FROM lout", {**FEATURE_EX, **LV})
def _(spark, sf):
    return plans(spark, sf).select("symbol", "bar_idx", "strategy", (c("side") == "long").alias("up"), *[F.round(c(f"plan.{x}") + 1e-7, 5).alias(y) for x, y in (("sl_price", "sl"), ("tp_price", "tp"), ("trailing_activation_price", "act"))])


@query("out09_liquidity_target", "SELECT symbol, i AS bar_idx, up, CASE WHEN okv AND (NOT okp OR abs(vw - e) <= abs(poc - e)) THEN 'vwap_20' WHEN okp THEN 'vol_poc_20' END AS target FROM lg2 WHERE strategy = 'ORDERFLOW'", {**FEATURE_EX, **LV})
def _(spark, sf):
    f = level_frame(spark, sf).withColumn("up", F.explode(F.array(F.lit(True), F.lit(False))))
    t = levels.liquidity_target(c("close"), c("up"), 1.5 * c("atr_14"))
    return f.select("symbol", "bar_idx", "up", t.getField("name").alias("target"))


@query("out10_risk_sizing", "SELECT symbol, i AS bar_idx, round(ct, 8) AS contracts FROM (SELECT *, least(greatest(10.0 / abs(e - sl), 0.001), 1000 * 0.99 * 5 / e) AS ct FROM (SELECT symbol, i, e, slb AS sl FROM lg2 WHERE strategy = 'BREAKOUT' AND up)) WHERE ct * e >= 5", {**FEATURE_EX, **LV})
def _(spark, sf):
    p = plans(spark, sf).where("strategy = 'BREAKOUT' and side = 'long'").select("symbol", "bar_idx", "entry", "plan.sl_price", F.lit(1000.0).alias("balance"), F.lit(1.0).alias("risk_per_trade_pct"), F.lit(0.001).alias("min_amount"), F.lit(5.0).alias("leverage"))
    return levels.position_size(p).select("symbol", "bar_idx", F.round("contracts", 8).alias("contracts"))


@query("out11_merged_ledger", "SELECT epoch(close_ts)::BIGINT AS close_s, round(300 + sum(p) OVER (ORDER BY close_ts), 4) AS total_capital FROM (SELECT close_ts, sum(pnl) AS p FROM tr GROUP BY ALL)")
def _(spark, sf):
    t = inputs.base_trades(spark, sf)
    configs = inputs.bars(spark, sf).select(*KEY).distinct().withColumn("start_capital", F.lit(100.0))
    return ledger.merged_capital(t, configs).select(F.unix_seconds("close_ts").alias("close_s"), F.round("total_capital", 4).alias("total_capital"))


@query("out12_rescale", "SELECT symbol, entry_idx, round(pnl * 2.5, 4) AS pnl FROM tr")
def _(spark, sf):
    return ledger.rescale_capital(inputs.base_trades(spark, sf), 250.0).select("symbol", "entry_idx", "pnl")


@query("out12b_share_capital", "SELECT symbol, round(c0 / sum(c0) OVER () * 5000, 4) AS start_capital FROM (SELECT symbol, CAST(count(*) AS DOUBLE) AS c0 FROM ev GROUP BY ALL)")
def _(spark, sf):
    conf = inputs.movements(spark, sf).groupBy("symbol").agg(F.count("*").cast("double").alias("start_capital"))
    return ledger.share_capital(conf, 5000.0).select("symbol", "start_capital")


@query("out13_oos_ranking", "SELECT symbol, n_trades, win_rate, pnl_pct, row_number() OVER (ORDER BY pnl_pct DESC, symbol) AS position FROM summ")
def _(spark, sf):
    s = ledger.summarize(inputs.base_trades(spark, sf))
    return ledger.ranking(s).select("symbol", "n_trades", "win_rate", "pnl_pct", "position")


# ── studies ──────────────────────────────────────────────────────────────────

SF_COLS = "sf.* EXCLUDE (symbol), sf.symbol AS base"
WF = {"tsrc": """SELECT sf.symbol || '@' || k AS symbol, sf.* EXCLUDE (symbol), sf.symbol AS base FROM (SELECT * FROM sf WHERE NOT is_train) sf JOIN (SELECT symbol, min(ts) AS t0, max(ts) AS t1 FROM sf WHERE NOT is_train GROUP BY ALL) q USING (symbol)
 JOIN (SELECT unnest(range(0, 400)) AS k) w ON t0 + to_days(28 * k) < t1 AND ts >= t0 + to_days(28 * k) AND ts < least(t0 + to_days(28 * (k + 1)), t1) + INTERVAL 1 DAY"""}


def sliced(spark, sf, name, cut):
    return grid_summary(spark, sf, name, [{**BASE_PARAMS, "param_id": 0}], cut)


@query("an01_walk_forward", "SELECT symbol, win AS \"window\", n_trades, pnl_pct FROM (SELECT split_part(symbol, '@', 1) AS symbol, CAST(split_part(symbol, '@', 2) AS INT) AS win, n_trades, pnl_pct FROM summ)", WF)
def _(spark, sf):
    s = sliced(spark, sf, "walk", an.time_windows(inputs.test_bars(spark, sf)))
    return an.by_slice(s, "window").select("symbol", "window", "n_trades", "pnl_pct")


@query("an01b_positive_windows", "SELECT split_part(symbol, '@', 1) AS symbol, count(*) AS n_windows, count(*) FILTER (WHERE pnl_pct > 0) AS n_positive, round(count(*) FILTER (WHERE pnl_pct > 0) * 100.0 / count(*), 1) AS positive_pct FROM summ GROUP BY ALL", WF)
def _(spark, sf):
    s = sliced(spark, sf, "walk", an.time_windows(inputs.test_bars(spark, sf)))
    return an.positive_share(an.by_slice(s, "window")).select("symbol", "n_windows", "n_positive", "positive_pct")


FEES = an.level_rows(BASE_PARAMS, "fee_pct_per_side", an.FEE_LEVELS)


@query("an02_fee_break_even", "SELECT symbol, round(min((fee + nf) / 2) FILTER (WHERE pnl_pct > 0 AND np <= 0), 4) AS break_even_fee, first(pnl_pct ORDER BY fee) AS pnl_pct_without_fee FROM (SELECT *, lead(pnl_pct) OVER (PARTITION BY symbol ORDER BY fee) AS np, lead(fee) OVER (PARTITION BY symbol ORDER BY fee) AS nf FROM (SELECT s.*, g.fee_pct_per_side AS fee FROM summ s JOIN g USING (param_id))) GROUP BY ALL", grid_ex(FEES))
def _(spark, sf):
    return an.fee_break_even(grid_summary(spark, sf, "fees", FEES), outcomes.grid(spark, FEES)).drop("timeframe")


MC = {
    "mt": "SELECT symbol, entry_idx, pnl, row_number() OVER (PARTITION BY symbol ORDER BY entry_idx) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM tr",
    "ml": "SELECT symbol, list(pnl ORDER BY entry_idx) AS xs, count(*) AS n FROM tr GROUP BY symbol",
    "ms_": "SELECT symbol, xs, n, unnest(range(0, 200)) AS sim FROM ml",
    "md": "SELECT symbol, sim, pos, xs[(sim * 7919 + pos * 104729 + sim * pos * 31) % 1000003 % n + 1] AS v FROM (SELECT symbol, xs, n, sim, unnest(range(0, n)) AS pos FROM ms_)",
    "mp": "SELECT *, 100 + sum(v) OVER (PARTITION BY symbol, sim ORDER BY pos) AS cap FROM md",
    "mq": "SELECT *, greatest(100, max(cap) OVER (PARTITION BY symbol, sim ORDER BY pos)) AS pk FROM mp",
    "mm": "SELECT symbol, sim, round(sum(v), 6) AS pct, round(max((pk - cap) / pk * 100), 6) AS dd FROM mq GROUP BY ALL",
    "mr": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pct) - 1 AS r1, row_number() OVER (PARTITION BY symbol ORDER BY dd) - 1 AS r2 FROM mm",
}


@query("an03_monte_carlo", "SELECT symbol, round(max(pct) FILTER (WHERE r1 = 10), 4) AS p5, round(max(pct) FILTER (WHERE r1 = 100), 4) AS p50, round(max(pct) FILTER (WHERE r1 = 190), 4) AS p95, round(max(dd) FILTER (WHERE r2 = 190), 4) AS dd_p95, round(count(*) FILTER (WHERE pct < -50) * 100.0 / 200, 2) AS ruin_pct, round(count(*) FILTER (WHERE pct > 0) * 100.0 / 200, 2) AS profitable_pct FROM mr GROUP BY ALL", MC)
def _(spark, sf):
    m = an.monte_carlo(inputs.base_trades(spark, sf), 200)
    return m.select("symbol", *[F.round(x, 4).alias(x) for x in ("p5", "p50", "p95", "dd_p95")], "ruin_pct", "profitable_pct")


@query("an04_significance", "SELECT symbol, move_type, n, wins, round(least(1, (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM (SELECT unnest(range(wins, n + 1)) AS k))), 6) AS p_value FROM (SELECT symbol, move_type, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins FROM tr GROUP BY ALL HAVING count(*) >= 10) q")
def _(spark, sf):
    return an.significance(inputs.base_trades(spark, sf)).select(*TK, "n", "wins", F.round("p_value", 6).alias("p_value"))


for _n, _p, _levels, _rel in (("an05_sweep_ratio", "tp_rr", an.RR_LEVELS, False), ("an06_sweep_score", "min_score", an.REL_LEVELS, True), ("an07_sweep_stop", "sl_pct", an.REL_LEVELS, True)):
    _rows = an.level_rows(BASE_PARAMS, _p, _levels, _rel)

    @query(_n, "SELECT s.symbol, param_id, n_trades, win_rate, pnl_pct, max_drawdown FROM summ s", grid_ex(_rows))
    def _(spark, sf, name=_n, rows=_rows):
        return grid_summary(spark, sf, name, rows).select("symbol", "param_id", "n_trades", "win_rate", "pnl_pct", "max_drawdown")


@query("an05b_best_ratio", "SELECT symbol, first(tp_rr ORDER BY pnl_pct DESC, param_id) AS best_level, max(pnl_pct) AS best_pnl_pct FROM summ JOIN g USING (param_id) GROUP BY ALL", grid_ex(an.level_rows(BASE_PARAMS, "tp_rr", an.RR_LEVELS)))
def _(spark, sf):
    rows = an.level_rows(BASE_PARAMS, "tp_rr", an.RR_LEVELS)
    return an.best_level(grid_summary(spark, sf, "an05_sweep_ratio", rows), outcomes.grid(spark, rows), "tp_rr").drop("timeframe")


SENS = an.sensitivity_rows(BASE_PARAMS)
SENS_NAMES = "[" + ", ".join(f"'{n}'" for n in an.SENSITIVE) + "]"


@query("an08_sensitivity", f"""
SELECT symbol, param, lo, hi, round(abs(hi - lo), 4) AS spread, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(hi - lo), 4) DESC, param) AS rank FROM (
 SELECT s.symbol, {SENS_NAMES}[CAST(floor((s.param_id - 1) / 2) AS INT) + 1] AS param, coalesce(max(s.pnl_pct) FILTER (WHERE s.param_id % 2 = 1), any_value(z.pnl_pct)) AS lo, coalesce(max(s.pnl_pct) FILTER (WHERE s.param_id % 2 = 0), any_value(z.pnl_pct)) AS hi
 FROM summ s LEFT JOIN (SELECT symbol, pnl_pct FROM summ WHERE param_id = 0) z USING (symbol) WHERE s.param_id > 0 GROUP BY ALL)""", grid_ex(SENS))
def _(spark, sf):
    return an.sensitivity(grid_summary(spark, sf, "sens", SENS)).select("symbol", "param", "lo", "hi", "spread", "rank")


@query("an09_confluence", """
SELECT confirmed, count(*) AS n_trades, round(avg(CASE WHEN pnl > 0 THEN 100.0 ELSE 0 END), 1) AS win_rate, round(avg(pnl), 4) AS avg_pnl FROM (
 SELECT a.*, EXISTS (SELECT 1 FROM tr b WHERE b.symbol <> a.symbol AND abs(epoch(b.entry_ts) - epoch(a.entry_ts)) <= 86400) AS confirmed FROM tr a) GROUP BY ALL""")
def _(spark, sf):
    return an.confluence(inputs.base_trades(spark, sf), 24.0)


QUERIES["jn07_time_band_semi"], ORACLES["jn07_time_band_semi"] = QUERIES["an09_confluence"], ORACLES["an09_confluence"]
WR = "round(avg(CASE WHEN pnl > 0 THEN 100.0 ELSE 0 END), 1) AS win_rate"


@query("an10_signal_decay", f"SELECT symbol, bucket, count(*) AS n_trades, {WR}, round(sum(pnl), 4) AS pnl FROM (SELECT *, CAST(least(floor(pos / floor(n / 4)), 3) + 1 AS BIGINT) AS bucket FROM mt WHERE n >= 12) GROUP BY ALL", MC)
def _(spark, sf):
    return an.signal_decay(inputs.base_trades(spark, sf)).select("symbol", "bucket", "n_trades", "win_rate", "pnl")


CORR_ROWS = [{**BASE_PARAMS, "param_id": i, "sl_pct": s} for i, s in enumerate((10.0, 20.0, 30.0))]


@query("an11_weekly_correlation", """
SELECT a.cfg AS config_a, b.cfg AS config_b, count(*) AS n_weeks, round(corr(a.p, b.p), 4) AS r FROM wd a JOIN wd b ON a.w = b.w AND a.cfg < b.cfg
WHERE EXISTS (SELECT 1 FROM wk x JOIN wk y ON x.w = y.w WHERE x.cfg = a.cfg AND y.cfg = b.cfg) GROUP BY ALL""", {
    **grid_ex(CORR_ROWS), "wb": "SELECT date_trunc('day', min(entry_ts)) AS t0, max(entry_ts) AS t1 FROM tr",
    "wk": "SELECT symbol || ' 1d ' || param_id AS cfg, floor((epoch(entry_ts) - epoch(t0)) / 604800) AS w, sum(pnl) AS p FROM tr CROSS JOIN wb GROUP BY ALL",
    "wd": "SELECT c.cfg, k.w, coalesce(wk.p, 0) AS p FROM (SELECT DISTINCT cfg FROM wk) c CROSS JOIN (SELECT unnest(range(0, CAST(ceil((epoch(t1) - epoch(t0)) / 604800) AS BIGINT))) AS w FROM wb) k LEFT JOIN wk ON wk.cfg = c.cfg AND wk.w = k.w"})
def _(spark, sf):
    r = an.weekly_correlation(inputs.run_grid(spark, sf, "corr", CORR_ROWS))
    return r.select("config_a", "config_b", "n_weeks", F.round("r", 4).alias("r"))


@query("an12_kelly", "SELECT symbol, round(least(greatest((win_rate / 100 - (1 - win_rate / 100) / tp_rr) * 100, 0) / 2, 10), 4) AS kelly_pct, pnl_pct FROM summ JOIN g USING (param_id) WHERE n_trades >= 5")
def _(spark, sf):
    s = ledger.summarize(inputs.base_trades(spark, sf))
    return an.kelly(s, base_grid(spark)).select("symbol", "kelly_pct", "pnl_pct")


@query("an13_by_regime", f"SELECT t.symbol, regime, count(*) AS n_trades, {WR}, round(sum(pnl), 4) AS pnl FROM tr t JOIN rgm r ON r.symbol = t.symbol AND r.i = t.entry_idx GROUP BY ALL HAVING count(*) >= 10", REG_EX)
def _(spark, sf):
    return an.by_regime(inputs.base_trades(spark, sf), regime_frame(spark, sf)).select("symbol", "regime", "n_trades", "win_rate", "pnl")


QUERIES["jn01_trade_to_bar"], ORACLES["jn01_trade_to_bar"] = QUERIES["an13_by_regime"], ORACLES["an13_by_regime"]


@query("an14_score_strength", f"SELECT symbol, bucket, count(*) AS n_trades, min(score) AS score_lo, max(score) AS score_hi, {WR} FROM (SELECT *, CAST(least(floor(pos / floor(n / 4)), 3) + 1 AS BIGINT) AS bucket FROM (SELECT symbol, score, pnl, row_number() OVER (PARTITION BY symbol ORDER BY score, entry_idx) - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM tr) WHERE n >= 20) GROUP BY ALL")
def _(spark, sf):
    return an.score_strength(inputs.base_trades(spark, sf)).select("symbol", "bucket", "n_trades", "score_lo", "score_hi", "win_rate")


@query("an15_by_confluence", f"SELECT symbol, n_types_signaling, count(*) AS n_trades, {WR} FROM tr WHERE symbol IN (SELECT symbol FROM tr GROUP BY symbol HAVING max(n_types_signaling) > 1) GROUP BY ALL HAVING count(*) >= 5")
def _(spark, sf):
    return an.by_confluence(inputs.base_trades(spark, sf)).select("symbol", c("n_types_signaling").cast("long").alias("n_types_signaling"), "n_trades", "win_rate")


@query("an16_volatility_filter", f"""
SELECT symbol, lv AS level, count(*) AS n_trades, round(sum(pnl), 2) AS pnl_pct, round(max(d), 2) AS max_drawdown, {WR} FROM (SELECT *, (greatest(100, max(cap) OVER o) - cap) / greatest(100, max(cap) OVER o) * 100 AS d FROM (
 SELECT t.symbol, k.lv, t.entry_idx, t.pnl, 100 + sum(pnl) OVER (PARTITION BY t.symbol, k.lv ORDER BY t.entry_idx) AS cap FROM tr t LEFT JOIN rgm r ON r.symbol = t.symbol AND r.i = t.entry_idx
 JOIN (VALUES (0, NULL), (1, 1.0::DOUBLE), (2, 1.5), (3, 2.0), (4, 2.5), (5, 3.0)) k(lv, mx) ON k.mx IS NULL OR abs(coalesce(r.atr_z, 0)) <= k.mx) WINDOW o AS (PARTITION BY symbol, lv ORDER BY entry_idx)) GROUP BY ALL""", REG_EX)
def _(spark, sf):
    return an.volatility_filter(inputs.base_trades(spark, sf), regime_frame(spark, sf)).select("symbol", "level", "n_trades", "pnl_pct", "max_drawdown", "win_rate")


@query("an17_by_session", f"SELECT symbol, CASE WHEN hour(entry_ts) < 8 THEN 'Asien' WHEN hour(entry_ts) < 16 THEN 'Europa' ELSE 'US' END AS session, count(*) AS n_trades, {WR} FROM tr GROUP BY ALL HAVING count(*) >= 5")
def _(spark, sf):
    return an.by_session(inputs.base_trades(spark, sf)).select("symbol", "session", "n_trades", "win_rate")


@query("an18_regime_best_ratio", """
SELECT symbol, regime, first(tp_rr ORDER BY p DESC, tp_rr) AS best_rr, max(p) AS best_pnl_pct FROM (SELECT t.symbol, regime, tp_rr, round(sum(pnl), 4) AS p FROM tr t JOIN g USING (param_id) JOIN rgm r ON r.symbol = t.symbol AND r.i = t.entry_idx GROUP BY ALL HAVING count(*) >= 5) GROUP BY ALL""",
       {**REG_EX, **grid_ex(an.level_rows(BASE_PARAMS, "tp_rr", an.RR_LEVELS))})
def _(spark, sf):
    rows = an.level_rows(BASE_PARAMS, "tp_rr", an.RR_LEVELS)
    return an.regime_best_ratio(inputs.run_grid(spark, sf, "an05_sweep_ratio", rows), regime_frame(spark, sf), outcomes.grid(spark, rows)).drop("timeframe")


DD = {
    "d0": "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY entry_idx) AS pos, 100 + sum(pnl) OVER (PARTITION BY symbol ORDER BY entry_idx) AS cap FROM tr",
    "d1": "SELECT *, greatest(100, max(cap) OVER (PARTITION BY symbol ORDER BY pos)) AS pk, lead(pos) OVER (PARTITION BY symbol ORDER BY pos) AS nx FROM d0",
    "d2": "SELECT *, coalesce(max(CASE WHEN cap >= pk THEN pos END) OVER (PARTITION BY symbol ORDER BY pos), 0) AS pp FROM d1",
    "d3": "SELECT symbol, pp AS start_pos, max(coalesce(nx, pos)) AS end_pos, max((pk - cap) / pk * 100) AS depth FROM d2 WHERE cap < pk GROUP BY ALL",
}


@query("an19_drawdown_episodes", "SELECT symbol, start_pos, end_pos, end_pos - start_pos AS length, round(depth, 4) AS depth_pct FROM d3", DD)
def _(spark, sf):
    return ledger.drawdown_episodes(inputs.base_trades(spark, sf)).select("symbol", c("start_pos").cast("long").alias("start_pos"), c("end_pos").cast("long").alias("end_pos"), c("length").cast("long").alias("length"), F.round("depth_pct", 4).alias("depth_pct"))


@query("an19b_drawdown_summary", "SELECT symbol, count(*) AS n_episodes, max(end_pos - start_pos) AS longest, list_sort(list(end_pos - start_pos))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_length, round(max(depth), 1) AS deepest_pct FROM d3 GROUP BY ALL", DD)
def _(spark, sf):
    e = ledger.drawdown_episodes(inputs.base_trades(spark, sf))
    return ledger.drawdown_summary(e).select("symbol", "n_episodes", c("longest").cast("long").alias("longest"), c("median_length").cast("long").alias("median_length"), "deepest_pct")


SPLIT = {"tsrc": "SELECT sf.symbol || '@' || p AS symbol, sf.* EXCLUDE (symbol), sf.symbol AS base FROM sf JOIN (SELECT symbol, p, date_trunc('day', ts) AS d FROM sf, (VALUES (60, 0.60::DOUBLE), (65, 0.65), (70, 0.70), (75, 0.75), (80, 0.80)) k(p, f) WHERE i = floor(n * f)) q ON q.symbol = sf.symbol AND sf.ts >= d"}


@query("an20_split_sensitivity", "SELECT split_part(symbol, '@', 1) AS symbol, CAST(split_part(symbol, '@', 2) AS INT) AS split_pct, n_trades, pnl_pct, max_drawdown FROM summ", SPLIT)
def _(spark, sf):
    s = sliced(spark, sf, "splits", an.split_slices(inputs.study(spark, sf)))
    return an.by_slice(s, "split_pct").select("symbol", "split_pct", "n_trades", "pnl_pct", "max_drawdown")


@query("an20b_split_spread", "SELECT split_part(symbol, '@', 1) AS symbol, round(max(pnl_pct) - min(pnl_pct), 2) AS spread, count(*) AS n_slices FROM summ GROUP BY ALL", SPLIT)
def _(spark, sf):
    s = sliced(spark, sf, "splits", an.split_slices(inputs.study(spark, sf)))
    return an.spread_over(an.by_slice(s, "split_pct")).drop("timeframe")
