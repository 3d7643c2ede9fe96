"""Plain SQL for events, predictors, conditions and trades (DuckDB dialect)."""

from __future__ import annotations

from candlewright.operators.outcomes import DEFAULTS
from candlewright.plans.inputs import BASE_PARAMS, LEADING, STUDY, TIERS
from candlewright.plans.sql_features import CTE, P, before, prev, roll

FEATS = ", ".join(STUDY)
TK = "symbol, move_type"

CTE["sf"] = f"""
SELECT symbol, timeframe, ts, i, open, high, low, close, volume, pc, rng, rsi_14, (close - bb_lower) / (bb_upper - bb_lower + 1e-10) AS bb_position,
 (close - ll20) / (hh20 - ll20 + 1e-10) AS donchian_pos, volume_ratio, (close / {prev('close', 5)} - 1) * 100 AS roc_5, body / (rng + 1e-10) AS body_ratio,
 rng / (({roll('avg', 'rng', 10)}) + 1e-10) AS range_compression_10, stoch_k, count(*) OVER (PARTITION BY symbol) AS n,
 i < floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) AS is_train, coalesce({roll('avg', 'rng', 14)}, 0.001) AS atr0
FROM l3"""
CTE["run0"] = f"SELECT symbol, i, i - max(CASE WHEN sign(close - open) = 1 THEN -1 ELSE i END) OVER ({P}) AS cb, i - max(CASE WHEN sign(close - open) = -1 THEN -1 ELSE i END) OVER ({P}) AS cr FROM b"
CTE["run1"] = f"SELECT symbol, i, lag(cb) OVER ({P}) AS bull, lag(cr) OVER ({P}) AS bear FROM run0"
CTE["dt"] = f"""
SELECT sf.*, bull, bear, (close - pc) / (pc + 1e-10) AS mv, (open - pc) / (pc + 1e-10) AS gap,
 max(close) {before(20).replace('PARTITION BY symbol ORDER BY i', 'PARTITION BY sf.symbol ORDER BY sf.i')} AS hi, min(close) {before(20).replace('PARTITION BY symbol ORDER BY i', 'PARTITION BY sf.symbol ORDER BY sf.i')} AS lo
FROM sf JOIN run1 USING (symbol, i)"""


def type_case(k: str = "2.5", gap: float = 4.0, run: int = 3, squeeze: str = "") -> str:
    return f"""CASE WHEN rng > {k} * atr0 THEN (CASE WHEN mv > 0 THEN 'IMPULSE_UP' ELSE 'IMPULSE_DOWN' END)
 WHEN close > hi * 1.001 AND pc <= hi THEN 'BREAKOUT_UP' WHEN close < lo * 0.999 AND pc >= lo THEN 'BREAKDOWN'
 WHEN mv < -0.005 AND bull >= {run} THEN 'REVERSAL_DOWN' WHEN mv > 0.005 AND bear >= {run} THEN 'REVERSAL_UP' {squeeze}
 WHEN gap > {gap} THEN 'GAP_UP' WHEN gap < -{gap} THEN 'GAP_DOWN' END"""


SIDE = "CASE WHEN starts_with(move_type, 'IMPULSE') THEN (CASE WHEN mv >= 0 THEN 'UP' ELSE 'DOWN' END) WHEN contains(move_type, 'UP') THEN 'UP' ELSE 'DOWN' END"
CTE["ev0"] = f"SELECT *, {type_case()} AS move_type FROM dt WHERE i >= 50"
CTE["ev"] = f"""SELECT symbol, timeframe, i, ts, move_type, {SIDE} AS direction, round(mv * 100, 4) AS magnitude_pct, round(rng / (atr0 + 1e-10), 2) AS atr_multiple, is_train
FROM ev0 WHERE move_type IS NOT NULL"""
CTE["tev"] = "SELECT * FROM ev WHERE is_train"
CTE["okt"] = "SELECT symbol, move_type FROM tev GROUP BY ALL HAVING count(*) >= 3"
CTE["sp"] = "SELECT symbol, i, " + ", ".join(f"avg({f}) {before(5)} AS {f}" for f in STUDY) + " FROM sf"
CTE["prew"] = f"SELECT v.symbol, v.move_type, v.i, {', '.join('p.' + f for f in STUDY)} FROM tev v JOIN okt USING (symbol, move_type) JOIN sp p ON p.symbol = v.symbol AND p.i = v.i"
CTE["pre"] = f"SELECT symbol, move_type, i, feature, value FROM (SELECT symbol, move_type, i, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in STUDY)} FROM prew) UNPIVOT (value FOR feature IN ({FEATS}))"
CTE["bgw"] = f"""
SELECT t.symbol, t.move_type, s.i, {', '.join('s.' + f for f in STUDY)} FROM (SELECT * FROM sf WHERE is_train) s
JOIN (SELECT DISTINCT symbol, move_type FROM tev) t ON t.symbol = s.symbol
WHERE s.i >= 50 AND NOT EXISTS (SELECT 1 FROM tev v WHERE v.symbol = t.symbol AND v.move_type = t.move_type AND v.i BETWEEN s.i - 7 AND s.i + 7)"""
CTE["bg"] = f"SELECT symbol, move_type, i, feature, value FROM (SELECT symbol, move_type, i, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in STUDY)} FROM bgw) UNPIVOT (value FOR feature IN ({FEATS}))"
M = "count(*) AS n_{t}, avg(value) AS mean_{t}, stddev_pop(value) AS std_{t}, var_samp(value) AS var_{t}"
CTE["mo"] = f"""SELECT * FROM (SELECT symbol, move_type, feature, {M.format(t='ev')} FROM pre GROUP BY ALL) JOIN (SELECT symbol, move_type, feature, {M.format(t='bg')} FROM bg GROUP BY ALL) USING (symbol, move_type, feature)
WHERE n_ev >= 2 AND n_bg >= 2 AND NOT (std_ev < 1e-10 AND std_bg < 1e-10)"""
CTE["st1"] = """
SELECT symbol, move_type, feature, n_ev AS n_events, n_bg AS n_background, mean_ev AS mean_before, std_ev AS std_before, mean_bg AS mean_all, std_bg AS std_all,
 (mean_ev - mean_bg) / sqrt(var_ev / n_ev + var_bg / n_bg) AS t_statistic,
 pow(var_ev / n_ev + var_bg / n_bg, 2) / (pow(var_ev / n_ev, 2) / (n_ev - 1) + pow(var_bg / n_bg, 2) / (n_bg - 1)) AS dof,
 (mean_ev - mean_bg) / (sqrt((std_ev * std_ev + std_bg * std_bg) / 2) + 1e-10) AS cohens_d, (mean_ev - mean_bg) / (abs(mean_bg) + 1e-10) AS lift_factor,
 mean_bg + sign((mean_ev - mean_bg)) * std_bg AS threshold FROM mo"""
CTE["stats"] = """
SELECT s.*, h.predictive_pct FROM st1 s JOIN (SELECT p.symbol, p.move_type, p.feature, 100 * avg(CASE WHEN (CASE WHEN t_statistic > 0 THEN value > threshold ELSE value < threshold END) THEN 1.0 ELSE 0.0 END) AS predictive_pct
 FROM pre p JOIN st1 USING (symbol, move_type, feature) GROUP BY ALL) h USING (symbol, move_type, feature)"""
CTE["pred"] = """
SELECT *, row_number() OVER (PARTITION BY symbol, move_type ORDER BY abs(t_statistic) DESC, feature) AS rank FROM (
 SELECT symbol, move_type, feature, n_events, n_background, round(mean_before, 6) AS mean_before, round(std_before, 6) AS std_before, round(mean_all, 6) AS mean_all, round(std_all, 6) AS std_all,
 round(t_statistic, 4) AS t_statistic, dof, round(cohens_d, 4) AS cohens_d, round(lift_factor, 4) AS lift_factor, round(threshold, 6) AS threshold, round(predictive_pct, 1) AS predictive_pct FROM stats)"""
CTE["lead"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, move_type ORDER BY rank) AS pos FROM pred
 WHERE abs(t_statistic) >= {LEADING['min_t']} AND predictive_pct >= {LEADING['min_hit']}) WHERE pos <= {LEADING['top']}"""
CTE["xev"] = "SELECT * FROM ev WHERE NOT is_train"
CTE["sfl"] = f"SELECT symbol, i, is_train, feature, value FROM (SELECT symbol, i, is_train, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in STUDY)} FROM sf) UNPIVOT (value FOR feature IN ({FEATS}))"
MET = "(CASE WHEN l.t_statistic > 0 THEN x.value > l.mean_before * 0.9 ELSE x.value < l.mean_before * 1.1 END)"
CTE["hits"] = f"""
SELECT v.symbol, v.move_type, v.i, l.feature, coalesce(bool_or({MET}), false) AS met FROM xev v JOIN lead l USING (symbol, move_type)
LEFT JOIN sfl x ON x.symbol = v.symbol AND x.feature = l.feature AND x.i BETWEEN v.i - 3 AND v.i - 1 GROUP BY ALL"""
CTE["rec_"] = """SELECT symbol, move_type, count(*) AS n_test, CAST(round_even(avg(CASE WHEN cov >= 0.5 THEN 1.0 ELSE 0.0 END) * 100, 0) AS INT) AS recall_pct
FROM (SELECT symbol, move_type, i, avg(CASE WHEN met THEN 1.0 ELSE 0.0 END) AS cov FROM hits GROUP BY ALL) GROUP BY ALL"""
CTE["fire"] = f"""
SELECT symbol, move_type, i FROM (SELECT l.symbol, l.move_type, x.i, count(*) FILTER (WHERE {MET}) AS met FROM lead l JOIN sfl x USING (symbol, feature) WHERE NOT x.is_train GROUP BY ALL)
JOIN (SELECT symbol, move_type, count(*) AS k FROM lead GROUP BY ALL) USING (symbol, move_type) WHERE met / k >= 0.5"""
CTE["prc"] = """SELECT f.symbol, f.move_type, count(*) AS signal_fires, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM xev v WHERE v.symbol = f.symbol AND v.move_type = f.move_type AND v.i BETWEEN f.i + 1 AND f.i + 2)) AS signal_confirmed FROM fire f GROUP BY ALL"""
CTE["val0"] = """
SELECT b.*, coalesce(t.n_train, 0) AS n_train, coalesce(n_test, 0) AS n_test, coalesce(recall_pct, 0) AS recall_pct, coalesce(signal_fires, 0) AS signal_fires, coalesce(signal_confirmed, 0) AS signal_confirmed,
 coalesce(CAST(round_even(signal_confirmed * 100.0 / nullif(signal_fires, 0), 0) AS INT), 0) AS precision_pct
FROM (SELECT symbol, move_type, count(*) AS n_conditions, CAST(round_even(avg(predictive_pct), 0) AS INT) AS insample_hit FROM lead GROUP BY ALL) b
LEFT JOIN rec_ USING (symbol, move_type) LEFT JOIN prc USING (symbol, move_type) LEFT JOIN (SELECT symbol, move_type, count(*) AS n_train FROM tev GROUP BY ALL) t USING (symbol, move_type)"""
CTE["val"] = """
SELECT *, insample_hit - recall_pct AS degradation, CASE WHEN recall_pct >= 60 AND precision_pct >= 50 AND insample_hit - recall_pct <= 10 THEN 'ROBUST'
 WHEN recall_pct >= 45 AND precision_pct >= 35 AND insample_hit - recall_pct <= 20 THEN 'STABIL' WHEN recall_pct >= 30 AND insample_hit - recall_pct <= 35 THEN 'SCHWACH' ELSE 'OVERFITTED' END AS label FROM val0"""
CTE["cond"] = f"""
SELECT symbol, move_type, tier, tier_rank, feature, CASE WHEN t_statistic > 0 THEN 'above' ELSE 'below' END AS direction, mean_before AS threshold, mean_all AS baseline_avg,
 round(abs(mean_before - mean_all) / (abs(mean_all) + 1e-9) * 100, 1) AS deviation_pct, round(t_statistic, 3) AS t_statistic, predictive_pct AS hit_rate_pct FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol, move_type, tier ORDER BY s) AS tier_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, move_type ORDER BY rank) AS s,
   CASE WHEN abs(t_statistic) >= {TIERS['must'][0]} AND predictive_pct >= {TIERS['must'][1]} THEN 'must_have' WHEN abs(t_statistic) >= {TIERS['should'][0]} AND predictive_pct >= {TIERS['should'][1]} THEN 'should_have' ELSE 'supporting' END AS tier
  FROM pred WHERE abs(t_statistic) >= {TIERS['strong_t']}))
WHERE tier_rank <= CASE WHEN tier = 'must_have' THEN 8 ELSE 10 END"""

# ── trades ───────────────────────────────────────────────────────────────────
CTE["tsrc"] = "SELECT *, symbol AS base FROM sf WHERE NOT is_train"
CTE["tl"] = f"SELECT symbol, base, i, feature, value FROM (SELECT symbol, base, i, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in STUDY)} FROM tsrc) UNPIVOT (value FOR feature IN ({FEATS}))"
CTE["sc"] = """
SELECT g.param_id, k.slice AS symbol, k.i, k.move_type, sum(CASE WHEN met THEN t ELSE 0 END) AS score, count(*) FILTER (WHERE met) AS m, count(*) AS tt
FROM (SELECT tl.symbol AS slice, tl.i, c.move_type, abs(c.t_statistic) AS t, CASE WHEN c.direction = 'above' THEN value > baseline_avg ELSE value < baseline_avg END AS met
 FROM tl JOIN cond c ON c.symbol = tl.base AND c.feature = tl.feature AND c.tier IN ('must_have', 'should_have')) k JOIN g ON k.t >= g.t_threshold GROUP BY ALL"""
CTE["bs"] = """
SELECT param_id, symbol, i, first(move_type ORDER BY round(score, 9) DESC, move_type) AS move_type, max(score) AS score, first(m / tt ORDER BY round(score, 9) DESC, move_type) AS hit_rate, count(*) AS n_types_signaling
FROM sc JOIN g USING (param_id) WHERE score >= min_score AND m / tt >= min_hit_rate GROUP BY ALL HAVING max(score) > 0"""
CTE["lvl"] = """
SELECT *, CASE WHEN lg THEN liq_price > sl ELSE liq_price < sl END AS is_liq, CASE WHEN lg THEN greatest(sl, liq_price) ELSE least(sl, liq_price) END AS stop FROM (
 SELECT bs.*, g.* EXCLUDE (param_id), t.ts, t.close AS e, contains(move_type, 'UP') AS lg, t.close * sl_pct / 100 AS sd, mi, mx,
  t.close - (CASE WHEN contains(move_type, 'UP') THEN 1 ELSE -1 END) * t.close * sl_pct / 100 AS sl, t.close + (CASE WHEN contains(move_type, 'UP') THEN 1 ELSE -1 END) * t.close * sl_pct / 100 * tp_rr AS tp,
  t.close - (CASE WHEN contains(move_type, 'UP') THEN 1 ELSE -1 END) * t.close * greatest(100.0 / leverage - 0.5, 0.05) / 100 AS liq_price,
  risk_per_trade_pct * (CASE WHEN risk_per_trade_pct / (sl_pct / 100) / leverage > 90 THEN 90 / (risk_per_trade_pct / (sl_pct / 100) / leverage) ELSE 1 END) AS risk,
  least(risk_per_trade_pct / (sl_pct / 100) / leverage, 90) AS margin
 FROM bs JOIN g USING (param_id) JOIN tsrc t USING (symbol, i) JOIN (SELECT symbol, min(i) AS mi, max(i) AS mx FROM tsrc GROUP BY ALL) USING (symbol) WHERE t.close > 0)"""
CTE["ox"] = """
SELECT l.param_id, l.symbol, l.i, min(b.i) AS xi FROM lvl l JOIN tsrc b ON b.symbol = l.symbol AND b.i > l.i AND b.i <= l.i + l.max_hold_bars AND b.close > 0
WHERE (CASE WHEN lg THEN b.low <= stop OR b.high >= tp ELSE b.high >= stop OR b.low <= tp END) OR b.i - l.i >= max_hold_bars GROUP BY ALL"""
CTE["oc"] = """
SELECT l.*, coalesce(ox.xi, l.mx) AS exit_idx, coalesce(b.close, z.close) AS close_price, coalesce(b.ts, z.ts) AS close_ts, risk / (sl_pct / 100) * (fee_pct_per_side / 100) * 2 AS fee,
 CASE WHEN ox.xi IS NULL THEN 'END' WHEN (CASE WHEN lg THEN b.low <= stop ELSE b.high >= stop END) THEN (CASE WHEN is_liq THEN 'LIQ' ELSE 'SL' END) WHEN (CASE WHEN lg THEN b.high >= tp ELSE b.low <= tp END) THEN 'TP' ELSE 'TIMEOUT' END AS close_reason
FROM lvl l LEFT JOIN ox USING (param_id, symbol, i) LEFT JOIN tsrc b ON b.symbol = l.symbol AND b.i = ox.xi JOIN tsrc z ON z.symbol = l.symbol AND z.i = l.mx"""
CTE["oc1"] = """
SELECT *, CASE WHEN close_reason = 'END' THEN mx + 1 ELSE greatest(exit_idx, i + 1) END AS free, (CASE close_reason WHEN 'LIQ' THEN -margin WHEN 'SL' THEN -risk WHEN 'TP' THEN risk * tp_rr ELSE (CASE WHEN lg THEN 1 ELSE -1 END) * (close_price - e) / sd * risk END) - fee AS raw_pnl
FROM oc WHERE i - mi >= 10"""
CTE["nx"] = "SELECT a.*, b.i AS nxt FROM oc1 a ASOF LEFT JOIN (SELECT param_id, symbol, i FROM oc1) b ON a.param_id = b.param_id AND a.symbol = b.symbol AND a.free <= b.i"
CTE["chain"] = """
SELECT param_id, symbol, min(i) AS i FROM oc1 GROUP BY ALL
UNION ALL SELECT c.param_id, c.symbol, n.nxt FROM chain c JOIN nx n ON n.param_id = c.param_id AND n.symbol = c.symbol AND n.i = c.i WHERE n.nxt IS NOT NULL"""
CTE["tr"] = """
SELECT n.symbol, n.param_id, ts AS entry_ts, close_ts, move_type, CASE WHEN lg THEN 'LONG' ELSE 'SHORT' END AS direction, e AS entry_price, close_price, sl, tp, liq_price, leverage, round(score, 2) AS score, round(hit_rate, 3) AS hit_rate,
 n_types_signaling, round(raw_pnl, 4) AS pnl, round(raw_pnl, 3) AS pnl_pct, close_reason, exit_idx - n.i AS bars_held, n.i AS entry_idx, exit_idx, raw_pnl FROM nx n JOIN chain c ON c.param_id = n.param_id AND c.symbol = n.symbol AND c.i = n.i"""
CTE["eq0"] = "SELECT *, 100 + sum(raw_pnl) OVER (PARTITION BY symbol, param_id ORDER BY entry_idx) AS capital FROM tr"
CTE["eq"] = "SELECT *, (peak - capital) / peak * 100 AS dd FROM (SELECT *, greatest(100, max(capital) OVER (PARTITION BY symbol, param_id ORDER BY entry_idx)) AS peak FROM eq0)"
CTE["summ"] = """
SELECT symbol, param_id, count(*) AS n_trades, round(count(*) FILTER (WHERE pnl > 0) * 100.0 / count(*), 1) AS win_rate, CAST(round(CAST(round(sum(raw_pnl), 8) AS DECIMAL(20, 8)), 2) AS DOUBLE) AS pnl_pct, round(greatest(max(dd), 0), 2) AS max_drawdown,
 round(CASE WHEN count(*) <= 1 OR stddev_pop(pnl) <= greatest(abs(avg(pnl)) * 1e-6, 1e-9) THEN 0 ELSE avg(pnl) / stddev_pop(pnl) * sqrt(count(*)) END, 3) AS sharpe,
 round(CASE WHEN abs(coalesce(sum(pnl) FILTER (WHERE pnl <= 0), 0)) > 0 THEN coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / abs(sum(pnl) FILTER (WHERE pnl <= 0)) ELSE 999 END, 2) AS profit_factor,
 round(coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0), 4) AS avg_win, round(coalesce(avg(pnl) FILTER (WHERE pnl <= 0), 0), 4) AS avg_loss, round(100 + sum(raw_pnl), 4) AS end_capital, count(*) FILTER (WHERE close_reason = 'LIQ') AS n_liquidations
FROM eq GROUP BY ALL"""


def grid_sql(rows: list[dict]) -> str:
    names = ["param_id", "t_threshold", "min_score", "min_hit_rate", "sl_pct", "tp_rr", "leverage", "risk_per_trade_pct", "max_hold_bars", "fee_pct_per_side"]
    vals = []
    for n, r in enumerate(rows):
        full = {**DEFAULTS, "param_id": n, **r}
        vals.append("(" + ", ".join(f"CAST({full[k]!r} AS {'BIGINT' if k in ('param_id', 'max_hold_bars') else 'DOUBLE'})" for k in names) + ")")
    return f"SELECT * FROM (VALUES {', '.join(vals)}) t({', '.join(names)})"


CTE["g"] = grid_sql([{**BASE_PARAMS, "param_id": 0}])
