"""One query per feature operator, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.core import KEY
from candlewright.plans import inputs
from candlewright.plans.sql_features import P, before, div_sign, oracle, prev, roll, w, z

# query name -> {column: (SQL expression, decimals)}; the SQL reads table `l3` or `ema`
SPEC: dict[str, tuple[str, dict[str, tuple[str, int]]]] = {}


def spec(name: str, source: str = "l3", **cols) -> None:
    SPEC[name] = (source, {k: v if isinstance(v, tuple) else (v, 6) for k, v in cols.items()})


spec("t01_sma", **{f"sma_{n}": (roll("avg", "close", n), 4) for n in (10, 20, 50, 100, 200)})
spec("t02_ema", "ema", **{f"ema_{n}": (f"e{n}", 4) for n in (9, 10, 20, 21, 50, 100, 200)})
spec("t03_dist_ema", "ema", **{f"dist_ema_{n}": f"(close - e{n}) / (e{n} + 1e-10)" for n in (9, 21, 50, 200)})
spec("t04_ema_alignment", "ema", ema_alignment=("sign(e9 - e21) + sign(e21 - e50) + sign(e50 - e200)", 0))
WMA = lambda x, n: f"CASE WHEN count({x}) {w(n)} = {n} THEN (" + " + ".join(f"{n - k} * lag({x}, {k}) OVER ({P})" if k else f"{n} * {x}" for k in range(n)) + f") / {n * (n + 1) / 2} END"
spec("t05_wma", wma_14=(WMA("close", 14), 4))
spec("t07_rsi", **{f"rsi_{n}": f"100 - 100 / (1 + ({roll('avg', 'gain', n)}) / (({roll('avg', 'loss', n)}) + 1e-10))" for n in (7, 14, 21)})
spec("t08_rsi_divergence", rsi_divergence=(div_sign("rsi_14", 5), 0))
spec("t09_macd", "ema", macd=("macd", 3), macd_signal=("sig", 3), macd_hist=("macd - sig", 3), macd_hist_slope=(f"(macd - sig) - lag(macd - sig) OVER ({P})", 3))
spec("t10_bollinger", bb_upper=("bb_upper", 3), bb_lower=("bb_lower", 3), bb_width="bb_width", bb_position="(close - bb_lower) / (bb_upper - bb_lower + 1e-10)")
spec("t11_bb_squeeze", bb_squeeze=(f"coalesce(bb_width < ({roll('avg', 'bb_width', 50)}) * 0.8, false)", -99))
spec("t12_keltner", "ema", kc_upper=("e20 + 1.5 * a14", 3), kc_lower=("e20 - 1.5 * a14", 3),
     kc_squeeze=("coalesce(bb_upper < e20 + 1.5 * a14 AND bb_lower > e20 - 1.5 * a14, false)", -99))
spec("t13_atr", "ema", atr_7=("a7", 4), atr_14=("a14", 4), atr_21=("a21", 4))
spec("t14_atr_pct_z", "ema", atr_pct="a14 / (close + 1e-10)", atr_z=z("a14", 50))
spec("t15_adx", "ema", adx="adx", di_plus="di_plus", di_minus="di_minus", di_delta="di_plus - di_minus")
spec("t18_willr", willr_14="-100 * (hh14 - close) / (hh14 - ll14 + 1e-10)")
spec("t19_roc_momentum", **{f"roc_{n}": f"(close / {prev('close', n)} - 1) * 100" for n in (5, 10, 20)}, momentum_10=(f"close - {prev('close', 10)}", 7))
spec("t20_donchian", donchian_high_20=("hh20", 9), donchian_low_20=("ll20", 9), donchian_mid_20=("(hh20 + ll20) / 2", 9),
     donchian_width="(hh20 - ll20) / ((hh20 + ll20) / 2 + 1e-10)", donchian_pos="(close - ll20) / (hh20 - ll20 + 1e-10)")
spec("t21_at_donchian", at_donchian_high=(f"CASE WHEN close >= {prev('hh20')} THEN 1 ELSE 0 END", 0), at_donchian_low=(f"CASE WHEN close <= {prev('ll20')} THEN 1 ELSE 0 END", 0))
spec("t22_stochastic", stoch_k="stoch_k", stoch_d="stoch_d", stoch_cross=(f"sign(stoch_k - stoch_d) - lag(sign(stoch_k - stoch_d)) OVER ({P})", 0))
spec("t23_mfi", mfi_14="mfi_14")
spec("t24_log_returns", **{f"log_return_{n}": f"ln(close / {prev('close', n)})" for n in (1, 3, 5, 10)}, realized_vol_20=f"({roll('stddev_samp', 'lr', 20)}) * sqrt(252)")
spec("t25_body", body=("body", 9), body_ratio="body / (rng + 1e-10)", upper_wick=("uw", 9), lower_wick=("lw", 9), candle_dir=("sign(close - open)", 0))
spec("t27_ichimoku", ichi_tenkan=("tenkan", 9), ichi_kijun=("kijun", 9),
     ichi_above_cloud=(f"CASE WHEN close > lag((tenkan + kijun) / 2, 26) OVER ({P}) AND close > lag((hh52 + ll52) / 2, 26) OVER ({P}) THEN 1.0 ELSE 0.0 END", 0),
     ichi_tk_cross=(f"tk - lag(tk) OVER ({P})", 0))

spec("ph01_motion", velocity=("vel", 7), acceleration=("acc", 7), jerk=(f"acc - lag(acc) OVER ({P})", 7), energy=("energy", 2))
spec("ph07_autocorr", **{
    f"autocorr_{k}": f"CASE WHEN count(lr) {w(20)} = 20 THEN corr(lr, lr{k}) OVER ({P} ROWS BETWEEN {20 - k - 1} PRECEDING AND CURRENT ROW) END" for k in ((1, 2, 5, 10)[0], 5, 10)})
spec("ph09_wpi", wpi="wpi")
spec("ph10_memory_pressure", "ema", memory_pressure="mp")
spec("ph11_cct", cct="cct")
EAR = " + ".join(f"least(greatest({q}, 1e-10), 1 - 1e-10) * log2(least(greatest({q}, 1e-10), 1 - 1e-10))" for q in ("(close - low) / (high - low + 1e-10)", "(high - close) / (high - low + 1e-10)"))
spec("ph14_ear_entropy", ear_entropy=f"CASE WHEN i >= 9 THEN avg(-({EAR})) {w(10)} END")
spec("ph15_phase_regime", phase_regime=("CASE WHEN abs(acc_z) > 2 THEN -1 WHEN abs(vel_z) > 1.5 AND abs(acc_z) < 1 THEN 1 ELSE 0 END", 0))
spec("ph17_energy_z", energy_z=z("energy", 50))

SWING = lambda fn, x: f"coalesce(count({x}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7 AND {x} = {fn}({x}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), false)"
spec("st01_swings", swing_high=(SWING("max", "high"), -99), swing_low=(SWING("min", "low"), -99))
E_ = lambda fn: f"{fn}(close) OVER ({P} ROWS BETWEEN 10 PRECEDING AND 6 PRECEDING)"
L_ = lambda fn: f"{fn}(close) OVER ({P} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
FL = lambda cond: f"CASE WHEN {cond} THEN 1.0 ELSE 0.0 END"
HH, HL, LL, LH = (FL(f"i >= 10 AND {x}") for x in (f"{L_('max')} > {E_('max')}", f"{L_('min')} > {E_('min')}", f"{L_('min')} < {E_('min')}", f"{L_('max')} < {E_('max')}"))
spec("st02_structure", struct_hh=(HH, 0), struct_hl=(HL, 0), struct_ll=(LL, 0), struct_lh=(LH, 0), struct_score=(f"CAST({HH} + {HL} - {LL} - {LH} AS INT)", 0))
spec("st04_fair_value_gaps", fvg_bull=(FL(f"{prev('high', 2)} < low"), 0), fvg_bear=(FL(f"{prev('low', 2)} > high"), 0),
     in_fvg=(FL(f"{prev('high', 2)} < low OR {prev('low', 2)} > high"), 0))
spec("st06_breakouts", **{f"breakout_{d}_{n}": (FL(f"i >= {n} AND close {op} {fn}(close) {before(n)}"), 0) for n in (10, 20) for d, op, fn in (("up", ">", "max"), ("down", "<", "min"))})
spec("st07_gaps", gap_up=(FL("open > pc * 1.002"), 0), gap_down=(FL("open < pc * 0.998"), 0), gap_pct="(open - pc) / (pc + 1e-10)")
VW = f"(({roll('sum', '(tp * volume)', 20)}) / (({roll('sum', 'volume', 20)}) + 1e-10))"
spec("st08_vwap", vwap_20=(VW, 4), price_vs_vwap=f"(close - {VW}) / ({VW} + 1e-10)")
spec("st09_range_compression", **{f"range_compression_{n}": f"rng / (({roll('avg', 'rng', n)}) + 1e-10)" for n in (10, 20)})
spec("st10_inside_outside", inside_bar=(FL("high < ph AND low > pl"), 0), outside_bar=(FL("high > ph AND low < pl"), 0))
spec("st11_pin_bars", pin_bar_bull=(FL("lw > 2 * body AND lw > uw * 2 AND rng > 0"), 0), pin_bar_bear=(FL("uw > 2 * body AND uw > lw * 2 AND rng > 0"), 0))
spec("st12_engulfing", bull_engulf=(FL("close > open AND pc < po AND open < pc AND close > po"), 0), bear_engulf=(FL("close < open AND pc > po AND open > pc AND close < po"), 0))
spec("st13_range_position", range_position_50=f"(close - ({roll('min', 'low', 50)})) / (({roll('max', 'high', 50)}) - ({roll('min', 'low', 50)}) + 1e-10)")

OBV = f"CASE WHEN i > 0 THEN sum(coalesce(sign(close - pc), 0) * volume) OVER ({P}) END"
CVD = f"sum(sign(close - open) * volume) OVER ({P})"
spec("v02_volume_ratio", volume_ratio="volume_ratio", volume_z=z("volume", 20))
spec("v03_surge", volume_surge=(FL("volume_ratio > 2"), 0), volume_dry_up=(FL("volume_ratio < 0.5"), 0))
spec("v04_declining", vol_declining_3=(FL(f"volume < {prev('volume')} AND {prev('volume')} < {prev('volume', 2)} AND {prev('volume', 2)} < {prev('volume', 3)}"), 0))
spec("v06_vol_confirm", vol_confirm="sign(close - open) * volume_ratio")
spec("v09_mfi_divergence", mfi_divergence=(div_sign("mfi_14", 5), 0))
spec("v10_pressure", buy_pressure="buy", sell_pressure="sell", pressure_ratio=("buy / (sell + 1e-10)", -6), cum_pressure_slope=roll("sum", "(buy - sell)", 10))
spec("v11_institutional", institutional_candle=(FL("volume_ratio > 2 AND body / (rng + 1e-10) > 0.6"), 0))
spec("v12_vol_slope", vol_slope_5=(f"volume - {prev('volume', 5)}", 3), vol_slope_10=(f"volume - {prev('volume', 10)}", 3))
spec("c01_dna_code", "ema", dna_code=(
    "(CASE WHEN close >= open THEN 'B' ELSE 'S' END) || (CASE WHEN body < 0.3 * a14 THEN '1' WHEN body < 0.8 * a14 THEN '2' ELSE '3' END) || (CASE WHEN rng < a14 THEN 'L' ELSE 'H' END)", -99))

EXTRA = {
    "cv": f"SELECT *, {OBV} AS obv, {CVD} AS cvd FROM l3",
    "wm": f"SELECT *, {WMA('close', 14)} AS wm, {WMA('close', 7)} AS wh FROM l3",
    "hm": "SELECT *, 2 * wh - wm AS hr FROM wm",
    "lg": "SELECT *, " + ", ".join(f"lag(lr, {k}) OVER ({P}) AS lr{k}" for k in (1, 5, 10)) + " FROM l3",
    "isl": f"SELECT *, max(CASE WHEN sign(close - open) = 1 THEN -1 ELSE i END) OVER ({P}) AS bb, max(CASE WHEN sign(close - open) = -1 THEN -1 ELSE i END) OVER ({P}) AS sb FROM l3",
    # windows of earlier values, with as many rows as bins are needed from
    "ent": "SELECT a.symbol, a.i, k.n, x.lr AS v FROM b a CROSS JOIN (VALUES (10), (20), (40)) k(n) JOIN l1 x ON x.symbol = a.symbol AND x.i BETWEEN a.i - k.n AND a.i - 1 AND x.lr IS NOT NULL WHERE a.i >= k.n",
    "ent1": "SELECT *, min(v) OVER (PARTITION BY symbol, i, n) AS mn, max(v) OVER (PARTITION BY symbol, i, n) AS mx FROM ent",
    "ent2": "SELECT symbol, i, n, least(CAST(floor((v - mn) / ((mx - mn) / 10)) AS INT), 9) AS bin, count(*) AS k FROM ent1 WHERE mx > mn GROUP BY ALL",
    "ent3": "SELECT symbol, i, n, -sum(p * ln(p + 1e-12)) AS h FROM (SELECT *, k / sum(k) OVER (PARTITION BY symbol, i, n) AS p FROM ent2) GROUP BY ALL",
    "ent4": f"SELECT b.*, e1.h AS h10, e2.h AS h20, e3.h AS h40 FROM b LEFT JOIN (SELECT * FROM ent3 WHERE n = 10) e1 USING (symbol, i) LEFT JOIN (SELECT * FROM ent3 WHERE n = 20) e2 USING (symbol, i) LEFT JOIN (SELECT * FROM ent3 WHERE n = 40) e3 USING (symbol, i)",
    "hu": "SELECT a.symbol, a.i, k.n, x.i AS j, x.lr AS v FROM b a CROSS JOIN (VALUES (30), (60), (100)) k(n) JOIN l1 x ON x.symbol = a.symbol AND x.i BETWEEN a.i - k.n AND a.i - 1 AND x.lr IS NOT NULL WHERE a.i >= k.n",
    "hu1": "SELECT *, v - avg(v) OVER (PARTITION BY symbol, i, n) AS d FROM hu",
    "hu2": "SELECT *, sum(d) OVER (PARTITION BY symbol, i, n ORDER BY j) AS cd FROM hu1",
    "hu3": "SELECT symbol, i, n, ln((max(cd) - min(cd)) / sqrt(sum(d * d) / (count(*) - 1))) / ln(count(*)) AS h FROM hu2 GROUP BY ALL",
    "vr": "SELECT a.symbol, a.i, x.i AS j, x.lr AS v FROM b a JOIN l1 x ON x.symbol = a.symbol AND x.i BETWEEN a.i - 40 AND a.i - 1 AND x.lr IS NOT NULL WHERE a.i >= 40",
    "vr1": "SELECT *, sum(v) OVER (PARTITION BY symbol, i ORDER BY j ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS q, count(*) OVER (PARTITION BY symbol, i ORDER BY j ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS nq FROM vr",
    "vr2": "SELECT symbol, i, var_samp(q) FILTER (WHERE nq = 4) / 4 / (var_samp(v) + 1e-12) AS r FROM vr1 GROUP BY ALL",
    "ly": "SELECT a.symbol, a.i, x.i AS j, x.close AS v FROM b a JOIN b x ON x.symbol = a.symbol AND x.i BETWEEN a.i - 30 AND a.i - 1 WHERE a.i >= 30",
    "ly1": "SELECT *, (v - lag(v) OVER (PARTITION BY symbol, i ORDER BY j)) / stddev_pop(v) OVER (PARTITION BY symbol, i) AS d FROM ly",
    "ly2": "SELECT symbol, i, avg(ln(abs(d) + 1e-10)) AS l FROM ly1 WHERE abs(d) > 0 GROUP BY ALL",
    "ve": "SELECT a.symbol, a.i, x.volume AS v, min(x.volume) OVER (PARTITION BY a.symbol, a.i) AS mn, max(x.volume) OVER (PARTITION BY a.symbol, a.i) AS mx FROM b a JOIN b x ON x.symbol = a.symbol AND x.i BETWEEN a.i - 20 AND a.i - 1 WHERE a.i >= 20",
    "ve1": "SELECT symbol, i, CASE WHEN mx > mn THEN least(CAST(floor((v - mn) / ((mx - mn) / 8)) AS INT), 7) ELSE 0 END AS bin, count(*) AS k FROM ve GROUP BY ALL",
    "ve2": "SELECT symbol, i, -sum(p * ln(p + 1e-12)) AS h FROM (SELECT *, k / sum(k) OVER (PARTITION BY symbol, i) AS p FROM ve1) GROUP BY ALL",
    "po": "SELECT a.symbol, a.i, k.n, x.close AS cl, x.volume AS v, min(x.low) OVER (PARTITION BY a.symbol, a.i, k.n) AS lo, max(x.high) OVER (PARTITION BY a.symbol, a.i, k.n) AS hi FROM b a CROSS JOIN (VALUES (20), (50)) k(n) JOIN b x ON x.symbol = a.symbol AND x.i BETWEEN a.i - k.n AND a.i - 1 WHERE a.i >= k.n",
    "po1": "SELECT symbol, i, n, lo, hi, least(CAST(floor((cl - lo) / (hi - lo) * 20) AS INT), 19) AS bin, sum(v) AS v FROM po WHERE hi > lo GROUP BY ALL",
    "po2": "SELECT symbol, i, n, lo, hi, first(bin ORDER BY v DESC, bin) AS top FROM po1 GROUP BY ALL",
    "po3": "SELECT b.*, p1.lo + (p1.hi - p1.lo) / 20 * (p1.top + 0.5) AS p20, p2.lo + (p2.hi - p2.lo) / 20 * (p2.top + 0.5) AS p50 FROM b LEFT JOIN (SELECT * FROM po2 WHERE n = 20) p1 USING (symbol, i) LEFT JOIN (SELECT * FROM po2 WHERE n = 50) p2 USING (symbol, i)",
    "cc": f"SELECT *, CASE WHEN i >= 19 THEN avg(tp) {w(20)} END AS m, list(tp) {w(20)} AS xs FROM b",
    "sl": "SELECT symbol, i, close, row_number() OVER (PARTITION BY symbol ORDER BY i) AS o FROM sw WHERE h",
    "ss": "SELECT symbol, i, close, row_number() OVER (PARTITION BY symbol ORDER BY i) AS o FROM sw WHERE l",
    "sw": f"SELECT *, {SWING('max', 'high')} AS h, {SWING('min', 'low')} AS l FROM b",
    "sn": f"SELECT *, coalesce(sum(CASE WHEN h THEN 1 ELSE 0 END) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nh, coalesce(sum(CASE WHEN l THEN 1 ELSE 0 END) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nl FROM sw",
    "lv": "SELECT n.symbol, n.i, min(h.close) FILTER (WHERE h.close > n.close) - any_value(n.close) AS up, any_value(n.close) AS c FROM sn n LEFT JOIN sl h ON h.symbol = n.symbol AND h.o BETWEEN n.nh - 4 AND n.nh GROUP BY n.symbol, n.i",
    "lu": "SELECT n.symbol, n.i, any_value(n.close) - max(h.close) FILTER (WHERE h.close < n.close) AS dn, any_value(n.close) AS c FROM sn n LEFT JOIN ss h ON h.symbol = n.symbol AND h.o BETWEEN n.nl - 4 AND n.nl GROUP BY n.symbol, n.i",
    "dist": "SELECT b.*, lv.up / (lv.c + 1e-10) AS up, lu.dn / (lu.c + 1e-10) AS dn FROM b JOIN lv USING (symbol, i) JOIN lu USING (symbol, i)",
    # band ratchet: state carried row by row
    "st0": "SELECT symbol, i, (high + low) / 2 - 3 * a10 AS lb, (high + low) / 2 + 3 * a10 AS ub, close, pc FROM ema",
    "st": "SELECT symbol, i, close, lb, ub, 1 AS dir FROM st0 WHERE i = 0 UNION ALL SELECT n.symbol, n.i, n.close, CASE WHEN n.lb < e.lb OR e.close < e.lb THEN n.lb ELSE e.lb END, CASE WHEN n.ub > e.ub OR e.close > e.ub THEN n.ub ELSE e.ub END, CASE WHEN e.dir = 1 AND n.close < (CASE WHEN n.lb < e.lb OR e.close < e.lb THEN n.lb ELSE e.lb END) THEN -1 WHEN e.dir = -1 AND n.close > (CASE WHEN n.ub > e.ub OR e.close > e.ub THEN n.ub ELSE e.ub END) THEN 1 ELSE e.dir END FROM st e JOIN st0 n ON n.symbol = e.symbol AND n.i = e.i + 1",
    # regime and scores
    "hx": "SELECT * FROM hu3 WHERE n = 60",
    "rg": f"SELECT ema.*, ent4.h20, hx.h AS h60, {roll('avg', 'ent4.h20', 50).replace('PARTITION BY symbol ORDER BY i', 'PARTITION BY ema.symbol ORDER BY ema.i')} AS hm FROM ema JOIN ent4 USING (symbol, i) LEFT JOIN hx USING (symbol, i)",
    "rv": "SELECT *, (CASE WHEN adx > 25 THEN 1 ELSE 0 END) + (CASE WHEN h60 > 0.55 THEN 1 ELSE 0 END) + (CASE WHEN abs(vel_z) > 1.5 AND abs(acc_z) < 1 THEN 1 ELSE 0 END) AS tv, (CASE WHEN adx < 20 THEN 1 ELSE 0 END) + (CASE WHEN h60 < 0.45 THEN 1 ELSE 0 END) AS rgv, (CASE WHEN abs(acc_z) > 2 THEN 1 ELSE 0 END) + (CASE WHEN h20 > hm * 1.2 THEN 1 ELSE 0 END) AS cv FROM rg",
}
spec("t06_hma", "hm", hma_14=(WMA("hr", 3), 4))
spec("t16_supertrend", "st", supertrend=("CASE WHEN i > 0 THEN CASE WHEN dir = 1 THEN lb ELSE ub END END", 3), supertrend_dir=("dir", 0))
spec("t17_cci", "cc", cci_20="CASE WHEN i >= 19 THEN (tp - m) / (0.015 * list_avg(list_transform(xs, lambda x: abs(x - m))) + 1e-10) END")
spec("t26_consecutive", "isl", consec_bull=("i - bb", 0), consec_bear=("i - sb", 0))
SPEC["ph07_autocorr"] = ("lg", SPEC["ph07_autocorr"][1])
spec("ph02_entropy", "ent4", entropy_10="h10", entropy_20="h20", entropy_40="h40")
spec("ph03_hurst", "(SELECT b.symbol, b.i, b.timeframe, a.h AS h1, c.h AS h2, d.h AS h3 FROM b LEFT JOIN (SELECT * FROM hu3 WHERE n = 30) a USING (symbol, i) LEFT JOIN (SELECT * FROM hu3 WHERE n = 60) c USING (symbol, i) LEFT JOIN (SELECT * FROM hu3 WHERE n = 100) d USING (symbol, i))", hurst_30="h1", hurst_60="h2", hurst_100="h3")
spec("ph08_variance_ratio", "(SELECT b.symbol, b.i, b.timeframe, vr2.r FROM b LEFT JOIN vr2 USING (symbol, i))", variance_ratio="r")
spec("ph16_lyapunov", "(SELECT b.symbol, b.i, b.timeframe, ly2.l FROM b LEFT JOIN ly2 USING (symbol, i))", lyapunov="l")
spec("ph18_entropy_squeeze", "ent4", entropy_squeeze=(FL(f"h20 < ({roll('avg', 'h20', 50)}) * 0.8"), 0))
spec("ph19_entropy_slope", "ent4", entropy_slope=f"h20 - {prev('h20', 3)}")
spec("st03_level_distance", "dist", dist_to_nearest_resistance="up", dist_to_nearest_support="dn")
spec("v01_obv", "cv", obv=("obv", 2), obv_slope=(f"obv - {prev('obv', 5)}", 2), obv_z=z("obv", 20))
spec("v05_cvd", "cv", cvd=("cvd", 2), cvd_slope=(f"cvd - {prev('cvd', 5)}", 2), cvd_divergence=(div_sign("cvd", 5), 0))
spec("v07_volume_entropy", "(SELECT b.symbol, b.i, b.timeframe, ve2.h FROM b LEFT JOIN ve2 USING (symbol, i))", volume_entropy="h")
spec("v08_point_of_control", "po3", vol_poc_20=("p20", -7), price_vs_poc_20="(close - p20) / (p20 + 1e-10)", vol_poc_50=("p50", -7), price_vs_poc_50="(close - p50) / (p50 + 1e-10)")
spec("c02_regime", "rv", regime=("CASE WHEN cv >= tv AND cv >= rgv THEN 'CHAOS' WHEN rgv >= tv THEN 'RANGE' ELSE 'TREND' END", -99))
EXTRA["ts"] = f"SELECT ema.*, s.dir, {HH} + {HL} - {LL} - {LH} AS sc, CASE WHEN close > lag((tenkan + kijun) / 2, 26) OVER (PARTITION BY ema.symbol ORDER BY ema.i) AND close > lag((hh52 + ll52) / 2, 26) OVER (PARTITION BY ema.symbol ORDER BY ema.i) THEN 1.0 ELSE 0.0 END AS cloud FROM ema JOIN (SELECT symbol AS sy, i AS si, dir FROM st) s ON s.sy = ema.symbol AND s.si = ema.i"
CL = lambda x, lo, hi: f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"
spec("c03_trend_score", "ts", trend_score=CL(f"sign(e9 - e21) + sign(e21 - e50) + sign(e50 - e200) + dir * 2 + sign(di_plus - di_minus) * least(greatest(adx - 20, 0), 30) / 30 * 2 + (cloud * 2 - 1) + least(greatest(sc, -2), 2) * 0.5", -10, 10))
EXTRA["ms"] = f"SELECT ema.*, macd - sig AS mh, cc.m AS cm, cc.xs AS xs FROM ema JOIN cc USING (symbol, i)"
EXTRA["ms1"] = f"SELECT *, {roll('stddev_samp', 'mh', 50)} AS msd FROM ms"
spec("c04_momentum_score", "ms1", momentum_score=CL(f"(rsi_14 - 50) / 10 + ({CL('mh / (msd + 1e-10)', -3, 3)}) + (stoch_k - 50) / 25 + ({CL('(tp - cm) / (0.015 * list_avg(list_transform(xs, lambda x: abs(x - cm))) + 1e-10) / 100', -2, 2)})", -10, 10))
spec("c05_move_readiness", "(SELECT *, " + z("a14", 50) + " AS az, " + z("cct", 50) + " AS cz FROM rg)", move_readiness=CL(
    "(CASE WHEN coalesce(bb_upper < e20 + 1.5 * a14 AND bb_lower > e20 - 1.5 * a14, false) THEN 2 ELSE 0 END) + (CASE WHEN h20 < hm * 0.8 THEN 2 ELSE 0 END) + (" + CL("cz", 0, 2) + ") + (CASE WHEN volume_ratio < 0.5 THEN 1.5 ELSE 0 END) + (" + CL("-az", 0, 2) + ") + (" + CL("1 - abs(h60 - 0.5) * 4", 0, 1) + ")", 0, 10))

ROWS_ONLY = {
    "ph04_higuchi": ["higuchi_fd"], "ph05_dfa": ["dfa_alpha"], "ph06_kalman": ["kalman_vel"], "ph12_fft_period": ["fft_dominant_period"],
    "ph13_hilbert": ["hilbert_phase", "hilbert_phase_cos", "hilbert_phase_sin"], "st05_order_blocks": ["bull_ob", "bear_ob"],
    "st14_last_swing_prices": ["last_swing_high", "last_swing_low"],
}


def _significant(col: str, d: int):
    """-99 keeps the value, a negative count means that many significant decimals."""
    if d == -99:
        return F.col(col)
    if d < 0:
        return F.round(F.col(col) / F.pow(F.lit(10.0), F.floor(F.log10(F.abs(F.col(col)) + 1e-300))), -d).alias(col)
    return F.round(F.col(col).cast("double"), d).alias(col)


def _query(cols: dict[str, tuple[str, int]]):
    def run(spark, sf_dir):
        df = inputs.features(spark, sf_dir, list(cols))
        return df.select("symbol", "bar_idx", *[_significant(k, d) for k, (_, d) in cols.items()])

    return run


def _plain(names):
    return lambda spark, sf_dir: inputs.features(spark, sf_dir, names).select(*KEY, "bar_idx", *[F.round(F.col(n).cast("double"), 6).alias(n) for n in names])


def sql_value(name: str, expr: str, d: int) -> str:
    if d == -99:
        return f"{expr} AS {name}"
    if d < 0:
        return f"round(({expr}) / pow(10.0, floor(log10(abs({expr}) + 1e-300))), {-d}) AS {name}"
    return f"round(CAST({expr} AS DOUBLE), {d}) AS {name}"


QUERIES = {name: _query(cols) for name, (_, cols) in SPEC.items()} | {n: _plain(c) for n, c in ROWS_ONLY.items()}
ORACLES = {
    name: oracle("SELECT symbol, i AS bar_idx, " + ", ".join(sql_value(k, e, d) for k, (e, d) in cols.items()) + f" FROM {source}", EXTRA)
    for name, (source, cols) in SPEC.items()
}
