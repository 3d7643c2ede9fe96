"""Candle fixtures and slow, obvious re-statements used to check the operators."""

import numpy as np
import pandas as pd


def walk(n, seed=42, symbols=("X", "Y"), timeframe="1h", step=0.01, start="2022-01-01", freq="h"):
    out = []
    for k, s in enumerate(symbols):
        rng = np.random.default_rng(seed + k)
        close = 100 * np.exp(np.cumsum(rng.normal(0, step, n)))
        open_ = close * (1 + rng.normal(0, step / 3, n))
        high = np.maximum(open_, close) * (1 + np.abs(rng.normal(0, step / 2, n)))
        low = np.minimum(open_, close) * (1 - np.abs(rng.normal(0, step / 2, n)))
        out.append(pd.DataFrame({"symbol": s, "timeframe": timeframe, "ts": pd.date_range(start, periods=n, freq=freq), "open": open_,
                                 "high": high, "low": low, "close": close, "volume": np.abs(rng.normal(5e3, 1e3, n))}))
    return pd.concat(out, ignore_index=True)


def to_spark(spark, pdf):
    from candlewright.core import BAR_SCHEMA

    return spark.createDataFrame(pdf, BAR_SCHEMA)


def order_blocks(o, h, lo, cl, sign, lookback=5, age=50, cap=3, impulse=0.015):
    zones, hits = [], np.zeros(len(cl))
    for i in range(3, len(cl)):
        zones = [z for z in zones if i - z[0] <= age]
        touched = next((z for z in zones if lo[i] <= z[2] and h[i] >= z[1]), None)
        if touched is not None:
            hits[i] = 1
            zones.remove(touched)
        if sign * (cl[i] - cl[i - 1]) / (cl[i - 1] + 1e-10) > impulse:
            for j in range(i - 1, max(i - lookback, 0), -1):
                if sign * (cl[j] - o[j]) < 0:
                    zones = (zones + [(i, lo[j], h[j])])[-cap:]
                    break
    return hits


def trades_one_by_one(bars, conds, p, capital=100.0):
    """Bar-by-bar walk over one series; conds: {type: [(feature, above, base, t)]}."""
    out, pos = [], None
    for i in range(10, len(bars)):
        b = bars.iloc[i]
        if b.close <= 0:
            continue
        if pos is not None:
            long, held = pos["long"], i - pos["i"]
            stop_hit = b.low <= pos["stop"] if long else b.high >= pos["stop"]
            tp_hit = b.high >= pos["tp"] if long else b.low <= pos["tp"]
            pnl = None
            if stop_hit:
                pnl, why = (-pos["margin"], "LIQ") if pos["liq"] else (-pos["risk"], "SL")
            elif tp_hit:
                pnl, why = pos["risk"] * p["tp_rr"], "TP"
            elif held >= p["max_hold_bars"]:
                pnl, why = (1 if long else -1) * (b.close - pos["e"]) / pos["d"] * pos["risk"], "TIMEOUT"
            if pnl is not None:
                out.append((pos["i"], i, why, pnl - pos["fee"]))
                pos = None
        if pos is None:
            best = None
            for mt in sorted(conds):
                ok = [(f, a, base, t) for f, a, base, t in conds[mt] if t >= p["t_threshold"] and not np.isnan(b[f])]
                met = [t for f, a, base, t in ok if (b[f] > base if a else b[f] < base)]
                if ok and sum(met) >= p["min_score"] and len(met) / len(ok) >= p["min_hit_rate"] and sum(met) > (best[0] if best else 0):
                    best = (sum(met), mt)
            if best:
                long, d = "UP" in best[1], b.close * p["sl_pct"] / 100
                risk = capital * p["risk_per_trade_pct"] / 100
                notional = risk / (p["sl_pct"] / 100)
                margin = notional / p["leverage"]
                if margin > capital * 0.9:
                    f = capital * 0.9 / margin
                    risk, notional, margin = risk * f, notional * f, capital * 0.9
                s = 1 if long else -1
                sl, liq = b.close - s * d, b.close - s * b.close * max(100 / p["leverage"] - 0.5, 0.05) / 100
                is_liq = liq > sl if long else liq < sl
                pos = dict(i=i, e=b.close, d=d, long=long, stop=liq if is_liq else sl, liq=is_liq, tp=b.close + s * d * p["tp_rr"], risk=risk, margin=margin,
                           fee=notional * p["fee_pct_per_side"] / 100 * 2)
    if pos is not None:
        last = bars.iloc[-1].close or pos["e"]
        out.append((pos["i"], len(bars) - 1, "END", (1 if pos["long"] else -1) * (last - pos["e"]) / pos["d"] * pos["risk"] - pos["fee"]))
    return out
