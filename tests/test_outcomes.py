import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.operators import ledger, outcomes, touch
from candlewright.operators.chunks import index_bars
from helpers import to_spark, trades_one_by_one, walk

CONDS = [
    ("IMPULSE_UP", "fa", "above", 0.0, 5.0), ("IMPULSE_UP", "fb", "above", 1.0, 3.2), ("IMPULSE_UP", "fc", "below", 0.0, 4.1),
    ("IMPULSE_DOWN", "fa", "below", 0.0, 5.0), ("IMPULSE_DOWN", "fc", "above", 0.0, 3.9),
]
NAMES = ["fa", "fb", "fc"]


def setup(spark, pdf):
    feats = index_bars(to_spark(spark, pdf[["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"]]))
    extra = spark.createDataFrame(pdf[["symbol", "ts", *NAMES]].astype({"ts": "datetime64[us]"}))
    extra = extra.select("symbol", "ts", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in NAMES])
    series = [r[0] for r in feats.select("symbol").distinct().collect()]
    rows = [(s, "1h", mt, "must_have", f, d, b, t) for s in series for mt, f, d, b, t in CONDS]
    conds = spark.createDataFrame(rows, "symbol string, timeframe string, move_type string, tier string, feature string, direction string, baseline_avg double, t_statistic double")
    return feats.join(extra, ["symbol", "ts"]), conds


def noisy(n=3000, seed=42):
    pdf = walk(n, seed=seed, symbols=("A",), step=0.015)
    rng = np.random.default_rng(seed)
    for k in NAMES:
        pdf[k] = rng.normal(0.3, 1.2, n)
    pdf.loc[::200, "fa"] = np.nan
    pdf.loc[[i for i in (500, 1500, 2500) if i < n], "close"] = 0.0
    return pdf


def compare(spark, pdf, rows):
    feats, conds = setup(spark, pdf)
    hold = max(r["max_hold_bars"] for r in rows)
    got = outcomes.simulate(feats, conds, NAMES, outcomes.grid(spark, rows), hold).toPandas()
    types: dict = {}
    for mt, f, d, b, t in CONDS:
        types.setdefault(mt, []).append((f, d == "above", b, t))
    for i, r in enumerate(rows):
        want = trades_one_by_one(pdf, types, {**outcomes.DEFAULTS, **r})
        g = got[got["param_id"] == i].sort_values("entry_idx")
        assert g[["entry_idx", "exit_idx", "close_reason"]].values.tolist() == [[a, b, w] for a, b, w, _ in want], r
        assert np.allclose(g["raw_pnl"], [x[3] for x in want], atol=1e-6)
    return got


def test_random_grid_equals_bar_by_bar(spark):
    rows = [{**r, "min_score": float(s)} for r, s in zip(outcomes.random_grid(24), np.random.default_rng(1).uniform(1, 9, 24))]
    got = compare(spark, noisy(), rows)
    assert len(got) > 200


def test_liquidations(spark):
    rows = [dict(t_threshold=3.0, min_score=4.0, min_hit_rate=0.3, sl_pct=s, tp_rr=2.0, leverage=lv, risk_per_trade_pct=1.0, max_hold_bars=24) for lv in (30, 40, 50, 60) for s in (3.0, 4.0, 5.0)]
    assert (compare(spark, noisy(1500, 7), rows)["close_reason"] == "LIQ").any()


def test_chain_across_chunks(spark):
    """Selection chained over small chunks equals selection in one piece."""
    pdf = noisy(3000, 3)
    feats, conds = setup(spark, pdf)
    p = outcomes.grid(spark, [dict(t_threshold=3.0, min_score=3.0, min_hit_rate=0.2, sl_pct=3.0, tp_rr=2.0, max_hold_bars=30)])
    o = outcomes.label_outcomes(outcomes.add_levels(outcomes.best_signals(outcomes.signal_ladders(feats, conds, NAMES), p)), feats, 30)
    pick = lambda size: [r[0] for r in outcomes.select_non_overlapping(o, 30, size).select("bar_idx").orderBy("bar_idx").collect()]
    assert pick(64) == pick(100000)


def test_sweep_does_not_depend_on_chunks_or_blocks_of_sets(spark):
    feats, conds = setup(spark, noisy(1500, 5))
    rows = [{**r, "min_score": 2.0 + i % 4, "max_hold_bars": 5 + 9 * (i % 4)} for i, r in enumerate(outcomes.random_grid(9))]
    grid = outcomes.grid(spark, rows)
    read = lambda **kw: sorted(map(tuple, outcomes.simulate(feats, conds, NAMES, grid, 40, **kw).select("param_id", "entry_idx", "exit_idx", "close_reason", "raw_pnl").collect()))
    whole = read()
    assert len(whole) > 100 and read(chunk=64, sets_per_task=2) == whole


def test_first_touch_by_plain_search():
    rng = np.random.default_rng(9)
    n = 700
    index = np.cumsum(rng.integers(1, 3, n))  # some bars cannot be traded
    close = 100 + rng.normal(0, 1, n).cumsum()
    high, low = close + rng.random(n), close - rng.random(n)
    path = touch.Bars(index, high, low, 40)
    at = rng.integers(0, n, 2000)
    hold = rng.integers(1, 41, 2000)
    long = rng.random(2000) < 0.5
    side = np.where(long, 1.0, -1.0)
    stop, target = close[at] - side * rng.random(2000) * 6, close[at] + side * rng.random(2000) * 6
    place, why = path.exits(at, long, stop, target, hold)
    for i in range(2000):
        want = (n, 3)
        for j in range(at[i] + 1, min(at[i] + hold[i] + 1, n)):
            if (low[j] <= stop[i]) if long[i] else (high[j] >= stop[i]):
                want = (j, 1)
            elif (high[j] >= target[i]) if long[i] else (low[j] <= target[i]):
                want = (j, 2)
            elif index[j] - index[at[i]] >= hold[i]:
                want = (j, 0)
            else:
                continue
            break
        assert (place[i], why[i]) == want


def test_single_take_profit(spark):
    pdf = walk(30, symbols=("A",))
    pdf[["open", "close"]] = 100.0
    pdf["high"], pdf["low"] = 100.1, 99.9
    pdf["fa"], pdf["fb"], pdf["fc"] = -0.0, 0.0, 0.0
    pdf.loc[12, "fa"] = 1.0
    pdf.loc[13, "high"] = 110.0
    feats, conds = setup(spark, pdf)
    conds = conds.where("feature = 'fa' and move_type = 'IMPULSE_UP'")
    t = outcomes.simulate(feats, conds, NAMES, outcomes.grid(spark, [dict(min_score=1.0, sl_pct=2.0, tp_rr=1.0)]), 24)
    s = ledger.summarize(t).collect()
    assert len(s) == 1 and s[0]["n_trades"] == 1 and s[0]["sharpe"] == 0.0 and s[0]["profit_factor"] == 999.0
    assert t.collect()[0]["close_reason"] == "TP"


def test_drawdown_episodes(spark):
    pnl = [1, -2, -1, 4, 2, -5, 1]
    rows = [("A", "1h", 0, i, float(p), float(p), 100.0, "SL") for i, p in enumerate(pnl)]
    t = spark.createDataFrame(rows, "symbol string, timeframe string, param_id long, entry_idx long, pnl double, raw_pnl double, start_capital double, close_reason string")
    e = [(r["start_pos"], r["end_pos"], r["length"]) for r in ledger.drawdown_episodes(t).orderBy("start_pos").collect()]
    assert e == [(1, 4, 3), (5, 7, 2)]


@pytest.mark.parametrize("wins,n,p", [(8, 10, 0.0546875), (10, 10, 0.0009765625), (0, 5, 1.0)])
def test_binomial_tail(spark, wins, n, p):
    from candlewright.operators.analyses import binomial_tail

    df = spark.createDataFrame([(wins, n)], "w long, n long").select(binomial_tail(F.col("w"), F.col("n")).alias("p"))
    assert abs(df.collect()[0]["p"] - p) < 1e-12
