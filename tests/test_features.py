import numpy as np
import pandas as pd

from candlewright.functions import kernels
from candlewright.functions.features import ALL_FEATURES, LOOK_AHEAD_FEATURES, compute_features
from candlewright.functions.registry import register_feature
from helpers import order_blocks, to_spark, walk


def frame(df):
    return df.orderBy("symbol", "bar_idx").toPandas()


def same(a, b):
    if a.dtype == object or b.dtype == object:
        x, y = pd.Series(a), pd.Series(b)
        return bool(((x == y) | (x.isna() & y.isna())).all())
    return np.allclose(a.astype(float), b.astype(float), rtol=1e-8, atol=1e-8, equal_nan=True)


def test_catalogue_size():
    assert len(ALL_FEATURES) == 171 == len(set(ALL_FEATURES))


def test_machines_do_not_depend_on_chunks(spark):
    """State handed from chunk to chunk equals one pass over the whole series."""
    pdf = walk(6000, symbols=("A", "B"), step=0.008)
    bars = to_spark(spark, pdf)
    names = ["supertrend", "supertrend_dir", "consec_bull", "consec_bear", "obv", "cvd", "last_swing_high", "last_swing_low",
             "dist_to_nearest_resistance", "dist_to_nearest_support", "memory_pressure"]
    small, big = (frame(compute_features(bars, names, chunk=c)) for c in (1024, 8192 * 4))
    for n in names:
        assert same(small[n], big[n]), n


def test_order_blocks_equal_plain_walk(spark):
    pdf = walk(9000, symbols=("A",), step=0.006)
    got = frame(compute_features(to_spark(spark, pdf), ["bull_ob", "bear_ob"], chunk=4096))
    o, h, lo, cl = (pdf[k].to_numpy() for k in ("open", "high", "low", "close"))
    assert got["bull_ob"].tolist() == order_blocks(o, h, lo, cl, 1).tolist()
    assert got["bear_ob"].tolist() == order_blocks(o, h, lo, cl, -1).tolist()


def test_supertrend_equals_plain_walk(spark):
    pdf = walk(3000, symbols=("A",), step=0.02)
    got = frame(compute_features(to_spark(spark, pdf), ["supertrend", "supertrend_dir"], chunk=1024))
    prev = pdf["close"].shift(1)
    tr = pd.concat([pdf["high"] - pdf["low"], (pdf["high"] - prev).abs(), (pdf["low"] - prev).abs()], axis=1).max(axis=1)
    atr = tr.ewm(span=10, adjust=False).mean()
    mid = (pdf["high"] + pdf["low"]) / 2
    lb, ub, cl = (mid - 3 * atr).to_numpy(), (mid + 3 * atr).to_numpy(), pdf["close"].to_numpy()
    side, sides, band = 1, [1], [np.nan]
    for i in range(1, len(cl)):
        if not (lb[i] < lb[i - 1] or cl[i - 1] < lb[i - 1]):
            lb[i] = lb[i - 1]
        if not (ub[i] > ub[i - 1] or cl[i - 1] > ub[i - 1]):
            ub[i] = ub[i - 1]
        side = -1 if side == 1 and cl[i] < lb[i] else 1 if side == -1 and cl[i] > ub[i] else side
        sides.append(side)
        band.append(lb[i] if side == 1 else ub[i])
    assert got["supertrend_dir"].astype(int).tolist() == sides
    assert np.allclose(got["supertrend"].astype(float), band, equal_nan=True)


def test_later_bars_change_nothing(spark):
    pdf = walk(1300, symbols=("A",))
    names = [n for n in ALL_FEATURES if n not in LOOK_AHEAD_FEATURES]
    long, short = frame(compute_features(to_spark(spark, pdf), names)), frame(compute_features(to_spark(spark, pdf.head(1100)), names))
    for n in names:
        assert same(long[n].head(1100), short[n]), n


def test_series_do_not_mix(spark):
    pdf = walk(700)
    names = ["ema_50", "rsi_14", "supertrend_dir", "entropy_20", "regime"]
    both, one = frame(compute_features(to_spark(spark, pdf), names)), frame(compute_features(to_spark(spark, pdf[pdf["symbol"] == "Y"]), names))
    for n in names:
        assert same(both[both["symbol"] == "Y"][n].reset_index(drop=True), one[n]), n


def test_scaling_and_constant_prices(spark):
    pdf = walk(300, symbols=("A",), timeframe="4h", freq="4h")
    got = frame(compute_features(to_spark(spark, pdf), ["sma_20"], "4h"))
    assert np.allclose(got["sma_20"].astype(float), pdf["close"].rolling(5).mean(), equal_nan=True)
    flat = pdf.assign(open=100.0, high=100.0, low=100.0, close=100.0, volume=0.0)
    f = frame(compute_features(to_spark(spark, flat), ["entropy_20", "hurst_30", "vol_poc_20", "volume_entropy", "bb_position", "lyapunov", "hilbert_phase"]))
    assert f[["entropy_20", "hurst_30", "vol_poc_20", "lyapunov", "hilbert_phase"]].isna().all().all()
    assert (f["bb_position"].dropna() == 0).all()


def test_short_series_are_left_out(spark):
    pdf = pd.concat([walk(150, symbols=("S",)), walk(250, symbols=("L",))])
    got = compute_features(to_spark(spark, pdf), ["sma_10"], min_bars=200).select("symbol").distinct().toPandas()
    assert got["symbol"].tolist() == ["L"]


def test_user_column(spark):
    from pyspark.sql import functions as F

    register_feature("close_over_sma", ["sma_10"], lambda: F.col("close") / F.col("sma_10"))
    got = frame(compute_features(to_spark(spark, walk(300, symbols=("A",))), ["close_over_sma"]))
    assert got["close_over_sma"].notna().sum() == 291


def test_several_timeframes_in_one_call(spark):
    hour, quarter = walk(300, symbols=("A",)), walk(400, symbols=("A", "B"), timeframe="15m", freq="15min")
    names = ["sma_20", "ema_9", "rsi_14"]
    both = compute_features(to_spark(spark, pd.concat([hour, quarter])), names, ["1h", "15m"])
    for pdf, t in ((hour, "1h"), (quarter, "15m")):
        want = frame(compute_features(to_spark(spark, pdf), names, t))
        got = frame(both.where(f"timeframe = '{t}'"))
        assert len(got) == len(want) and all(same(got[n], want[n]) for n in names)


def test_kernels_do_not_depend_on_blocks_of_windows(monkeypatch):
    rng = np.random.default_rng(2)
    close = 100 + rng.normal(0, 1, 900).cumsum()
    data = {"close": close, "high": close + rng.random(900), "low": close - rng.random(900), "volume": rng.random(900), "_logret": np.diff(np.log(close), prepend=np.nan)}
    jobs = [
        (kernels.histogram_entropy, "_logret", 20, 10, False), (kernels.rescaled_range, "_logret", 30), (kernels.higuchi, "close", 30, 6), (kernels.detrended_fluctuation, "_logret", 60),
        (kernels.variance_ratio, "_logret", 40, 4), (kernels.dominant_period, "close", 64), (kernels.hilbert_phase, "close", 32), (kernels.lyapunov, "close", 30), (kernels.point_of_control, 20, 20),
    ]
    whole = [fn(data, *args) for fn, *args in jobs]
    monkeypatch.setattr(kernels, "BLOCK_VALUES", 200)
    for (fn, *args), want in zip(jobs, whole, strict=True):
        assert same(fn(data, *args), want), fn.__name__
