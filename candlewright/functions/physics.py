"""Motion, complexity and spectral columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from candlewright.core import EPS, clip, flag, scaled
from candlewright.functions import kernels
from candlewright.functions.registry import Catalogue
from candlewright.functions.technical import zscore
from candlewright.operators.chunks import diff, lag, order, rolling

c = F.col


def autocorrelation(name: str, n: int, k: int) -> Column:
    """Correlation of the last n values with themselves k bars earlier."""
    if n <= k:
        return F.lit(None).cast("double")
    pairs = order().rowsBetween(-(n - k - 1), 0)
    complete = F.count(name).over(order().rowsBetween(-(n - 1), 0)) == n
    r = F.corr(name, f"{name}_lag{k}").over(pairs)
    return F.when(complete & ~F.isnan(r), r)


def define(cat: Catalogue, s: float) -> None:
    p = lambda n, m=2: scaled(n, s, m)
    col, close, high, low, open_ = cat.column, c("close"), c("high"), c("low"), c("open")

    col("velocity", ["close"], lambda: diff("close"))
    col("acceleration", ["velocity"], lambda: diff("velocity"))
    col("jerk", ["acceleration"], lambda: diff("acceleration"))
    col("energy", ["velocity"], lambda: c("velocity") * c("velocity"))

    cat.array("_logret", kernels.log_return, ["close"], lookback=1)
    for n in (10, 20, 40):
        cat.array(f"entropy_{n}", kernels.histogram_entropy, ["_logret"], "_logret", p(n), 10, False, lookback=p(n) + 1)
    for n in (30, 60, 100):
        cat.array(f"hurst_{n}", kernels.rescaled_range, ["_logret"], "_logret", p(n), lookback=p(n) + 1)
    cat.array("higuchi_fd", kernels.higuchi, ["close"], "close", p(30), 6, lookback=p(30))
    cat.array("dfa_alpha", kernels.detrended_fluctuation, ["_logret"], "_logret", p(60), lookback=p(60) + 1)
    cat.array("kalman_vel", kernels.kalman_velocity, ["close"], "close", 0.001, 0.01, lookback=256)
    cat.array("variance_ratio", kernels.variance_ratio, ["_logret"], "_logret", p(40), p(4, 2), lookback=p(40) + 1)
    cat.array("fft_dominant_period", kernels.dominant_period, ["close"], "close", p(64), lookback=p(64))
    cat.array("hilbert_phase", kernels.hilbert_phase, ["close"], "close", p(32), lookback=p(32))
    cat.array("lyapunov", kernels.lyapunov, ["close"], "close", p(30), lookback=p(30))

    lags = {k: p(k, 1) for k in (1, 5, 10)}
    for k in sorted(set(lags.values())):
        col(f"log_return_1_lag{k}", ["log_return_1"], lambda k=k: lag("log_return_1", k), k)
    for k, v in lags.items():
        col(f"autocorr_{k}", ["log_return_1", f"log_return_1_lag{v}"], lambda v=v: autocorrelation("log_return_1", p(20), v), p(20))

    col("wpi", ["upper_wick", "lower_wick"], lambda: (c("lower_wick") - c("upper_wick")) / (high - low + EPS))
    cat.scan("memory_pressure", "wpi", 0.9, 1.0, 0.0)
    n10, n20, n50 = p(10), p(20), p(50)
    col("cct", ["_range"], lambda: (1 - F.abs(close - open_) / (c("_range") + EPS))
        * (c("_range") / (rolling(F.avg, "_range", n10) + EPS)), n10)
    col("hilbert_phase_cos", ["hilbert_phase"], lambda: F.cos("hilbert_phase"))
    col("hilbert_phase_sin", ["hilbert_phase"], lambda: F.sin("hilbert_phase"))

    def two_outcome_entropy() -> Column:
        h = F.lit(0.0)
        for share in ((close - low) / (high - low + EPS), (high - close) / (high - low + EPS)):
            q = clip(share, EPS, 1 - EPS)
            h = h - q * F.log2(q)
        return h

    col("_ear", ["high", "low", "close"], two_outcome_entropy)
    col("ear_entropy", ["_ear"], lambda: rolling(F.avg, "_ear", n10), n10)
    col("_vel_z", ["velocity"], lambda: zscore("velocity", n20), n20)
    col("_acc_z", ["acceleration"], lambda: zscore("acceleration", n20), n20)
    col("phase_regime", ["_vel_z", "_acc_z"], lambda: F.when(F.abs("_acc_z") > 2.0, -1)
        .when((F.abs("_vel_z") > 1.5) & (F.abs("_acc_z") < 1.0), 1).otherwise(0))
    col("energy_z", ["energy"], lambda: zscore("energy", n50), n50)
    col("_entropy_mean", ["entropy_20"], lambda: rolling(F.avg, "entropy_20", n50), n50)
    col("entropy_squeeze", ["_entropy_mean", "entropy_20"], lambda: flag(c("entropy_20") < c("_entropy_mean") * 0.8))
    col("entropy_slope", ["entropy_20"], lambda: diff("entropy_20", p(3, 1)), p(3, 1))


# The names of the columns.
NAMES = (
    "velocity", "acceleration", "jerk", "energy", "entropy_10", "entropy_20", "entropy_40", "hurst_30", "hurst_60",
    "hurst_100", "higuchi_fd", "dfa_alpha", "kalman_vel", "autocorr_1", "autocorr_5", "autocorr_10", "variance_ratio",
    "wpi", "memory_pressure", "cct", "fft_dominant_period", "hilbert_phase", "hilbert_phase_cos", "hilbert_phase_sin",
    "ear_entropy", "phase_regime", "lyapunov", "energy_z", "entropy_squeeze", "entropy_slope",
)
