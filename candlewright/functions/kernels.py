"""Small NumPy kernels for windows that SQL aggregates cannot express.

Each takes the arrays of one (series, chunk) with its halo and returns one value per
row, looking only at the n bars before that row. Spark partitions the work; a kernel
never sees more than one chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view


def _before(x: np.ndarray, n: int) -> np.ndarray:
    """Row j holds the n values before position n + j."""
    return sliding_window_view(x, n)[:-1] if len(x) > n else np.empty((0, n))


def _spread(values: np.ndarray, size: int, n: int) -> np.ndarray:
    out = np.full(size, np.nan)
    if len(values):
        out[n:] = values
    return out


#: Numbers copied at once for windows that are worked through together.
BLOCK_VALUES = 1 << 18


def _in_blocks(block, *windows: np.ndarray) -> np.ndarray:
    """block over all windows (views of one length), a bounded number of rows at a time."""
    rows, n = windows[0].shape
    step = max(1, BLOCK_VALUES // max(n, 1))
    parts = [block(*(w[lo : lo + step] for w in windows)) for lo in range(0, rows, step)]
    return np.concatenate(parts) if parts else np.empty(0)


def _per_window(x: np.ndarray, n: int, block, min_valid: int) -> np.ndarray:
    """Applies `block` to complete windows together and to gappy ones one by one."""

    def some(w):
        out = np.full(len(w), np.nan)
        gaps = np.isnan(w).any(axis=1)
        full = ~gaps
        if full.any():
            out[full] = block(w[full])
        for j in np.flatnonzero(gaps):
            v = w[j][~np.isnan(w[j])]
            if len(v) >= min_valid:
                out[j] = block(v[None, :])[0]
        return out

    return _spread(_in_blocks(some, _before(x, n)), len(x), n)


def _slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dx = x - x.mean()
    return ((y - y.mean(axis=-1, keepdims=True)) * dx).sum(axis=-1) / (dx * dx).sum()


def histogram_entropy(data, column, n, bins, constant_is_certain):
    """Shannon entropy over equal bins between the window's own extremes."""

    def block(w):
        lo, hi = w.min(axis=1), w.max(axis=1)
        width = (hi - lo) / bins
        flat = width <= 0
        safe = np.where(flat, 1.0, width)
        b = np.clip(((w - lo[:, None]) / safe[:, None]).astype(np.int64), 0, bins - 1)
        counts = np.zeros((len(w), bins))
        np.add.at(counts, (np.arange(len(w))[:, None], b), 1.0)
        p = counts / w.shape[1]
        h = -np.where(p > 0, p * np.log(p + 1e-12), 0.0).sum(axis=1)
        return h if constant_is_certain else np.where(flat, np.nan, h)

    return _per_window(data[column], n, block, n // 2)


def rescaled_range(data, column, n):
    """ln(range of cumulative deviations / sample deviation) / ln(length)."""

    def block(w):
        m = w.shape[1]
        d = w - w.mean(axis=1, keepdims=True)
        walk = d.cumsum(axis=1)
        r = walk.max(axis=1) - walk.min(axis=1)
        s = np.sqrt((d * d).sum(axis=1) / (m - 1))
        ok = (s > 0) & (r > 0)
        return np.where(ok, np.log(np.where(ok, r, 1.0) / np.where(ok, s, 1.0)) / np.log(m), np.nan)

    return _per_window(data[column], n, block, max(2, n // 2))


def higuchi(data, column, n, kmax):
    """Fractal dimension from mean curve lengths at strides 1..kmax."""
    logk = np.log(np.arange(1, kmax + 1))

    def block(w):
        lengths = []
        for k in range(1, kmax + 1):
            per_start = []
            for start in range(k):
                pts = w[:, start::k]
                steps = pts.shape[1] - 1
                if steps >= 1:
                    per_start.append(np.abs(np.diff(pts, axis=1)).sum(axis=1) * (n - 1) / (steps * k))
            lengths.append(np.mean(per_start, axis=0) if per_start else np.full(len(w), np.nan))
        ln = np.array(lengths).T.reshape(len(w), kmax)
        out = np.full(len(w), np.nan)
        usable = ~np.isnan(ln) & (ln > 0)
        for pattern in np.unique(usable, axis=0):
            rows = (usable == pattern).all(axis=1)
            if pattern.sum() >= 2:
                out[rows] = -_slope(logk[pattern], np.log(ln[rows][:, pattern]))
        out[np.isnan(w).any(axis=1)] = np.nan
        return out

    return _spread(_in_blocks(block, _before(data[column], n)), len(data[column]), n)


def detrended_fluctuation(data, column, n):
    """Slope of log fluctuation against log segment length, linear detrending."""

    def block(w):
        m = w.shape[1]
        if m < 20 or m // 4 < 4:
            return np.full(len(w), np.nan)
        grid = 10.0 ** (np.log10(4.0) + np.arange(15) * (np.log10(float(m // 4)) - np.log10(4.0)) / 14.0)
        sizes = np.unique(grid.astype(np.int64))
        if len(sizes) < 2:
            return np.full(len(w), np.nan)
        y = (w - w.mean(axis=1, keepdims=True)).cumsum(axis=1)
        logs = []
        for s in sizes:
            seg = y[:, : m // s * s].reshape(len(w), m // s, s)
            t = np.arange(s) - (s - 1) / 2.0
            dev = seg - seg.mean(axis=2, keepdims=True)
            a = (dev * t).sum(axis=2, keepdims=True) / (t * t).sum()
            res = dev - a * t
            logs.append(np.log(np.sqrt((res * res).mean(axis=2).mean(axis=1)) + 1e-12))
        return _slope(np.log(sizes.astype(float)), np.array(logs).T)

    return _per_window(data[column], n, block, 20)


def variance_ratio(data, column, n, q):
    """Variance of overlapping q-sums per step over the one-step variance."""

    def block(w):
        sums = sliding_window_view(w, q, axis=1).sum(axis=2)
        return sums.var(axis=1, ddof=1) / q / (w.var(axis=1, ddof=1) + 1e-12)

    return _per_window(data[column], n, block, q + 2)


def dominant_period(data, column, n):
    """Period of the strongest non-zero frequency."""
    periods = 1.0 / np.fft.rfftfreq(n)[1:]
    if len(periods) == 0:
        return np.full(len(data[column]), np.nan)

    def block(w):
        mag = np.abs(np.fft.rfft(w - w.mean(axis=1, keepdims=True), axis=1))[:, 1:]
        return periods[np.argmax(mag, axis=1)]

    return _spread(_in_blocks(block, _before(data[column], n)), len(data[column]), n)


def hilbert_phase(data, column, n):
    """Angle of the analytic signal at the window's last bar, by FFT."""
    gain = np.zeros(n)
    gain[0] = 1.0
    gain[1 : (n + 1) // 2] = 2.0
    if n % 2 == 0:
        gain[n // 2] = 1.0

    def block(w):
        d = w - w.mean(axis=1, keepdims=True)
        last = np.fft.ifft(np.fft.fft(d, axis=1) * gain, axis=1)[:, -1]
        return np.where(d.std(axis=1) < 1e-10, np.nan, np.angle(last))

    return _spread(_in_blocks(block, _before(data[column], n)), len(data[column]), n)


def lyapunov(data, column, n):
    """Mean log step of the standardised window, zero steps left out."""

    def block(w):
        sd = w.std(axis=1)
        live = sd >= 1e-10
        step = np.abs(np.diff((w - w.mean(axis=1, keepdims=True)) / np.where(live, sd, 1.0)[:, None], axis=1))
        moved = step > 0
        total = np.where(moved, np.log(step + 1e-10), 0.0).sum(axis=1)
        count = moved.sum(axis=1)
        ok = live & (count > 0) & ~np.isnan(w).any(axis=1)
        return np.where(ok, total / np.maximum(count, 1), np.nan)

    return _spread(_in_blocks(block, _before(data[column], n)), len(data[column]), n)


def point_of_control(data, n, bins):
    """Middle of the price bin that traded most volume; the lowest bin wins ties."""

    def block(cl, vol, low, high):
        lo, hi = low.min(axis=1, initial=np.inf), high.max(axis=1, initial=-np.inf)
        span = hi - lo
        ok = span > 0
        safe = np.where(ok, span, 1.0)
        b = np.clip(((cl - lo[:, None]) / safe[:, None] * bins).astype(np.int64), 0, bins - 1)
        level = np.zeros((len(cl), bins))
        np.add.at(level, (np.arange(len(cl))[:, None], b), vol)
        top = np.argmax(level, axis=1)
        return np.where(ok, lo + span / bins * (top + 0.5), np.nan)

    return _spread(_in_blocks(block, *(_before(data[k], n) for k in ("close", "volume", "low", "high"))), len(data["close"]), n)


def kalman_velocity(data, column, q, r):
    """Velocity of a constant-velocity filter.

    The gain depends on the bar's index alone and settles within a few dozen bars; the
    filter forgets its state faster than 0.8 per bar, so a chunk started inside its halo
    agrees with the whole-series run to rounding.
    """
    x = data[column]
    first = int(data["bar_idx"][0])
    gains = []
    p00, p01, p11 = 0.1, 0.0, 0.1
    for _ in range(400):
        a, b, d = p00 + 2 * p01 + p11 + q, p01 + p11, p11 + q
        k0, k1 = a / (a + r), b / (a + r)
        gains.append((k0, k1))
        p00, p01, p11 = (1 - k0) * a, (1 - k0) * b, d - k1 * b
    out = np.zeros(len(x))
    pos, vel = x[0], 0.0
    for i in range(1, len(x)):
        k0, k1 = gains[min(first + i - 1, 399)]
        ahead = pos + vel
        miss = x[i] - ahead
        pos, vel = ahead + k0 * miss, vel + k1 * miss
        out[i] = vel
    return out


# ── recurrences ──────────────────────────────────────────────────────────────


def _previous(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.nan], x[:-1]])


def log_return(data):
    return np.log(data["close"] / _previous(data["close"]))


# ── machines whose state crosses chunks ──────────────────────────────────────
# Each has an effect (a chunk's own rows reduced to a few numbers) and a fold step;
# data["state"] holds the state at the chunk's first own row.


def _own(data) -> np.ndarray:
    return np.flatnonzero(data["own"])


def _volume_steps(data, which):
    base = _previous(data["close"]) if which == "obv" else data["open"]
    return np.nan_to_num(np.sign(data["close"] - base) * data["volume"])


def signed_volume_total(data, which):
    own = _own(data)
    out = np.full(len(data["close"]), np.nan)
    out[own] = data["state"][which][0] + _volume_steps(data, which)[own].cumsum()
    if which == "obv" and data["bar_idx"][0] == 0:
        out[0] = np.nan
    return out


def _breaks(data, side):
    sign = np.sign(data["close"] - data["open"])
    return sign != (1 if side == "bull" else -1)


def run_length(data, side):
    """Distance to the latest bar that was not of this colour."""
    own, idx = _own(data), data["bar_idx"]
    last = np.where(_breaks(data, side), idx, -1)
    last[own[0]] = max(last[own[0]], int(data["state"][f"consec_{side}"][0]))
    out = np.full(len(idx), np.nan)
    out[own] = idx[own] - np.maximum.accumulate(last[own])
    return out


def _pivots(x: np.ndarray, k: int, sign: int) -> np.ndarray:
    flags = np.zeros(len(x), dtype=bool)
    if len(x) > 2 * k:
        flags[k:-k] = (sign * x)[k:-k] == (sign * sliding_window_view(x, 2 * k + 1)).max(axis=1) if sign > 0 else (
            x[k:-k] == sliding_window_view(x, 2 * k + 1).min(axis=1))
    return flags


def _confirmed(data, name, k):
    x = data["high"] if name.endswith("high") else data["low"]
    out = np.full(len(x), np.nan)
    flags = _pivots(x, k, 1 if name.endswith("high") else -1)
    at = np.flatnonzero(flags) + k
    at = at[at < len(x)]
    out[at] = x[at - k]
    return out


def latest_pivot(data, name, k):
    own = _own(data)
    out = np.full(len(data["close"]), np.nan)
    seen = pd.Series(np.concatenate([data["state"][name][:1] or [np.nan], _confirmed(data, name, k)[own]])).ffill()
    out[own] = seen.to_numpy()[1:]
    return out


def _pivot_closes(data, name, k):
    side = ("high", 1) if name.endswith("resistance") else ("low", -1)
    own = _own(data)
    flags = _pivots(data[side[0]], k, side[1])[own]
    return flags, data["close"][own]


def level_distance(data, name, k):
    """Share of the close to the nearest of the last five pivot closes on one side."""
    own = _own(data)
    flags, cl = _pivot_closes(data, name, k)
    carried = np.full(5, np.nan)
    state = data["state"][name]
    if state:
        carried[-len(state):] = state
    levels = np.concatenate([carried, cl[flags]])
    seen = np.concatenate([[0], flags.cumsum()[:-1]])
    five = levels[seen[:, None] + np.arange(5)]
    if name.endswith("resistance"):
        near = np.where(five > cl[:, None], five, np.inf).min(axis=1) - cl
    else:
        near = cl - np.where(five < cl[:, None], five, -np.inf).max(axis=1)
    out = np.full(len(data["close"]), np.nan)
    out[own] = np.where(np.isfinite(near), near / (cl + 1e-10), np.nan)
    return out


def ratchet(level: np.ndarray, limit: np.ndarray, start: float) -> np.ndarray:
    """state = state if state <= limit else level, row by row."""
    out = np.empty(len(level))
    state = start
    for i in range(len(level)):
        if not state <= limit[i]:
            state = level[i]
        out[i] = state
    return out


def _band_rows(data, which, multiplier=3.0):
    """Level and limit of a band ratchet; the upper band is mirrored to minima."""
    mid, width = (data["high"] + data["low"]) / 2, multiplier * data["_atr_10"]
    prev = _previous(data["close"])
    level, bar = (mid - width, prev) if which == "lower" else (-(mid + width), -prev)
    limit = np.fmin(level, bar)
    if data["bar_idx"][0] == 0:
        limit[0] = -np.inf
    return level, limit


def band(data, which):
    own = _own(data)
    level, limit = _band_rows(data, which)
    out = np.full(len(level), np.nan)
    out[own] = ratchet(level[own], limit[own], data["state"][f"_st_{which}"][0])
    return out if which == "lower" else -out


def _side_events(data):
    """+1 / -1 where the close leaves the bands, 0 elsewhere; the bands never cross."""
    ev = np.where(data["close"] < data["_st_lower"], -1.0, np.where(data["close"] > data["_st_upper"], 1.0, 0.0))
    if data["bar_idx"][0] == 0:
        ev[0] = 1.0
    return ev


def band_side(data):
    own = _own(data)
    ev = _side_events(data)[own]
    seen = pd.Series(np.concatenate([[data["state"]["supertrend_dir"][0]], np.where(ev == 0, np.nan, ev)])).ffill()
    out = np.full(len(data["close"]), np.nan)
    out[own] = seen.to_numpy()[1:]
    return out


def _last(x: np.ndarray) -> list:
    x = x[~np.isnan(x)]
    return [float(x[-1])] if len(x) else []


def _band_effect(data, which):
    """(m, q): a state <= m leaves the rows unchanged, any other leaves as q.

    All states above m have met by the row of the smallest limit, because a state
    taken from an earlier row is never below the limits seen before that row.
    """
    own = _own(data)
    level, limit = (a[own] for a in _band_rows(data, which))
    at = int(np.argmin(limit))
    return [float(limit[at]), float(ratchet(level[at:], limit[at:], np.inf)[-1])]


def _total_effect(data, which):
    return [float(_volume_steps(data, which)[_own(data)].sum())]


def _break_effect(data, side):
    own = _own(data)
    idx = data["bar_idx"][own][_breaks(data, side)[own]]
    return [float(idx[-1])] if len(idx) else []


def _pivot_effect(data, name, k):
    return _last(_confirmed(data, name, k)[_own(data)])


def _level_effect(data, name, k):
    flags, cl = _pivot_closes(data, name, k)
    return [float(v) for v in cl[flags][-5:]]


def _side_effect(data):
    ev = _side_events(data)[_own(data)]
    return _last(np.where(ev == 0, np.nan, ev))


def _replace(state, effect):
    return effect or state


def machine(name, fn, args):
    """(effect function, initial state, fold step) for stateful columns, else None."""
    if fn is signed_volume_total:
        return lambda d: _total_effect(d, *args), [0.0], lambda s, e: [s[0] + e[0]]
    if fn is run_length:
        return lambda d: _break_effect(d, *args), [-1.0], _replace
    if fn is latest_pivot:
        return lambda d: _pivot_effect(d, *args), [], _replace
    if fn is level_distance:
        return lambda d: _level_effect(d, *args), [], lambda s, e: (s + e)[-5:]
    if fn is band:
        return lambda d: _band_effect(d, *args), [float("inf")], lambda s, e: s if s[0] <= e[0] else [e[1]]
    if fn is band_side:
        return _side_effect, [1.0], _replace
    if fn is order_block_retest:
        return lambda d: _zone_effect(d, *args), [], _after_zones
    return None


# ── order-block retests ──────────────────────────────────────────────────────


def zone_retests(high, low, zone_lo, zone_hi, zones, max_age: int, cap: int):
    """Flags of bars that touch an active zone, and the zones left at the end.

    zone_lo/zone_hi hold the zone confirmed on a bar (NaN: none); zones are those active
    before the first bar, as (age in bars, low, high), oldest first. A touch uses the
    oldest touched zone up; of more than `cap` zones the oldest goes.
    """
    n = len(high)
    hit = np.zeros(n, dtype=bool)
    live = [(-int(age), lo, hi) for age, lo, hi in zones]
    i = 0
    confirmed = np.flatnonzero(~np.isnan(zone_lo)).tolist()
    at = 0
    while i < n:
        if not live:  # nothing happens before the next zone
            while at < len(confirmed) and confirmed[at] < i:
                at += 1
            if at == len(confirmed):
                break
            i = confirmed[at]
        live = [z for z in live if i - z[0] <= max_age]
        for z in live:
            if low[i] <= z[2] and high[i] >= z[1]:
                live.remove(z)
                hit[i] = True
                break
        if not np.isnan(zone_lo[i]):
            live = [*live, (i, zone_lo[i], zone_hi[i])][-cap:]
        i += 1
    return hit, [(n - z[0], z[1], z[2]) for z in live if n - z[0] <= max_age]


def forgetful(high, low, zone_lo, zone_hi, max_age: int, cap: int):
    """The zones left at the end where these do not depend on the zones before, else None.

    Zones before the first bar are unknown for `max_age` bars: whatever they may have
    changed is tracked as unsure until it is gone.
    """
    n = len(high)
    live: list[list] = []  # [row, low, high, sure]
    for i in range(n):
        live = [z for z in live if i - z[0] <= max_age]
        doubt = i <= max_age
        if not live and not doubt and np.isnan(zone_lo[i]):
            continue
        for z in list(live):
            if low[i] <= z[2] and high[i] >= z[1]:
                if doubt:
                    z[3] = False
                else:
                    live.remove(z)
                    if z[3]:
                        break
                    doubt = True
        if not np.isnan(zone_lo[i]):
            live.append([i, zone_lo[i], zone_hi[i], True])
            sure = maybe = 0
            for z in reversed(list(live)):
                if sure >= cap:
                    live.remove(z)
                else:
                    if maybe >= cap:
                        z[3] = False
                    sure += z[3]
                    maybe += 1
    if n <= max_age or not all(z[3] for z in live):
        return None
    return [(n - z[0], z[1], z[2]) for z in live if n - z[0] <= max_age]


def _order_zones(data, name, lookback, max_age, impulse=0.015):
    """Of the chunk's own rows: high, low, and the zone confirmed on each."""
    o, h, lo, cl = data["open"], data["high"], data["low"], data["close"]
    n, first, own = len(cl), int(data["bar_idx"][0]), _own(data)
    sign = 1 if name == "bull_ob" else -1
    move = (cl - _previous(cl)) / (_previous(cl) + 1e-10) * sign
    against = (cl - o) * sign < 0
    z_lo, z_hi = np.full(n, np.nan), np.full(n, np.nan)
    rows = np.arange(n)
    for back in range(1, lookback):
        src = rows - back
        ok = (src >= 0) & (first + src >= 1)
        take = ok & (move > impulse) & np.isnan(z_lo)
        take[ok] &= against[src[ok]]
        z_lo[take], z_hi[take] = lo[src[take]], h[src[take]]
    z_lo[: max(0, 3 - first)] = np.nan
    return h[own], lo[own], z_lo[own], z_hi[own]


CAP = 3


def order_block_retest(data, name, lookback, max_age):
    """1.0 where price returns to the last opposite candle before a strong move."""
    own = _own(data)
    zones = np.reshape(data["state"][name], (-1, 3))
    hit, _ = zone_retests(*_order_zones(data, name, lookback, max_age), zones, max_age, CAP)
    out = np.full(len(data["close"]), np.nan)
    out[own] = hit
    return out


def _zone_effect(data, name, lookback, max_age):
    """[1, zones left...] where the chunk forgets the zones before it; else [0, max_age, its rows...], for the fold to run."""
    rows = _order_zones(data, name, lookback, max_age)
    left = forgetful(*rows, max_age, CAP)
    if left is not None:
        return [1.0, *np.ravel(left).astype(float).tolist()]
    return [0.0, float(max_age), *np.concatenate(rows).tolist()]


def _after_zones(state, effect):
    if effect[0]:
        return effect[1:]
    rows = np.reshape(effect[2:], (4, -1))
    _, left = zone_retests(*rows, np.reshape(state, (-1, 3)), int(effect[1]), CAP)
    return np.ravel(left).astype(float).tolist()
