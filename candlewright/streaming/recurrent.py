"""Bars of a stream with the columns that have no finite look-back.

Exponential means, the wick pressure, running volume totals and run lengths depend on
every earlier bar. Their last values are the carries of a series; they stand in the
stream's state beside a ring of the newest bars, so the state has one size however long
the series is, and each poll equals the batch columns. Windows read the ring.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from candlewright.core import EPS, KEY, period_scale
from candlewright.functions.features import catalogue
from candlewright.functions.registry import BASE

PRICES = ("open", "high", "low", "close", "volume")
TOTALS = ("obv", "cvd")
RUNS = ("consec_bull", "consec_bear")
LEAST_RING = 250


@dataclass(frozen=True)
class Carried:
    """The recurrences of one period scale: y = decay * y + gain * source, first * source on the first bar."""

    names: tuple[str, ...]
    source: tuple[str, ...]
    decay: np.ndarray
    gain: np.ndarray
    first: np.ndarray


def carried(scale: float) -> Carried:
    scans = [f for f in catalogue(scale).features.values() if f.stage == "scan"]
    d, g, s = (np.array(x) for x in zip(*(f.kernel for f in scans), strict=True))
    return Carried(tuple(f.name for f in scans), tuple(f.deps[0] for f in scans), d, g, s)


def carried_columns(scale: float) -> tuple[str, ...]:
    return (*carried(scale).names, *TOTALS, *RUNS)


def history_bars(names, scale: float) -> int:
    """Bars that the windows of `names` reach back, carried columns counting as given."""
    cat, given = catalogue(scale), BASE | set(carried_columns(scale))
    depth: dict[str, int] = {}

    def reach(name: str) -> int:
        if name in given:
            return 0
        if name not in depth:
            f = cat.features[name]
            depth[name] = max(f.lookback, 1) + max(map(reach, f.deps), default=0)
        return depth[name]

    return max(map(reach, names), default=0)


def _level(c: Carried, pick, sources: dict[str, np.ndarray], y: dict[str, float], fresh: bool, out: dict[str, np.ndarray]) -> None:
    """Runs the recurrences at places `pick` side by side over the new bars."""
    x = np.nan_to_num(np.stack([sources[c.source[j]] for j in pick], axis=1))
    d, g = c.decay[pick], c.gain[pick]
    now = np.array([y.get(c.names[j], 0.0) for j in pick])
    rows = np.empty_like(x)
    for i in range(len(x)):
        now = c.first[pick] * x[0] if fresh and i == 0 else d * now + g * x[i]
        rows[i] = now
    for k, j in enumerate(pick):
        out[c.names[j]] = rows[:, k]


def _runs(hit: np.ndarray, before: float) -> np.ndarray:
    at = np.arange(len(hit))
    last = np.maximum.accumulate(np.where(hit, -1 - before, at))
    return (at - last).astype(float)


def advance(c: Carried, bars: dict[str, np.ndarray], prev: dict[str, float] | None, y: dict[str, float]) -> dict[str, np.ndarray]:
    """Carried columns of new bars. `prev` is the bar before them (None: a series begins), `y` its columns."""
    o, h, lo, cl, v = (bars[k] for k in PRICES)
    fresh = prev is None
    before = {k: np.concatenate([[np.nan if fresh else prev[k]], bars[k][:-1]]) for k in ("high", "low", "close")}
    with np.errstate(invalid="ignore"):
        up, down = (np.fmax(x, 0.0) for x in (h - before["high"], before["low"] - lo))
        plus = np.where(up > down, up, 0.0)
        sources = {
            "close": cl, "_tr": np.fmax(h - lo, np.fmax(abs(h - before["close"]), abs(lo - before["close"]))),
            "_dm_plus": plus, "_dm_minus": np.where(down > plus, down, 0.0),
            "wpi": ((np.minimum(o, cl) - lo) - (h - np.maximum(o, cl))) / (h - lo + EPS)}
        steps = {"obv": np.sign(cl - before["close"]) * v, "cvd": np.sign(cl - o) * v}
        color = np.sign(cl - o)
    out: dict[str, np.ndarray] = {}
    direct = [j for j, s in enumerate(c.source) if s in sources]
    _level(c, direct, sources, y, fresh, out)
    strength = out["atr_14"] + EPS
    di_plus, di_minus = 100 * out["_dm_plus_ema"] / strength, 100 * out["_dm_minus_ema"] / strength
    sources |= {"macd": out["_ema_fast"] - out["_ema_slow"], "_dx": 100 * abs(di_plus - di_minus) / (di_plus + di_minus + EPS)}
    _level(c, [j for j in range(len(c.names)) if j not in set(direct)], sources, y, fresh, out)
    for name in TOTALS:
        out[name] = y.get(name, 0.0) + np.nan_to_num(steps[name]).cumsum()
    for name, side in zip(RUNS, (1, -1), strict=True):
        out[name] = _runs(color == side, y.get(name, 0.0))
    return out


def with_state(bars: DataFrame, timeframe: str, names=(), scale_multiplier: float = 1.0, keep: int | None = None) -> DataFrame:
    """Each new bar of a stream with its index, its carried columns and the bars before it that windows need.

    The state of a series is its number of bars, the carries and a ring of `keep` bars
    (by default what the windows of `names` reach back, 250 at least). Bars must come in
    time order from poll to poll: one that is not newer than the series' last bar is a
    repeat or too late and is left out; of several with one time in a poll the first counts.
    Rows of one update carry its newest time in `as_of`; `is_new` marks the new bars.
    """
    scale = period_scale(timeframe, scale_multiplier)
    c = carried(scale)
    columns = carried_columns(scale)
    ring = (*PRICES, *columns)
    keep = keep or max(LEAST_RING, history_bars(names, scale) + 1)
    state_schema = "n long, ts array<timestamp>, " + ", ".join(f"`{f}` array<double>" for f in ring)
    out_schema = "symbol string, timeframe string, as_of timestamp, ts timestamp, bar_idx long, " + ", ".join(f"`{f}` double" for f in ring) + ", is_new boolean"

    def update(key, batches, state):
        new = pd.concat(list(batches), ignore_index=True)[["ts", *PRICES]]
        new = new.drop_duplicates("ts").sort_values("ts", ignore_index=True)
        n, old = 0, pd.DataFrame(columns=["ts", *ring])
        if state.exists:
            n, *kept = state.get
            old = pd.DataFrame(dict(zip(("ts", *ring), kept, strict=True)))
            old["ts"] = pd.to_datetime(old["ts"])
            new = new[new["ts"] > old["ts"].iloc[-1]].reset_index(drop=True)
        if new.empty:
            return
        last = None if old.empty else old.iloc[-1].to_dict()
        found = advance(c, {k: new[k].to_numpy(float) for k in PRICES}, last, last or {})
        new = new.assign(**found, is_new=True)
        both = new if old.empty else pd.concat([old.assign(is_new=False), new], ignore_index=True)
        both["bar_idx"] = np.arange(n + len(new) - len(both), n + len(new))
        tail = both.tail(keep)
        state.update((n + len(new), [t.to_pydatetime() for t in tail["ts"]], *[tail[f].astype(float).tolist() for f in ring]))
        both.loc[both["bar_idx"] == 0, "obv"] = np.nan  # the first bar has no bar before it
        yield both.assign(symbol=key[0], timeframe=key[1], as_of=both["ts"].iloc[-1])[["symbol", "timeframe", "as_of", "ts", "bar_idx", *ring, "is_new"]]

    return bars.groupBy(*KEY).applyInPandasWithState(update, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)
