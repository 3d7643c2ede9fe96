"""First touch of a price among the bars that follow, by running extremes and a binary search.

For every bar and every power of two the highest high and the lowest low of that many bars from there
on are kept (a sparse table, worked out once per chunk). The first later bar beyond a price is then
found by halving steps: a stretch whose extremes stay inside the prices is skipped whole. All signals
of a chunk search together, whatever their prices, so a parameter set costs a few array operations
of log2(holding time) steps and no path is scanned.
"""

from __future__ import annotations

import numpy as np

#: Exit of a trade that the series ends on: after every bar.
NEVER = 2**53


class Bars:
    """Tradable bars in time order: their index in the series, and the extremes of every stretch."""

    def __init__(self, index: np.ndarray, high: np.ndarray, low: np.ndarray, longest: int) -> None:
        n = len(index)
        self.index, self.n = index, n
        self.high, self.low = high, low
        self.top, self.bottom = [np.append(high, np.inf)], [np.append(low, -np.inf)]
        width = 1
        while 2 * width <= min(longest, n):
            top, bottom = np.full(n + 1, np.inf), np.full(n + 1, -np.inf)
            ends = n - 2 * width + 1
            top[:ends] = np.fmax(self.top[-1][:ends], self.top[-1][width : width + ends])
            bottom[:ends] = np.fmin(self.bottom[-1][:ends], self.bottom[-1][width : width + ends])
            self.top.append(top)
            self.bottom.append(bottom)
            width *= 2

    def first_beyond(self, start: np.ndarray, end: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First place in [start, end) whose high is at least `above` or whose low is at most `below`; `end` where none is."""
        at = np.minimum(start, end)
        for k in range(len(self.top) - 1, -1, -1):
            after = at + (1 << k)
            clear = (after <= end) & ~((self.top[k][at] >= above) | (self.bottom[k][at] <= below))
            at = np.where(clear, after, at)
        return at

    def exits(self, at: np.ndarray, long: np.ndarray, stop: np.ndarray, target: np.ndarray, hold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the exit bar of each signal (n: the series ends first), and 0 time-out, 1 stop, 2 target, 3 end.

        A stop is checked before a target. A trade times out at the first tradable bar at
        least `hold` bars on; bars in between that cannot be traded are skipped.
        """
        end = np.minimum(at + hold + 1, self.n)
        above, below = np.where(long, target, stop), np.where(long, stop, target)
        hit = self.first_beyond(at + 1, end, above, below)
        late = np.searchsorted(self.index, self.index[at] + hold, side="left")
        place = np.minimum(np.where(hit < end, hit, self.n), late)
        there = np.minimum(place, self.n - 1)
        high, low = self.high[there], self.low[there]
        stopped = np.where(long, low <= stop, high >= stop)
        reached = np.where(long, high >= target, low <= target)
        return place, np.where(place >= self.n, 3, np.where(stopped, 1, np.where(reached, 2, 0)))


def after_all(starts: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """For each signal, the first free bar once it and all that can follow it have been worked through."""
    n = len(starts)
    follow = np.maximum(np.searchsorted(starts, exits, side="left"), np.arange(n) + 1)
    last = np.where(follow < n, follow, np.arange(n))
    while n and (last[last] != last).any():
        last = last[last]
    return exits[last]


def taken(starts: np.ndarray, exits: np.ndarray, free: float) -> list[int]:
    """Signals taken when the first bar allowed is `free`; an exit bar may be used again."""
    follow = np.maximum(np.searchsorted(starts, exits, side="left"), np.arange(len(starts)) + 1).tolist()
    at, out = int(np.searchsorted(starts, free)), []
    while at < len(starts):
        out.append(at)
        at = follow[at]
    return out


def effect(starts: np.ndarray, exits: np.ndarray, base: int, hold: int) -> list[float]:
    """A chunk's effect on the first free bar: [m, first m starts, free bar after each].

    Earlier trades end within `hold` tradable bars, so the bar that is free on entry lies
    before base + hold and the table stops at the first start from there on.
    """
    m = min(len(starts), int(np.searchsorted(starts, base + hold)) + 1)
    return [float(m), *starts[:m].astype(float).tolist(), *after_all(starts, exits)[:m].astype(float).tolist()]


def after_effect(free: float, found: list[float]) -> float:
    m = int(found[0])
    at = int(np.searchsorted(found[1 : m + 1], free))
    return found[1 + m + at] if at < m else free
