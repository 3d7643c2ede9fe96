"""Euclidean p-stable hashing: a vector's bucket is the vector of quantised random projections.

h(x) = floor((a.x + b) / width) with Gaussian a and uniform b: near vectors share all projections of
a table with a probability that falls with their distance. Several independent tables are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import erf, erfc, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from candlewright.llm import words as W


@dataclass(frozen=True)
class PStable:
    tables: int
    projections: int
    width: float
    seed: int = 17

    def slots(self, x: np.ndarray) -> np.ndarray:
        """Projections in units of the width: rows x tables x projections."""
        a, b = _directions(x.shape[1], self.tables * self.projections, self.seed)
        return (x @ a / self.width + b).reshape(len(x), self.tables, self.projections)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """Bucket keys (int64) of integer cells, rows x projections, of one table."""
        h = np.zeros(len(cells), np.uint64)
        for j in range(cells.shape[1]):
            h = W.mix(h ^ (cells[:, j].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        return h.view(np.int64)


@lru_cache(maxsize=8)
def _directions(dim: int, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    return rng.standard_normal((dim, count)), rng.random(count)


def matrix(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a list<float> column as doubles, and which rows are usable (not null, of length dim, finite, not all
    zero). Without dim it is the commonest length above 0. Other rows are zeros and not usable."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(arr)
    size = np.array([0 if s is None else s for s in pc.list_value_length(arr).to_pylist()], np.int64)
    if dim is None:
        dim = int(np.bincount(size[size > 0]).argmax()) if (size > 0).any() else 0
    good = np.flatnonzero(size == dim) if dim else np.zeros(0, np.int64)
    out = np.zeros((n, dim))
    if len(good):
        flat = arr.take(pa.array(good)).flatten()
        out[good] = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)  # null components become NaN
    usable = (size == dim) & np.isfinite(out).all(1) & (out != 0).any(1) if dim else np.zeros(n, bool)
    return out, usable


def success(slot: np.ndarray, spread: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells of one table in falling order of the estimated probability that a neighbour lies there, as many as
    reach the total probability `least`. A neighbour's projection is normal around the query's with standard
    deviation `spread` widths."""
    home = np.floor(slot)
    reach = max(1, int(np.ceil(4 * spread)))
    options = []
    for s, h in zip(slot, home, strict=True):
        edge = h + np.arange(-reach, reach + 2) - s
        below = np.array([0.5 * (1 + erf(e / spread / sqrt(2))) for e in edge])
        options.append((h + np.arange(-reach, reach + 1), np.diff(below)))
    best_after = np.append(np.cumprod([p.max() for _, p in options][::-1])[::-1][1:], 1.0)
    floor = best_after[0] * options[0][1].max() / 8
    while True:
        prob, cells = np.ones(1), np.zeros((1, 0))
        for (cell, p), rest in zip(options, best_after, strict=True):
            grid = prob[:, None] * p[None, :]
            i, j = np.nonzero(grid * rest >= floor)
            prob, cells = grid[i, j], np.column_stack([cells[i], cell[j]])
        if prob.sum() >= least or floor < 1e-12:
            order = np.argsort(-prob, kind="stable")
            enough = int(np.searchsorted(np.cumsum(prob[order]), least)) + 1
            return cells[order[:enough]].astype(np.int64), prob[order[:enough]]
        floor /= 3


#: Standard normal distribution function at multiples of 1 / GRID, from -9 to 9.
GRID = 512
NORMAL = np.array([0.5 * erfc(-z / GRID / sqrt(2)) for z in range(-9 * GRID, 9 * GRID + 1)])
#: Neighbours drawn to find how improbable a bucket may be.
DRAWS = 1024


def reach_of(spread: np.ndarray) -> int:
    """Cells on either side of the query's own that are told apart; all beyond count as the last."""
    return int(np.ceil(5 * spread.max(initial=0))) + 1


def log_chances(part: np.ndarray, spread: np.ndarray, reach: int) -> np.ndarray:
    """Queries x projections x (2 reach + 1): log probability that a neighbour's projection lies in each cell around
    the query's own. part: the query's place in its cell. A neighbour's projection is normal around the query's."""
    z = (np.arange(-reach, reach + 2) - part[:, :, None]) / spread[:, None, None]
    below = NORMAL[np.clip(np.rint(z * GRID), -9 * GRID, 9 * GRID).astype(np.int32) + 9 * GRID]
    return np.log(np.maximum(np.diff(below, axis=2), 1e-30)).astype(np.float32)


def cuts(part: np.ndarray, spread: np.ndarray, logs: np.ndarray, least: float) -> np.ndarray:
    """The log probability of the last cell visited where cells are taken in falling order until their total
    probability is at least `least`: a quantile over drawn neighbours of the probability of their cells."""
    draws = _draws(part.shape[1])
    reach = logs.shape[2] // 2
    total = np.zeros((len(part), DRAWS), np.float32)
    for j in range(part.shape[1]):
        off = np.floor(part[:, j, None] + spread[:, None] * draws[:, j])
        total += np.take_along_axis(logs[:, j], np.clip(off, -reach, reach).astype(np.int64) + reach, 1)
    least = min(1.0, least + sqrt(least * (1 - least) / DRAWS))  # the quantile's own error
    at = max(0, DRAWS - int(np.ceil(least * DRAWS)))
    return np.partition(total, at, 1)[:, at] - 1e-4  # rounding of the sums


@lru_cache(maxsize=8)
def _draws(projections: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([23, projections])).standard_normal((DRAWS, projections))
