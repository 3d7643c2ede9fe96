"""Search by cells: what a worker holds, the buckets visited, and a cell against brute force."""

import threading

import numpy as np
import psutil
import pytest
from pyspark.sql import functions as F

from candlewright.llm import multiprobe
from candlewright.llm.pstable import PStable, cuts, log_chances, reach_of, success


def unit(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.sqrt((x * x).sum(1))[:, None]


def largest_worker(done):
    """Most MB of a Python worker until done is set."""
    most = 0
    while not done.wait(0.1):
        for p in psutil.Process().children(recursive=True):
            try:
                if "pyspark.daemon" in p.cmdline():
                    most = max(most, p.memory_info().rss >> 20)
            except psutil.Error:
                pass
    return most


def test_workers_stay_small_however_many_buckets_are_probed(spark):
    """Six projections, as about 300,000 rows have: a query's probes are thousands, which were once listed (3,184 MB in a worker here, now 144)."""
    x = unit(3000, 64, 5)
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1)
    done, most = threading.Event(), []
    watch = threading.Thread(target=lambda: most.append(largest_worker(done)))
    watch.start()
    try:
        got = {}
        for r in multiprobe.search(df, F.col("vec_id") < 1500, rows_per_bucket=1).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
    finally:
        done.set()
        watch.join()
    print("MB", most)
    assert 0 < most[0] < 600
    assert len(got) == 1500
    found = [len(got[i] & set(np.argsort(((x - x[i]) ** 2).sum(1))[1:11].tolist())) / 10 for i in range(0, 1500, 15)]
    assert np.mean(found) >= 0.96


@pytest.mark.parametrize("spread", [1.0, 1.6])
def test_buckets_down_to_the_cut_hold_the_target(spread):
    """As many buckets, to the error of the drawn quantile, as in the list of them in falling order."""
    slots = np.random.default_rng(3).random((20, 5)) * 7 - 3
    wide = np.full(20, spread)
    part = slots - np.floor(slots)
    logs = log_chances(part, wide, reach_of(wide))
    for i, cut in enumerate(cuts(part, wide, logs, 0.8)):
        listed, prob = success(slots[i], spread, 0.9)
        off = (listed - np.floor(slots[i])).astype(int) + reach_of(wide)
        chance = sum(logs[i, j][off[:, j]] for j in range(5))
        assert np.abs(np.exp(chance) / prob - 1).max() < 0.05
        assert 0.775 < prob[chance >= cut].sum() < 0.87


def test_cells_cut_a_bucket_and_lie_between_their_bounds():
    rng = np.random.default_rng(4)
    coords = np.floor(rng.standard_normal((4000, 3)) * 2)
    coords[1000:2500] = coords[0]  # one bucket
    coords[0, 1], coords[1, 2] = 1e12, -1e12
    ids = rng.integers(-(2**62), 2**62, 4000)
    keys = multiprobe.bucket_keys(coords, ids)
    bounds = np.unique(np.sort(keys)[200::200])
    cell = np.searchsorted(bounds, keys, "right")
    assert np.bincount(cell, minlength=20).max() <= 201
    lo, hi = multiprobe.cell_boxes(bounds, 3)
    assert len(lo) == len(bounds) + 1 and (coords >= lo[cell]).all() and (coords <= hi[cell]).all()


@pytest.mark.parametrize(("kind", "scale"), [(np.float32, 1), (np.float32, 1e-22), (np.float32, 1e25), (np.float64, 1e-160), (np.float64, 1e140)])
def test_a_cell_equals_brute_force(kind, scale, monkeypatch):
    """Copies beyond k, ties, near copies, any magnitude; with bounds and without."""
    monkeypatch.setattr(multiprobe, "WAIT", 300)
    rng, k = np.random.default_rng(6), 5
    x = rng.standard_normal((700, 8))
    x[100:200], x[200:300], x[300:350] = x[100], x[200] * (1 + 1e-5 * rng.random((100, 1))), x[300] + 1e-3 * x[301:351]
    x[400:430] = -x[370:400]
    x[600:] *= 1e4
    x = (x * scale).astype(kind)
    ids = rng.permutation(5000)[:700].astype(np.int64)
    hashing = PStable(2, 4, 2.0 * scale)
    cell = multiprobe.Cell(ids, x, hashing, 1, k)
    me, q = np.r_[ids[:650:7], 9001, 9002], np.concatenate([x[:650:7], x[100:101], (2 * x[5:6]).astype(kind)])
    exact = np.sqrt(((x[None].astype(float) - q[:, None].astype(float)) ** 2).sum(2))
    exact[me[:, None] == ids] = np.inf
    for bound in (np.full(len(q), np.inf), np.sort(exact, 1)[:, 8]):
        found = {}
        for i, v, d in zip(*cell.answer(me, q, bound, np.full(len(q), -np.inf), np.ones(len(q))), strict=True):
            found.setdefault(i, []).append((d, v))
        for i in range(len(q)):
            order = np.lexsort((ids, exact[i]))[:k]
            assert sorted(found[me[i]]) == [(exact[i][o], ids[o]) for o in order]
