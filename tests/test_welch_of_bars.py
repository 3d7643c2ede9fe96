import numpy as np
import pandas as pd

from candlewright.operators import mining


def test_moments_of_chunks_equal_the_statistics_of_all_rows(spark):
    """Two chunks and two series; a gap of NULL, NaN, a constant column, a flag, and events on chunk borders."""
    rng = np.random.default_rng(8)
    parts = []
    for s, n in (("A", 6000), ("B", 300)):
        x = rng.normal(1e6, 1, n)
        parts.append(pd.DataFrame({"symbol": s, "timeframe": "1h", "bar_idx": range(n), "x": x, "flag": (x > 1e6).astype(float), "same": 0.1, "gaps": np.where(np.arange(n) % 7 < 3, None, x - 1e6)}))
    bars = spark.createDataFrame(pd.concat(parts, ignore_index=True), "symbol string, timeframe string, bar_idx long, x double, flag double, same double, gaps double")
    bars = bars.selectExpr("*", "if(bar_idx = 4090, double('NaN'), x) AS holes")
    events = [("A", int(i), t) for t, at in (("GAP_UP", (0, 2, 3, 700, 4092, 4095, 4096, 4097, 4101, 5999)), ("GAP_DOWN", range(60, 3000, 90))) for i in at] + [("B", i, "GAP_UP") for i in (80, 81, 200)]
    ev = spark.createDataFrame([(s, "1h", i, t) for s, i, t in events], "symbol string, timeframe string, bar_idx long, move_type string")
    names = ["x", "flag", "same", "gaps", "holes"]
    want = mining.welch(mining.precondition_vectors(bars, ev, names, 5), mining.background(bars, ev, names, 5), names)
    key = ["symbol", "move_type", "feature"]
    want, got = (d.toPandas().sort_values(key, ignore_index=True)[want.columns] for d in (want, mining.welch_of_bars(bars, ev, names, 5)))
    assert len(want) == 12 and got[[*key, "n_events", "n_background"]].equals(want[[*key, "n_events", "n_background"]])
    for name in want.columns[6:]:
        assert np.allclose(got[name].astype(float), want[name].astype(float), rtol=1e-6, atol=1e-9, equal_nan=True), name


def test_the_background_is_neither_repeated_per_type_nor_unpivoted(spark):
    bars = spark.range(200).selectExpr("'A' AS symbol", "'1h' AS timeframe", "id AS bar_idx", "double(id % 11) AS x", "double(id % 5) AS y")
    ev = spark.range(0, 200, 20).selectExpr("'A' AS symbol", "'1h' AS timeframe", "id AS bar_idx", "if(id % 40 = 0, 'GAP_UP', 'GAP_DOWN') AS move_type")
    parts = mining._chunk_parts(bars, ev, ["x", "y"], 5)
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "LeftAnti" not in plan
    rows = parts.collect()
    assert sorted((r["move_type"], r["part"]) for r in rows if r["part"] != "vector") == [(t, p) for t in ("GAP_DOWN", "GAP_UP") for p in ("bg", "ev")]
    assert sum(r["part"] == "vector" for r in rows) == 10
