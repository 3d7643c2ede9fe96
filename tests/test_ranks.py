import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candlewright.operators import ranks


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    parts = {
        "normal": rng.normal(0, 1, 3000), "ties": rng.integers(0, 3, 2000).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), "same": np.full(500, 7.5),
        "spread": np.concatenate([10.0 ** rng.uniform(-300, 300, 400), -(10.0 ** rng.uniform(-300, 300, 300))]), "wide": np.array([-1.7e308, 0.0, 1.7e308]),
        "outlier": np.concatenate([rng.uniform(0, 1, 1000), [1e18]]),
    }
    rows = [(k, float(x), float(x) * 2) for k, v in parts.items() for x in v if abs(x) < 8e307 or k == "wide"] + [("none", None, float("nan")), ("one", None, float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(7)
    shares = {"a": 0.0, "b": 0.005, "c": 0.5, "d": 0.731, "e": 1.0}
    got = {r["k"]: r for r in ranks.exact_quantiles(df, ["k"], {n: ("x", q) for n, q in shares.items()} | {"m": (F.col("y") + 1, 0.5)}).collect()}
    assert set(got) == set(parts) | {"none"}
    assert got["none"]["a"] is None
    for k, v in parts.items():
        for n, q in shares.items():
            at = q * (len(v) - 1)
            s = np.sort(v)
            lo = s[int(at)]
            want = lo + (s[min(int(at) + 1, len(s) - 1)] - lo) * (at - int(at)) if at > int(at) else lo
            assert np.isclose(got[k][n], want, rtol=1e-12, atol=0), (k, n)
    assert got["wide"]["m"] == 1.0 and got["two"]["m"] == 4.0


def test_positions(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 4000), "i": rng.permutation(4000), "v": rng.integers(0, 20, 4000).astype(float)})
    df = spark.createDataFrame(pdf)
    for got, by in ((ranks.positions(df, ["k"], F.floor(F.col("i") / 100), ["i"]), ["i"]), (ranks.ranged_positions(df, ["k"], ["v", "i"]), ["v", "i"])):
        got = got.toPandas()
        for _, g in got.groupby("k"):
            assert g.sort_values(by)["pos"].tolist() == list(range(len(g))) and set(g["_n"]) == {len(g)}
    flat = ranks.ranged_positions(df, [], [F.desc("v"), "i"]).toPandas().sort_values(["v", "i"], ascending=[False, True])
    assert flat["pos"].tolist() == list(range(4000))
    assert ranks.ranged_positions(df.limit(0), ["k"], ["i"]).count() == 0
