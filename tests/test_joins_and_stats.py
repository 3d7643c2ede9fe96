import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candlewright.operators import joins, mining
from candlewright.operators.clusters import similar_events


def test_asof(spark):
    rng = np.random.default_rng(0)
    left = pd.DataFrame({"symbol": "A", "timeframe": "1h", "t": np.sort(rng.choice(10000, 300, replace=False)).astype(float), "lid": range(300)})
    right = pd.DataFrame({"symbol": "A", "timeframe": "1h", "t": np.sort(rng.choice(10000, 40, replace=False)).astype(float), "v": rng.normal(size=40)})
    for strict in (False, True):
        got = joins.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "t", ["v"], 500, strict).orderBy("lid").toPandas()
        want = pd.merge_asof(left, right[["t", "v"]], on="t", allow_exact_matches=not strict)
        assert np.allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_confirmed_elsewhere(spark):
    rng = np.random.default_rng(3)
    t = pd.DataFrame({"config": rng.choice(list("abc"), 200), "s": rng.integers(0, 2_000_000, 200)})
    df = spark.createDataFrame(t).withColumn("entry_ts", F.timestamp_seconds("s"))
    got = joins.confirmed_elsewhere(df, 2.0).select("config", "s", "confirmed").toPandas()
    brute = [bool(((t["config"] != r.config) & ((t["s"] - r.s).abs() <= 7200)).any()) for r in got.itertuples()]
    assert got["confirmed"].tolist() == brute and 0 < sum(brute) < 200


def test_student_tail():
    # reference points of the t distribution
    p = mining.student_tail(np.array([2.228, 1.96, 0.0, 12.706]), np.array([10.0, 1e6, 5.0, 1.0]))
    assert np.allclose(p, [0.05, 0.05, 1.0, 0.05], atol=2e-4)


def vectors(spark, n=120):
    rng = np.random.default_rng(5)
    base = rng.normal(size=n)
    pdf = pd.DataFrame({"symbol": "A", "timeframe": "1h", "move_type": "GAP_UP", "direction": "UP", "magnitude_pct": 1.0, "bar_idx": range(n),
                        "x": base, "y": base + rng.normal(0, 0.05, n), "z": rng.normal(size=n), "u": rng.normal(size=n), "v": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf)


def test_pair_correlations_and_greedy_drop(spark):
    pdf, df = vectors(spark)
    r = {(x["fa"], x["fb"]): x["r"] for x in mining.correlations(df, ["x", "y", "z"]).collect()}
    assert np.isclose(r[("x", "y")], np.corrcoef(pdf["x"], pdf["y"])[0, 1])
    ranked = spark.createDataFrame([("A", "1h", "GAP_UP", "y", 4.0, 1), ("A", "1h", "GAP_UP", "x", 3.0, 2), ("A", "1h", "GAP_UP", "z", 2.0, 3)],
                                   "symbol string, timeframe string, move_type string, feature string, t_statistic double, rank int")
    assert {x["feature"] for x in mining.drop_correlated(ranked, df, ["x", "y", "z"]).collect()} == {"y", "z"}


def test_bootstrap_is_repeatable_and_ordered(spark):
    ranked = spark.createDataFrame([("A", "1h", "GAP_UP", f"f{i}", 50, float(p), i + 1) for i, p in enumerate((5, 30, 80))],
                                   "symbol string, timeframe string, move_type string, feature string, n_events long, predictive_pct double, rank int")
    a, b = (mining.bootstrap_hit_rate(ranked).orderBy("rank").toPandas() for _ in range(2))
    assert a.equals(b)
    assert (a["hit_rate_ci_low"] <= a["predictive_pct"]).all() and (a["predictive_pct"] <= a["hit_rate_ci_high"]).all()


def test_similar_events_by_brute_force(spark):
    pdf, df = vectors(spark)
    names = ["x", "y", "z", "u", "v"]
    got = similar_events(df.where("bar_idx = 7"), df, names, 5).orderBy("position").toPandas()
    m = pdf[names]
    s = ((m - m.median()) / (m.quantile(0.75) - m.quantile(0.25))).to_numpy()
    sim = s @ s[7] / np.linalg.norm(s, axis=1) / np.linalg.norm(s[7])
    sim[7] = -9
    assert got["bar_idx"].tolist() == np.argsort(-sim)[:5].tolist()
