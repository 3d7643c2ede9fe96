import numpy as np

from candlewright.operators import clusters


def test_k_means_runs_per_series_and_lowers_k(spark):
    rng = np.random.default_rng(3)
    rows = []
    for sym, centres in (("A", [(0, 0), (10, 0), (0, 10), (10, 10)]), ("B", [(100, 100), (110, 100), (100, 110), (110, 110)])):
        for i in range(120):
            x, y = centres[i % 4]
            rows.append((sym, "1h", i, [float(x + rng.normal(0, 0.3)), float(y + rng.normal(0, 0.3))]))
    rows += [("C", "1h", i, [float(i), 0.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "symbol string, timeframe string, bar_idx long, _x array<double>")
    got = clusters.k_means(df, 2, 4, rounds=15).toPandas()
    assert len(got) == len(rows) and set(got[got.symbol == "C"].cluster) == {0}
    for sym in "AB":
        own = got[got.symbol == sym]
        x = np.array(own["_x"].tolist())
        mean = {k: x[own.cluster == k].mean(0) for k in set(own.cluster)}
        near = [min(mean, key=lambda k: ((mean[k] - v) ** 2).sum()) for v in x]
        assert (np.array(near) == own.cluster.to_numpy()).all()  # a fixed point of the steps
