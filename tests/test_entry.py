import importlib

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
E = importlib.import_module("__spark_entry__")


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


def test_every_twin_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


@pytest.mark.parametrize("name", ["src06_bars_from_ticks", "t09_macd", "t16_supertrend", "ph02_entropy", "st03_level_distance", "c02_regime", "d07_detect", "ps01_welch", "va06_validate",
                                  "out05_summary", "l01_stream_candles"])
def test_twin_agrees(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(E.oracle_sql()[name]).df()
    got = E.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    cols = sorted(got.columns)
    keys = [c for c in cols if got[c].dtype.kind not in "f"]
    a, b = (d[cols].sort_values(keys or cols, ignore_index=True) for d in (got, want))
    for c in cols:
        if a[c].dtype.kind in "fiu" and b[c].dtype.kind in "fiu":
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-6, atol=1e-6, equal_nan=True), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
