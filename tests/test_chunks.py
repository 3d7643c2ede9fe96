import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from candlewright.core import KEY
from candlewright.operators import chunks
from helpers import to_spark, walk


def test_dense_index_survives_gaps(spark):
    pdf = walk(900, symbols=("A",))
    pdf = pdf.drop(pdf.index[100:400]).reset_index(drop=True)
    got = chunks.index_bars(to_spark(spark, pdf), block_bars=64).orderBy("ts").toPandas()
    assert got["bar_idx"].tolist() == list(range(len(pdf)))


def test_scan_equals_sequential(spark):
    n = 5000
    pdf = walk(n, symbols=("A", "B"))
    df = chunks.index_bars(to_spark(spark, pdf))
    halo, size = 256, 1024
    spans = (2, 3, 9, 14, 200)
    ch = chunks.with_halo(df, halo, size)
    ch = ch.select("*", *[F.when(F.col("bar_idx") == 0, F.col("close")).otherwise(F.col("close") * 2.0 / (s + 1)).alias(f"in{s}") for s in spans])
    got = chunks.linear_scan(ch, {f"e{s}": (f"in{s}", 1 - 2.0 / (s + 1)) for s in spans} | {"total": ("volume", 1.0)}, halo, size)
    got = chunks.own_rows(got).orderBy("symbol", "bar_idx").toPandas()
    for sym, g in got.groupby("symbol"):
        src = pdf[pdf["symbol"] == sym]
        for s in spans:
            want = src["close"].ewm(span=s, adjust=False).mean().to_numpy()
            assert np.allclose(g[f"e{s}"], want, rtol=1e-11), s
        assert np.allclose(g["total"], src["volume"].cumsum(), rtol=1e-11)


def test_running_latest(spark):
    pdf = walk(3000, symbols=("A",))
    ch = chunks.with_halo(chunks.index_bars(to_spark(spark, pdf)), 256, 1024)
    got = chunks.own_rows(chunks.running_latest(ch, {"m": "CASE WHEN bar_idx % 1700 = 5 THEN close END"})).orderBy("bar_idx").toPandas()
    want = pdf["close"].where(np.arange(3000) % 1700 == 5).ffill()
    assert np.allclose(got["m"].astype(float), want, equal_nan=True)


def test_halo_copies_only_what_is_needed(spark):
    ch = chunks.with_halo(chunks.index_bars(to_spark(spark, walk(2048, symbols=("A",)))), 256, 1024, ahead=3)
    rows = ch.groupBy("chunk", "in_halo").count().toPandas().set_index(["chunk", "in_halo"])["count"].to_dict()
    assert rows == {(0, False): 1024, (0, True): 3, (1, False): 1024, (1, True): 257, (2, True): 257}


_ = (pd, KEY)
