import numpy as np
import pandas as pd

from candlewright.functions.features import compute_features
from candlewright.streaming import live, recurrent
from tests.helpers import to_spark, walk

NAMES = ["ema_200", "macd_hist_slope", "atr_z", "adx", "memory_pressure", "obv_z", "consec_bull", "kc_squeeze", "sma_200"]


def test_carries_over_any_split_equal_one_pass(spark):
    pdf = walk(300, symbols=("X",))
    bars = {k: pdf[k].to_numpy() for k in recurrent.PRICES}
    c = recurrent.carried(1.0)
    whole = recurrent.advance(c, bars, None, {})
    assert np.allclose(whole["ema_200"], pdf["close"].ewm(span=200, adjust=False).mean())
    assert np.allclose(whole["obv"], (np.sign(pdf["close"].diff()).fillna(0) * pdf["volume"]).cumsum())
    for cuts in ((1, 2), (7, 250), (299, 299)):
        prev, y, got = None, {}, []
        for a, b in zip((0, *cuts), (*cuts, 300)):
            if a == b:
                continue
            part = {k: v[a:b] for k, v in bars.items()}
            out = recurrent.advance(c, part, prev, y)
            prev, y = ({k: v[-1] for k, v in d.items()} for d in (part, out))
            got.append(pd.DataFrame(out))
        for name, col in pd.concat(got).items():
            assert np.allclose(col, whole[name]), name


def test_stream_equals_batch(spark, tmp_path):
    """Three polls with repeats and bars that come too late; one series ends after the first poll, one starts in the second."""
    pdf = walk(330, symbols=("X", "Y", "Z"))
    at = pdf.groupby("symbol").cumcount()
    pdf = pdf[~((pdf.symbol == "Y") & (at >= 90)) & ~((pdf.symbol == "Z") & (at < 120))].reset_index(drop=True)
    hour = (pdf.ts - pdf.ts.min()) // pd.Timedelta("1h")
    late = pdf[(pdf.symbol == "X") & (hour == 50)]
    source = str(tmp_path / "in")
    polls = [pdf[(hour < 110) & ~pdf.index.isin(late.index)], pd.concat([pdf[(hour >= 100) & (hour < 280)], late]), pd.concat([pdf[hour >= 270], pdf[hour >= 300]])]

    def each(batch, batch_id):
        with live.kept(batch):
            live.batch_features(batch, NAMES, "1h").write.mode("append").parquet(str(tmp_path / "out"))

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for p in polls:
        df = to_spark(spark, p)
        df.write.mode("append").parquet(source)
        s = live.with_state(spark.readStream.schema(df.schema).parquet(source), "1h", NAMES)
        s.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    want = compute_features(to_spark(spark, pdf.drop(late.index)), NAMES, "1h").toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    assert len(got) == len(want) and got["bar_idx"].tolist() == want["bar_idx"].tolist()
    for n in NAMES:
        assert np.allclose(got[n].astype(float), want[n].astype(float), rtol=1e-9, atol=1e-7, equal_nan=True), n


def test_ring_reaches_as_far_as_the_windows(spark):
    assert recurrent.history_bars(["ema_200"], 1.0) == 0
    assert recurrent.history_bars(["sma_200"], 1.0) >= 199
    assert recurrent.history_bars(["ichi_above_cloud"], 1.0) >= 52 + 26
    assert recurrent.history_bars(["sma_200"], 12.0) >= 2399
