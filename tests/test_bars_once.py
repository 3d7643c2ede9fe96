from candlewright.operators import chunks
from candlewright.plans import inputs


def test_indexing_bars_does_not_read_the_ticks_again(spark, monkeypatch):
    seen, index_bars = [], chunks.index_bars
    monkeypatch.setattr(inputs, "_TABLES", {})
    monkeypatch.setattr(chunks, "index_bars", lambda bars: seen.append(bars) or index_bars(bars))
    sf = "/root/testdata/sf0.001"
    got = inputs.bars(spark, sf)
    assert len(seen) == 1 and not any("lineitem" in f for f in seen[0].inputFiles())
    assert got.count() == inputs.line_bars(spark, sf).count()
