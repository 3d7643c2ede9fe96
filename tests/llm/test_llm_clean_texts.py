"""Texts that lose nothing stay as they are; tied fractions; folders on a cluster."""

import hashlib
import types
from collections import Counter

import pytest
from pyspark.sql import functions as F

from candlewright.llm import common, repeats, sharding

PASSAGE = " ".join(f"p{i}" for i in range(40))


def test_removed_words_are_cut_and_nothing_else_changes(spark):
    rows = [
        (1, f"Start  of\n\tone {PASSAGE}\nand  its end."), (2, f"{PASSAGE} tail\t of two"), (3, f"head of  three\n{PASSAGE}"), (4, " kept \n\n as it  is\t"), (5, None), (6, ""),
        (7, "é ü　ß  x"), (8, PASSAGE), (None, "no id \n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df, window=35, keep_text=True).collect()}
    want = {1: "Start  of\n\tone and  its end.", 2: "tail\t of two", 3: "head of  three\n", 4: " kept \n\n as it  is\t", 5: None, 6: "", 7: "é ü　ß  x", 8: "", None: "no id \n"}
    assert {k: r["text"] for k, r in got.items()} == want
    for r in got.values():
        words = [w for w in (r["text"] or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        assert r["kept_sha256"] == hashlib.sha256(" ".join(words).encode()).hexdigest()


def test_tied_fractions_are_dealt_evenly(spark):
    rows = [(i, f"s{i}", "x") for i in range(3000)] + [(10_000 + i, "big", "y") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = sharding.interleave(df, shards=8, rows_per_part=100).collect()
    assert len(out) == 4000 and Counter(r["shard"] for r in out) == {s: 500 for s in range(8)}
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(500))
    # a plain sort by fractional rank gives the same order, up to ties
    place = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    assert [r["fraction"] for r in place] == sorted(r["fraction"] for r in out)
    rank = {}
    for r in sorted((r for r in out if r["source"] == "big"), key=lambda r: r["fraction"]):
        rank[r["doc_id"]] = r["fraction"]
    assert list(rank.values()) == [(i + 0.5) / 1000 for i in range(1000)]


def test_a_cluster_needs_a_shared_folder():
    conf = types.SimpleNamespace(get=lambda *a: None)
    spark = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="share"):
        common.shared_dir(spark)
