"""Cases of the second review."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.llm import exchange, multiprobe, pages, repeats, shingle_join


def brute(x, ids, i, k=10):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    return {int(ids[j]) for j in np.lexsort((ids, d)) if j != i}, [int(ids[j]) for j in np.lexsort((ids, d)) if j != i][:k]


def recall(spark, x, asks, partitions=8, extra=(), **kw):
    """Mean recall of the 10 nearest for the rows in asks."""
    ids = np.arange(len(x))
    rows = [(int(i), [float(e) for e in v]) for i, v in zip(ids, x, strict=True)] + list(extra)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(partitions)
    got = {}
    for r in multiprobe.search(df, F.col("vec_id").isin([int(a) for a in asks]), **kw).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(set(brute(x, ids, i)[1]) & got.get(int(i), set())) / 10 for i in asks])


def unit(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.sqrt((x * x).sum(1))[:, None]


def test_search_with_mostly_null_embeddings(spark):
    x = unit(400, 16, 1)
    extra = [(1000 + i, None if i % 3 else []) for i in range(600)] + [(5000 + i, [1.0] * 8) for i in range(300)]
    assert recall(spark, x, range(0, 400, 10), partitions=64, extra=extra) >= 0.9


def test_search_beside_a_large_group_of_copies(spark):
    x = unit(2100, 64, 2)
    x[1400:] = x[1400]  # a third
    got = recall(spark, x, range(0, 1400, 20))
    print("recall", got)
    assert got >= 0.9


def test_search_beside_tight_clusters(spark):
    x = unit(1500, 16, 3)
    x[600:] = x[600] + 1e-3 * x[600:]  # most vectors are near copies of one, so the median is no guide for the others
    assert recall(spark, x, range(0, 600, 20)) >= 0.9


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='content no-sidebar'><article><p>One</p></article></div>", "One"),
        ("<div class='wrapper has-sidebar'><main><p>One</p></main></div>", "One"),
        ("<article class='post comments-open'><p>One</p></article>", "One"),
        ("<article><section id='social-policy'><p>One</p></section><h2 id='notice-period'>Two</h2><h2 id='comments'>Three</h2></article>", "One\nTwo\nThree"),
        ("<article><div class='sharing-economy'><p>One</p></div><div id='navy-history'><p>Two</p></div><div class='promotion'><p>Three</p></div></article>", "One\nTwo\nThree"),
        ("<article><div aria-label='Notice of sharing'><p>One</p></div></article>", "One"),
        ("<div class='sidebar'><p>no</p><article><p>One</p><div class='ad'>no</div></article><p>no</p></div>", "One"),
        ("<form><header><p>no</p><main><p>One</p></main></header></form>", "One"),
        ("<article><p>One</p><div class='box comments'><p>no</p><article class='comment'><p>no</p></article></div></article>", "One"),
        ("<article><p>One</p></article><aside><article><p>no</p></article></aside><nav><p>no</p></nav>", "One"),
    ],
)
def test_names_are_whole_words(html, text):
    assert pages.main_text(pages.lines_of(html), None) == text


@pytest.fixture
def small_groups(monkeypatch):
    """Groups of about 2 kB, and the most rows that a call of applyInArrow sees at once."""
    monkeypatch.setattr(exchange, "GROUP_BYTES", 2000)
    seen = []
    real = exchange.grouped
    monkeypatch.setattr(exchange, "grouped", lambda docs, *a: seen.append(real(docs, *a)) or seen[-1])
    return lambda: [max((r["count"] for r in df.groupBy("__grp").count().collect()), default=0) for df in seen]


@pytest.mark.parametrize("copies", [False, True])
def test_one_id_for_all_rows_fills_no_group(spark, small_groups, copies):
    rng = np.random.default_rng(6)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 500, 40))
    one = text()
    rows = [(None if i % 2 else 7, one if copies else text()) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    removed = {(r.n_words, r.n_removed) for r in repeats.remove_repeats(df, window=10).collect()}
    assert removed == ({(40, 40)} if copies else {(40, 0)})
    joined = shingle_join.join_documents(df).collect()
    assert len(joined) == 400 and {r.n_shingles for r in joined} == {37}
    assert max(small_groups()) < 40  # 200 of one id
