"""Large groups of near copies in the shingle join: links grow with the group, not with its square."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.llm import shingle_join
from candlewright.llm import words as W


def near_copies(n, seed=1, words=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def components_of(rows, k, p):
    sets = [frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (t.split() for _, t in rows)]
    ids = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(ids)), np.float32)
    for i, s in enumerate(sets):
        m[i, [ids[x] for x in s]] = 1
    both, size = (m @ m.T).astype(np.int64), m.sum(1).astype(np.int64)
    near = 100 * both >= p * (size[:, None] + size[None, :] - both)
    label = np.arange(len(rows))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(rows))])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("n", [500, 4000])
@pytest.mark.parametrize(("k", "p"), [(5, 80)])
def test_links_of_near_copies_are_linear(spark, n, k, p):
    rows = near_copies(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    _, nodes, links = shingle_join.linked_sets(df, k=k, threshold=(p, 100))
    made, there = links.count(), nodes.count()
    print(n, k, p, made, there)
    assert made <= 2 * there
    if n == 500:
        got = {r["doc_id"]: r["component_id"] for r in shingle_join.join_documents(df, k=k, threshold=(p, 100), block=300).collect()}
        want = components_of(rows, k, p)
        assert [got[i] for i in range(n)] == want.tolist()


def test_divide_skip_rule_and_probe():
    for n in range(1, 400):
        need = -(-85 * n // 100)
        for longest in (1, 2, 50, 10**9):
            assert 0 <= shingle_join.divide(n, longest, 85, 100) < need
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(150)]
    lists = shingle_join.Lists(sets)
    tokens = np.unique(rng.integers(0, 400, 90).astype(np.uint64))
    asked = rng.permutation(150)[:100]
    assert lists.occurrences(tokens, asked).tolist() == [len(np.intersect1d(tokens, sets[i])) for i in asked]
    assert W.unpack_sorted(W.pack_sorted(tokens)).tolist() == tokens.tolist()


def test_long_lists_of_unlinked_documents(spark):
    """A passage that very many documents share, apart from a few that are near copies of each other."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join(passage + [f"u{i}_{j}" for j in range(rng.randrange(0, 16))])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.join_documents(df, k=4, threshold=(85, 100), block=50).collect()}
    assert [got[i] for i in range(len(rows))] == components_of(rows, 4, 85).tolist()
    assert shingle_join.join_documents(df.withColumns({"fp": F.lit(1), "n": F.lit(2), "th": F.lit(3), "id": F.lit("x")}), block=50).count() == len(rows)
