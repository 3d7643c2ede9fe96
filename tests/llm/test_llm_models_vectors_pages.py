import importlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.llm import grading, multiprobe, near_vectors, pages, toxicity
from candlewright.llm.components import components
from candlewright.llm.pstable import success
from candlewright.llm.queries import held_out

SF = "/root/testdata/sf0.1"


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    rows = []
    for i in range(400):
        x = base[i % 12] * rng.uniform(0.5, 3) + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.25, 2.0])
        rows.append((i, [float(v) for v in np.float32(x)], int(i % 3)))
    rows += [(500 + i, rows[12][1], rows[12][2]) for i in range(30)]  # copies
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] + [1.0] * 15, 1), (603, [None] + [1.0] * 15, 1), (604, rows[0][1], None), (605, [1.0, 2.0], 1), (606, [1.0, 2.0], 1), (607, [], 1)]
    return rows + [rows[5], rows[600 - 600]]


@pytest.mark.parametrize("block", [1500, 8])
def test_near_vectors_against_brute_force(spark, block):
    rows = {r[0]: r for r in vectors()}
    df = spark.createDataFrame([(*r, 1, "x") for r in vectors()], "vec_id long, embedding array<float>, label int, n_links int, rep string")
    ok = {i: np.array(v) for i, v, lab in rows.values() if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links, root = Counter(), {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in ok.items():
        for b, y in ok.items():
            if a < b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[a] += 1
                links[b] += 1
                hi, lo = max(find(a), find(b)), min(find(a), find(b))
                root[hi] = lo
    want = {i: (links[i], find(i), find(i) == i) for i in rows}
    # Enough tables that a missed pair in this fixture is out of the question.
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.link(df, tables=24, block=block).collect()}
    assert got == want
    assert near_vectors.missed(0.93, 10, 5, 2.0) < 0.003
    assert near_vectors.link(df.limit(0)).count() == 0


def test_multiprobe_reaches_its_recall(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = emb.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in multiprobe.search(emb, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = sorted(got[ids[i]])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        place = {int(v): j for j, v in enumerate(ids)}
        assert all(abs(d[place[v]] - s) < 1e-9 and v != ids[i] for _, v, s in own)
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if j != i][:10]
        found, total = found + len(set(best) & {v for _, v, _ in own}), total + 10
    assert found / total >= 0.9


def test_multiprobe_edges(spark):
    df = spark.createDataFrame([(*r, 3) for r in vectors()], "vec_id long, embedding array<float>, label int, rank int")
    out = multiprobe.search(df, F.col("vec_id") < 20, k=500, block=16, rows_per_cell=64).collect()
    valid = [i for i, v, _ in {r[0]: r for r in vectors()}.values() if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    per = Counter(r.query_id for r in out)
    assert set(per) == {i for i in valid if i < 20} and all(n == len(valid) - 1 for n in per.values())
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in multiprobe.search(few, F.col("vec_id") > 0).collect()) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert multiprobe.search(few.limit(0), F.lit(True)).count() == 0
    cells, prob = success(np.array([0.5, 2.2, -1.7]), 1.0, 0.95)
    assert (np.diff(prob) <= 0).all() and prob.sum() >= 0.95 and cells[0].tolist() == [0, 2, -2]


def test_models_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fit, held = labels.where(~held_out()), labels.where(held_out())
    tox = toxicity.train(docs, fit)
    assert len(tox.weights) < 20_000  # sparse
    got = toxicity.score(docs, tox).join(held, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert got.score.between(0, 1).all()
    assert got.predicted[got.toxic == 1].mean() > 0.8 and got.predicted[got.toxic == 0].mean() < 0.01
    grade = grading.train(docs, fit)
    assert (np.diff(grade.thresholds) > 0).all()
    got = grading.grade(docs, grade).join(held, "doc_id").select("keep", "quality", "toxic", "expected_grade").toPandas()
    assert got.keep[got.quality == 1].mean() > 0.99 and got.keep[got.quality == 0].mean() < 0.05
    assert got.expected_grade[got.quality == 0].mean() < 0.5 < 1.2 < got.expected_grade[got.quality == 1].mean()


def test_models_on_blanks_clashes_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 5, "x"), (2, "", 5, "x"), (3, "word " * 30_000, 5, "x"), (3, "word " * 30_000, 5, "x"), (None, "a b", 5, "x")], "doc_id long, text string, score int, keep string")
    none = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(3, 1, 0), (3, 1, 1), (2, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some, some.limit(0)):
        out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
        out = grading.grade(docs, grading.train(docs, labels)).collect()
        assert len(out) == 5 and all(0 <= r.tail_probability <= 1 and isinstance(r.keep, bool) for r in out)
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, some)).count() == 0 and grading.grade(empty, grading.train(empty, some)).count() == 0


def test_ordinal_gradient_recovers_known_thresholds():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    eta = x @ np.array([4.0, -4.0, 2.0, 0.0])
    grades = (eta + rng.logistic(size=3000) > 0.0).astype(int) + 0
    grades += (grades == 1) & (eta + rng.logistic(size=3000) > 2.0)
    model = grading.fit_ordinal([(np.arange(4), r) for r in x], grades, 4, steps=400, rate=0.1)
    assert model.weights[0] > 2 and model.weights[1] < -2 and model.thresholds[0] < model.thresholds[1]


def longest_common(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_common_subsequence_is_longest():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 14))] for _ in range(2))
        keep = pages.common_subsequence(np.array(a), np.array(b))
        own, it = [x for x, k in zip(a, keep, strict=True) if k], iter(b)
        assert all(x in it for x in own) and len(own) == longest_common(a, b)


NAV = "<div class='x'><p>Home</p><p>About us today</p></div>"


def test_pages(spark):
    rows = [
        (1, "http://a.b/x/1", f"<html><body>{NAV}<div><p>One first text</p><p>Shared quote</p></div><p>Imprint</p></body></html>"),
        (2, "http://a.b/x/2", f"<html><body>{NAV}<div><p>Two other text</p><p>More words here</p><p>third</p><p>4</p></div><p>Imprint</p></body></html>"),
        (3, "http://q.r/1", f"{NAV}<p>a copy</p>"), (4, "http://q.r/2", f"{NAV}<p>a copy</p>"),
        (5, "http://c.d/", "<p>Alone"), (6, None, None), (7, "http://c.e/", ""),
        (8, "http://a.b/y/4", "<title>T</title><script>var t='</p>';</script><header>Site</header><article><header><h1>H &amp;  1</h1></header><p>Art <b>x<br>\n y</b><p>z&copy;</p><div class='comments'><p>no</p></div><aside>n</aside></article><form>f</form><footer>g"),
        (8, "http://a.b/y/4", "<title>T</title><script>var t='</p>';</script><header>Site</header><article><header><h1>H &amp;  1</h1></header><p>Art <b>x<br>\n y</b><p>z&copy;</p><div class='comments'><p>no</p></div><aside>n</aside></article><form>f</form><footer>g"),
        (9, "http://a.b/big", "<article>" + "<p>line</p>" * 30_000 + "</article>"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = pages.extract(df).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert text[1] == "One first text\nShared quote" and text[2] == "Two other text\nMore words here\nthird\n4"
    assert text[3] == text[4] == "Home\nAbout us today\na copy"  # copies prove nothing
    assert text[5] == "Alone" and text[6] == text[7] == "" and text[8] == "H & 1\nArt x y\nz©" and text[9] == "\n".join(["line"] * 30_000)
    assert pages.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("per_range", [50_000, 3])
def test_nearest_pages(spark, per_range):
    keys = [(i, f"http://h{i % 2}.x/p/{i // 2:03d}?q={i}") for i in range(40)] + [(50, "http://lone.x/"), (51, None)]
    got = dict(map(tuple, pages.nearest_pages(spark.createDataFrame(keys, "key long, url string"), per_range).collect()))
    assert 50 not in got and 51 not in got and len(got) == 40
    path = {k: (k % 2, f"/p/{k // 2:03d}") for k in range(40)}
    alike = lambda a, b: next((i for i, (x, y) in enumerate(zip(path[a][1], path[b][1], strict=True)) if x != y), 6)
    for k, m in got.items():
        near = [x for x in (k - 2, k + 2) if 0 <= x < 40]
        assert m in near and alike(k, m) == max(alike(k, x) for x in near)


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, seen[-1], sf)
        if name != "best-fit packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        seen.append(out.cache())
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids[:-1], ids[1:], strict=True)) and ids[3] == ids[4] == ids[5] and len(ids[5]) > 100
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0}
    assert clean & ids[0] <= ids[2] and not ids[2] & {i for i, r in labels.items() if r.quality == 0}
    assert pipeline.run(spark, sf).count() == seen[5].count()
    for d in seen:
        d.unpersist()
