"""Document quality by ordinal cumulative-link regression on graded ratings.

The grade of a labelled document is 0 (quality 0: unusable), 1 (quality 1 but toxic: usable after
review) or 2 (quality 1, not toxic). One set of hashed-text weights is shared by all cuts, and the
cuts are ordered thresholds: P(grade <= j) = sigmoid(threshold[j] - x.w). From it come the expected
grade and the tail probability P(grade >= cut) by which documents are selected.

The features of a text are its white-space separated words (lower-cased), their shapes (runs of
capitals, small letters, digits and each sign as itself), pairs of neighbouring shapes, and whether
a word repeats one of the two before it; each is hashed to 2**bits coordinates and counts with its
share among the words of the text.

Cases: null and empty texts have no feature and get the thresholds' own distribution. Texts are
read whole. Repeated rows get equal results. Labels that are null or of no document are left out;
of several labels of a document the lowest grade counts. With fewer than two grades in the sample
every document is graded alike and kept. Input columns pass through; one that is called like an
output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm import words as W

#: Byte classes of a shape: capitals, small letters and all of UTF-8 beyond ASCII, digits; a sign is its own class.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[48:58] = 48


@dataclass(frozen=True)
class GradeModel:
    bits: int
    weights: np.ndarray
    thresholds: np.ndarray


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and coordinate of every feature occurrence, and the words of each document."""
    starts, ends, first = W.word_spans(buf, offsets)
    doc, count = W.documents_of(first), np.diff(first)
    if not len(doc):
        return doc, np.zeros(0, np.uint32), count
    h = W.span_hashes(W.LOWER_AZ[buf], starts, ends)
    # Shapes: the bytes that begin a run of one class within their word, hashed word by word.
    kind = _CLASS[buf]
    head = np.ones(len(kind), bool)
    head[1:] = kind[1:] != kind[:-1]
    head[starts] = True
    place = np.cumsum(head) - head
    shape = W.span_hashes(kind[head], place[starts], place[ends - 1] + head[ends - 1])
    docs, coords = [doc, doc], [h, shape + np.uint64(1)]
    for gap in (1, 2):
        same = np.flatnonzero(doc[gap:] == doc[:-gap])
        again = h[same] == h[same + gap]
        docs.append(doc[same])
        coords.append(W.mix(np.where(again, np.uint64(10 + gap), np.uint64(20 + gap))))
        if gap == 1:
            docs.append(doc[same])
            coords.append(shape[same] * np.uint64(3) + shape[same + 1])
    return np.concatenate(docs), (W.mix(np.concatenate(coords)) >> np.uint64(64 - bits)).astype(np.uint32), count


def linear(column, model: GradeModel) -> np.ndarray:
    buf, offsets = W.text_buffer(column)
    out = np.zeros(len(offsets) - 1)
    for lo, hi in W.slices(offsets):
        doc, coord, count = features(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model.bits)
        out[lo:hi] = np.bincount(doc, model.weights[coord], hi - lo) / np.maximum(count, 1)
    return out


def cumulative(eta: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade <= j) for every row and threshold."""
    return 1.0 / (1.0 + np.exp(-np.clip(thresholds[None, :] - eta[:, None], -40, 40)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, bits: int, l2: float = 1e-4, steps: int = 150, rate: float = 0.5) -> GradeModel:
    """Cumulative-link fit by Adam on (coordinates, values) rows; grades are 0..top and all occur."""
    top = int(grades.max()) if len(grades) else 0
    if top < 1 or len(np.unique(grades)) < top + 1:
        return GradeModel(bits, np.zeros(1 << bits), np.full(max(top, 1), -40.0))
    size = np.array([len(i) for i, _ in rows])
    index, where = np.unique(np.concatenate([i for i, _ in rows]), return_inverse=True)
    value, row = np.concatenate([v for _, v in rows]), np.repeat(np.arange(len(rows)), size)
    share = np.array([(grades <= j).mean() for j in range(top)])
    # The first threshold and the logarithms of the gaps to the next ones keep the order.
    base = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(len(index)), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    k = len(index)
    every = np.arange(len(grades))
    for t in range(1, steps + 1):
        gaps = np.exp(p[k + 1 :])
        theta = p[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        c = cumulative(np.bincount(row, p[where] * value, len(rows)), theta)
        full = np.concatenate([np.zeros((len(c), 1)), c, np.ones((len(c), 1))], 1)
        slope = full * (1 - full)
        hi, lo = full[every, grades + 1], full[every, grades]
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = slope[every, grades + 1] / prob, slope[every, grades] / prob
        g = np.empty_like(p)
        g[:k] = np.bincount(where, (d_hi - d_lo)[row] * value, k) / len(rows) + l2 * p[:k]
        by_cut = np.array([(d_lo * (grades == j + 1)).sum() - (d_hi * (grades == j)).sum() for j in range(top)]) / len(rows)
        g[k] = by_cut.sum()
        g[k + 1 :] = np.array([by_cut[j:].sum() for j in range(1, top)]) * gaps
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w = np.zeros(1 << bits)
    w[index] = p[:k]
    return GradeModel(bits, w, p[k] + np.concatenate([[0.0], np.cumsum(np.exp(p[k + 1 :]))]))


def train(docs: DataFrame, labels: DataFrame, per_grade: int = 1500, bits: int = 16) -> GradeModel:
    """Fits on at most per_grade labelled documents of each grade (the bound of all that reaches the driver), drawn by a hash of their id."""
    graded = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg(F.min(F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)).alias("__grade"))
        .withColumn("__order", F.xxhash64("doc_id", F.lit(11)))
    )
    parts = [graded.where(F.col("__grade") == g).orderBy("__order", "doc_id").limit(per_grade) for g in (0, 1, 2)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).unionByName(parts[2]))  # at most 3 * per_grade rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])

    @F.arrow_udf("struct<i:binary,v:binary>")
    def counted(text: pa.Array) -> pa.Array:
        buf, offsets = W.text_buffer(text)
        index, value = [], []
        for lo, hi in W.slices(offsets):
            doc, coord, count = features(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits)
            key, n = np.unique((doc.astype(np.uint64) << np.uint64(32)) | coord.astype(np.uint64), return_counts=True)
            of = (key >> np.uint64(32)).astype(np.int64)
            share = (n / np.maximum(count[of], 1)).astype("<f4")
            coord = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
            cuts = np.searchsorted(of, np.arange(hi - lo + 1))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                index.append(coord[a:b].tobytes())
                value.append(share[a:b].tobytes())
        return pa.StructArray.from_arrays([pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["i", "v"])

    got = rows.select("__order", "doc_id", "__grade", counted("text").alias("x")).toArrow().sort_by([("__order", "ascending"), ("doc_id", "ascending")])
    found = [(np.frombuffer(x["i"], "<u4"), np.frombuffer(x["v"], "<f4").astype(float)) for x in got["x"].to_pylist()]
    grades = np.array(got["__grade"].to_pylist(), int)
    if not set(grades) >= {0, 1, 2} and len(set(grades)) > 1:  # a grade that never occurs has no threshold
        grades = np.searchsorted(np.unique(grades), grades)
    return fit_ordinal(found, grades, bits)


def grade(docs: DataFrame, model: GradeModel, least_tail: float = 0.5, cut: int = 1, text: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability = P(grade >= cut) and keep (tail_probability >= least_tail)."""

    @F.arrow_udf("struct<expected:double,tail:double>")
    def graded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            above = 1 - cumulative(linear(column, model), model.thresholds)
            yield pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(above[:, min(cut, above.shape[1]) - 1])], ["expected", "tail"])

    out = docs.withColumn("__graded", graded(F.col(text)))
    return (
        out.withColumn("expected_grade", F.col("__graded.expected")).withColumn("tail_probability", F.col("__graded.tail"))
        .withColumn("keep", F.col("__graded.tail") >= least_tail).drop("__graded")
    )
