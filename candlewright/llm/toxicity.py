"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Terms are runs of letters and digits, lower-cased. The features of a text are the presence of its
terms, its adjacent pairs, its pairs one or two terms apart, and the first 3 to 6 bytes of a term
(so that inflected forms share a weight). Every feature hashes to one of 2**bits coordinates.

FTRL-proximal gives each coordinate its own learning rate and, by L1, leaves nearly all weights at
exactly zero. The rest, at most as many as coordinates occur in the bounded training sample, are
shipped to the executors; scoring is one pass over the texts with no shuffle.

Cases: null and empty texts hold no feature and get the score of the bias alone. Texts are read
whole. Repeated rows get equal scores. Labels that are null, or of no document, are left out; a
document labelled twice counts as toxic if any label says so. With no labels at all the score is
0.5. Columns of the input pass through; one that is called like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.llm import words as W

PREFIXES = (3, 4, 5, 6)


@dataclass(frozen=True)
class ToxicityModel:
    """bias and the nonzero weights by coordinate."""

    bits: int
    bias: float
    coordinates: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.coordinates] = self.weights
        return out


def _terms(buf: np.ndarray, offsets: np.ndarray):
    low = W.LOWER_AZ[buf]
    # Capital letters of Latin-1 (two bytes in UTF-8) to small ones.
    latin = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[latin] += 0x20
    return low, *W.word_spans(low, offsets, W.NOT_TERM)


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and coordinate of every feature occurrence."""
    low, starts, ends, first = _terms(buf, offsets)
    doc = W.documents_of(first)
    if not len(doc):
        return doc, np.zeros(0, np.uint32)
    h = W.span_hashes(low, starts, ends)
    docs, coords = [doc], [h]
    for gap in (1, 2, 3):
        same = np.flatnonzero(doc[gap:] == doc[:-gap])
        docs.append(doc[same])
        coords.append(W.mix(h[same] * np.uint64(2 * gap + 1) ^ (h[same + gap] + np.uint64(gap))))
    size = ends - starts
    for n in PREFIXES:
        long = np.flatnonzero(size >= n)
        docs.append(doc[long])
        coords.append(W.mix(W.span_hashes(low, starts[long], starts[long] + n) + np.uint64(n)))
    shift = np.uint64(64 - bits)
    return np.concatenate(docs), (np.concatenate(coords) >> shift).astype(np.uint32)


def logits(column, model: ToxicityModel, dense: np.ndarray) -> np.ndarray:
    buf, offsets = W.text_buffer(column)
    out = np.full(len(offsets) - 1, model.bias)
    for lo, hi in W.slices(offsets):
        doc, coord = features(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model.bits)
        hit = np.flatnonzero(dense[coord])
        # A feature counts once for a text, however often it occurs there.
        key = np.unique((doc[hit].astype(np.uint64) << np.uint64(32)) | coord[hit].astype(np.uint64))
        np.add.at(out, lo + (key >> np.uint64(32)).astype(np.int64), dense[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)])
    return out


def fit_ftrl(
    examples: list[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int,
) -> ToxicityModel:
    """FTRL-proximal over the examples in the given order."""
    if not examples:
        return ToxicityModel(bits, 0.0)
    z, n, w = (np.zeros(1 << bits) for _ in range(3))
    bias = bias_sq = 0.0
    for _ in range(epochs):
        for idx, y in examples:
            margin = bias + float(w[idx].sum())
            g = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35))) - y
            ni = n[idx]
            new = ni + g * g
            zi = z[idx] + g - (np.sqrt(new) - np.sqrt(ni)) / alpha * w[idx]
            z[idx], n[idx] = zi, new
            w[idx] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(new)) / alpha + l2))
            bias_sq += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_sq))
    at = np.flatnonzero(w)
    return ToxicityModel(bits, float(bias), at.astype(np.uint32), w[at].astype(np.float32))


def train(
    docs: DataFrame, labels: DataFrame, per_class: int = 3000, bits: int = 20, alpha: float = 2.0, beta: float = 1.0,
    l1: float = 6.0, l2: float = 0.0, epochs: int = 6, most_repeats: int = 8,
) -> ToxicityModel:
    """Fits on at most per_class labelled documents of each class (the bound of all that reaches the driver),
    drawn by a hash of their id; the rarer class is shown up to most_repeats times as often. The score is thus a
    probability under evenly weighted classes."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    parts = [
        labels.where((F.col("y") > 0) == F.lit(bool(y))).select("doc_id", F.lit(y).alias("__y"), F.xxhash64("doc_id", F.lit(7)).alias("__order"))
        .orderBy("__order", "doc_id").limit(per_class)
        for y in (0, 1)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])

    @F.arrow_udf("binary")
    def coordinates(text: pa.Array) -> pa.Array:
        buf, offsets = W.text_buffer(text)
        out = []
        for lo, hi in W.slices(offsets):
            doc, coord = features(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bits)
            key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | coord.astype(np.uint64))
            cuts = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(32))
            coord = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
            out += [coord[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.array(out, pa.binary())

    got = rows.select("__order", "doc_id", "__y", coordinates("text").alias("x")).toArrow().sort_by([("__order", "ascending"), ("doc_id", "ascending")])
    examples = [(np.frombuffer(x, "<u4"), y) for x, y in zip(got["x"].to_pylist(), got["__y"].to_pylist(), strict=True)]
    by_class = [[e for e in examples if e[1] == y] for y in (0, 1)]
    most = max(map(len, by_class))
    shown = [e for own in by_class if own for e in own * min(most_repeats, max(1, round(most / len(own))))]
    order = np.random.Generator(np.random.PCG64(1)).permutation(len(shown))
    return fit_ftrl([shown[i] for i in order], bits, alpha, beta, l1, l2, epochs)


def score_column(text: Column | str, model: ToxicityModel) -> Column:
    """Probability of label 1 for a text column."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dense = model.dense()
        for text in batches:
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(logits(text, model, dense), -60, 60))))

    return score(text)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on)."""
    out = docs.withColumn("score", score_column(F.col(text), model))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
