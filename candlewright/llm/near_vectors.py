"""Near-duplicate embeddings: p-stable buckets in several tables, then exact cosine checks.

Vectors are normalised; two whose cosine reaches c lie within sqrt(2 - 2c), where the tables bring
them together in some bucket with a probability that `missed` states (below 0.3 % at the threshold
itself by default, and far less above it). Buckets hold vectors of one label and one length only.

Equal vectors are one weighted vector from the start, so copies cost nothing. A bucket larger than
`block` is dealt into parts, and pairs of parts are compared in tasks of their own: no task holds
more than two parts and nothing is dropped. A comparison emits one count per vector and the edges of
a spanning star, never its pairs; a pair that meets in several tables counts in the first only.

Cases: a vector that is null, zero, or has null or non-finite components, or whose label is null,
links with nothing and is its own component. Rows that repeat a vec_id are one vector (the smallest
label and embedding count). A null vec_id is left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, pi, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.llm.common import written
from candlewright.llm.components import components
from candlewright.llm.pstable import PStable, matrix


def missed(cosine: float, tables: int, projections: int, width: float) -> float:
    """Probability that two vectors of this cosine share a bucket in no table."""
    t = width / sqrt(2 - 2 * cosine)
    one = 1 - 2 * NormalDist().cdf(-t) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))
    return (1 - one**projections) ** tables


def usable(column: F.Column) -> F.Column:
    @F.arrow_udf("boolean")
    def ok(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            yield pa.array([x is not None and len(x) > 0 and None not in x and bool(np.isfinite(x).all() and np.any(x)) for x in v.to_pylist()], pa.bool_())

    return ok(column)


def _compare(group: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every bucket (or pair of its parts) in the group: vectors, links of each that are new in its table, and star centre of each."""
    group = group.sort_by([("slot", "ascending"), ("rep", "ascending")])
    slot = group["slot"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1], True])
    rep, w, part, left, right, table = (group[c].to_numpy() for c in ("rep", "w", "part", "i", "j", "t"))
    size = len(group["v"][0]) if len(group) else 0
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi - lo < 2:
            continue
        own = group.slice(lo, hi - lo)
        x, _ = matrix(own["v"])
        x /= np.sqrt((x * x).sum(1))[:, None]
        codes = np.array(own["keys"].to_pylist(), np.int64)[:, : table[lo]]
        a = np.flatnonzero(part[lo:hi] == left[lo])
        b = np.flatnonzero(part[lo:hi] == right[lo])
        near = x[a] @ x[b].T >= threshold
        near &= a[:, None] != b[None, :]
        if not near.any():
            continue
        # Star of each connected piece: spread the smallest place (rows are in order of rep) until it rests.
        root = np.arange(hi - lo)
        while True:
            ra = np.minimum(root[a], np.where(near, root[b][None, :], hi - lo).min(1))
            new = root.copy()
            np.minimum.at(new, a, ra)
            rb = np.minimum(new[b], np.where(near, new[a][:, None], hi - lo).min(0))
            np.minimum.at(new, b, rb)
            if (new == root).all():
                break
            root = new
        fresh = near.copy()
        for t in range(codes.shape[1]):
            fresh &= codes[a, t][:, None] != codes[b, t][None, :]
        links = np.zeros(hi - lo, np.int64)
        links[a] += fresh @ w[lo:hi][b]
        if left[lo] != right[lo]:
            links[b] += w[lo:hi][a] @ fresh
        yield rep[lo:hi], links, rep[lo:hi][root]


def link(
    vectors: DataFrame, threshold: float = 0.93, tables: int = 10, projections: int = 5, width: float = 2.0, block: int = 1500, rows_per_task: int = 4096,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for vectors (vec_id, embedding, label)."""
    hashing = PStable(tables, projections, width)
    base = vectors.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.*")
    base = written(base.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull()))
    unique = base.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))

    @F.arrow_udf("array<bigint>")
    def buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out: list = [None] * len(column)
            size = np.array([len(v) for v in column.to_pylist()])
            for dim in np.unique(size):  # vectors of one length at a time
                rows = np.flatnonzero(size == dim)
                x, _ = matrix(column.take(pa.array(rows)))
                cells = np.floor(hashing.slots(x / np.sqrt((x * x).sum(1))[:, None]))
                keys = np.stack([hashing.keys(cells[:, t]) for t in range(tables)], 1)
                for r, k in zip(rows, keys, strict=True):
                    out[r] = k
            yield pa.array(out, pa.list_(pa.int64()))

    unique = written(unique.select("label", "rep", "w", F.col("embedding").alias("v"), buckets("embedding").alias("keys")))
    index = unique.select("label", F.size("v").alias("dim"), "rep", "w", "v", "keys", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "dim", "t", "key"]
    counts = written(index.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = counts.agg(F.sum(F.col("n") * F.ceil(F.col("n") / block))).first()[0] or 0
    tasks = max(1, -(-int(total) // rows_per_task))
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = index.join(counts.select(*bucket, parts.alias("parts")), bucket).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    dealt = dealt.select("rep", "w", "v", "keys", "t", "part", "i", "j", F.xxhash64(*bucket, "i", "j").alias("slot"))
    dealt = dealt.withColumn("cell", F.pmod("slot", F.lit(tasks)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        found = list(_compare(group, threshold))
        cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return pa.table({"rep": pa.array(cols[0], pa.int64()), "links": pa.array(cols[1], pa.int64()), "root": pa.array(cols[2], pa.int64())})

    hits = written(dealt.groupBy("cell").applyInArrow(run, "rep long, links long, root long").where("links > 0 OR rep <> root"))
    links = hits.groupBy("rep").agg(F.sum("links").alias("links"))
    group = components(hits.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    result = unique.select("label", F.col("v").alias("embedding"), "rep", "w").join(links, "rep", "left").join(group.withColumnRenamed("id", "rep"), "rep", "left")
    result = result.select("label", "embedding", "w", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("ok"))
    out = base.join(result, ["label", "embedding", "ok"], "left")
    out = out.select("vec_id", F.coalesce(F.col("links") + F.col("w") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
