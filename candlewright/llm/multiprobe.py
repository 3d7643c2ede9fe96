"""Nearest neighbours by multiprobe p-stable hashing and exact distance reranking.

The index holds every vector once in each table. A query visits buckets in falling order of the
estimated probability that a neighbour at its own distance lies in them, until their total reaches
what its tables together need for the target success; candidates of all tables are merged and
reranked by exact Euclidean distance.

The near radius sets the bucket width and the least distance probed for: it is the median distance to
the k-th neighbour of at most `RADIUS_ROWS` different vectors of a bounded sample (`fit_rows`), measured
against all rows. A query's own distance is that of its k-th neighbour among a hashed share of the rows
(first round); it is at least the true one, so a radius that does not fit costs time and not neighbours.
It also bounds the candidates: rows beyond it are never handed on.

Probes are not listed, as their number grows with a power of the rows. A query carries one number per
table, the probability of the last bucket it visits (`cuts`), and a bucket sees by its own
probability whether it is visited. Rows lie in cells of neighbouring buckets (ranges of the bucket
coordinates; a bucket with too many rows is cut by a hash of the row), and a query goes to the cells
that can hold a bucket it visits. A cell keeps its rows sorted by bucket, takes its queries a batch
at a time and scores blocks of rows by one product in single precision, whose margin loses no
neighbour; what passes is scored exactly. So a task holds one cell and one batch,
and hands on at most k rows per query and cell. More than k + 1 equal vectors of a cell count as k + 1.
A query left with fewer than k candidates in the first round, or whose buckets bring as many rows as
the table has, by an estimate from the sample, visits every bucket of the first table and is exact.

Cases: vectors that are null, zero, of a length other than the table's commonest, or with null or non-finite
components take no part, neither as query nor as candidate. Rows that repeat a vec_id are one vector
(the smallest embedding counts). Ties go to the smaller vec_id. With fewer than k other vectors all
are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.llm import words as W
from candlewright.llm.common import written
from candlewright.llm.pstable import PStable, cuts, log_chances, matrix, reach_of


#: Sampled vectors whose k-th neighbour is measured.
RADIUS_ROWS = 128
#: A query's own distance comes from one row in so many.
FIRST_SHARE = 32
#: A query is exact where its neighbours spread over more widths, or its buckets over the tables hold this share of the
#: rows: blocks of BLOCK rows bring along 1.6 to 1.8 times the rows of the buckets visited (simulated, 14.8 million rows).
FAR_SPREAD, FAR_SHARE = 4.0, 0.5
#: Bytes of the vectors of a cell, at most; queries answered at once, rows scored by one product, blocks whose
#: probabilities are summed at once; rows that give a query without a bound its first.
CELL_BYTES, BATCH, BLOCK, BLOCKS, SEED_ROWS = 32 << 20, 4096, 128, 512, 512
#: Pairs scored exactly at a time, and pairs that wait until the bounds are tightened.
PAIRS, WAIT = 1 << 14, 1 << 17
#: Sampled vectors by which a query's share of the rows is estimated, and sampled rows per cell.
SHARE_ROWS, CELL_SAMPLE = 256, 128
#: Bucket coordinates beyond count as this one in keys; components beyond are multiplied in double precision.
EDGE, BIG = 1 << 30, 1e15
FOUND = "query_id long, vec_id long, score double"


def near_radius(base: DataFrame, sample: np.ndarray, k: int) -> float:
    """Median distance of the sample's different vectors to their k-th nearest in base (v); copies count once."""
    _, first = np.unique(sample, axis=0, return_index=True)
    own = sample[np.sort(first)[:RADIUS_ROWS]]
    if not len(own):
        return 1.0
    dim = own.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(own), 0))
        for batch in batches:
            x, ok = matrix(batch.column(0), dim)
            for lo in range(0, len(x), 4096):
                y = x[lo : lo + 4096][ok[lo : lo + 4096]]
                d2 = np.maximum((own * own).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * own @ y.T, 0)
                best = np.concatenate([best, d2], 1)
                best = np.partition(best, k, 1)[:, : k + 1] if best.shape[1] > k + 1 else best  # itself and k others
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(own)), pa.int64()), "d2": pa.array(list(best), pa.list_(pa.float64()))})

    parts = base.select("v").mapInArrow(nearest, "i long, d2 array<double>")
    kth = parts.groupBy("i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("d2"))), 1, k + 1).alias("d2"))
    far = np.sqrt([r.d2 for r in kth.select(F.element_at("d2", -1).alias("d2")).collect()])
    far = far[far > 1e-6 * np.sqrt((own * own).sum(1).max())]  # below is rounding: k copies
    return float(np.median(far)) if len(far) else 1.0


def bucket_keys(coords: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bytes that sort as the bucket's coordinates, then as a hash of the row."""
    salt = W.mix(ids.astype(np.int64).view(np.uint64)).astype(">u8").view(np.uint8).reshape(-1, 8)
    places = (np.clip(coords, -EDGE, EDGE).astype(np.int64) + EDGE).astype(">u4")
    places = np.ascontiguousarray(places).view(np.uint8).reshape(len(coords), -1)
    return np.ascontiguousarray(np.concatenate([places, salt], 1)).view(f"S{places.shape[1] + 8}").ravel()


def cell_boxes(bounds: np.ndarray, projections: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinates (cells x projections) between neighbouring bounds: equal ones up to the first that differs."""
    lo, hi = np.full((len(bounds) + 1, projections), -np.inf), np.full((len(bounds) + 1, projections), np.inf)
    width = 4 * projections
    ends = [np.frombuffer(b.ljust(width + 8, b"\0")[:width], ">u4").astype(np.int64) - EDGE for b in bounds.tolist()]
    for i in range(len(bounds) + 1):
        for j in range(projections):
            first, last = (ends[i - 1][j] if i else -EDGE), (ends[i][j] if i < len(bounds) else EDGE)
            lo[i, j], hi[i, j] = (first if first > -EDGE else -np.inf), (last if last < EDGE else np.inf)
            if first != last:
                break
    return lo, hi


def native(column: pa.Array, dim: int) -> np.ndarray:
    """Usable vectors as they are stored, rows x dim."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Cell:
    """Rows of one cell, sorted by bucket, against batches of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, hashing: PStable, t: int, k: int):
        self.hashing, self.t, self.k, dim = hashing, t, k, x.shape[1]
        pieces = [slice(lo, lo + (1 << 14)) for lo in range(0, len(x), 1 << 14)]
        coords = np.concatenate([np.floor(hashing.slots(x[p].astype(float))[:, t]) for p in pieces])
        odd = W.mix(np.arange(x.itemsize // 4 * dim, dtype=np.uint64)) | np.uint64(1)
        marks = np.concatenate([(np.ascontiguousarray(x[p]).view(np.uint32).astype(np.uint64) * odd).sum(1) for p in pieces])
        order = np.lexsort((ids, marks, *coords.T[::-1]))
        same = np.concatenate([[False], *(((x[order[p]][1:] == x[order[p]][:-1]).all(1)) for p in (slice(lo, lo + (1 << 14) + 1) for lo in range(0, len(x), 1 << 14)))])[: len(x)]
        place = np.arange(len(x))
        order = order[place - np.maximum.accumulate(np.where(same, 0, place)) <= k]  # a query and k others of one vector are enough
        del marks, same, place
        self.ids, self.x, coords = ids[order], x[order], coords[order]
        self.half = np.concatenate([(self.x[p].astype(float) ** 2).sum(1) / 2 for p in pieces])
        self.narrow = bool(np.abs(self.x).max() < BIG)
        self.starts = np.arange(0, len(order), BLOCK)
        self.lo, self.hi = np.minimum.reduceat(coords, self.starts, 0), np.maximum.reduceat(coords, self.starts, 0)

    def wide(self, lo: int, hi: int, kind: type) -> np.ndarray:
        """Rows with two more columns, so that a product is at least 0 where a pair may be within the query's bound."""
        out = np.empty((hi - lo, self.x.shape[1] + 2), kind)
        out[:, :-2], out[:, -2], out[:, -1] = self.x[lo:hi], self.half[lo:hi] * (1 - margin(kind, self.x.shape[1])), 1
        return out

    def visits(self, q: np.ndarray, spread: np.ndarray, cut: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Blocks x queries: whether the block may hold a bucket that the query visits."""
        slots = self.hashing.slots(q)[:, self.t]
        home = np.floor(slots)
        far = reach_of(spread)
        logs = log_chances(slots - home, spread, far)
        total = np.zeros((len(lo), len(q)), np.float32)
        for j in range(self.hashing.projections):
            boxes, own = np.unique(np.stack([lo[:, j], hi[:, j]], 1), axis=0, return_inverse=True)
            off = np.maximum(boxes[:, :1] - home[:, j], 0) + np.minimum(boxes[:, 1:] - home[:, j], 0)
            off = np.clip(off, -far, far).astype(np.int64) + far
            total += np.take_along_axis(logs[:, j].T, off, 0)[own.ravel()]
        return total >= cut

    def answer(self, me: np.ndarray, q: np.ndarray, bound: np.ndarray, cut: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The query, vec_id and distance of the k nearest of each query within its bound."""
        kind = np.float32 if self.narrow and np.abs(q).max() < BIG else np.float64
        bound, q, dim = bound.copy(), q.astype(float), self.x.shape[1]
        slack, tiny = margin(kind, dim), 1e-37 if kind == np.float32 else 0.0
        norm = (q * q).sum(1)
        probe = np.empty((len(q), dim + 2), kind)
        probe[:, :-2], probe[:, -2] = q, -1
        limit = lambda: np.divide(bound * bound * (1 + 1e-6) - norm * (1 - slack), 2) + tiny
        free = np.isinf(bound)
        if kind == np.float32 and len(self.ids) > self.k and free.any():
            # The k + 1 nearest of some rows hold k others; their distances are known up to the margin.
            probe[:, -1] = 0
            some = np.unique(np.linspace(0, len(self.ids) - 1, max(SEED_ROWS, 8 * self.k)).astype(int))
            near = probe[free] @ np.concatenate([self.wide(i, i + 1, kind) for i in some]).T
            if len(some) > self.k + 1:
                near = np.partition(near, len(some) - self.k - 1, 1)[:, -self.k - 1 :]
            bound[free] = np.sqrt(np.maximum(norm[free] - 2.0 * near.min(1), 0) + slack * (norm[free] + 6 * self.half[some].max()) + 2 * tiny)
        with np.errstate(over="ignore", invalid="ignore"):
            probe[:, -1] = limit()
        held: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, row, distance
        waits: list = []

        def settle() -> None:
            at, row = (np.concatenate(x) for x in zip(*waits, strict=True))
            waits.clear()
            other = self.ids[row] != me[at]
            at, row = at[other], row[other]
            d = np.concatenate([np.zeros(0), *(np.sqrt(((self.x[row[i : i + PAIRS]].astype(float) - q[at[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(at), PAIRS))])
            near = d <= bound[at]
            at, row, d = (np.concatenate([a, b[near]]) for a, b in zip(held, (at, row, d), strict=True))
            order = np.lexsort((self.ids[row], d, at))
            at, row, d = at[order], row[order], d[order]
            place = np.arange(len(at))
            place -= np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]][: len(at)], place, 0)) if len(at) else 0
            last = place == self.k - 1
            bound[at[last]] = d[last]
            held[:] = (a[place < self.k] for a in (at, row, d))
            with np.errstate(over="ignore", invalid="ignore"):
                probe[:, -1] = limit()

        everywhere = bool(np.isneginf(cut).all())
        for first in range(0, len(self.starts), BLOCKS):
            some = slice(first, first + BLOCKS)
            mask = None if everywhere else self.visits(q, spread, cut, self.lo[some], self.hi[some])
            for b, lo in enumerate(self.starts[some]):
                at = np.arange(len(q)) if mask is None else np.flatnonzero(mask[b])
                if not len(at):
                    continue
                hi = min(lo + BLOCK, len(self.ids))
                rows = self.wide(lo, hi, kind)
                with np.errstate(over="ignore", invalid="ignore"):
                    near = ((probe if len(at) == len(q) else probe[at]) @ rows.T).ravel()
                    hit = np.flatnonzero(near >= 0 if kind == np.float32 else ~(near < 0))  # what overflows is scored
                if len(hit):
                    waits.append((at[hit // (hi - lo)], lo + hit % (hi - lo)))
                    if sum(len(x) for x, _ in waits) >= WAIT:
                        settle()
        if waits:
            settle()
        at, row, d = held
        return me[at], self.ids[row], d


def margin(kind: type, dim: int) -> float:
    """More than the relative error of a product of dim terms."""
    return (dim + 16) * float(np.finfo(kind).eps)


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, tables: int = 2, target: float = 0.96, fit_rows: int = 2000, rows_per_bucket: int = 64,
    block: int = 4096, rows_per_cell: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id and score (distance) for the rows of vectors (vec_id, embedding) that is_query selects."""
    v = F.col("embedding")
    if vectors.select(v).schema[0].dataType.simpleString() not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    base = vectors.where("vec_id IS NOT NULL").select("vec_id", v.alias("v"))
    if not base.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        base = written(base.groupBy("vec_id").agg(F.min("v").alias("v")))
    base = base.withColumn("asks", is_query)
    # Only usable vectors are sampled and counted, and all tasks go by one length.
    finite = F.forall("v", lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False)))
    usable = (F.size("v") > 0) & finite & F.exists("v", lambda e: e != 0)
    sizes = base.where(usable).groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("asks"))
    sizes = sizes.orderBy(F.desc("n"), "dim").first()
    dim, rows, asking = (sizes.dim, sizes.n, sizes.asks) if sizes else (0, 0, 0)
    ours = usable & (F.size("v") == dim)
    chosen = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // (8 * fit_rows)))) == 0).where(ours)
    sample, good = matrix(chosen.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").toArrow()["v"], dim)
    sample = sample[good]
    radius = near_radius(base, sample, k)
    hashing = PStable(tables, max(1, min(12, ceil(log2(max(rows / rows_per_bucket, 2)) / 2.05))), radius)
    each = 1 - (1 - target) ** (1 / tables)

    # Cells grow with the queries, so that those sent to all cells are about as many as the rows; small tables have 16 a table.
    kind = base.schema["v"].dataType.simpleString()
    largest = max(BLOCK, CELL_BYTES // ((4 if kind == "array<float>" else 8) * max(dim, 1)))
    per_cell = min(largest, max(block // 8, min(rows // 16, max(rows_per_cell, 2 * asking)), 1))
    cells = max(1, -(-rows // per_cell))
    some = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // (CELL_SAMPLE * cells)))) == 0).where(ours).select("vec_id", "v").toArrow()
    some_ids, (places, _) = some["vec_id"].to_numpy(), matrix(some["v"], dim)
    places = np.floor(hashing.slots(places))
    ends = np.linspace(0, len(some_ids), cells + 1)[1:-1].astype(int)
    bounds = [np.unique(np.sort(bucket_keys(places[:, t], some_ids))[ends]) if len(some_ids) else np.zeros(0, "S8") for t in range(tables)]
    boxes = [cell_boxes(b, hashing.projections) for b in bounds]
    share = np.floor(hashing.slots(sample[:SHARE_ROWS])) if len(sample) else np.zeros((0, tables, hashing.projections))

    @F.arrow_udf("array<int>")
    def cells_of(ids: pa.Array, v: pa.Array) -> pa.Array:
        x, ok = matrix(v, dim)
        out = np.zeros((len(x), tables), np.int32)
        if ok.any():
            places = np.floor(hashing.slots(x))
            own = ids.to_numpy(zero_copy_only=False)
            for t in range(tables):
                out[:, t] = t * cells + np.searchsorted(bounds[t], bucket_keys(places[:, t], own), "right")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tables * len(x) + 1, tables), pa.int32()), pa.array(out.ravel()))
        return pc.if_else(pa.array(ok), lists, pa.scalar(None, lists.type))

    def spreads(reach: np.ndarray) -> np.ndarray:
        """Widths by which neighbours at the distance spread; vectors at no distance share all buckets."""
        return np.where(reach > 0, np.clip(reach / radius, 1.0, FAR_SPREAD), 1 / 64)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that a query goes to, and for each table the log probability of the last bucket it visits."""
        for batch in batches:
            reach = batch.column("reach").to_numpy(zero_copy_only=False)
            slots, spread = hashing.slots(matrix(batch.column("v"), dim)[0]), spreads(reach)
            limits, goes = np.full((len(reach), tables), -np.inf), np.zeros((len(reach), tables * cells), bool)
            for lo in range(0, len(reach), 64):
                part = slice(lo, lo + 64)
                held = np.zeros(len(reach[part]))
                for t in range(tables):
                    home = np.floor(slots[part, t])
                    far = reach_of(spread[part])
                    logs = log_chances(slots[part, t] - home, spread[part], far)

                    def best(low: np.ndarray, high: np.ndarray) -> np.ndarray:
                        off = np.clip(np.maximum(low[None] - home[:, None], 0) + np.minimum(high[None] - home[:, None], 0), -far, far).astype(np.int64) + far  # noqa: B023
                        return sum(np.take_along_axis(logs[:, j], off[:, :, j], 1) for j in range(hashing.projections))  # noqa: B023

                    limits[part, t] = cuts(slots[part, t] - home, spread[part], logs, each)
                    held += (best(share[:, t], share[:, t]) >= limits[part, t][:, None]).mean(1) if len(share) else 1.0
                    goes[part, t * cells : t * cells + len(boxes[t][0])] = best(*boxes[t]) >= limits[part, t][:, None]
                every = (held >= FAR_SHARE) | ~(reach[part] <= FAR_SPREAD * radius)
                limits[part][every] = -np.inf
                goes[part][every] = np.arange(tables * cells) < len(boxes[0][0])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(goes.sum(1))], pa.int32()), pa.array(np.nonzero(goes)[1], pa.int32()))
            limits = pa.ListArray.from_arrays(pa.array(np.arange(0, limits.size + 1, tables), pa.int32()), pa.array(limits.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "v", "reach")), lists, limits], ["id", "v", "reach", "cells", "limits"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a cell (kind 0) come before its queries."""
        ids, parts, cell = [], [], None
        for batch in batches:
            kind, t = batch.column("kind").to_numpy(), batch.column("cell")[0].as_py() // cells
            own, v = batch.column("id").to_numpy(), native(batch.column("v"), dim)
            if (kind == 0).any():
                if cell is not None or (np.diff(kind) < 0).any():
                    raise ValueError("rows of a cell must come before its queries")
                ids.append(own[kind == 0])
                parts.append(v[kind == 0])
            if (kind == 1).any() and ids:
                if cell is None:
                    x = np.concatenate(parts)
                    parts.clear()
                    cell = Cell(np.concatenate(ids), x, hashing, t, k)
                    del x
                reach, cut = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("reach", "cut"))
                for at in np.array_split(np.flatnonzero(kind == 1), -(-int(kind.sum()) // BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cell.answer(own[at], v[at], reach[at], cut[at], spreads(reach[at]))], ["query_id", "vec_id", "score"])

    def nearest(index: DataFrame, asked: DataFrame) -> DataFrame:
        """index (id, v, cell), asked (id, v, cell, reach, cut): the k nearest of each query in each cell."""
        index = index.select("cell", F.lit(0).alias("kind"), "id", "v", F.lit(0.0).alias("reach"), F.lit(0.0).alias("cut"))
        both = index.unionByName(asked.select("cell", F.lit(1).alias("kind"), "id", "v", "reach", "cut"))
        return both.repartition("cell").sortWithinPartitions("cell", "kind", "cut").groupBy("cell").applyInArrow(scored, FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        """Once, though several tables found it."""
        found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)

    queries = base.where("asks").where(ours).select(F.col("vec_id").alias("id"), "v")
    part = max(1, min(FIRST_SHARE, rows // (16 * k)))
    pieces = max(1, min(16, rows // part // BLOCK), -(-rows // part // largest))
    first = base.where(F.pmod(F.xxhash64("vec_id", F.lit(part)), F.lit(part)) == 0).where(ours)
    first = first.select(F.col("vec_id").alias("id"), "v", F.pmod(F.hash("vec_id"), F.lit(pieces)).alias("cell"))
    everyone = queries.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("cell"), F.lit(float("inf")).alias("reach"), F.lit(float("-inf")).alias("cut"))
    found = written(ranked(nearest(first, everyone)).select("query_id", "vec_id", "score"))
    held = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("reach")).where(F.col("n") >= k)
    # A query with fewer has no distance to go by; it is exact.
    held = queries.join(held, queries.id == held.query_id, "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    asked = held.mapInArrow(probes, f"id long, v {kind}, reach double, cells array<int>, limits array<double>")
    asked = asked.select("id", "v", "reach", F.explode("cells").alias("cell"), "limits")
    asked = asked.withColumn("cut", F.element_at("limits", (F.floor(F.col("cell") / cells) + 1).cast("int")))
    index = base.select(F.col("vec_id").alias("id"), "v", F.explode(cells_of("vec_id", "v")).alias("cell"))
    return ranked(nearest(index, asked).unionByName(found)).select("query_id", "rank", "vec_id", "score")
