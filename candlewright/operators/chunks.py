"""Time chunks: the unit of parallel work inside one series.

A series may be most of the table, so nothing here windows over a whole series.
Bars get a dense index from per-block counts, the index is cut into chunks, and the
bars just before a chunk are copied into it (its halo) so that look-back windows can
be evaluated per (series, chunk).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewright.core import KEY, timeframe_minutes

BLOCK = 256          # rows per scan block
CHUNK = 16 * BLOCK   # bars per chunk unless the look-back asks for more

CHUNK_KEY = [*KEY, "chunk"]


def index_bars(bars: DataFrame, block_bars: int = CHUNK) -> DataFrame:
    """Adds bar_idx = 0, 1, 2 … in time order per series.

    (series, ts) must be unique, so a time block holds at most `block_bars` rows. The
    only series-wide window runs over block counts, one row per `block_bars` bars.
    """
    span = timeframe_minutes(F.col("timeframe")) * 60 * block_bars
    b = bars.withColumn("_tb", F.floor(F.unix_seconds("ts") / span))
    before = Window.partitionBy(*KEY).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        b.groupBy(*KEY, "_tb").agg(F.count("*").alias("_n"))
        .select(*KEY, "_tb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    in_block = Window.partitionBy(*KEY, "_tb").orderBy("ts")
    return (
        b.join(base, [*KEY, "_tb"])
        .withColumn("bar_idx", F.col("_base") + F.row_number().over(in_block) - 1)
        .drop("_tb", "_base")
    )


def chunk_rows(halo: int, chunk: int | None = None) -> tuple[int, int]:
    """(chunk, halo) rounded to whole scan blocks; the chunk is at least four halos."""
    halo = max(1, math.ceil(halo / BLOCK)) * BLOCK
    return max(chunk or CHUNK, 4 * halo), halo


def chunk_tasks(df: DataFrame) -> int:
    """Tasks for chunk work: the session's shuffle width, which is to grow with the data.

    Stated outright because the work is heavy for its bytes, which adaptive coalescing
    would otherwise squeeze into a few tasks.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_halo(indexed: DataFrame, halo: int, chunk: int | None = None, ahead: int = 0) -> DataFrame:
    """Copies each bar into every chunk that needs it; `in_halo` marks the copies.

    A chunk receives the `halo` bars before it (plus one for lag-based scan inputs) and
    the `ahead` bars after it.
    """
    size, halo = chunk_rows(halo, chunk)
    own = F.floor(F.col("bar_idx") / size)
    first = F.greatest(F.floor((F.col("bar_idx") - ahead) / size), F.lit(0)) if ahead else own
    last = F.floor((F.col("bar_idx") + halo + 1) / size)
    return (
        indexed.withColumn("chunk", F.explode(F.sequence(first, last)))
        .withColumn("in_halo", F.col("chunk") != own)
        .repartition(chunk_tasks(indexed), *CHUNK_KEY)
    )


def own_rows(chunked: DataFrame) -> DataFrame:
    return chunked.where(~F.col("in_halo")).drop("in_halo", "chunk")


def order() -> Window:
    return Window.partitionBy(*CHUNK_KEY).orderBy("bar_idx")


def lag(c, n: int = 1) -> Column:
    return F.lag(c, n).over(order())


def rolling(fn, c, n: int) -> Column:
    """fn over the current and n-1 earlier bars; NULL until n values are present."""
    w = order().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, fn(c).over(w))


def trailing(fn, c, n: int) -> Column:
    """fn over the n bars before the current one; NULL until n values are present."""
    w = order().rowsBetween(-n, -1)
    return F.when(F.count(c).over(w) == n, fn(c).over(w))


def diff(c, n: int = 1) -> Column:
    return (F.col(c) if isinstance(c, str) else c) - lag(c, n)


# ── state carried from chunk to chunk ──────────────────────────────────────────

def chunk_states(chunked: DataFrame, effects, folds: dict, key=tuple(KEY), key_types: str = "symbol string, timeframe string") -> DataFrame:
    """State of each named machine at the start of every chunk, exactly.

    `effects(pdf)` reduces one chunk to a short list of numbers per machine; `folds`
    maps a machine to (initial state, step(state, effect)). Only the reductions, one
    row per chunk, are walked in time order per key.
    """
    key = list(key)
    schema = f"{key_types}, chunk long, " + ", ".join(f"`{n}` array<double>" for n in folds)
    head = [*key, "chunk"]

    def reduce_chunk(pdf):
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        if "in_halo" in pdf and pdf["in_halo"].all():
            return pd.DataFrame(columns=[*head, *folds])
        found = effects(pdf)
        return pd.DataFrame([[*pdf.loc[0, head], *[found[n] for n in folds]]], columns=[*head, *folds])

    def walk(pdf):
        pdf = pdf.sort_values("chunk", ignore_index=True)
        for name, (state, step) in folds.items():
            starts = []
            for chunk, effect in zip(pdf["chunk"], pdf[name]):
                starts.append(list(state))
                state = step(state, list(effect))
            pdf[name] = starts
        return pdf

    per_chunk = chunked.groupBy(*head).applyInPandas(reduce_chunk, schema)
    return per_chunk.groupBy(*key).applyInPandas(walk, schema)


# ── linear recurrences ───────────────────────────────────────────────────────


def _carry_terms(decay: float) -> int:
    """Earlier blocks that still move a double: decay**(BLOCK*terms) < 1e-20."""
    return max(1, math.ceil(46.1 / (-BLOCK * math.log(decay))))


def linear_scan(chunked: DataFrame, scans: dict[str, tuple[str, float]], halo: int, chunk: int | None = None) -> DataFrame:
    """y_i = decay * y_(i-1) + input_i for many (input, decay) pairs at once, exactly.

    Inside a block of 256 bars the zero-start solution is a running sum of
    input_k * decay**-k (largest factor 3**256, well inside a double). Block ends form
    a summary 1/256 the size of the data; the carry into a block is a Horner fold over
    the preceding ends (or a running sum when decay is 1). Carries return as one map per
    (series, chunk), so the wide frame keeps its partitioning and is not shuffled again.
    """
    size, halo = chunk_rows(halo, chunk)
    blk = F.floor(F.col("bar_idx") / BLOCK)
    pos = (F.col("bar_idx") % BLOCK).cast("double")
    run = Window.partitionBy(*CHUNK_KEY, "_blk").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)

    local = chunked.withColumn("_blk", blk).withColumn("_pos", pos).select(
        "*",
        *[
            (
                F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.pow(F.lit(d), -F.col("_pos"))).over(run) * F.pow(F.lit(d), F.col("_pos"))
                if d != 1.0 else F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(run)
            ).alias(f"_z_{out}")
            for out, (c, d) in scans.items()
        ],
    )
    zs = [f"_z_{o}" for o in scans]
    ends = (
        local.where(~F.col("in_halo")).groupBy(*KEY, "_blk")
        .agg(F.max_by(F.struct(*zs), F.col("bar_idx")).alias("_e"))
    )
    ordered = Window.partitionBy(*KEY).orderBy("_blk")
    fading = {o: d for o, (_, d) in scans.items() if d != 1.0}
    terms = max([_carry_terms(d) for d in fading.values()], default=1)
    ends = ends.withColumn("_hist", F.collect_list("_e").over(ordered.rowsBetween(-terms, -1)))

    def carry(out: str, d: float) -> Column:
        if d == 1.0:
            c = F.sum(F.col(f"_e._z_{out}")).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        else:
            step = F.lit(d ** BLOCK)
            c = F.aggregate("_hist", F.lit(0.0), lambda acc, e: acc * step + e.getField(f"_z_{out}"))
        return F.coalesce(c, F.lit(0.0)).alias(f"_c_{out}")

    carries = ends.select(*KEY, "_blk", *[carry(o, d) for o, (_, d) in scans.items()])
    first = F.floor(F.col("_blk") * BLOCK / size)
    last = F.floor((F.col("_blk") * BLOCK + BLOCK - 1 + halo + 1) / size)
    per_chunk = (
        carries.withColumn("chunk", F.explode(F.sequence(first, last)))
        .groupBy(*CHUNK_KEY)
        .agg(F.map_from_entries(F.collect_list(F.struct("_blk", F.struct(*[f"_c_{o}" for o in scans])))).alias("_carry"))
    )
    joined = local.join(per_chunk, CHUNK_KEY, "left").withColumn("_cb", F.try_element_at("_carry", "_blk"))
    keep = chunked.columns
    return joined.select(
        *keep,
        *[
            (
                F.col(f"_z_{o}")
                + F.coalesce(F.col(f"_cb._c_{o}"), F.lit(0.0)) * (F.pow(F.lit(d), F.col("_pos") + 1) if d != 1.0 else F.lit(1.0))
            ).alias(o)
            for o, (_, d) in scans.items()
        ],
    )


def running_latest(chunked: DataFrame, columns: dict[str, Column | str], strict: bool = False) -> DataFrame:
    """Latest non-NULL value of each column up to (strict: before) the current bar.

    Within a chunk this is a running max over (bar_idx, value); one row per chunk
    carries the latest value of everything earlier, so chunks stay independent.
    """
    names = list(columns)
    src = chunked.select(
        "*",
        *[F.when(F.expr(c).isNotNull() if isinstance(c, str) else c.isNotNull(), F.struct("bar_idx", (F.expr(c) if isinstance(c, str) else c).alias("v"))).alias(f"_l_{o}") for o, c in columns.items()],
    )
    per_chunk = src.where(~F.col("in_halo")).groupBy(*CHUNK_KEY).agg(*[F.max(f"_l_{o}").alias(f"_l_{o}") for o in names])
    ordered = Window.partitionBy(*KEY).orderBy("chunk")
    carries = per_chunk.select(
        *KEY, (F.col("chunk") + 1).alias("chunk"),
        F.struct(*[F.max(f"_l_{o}").over(ordered).alias(o) for o in names]).alias("_upto"),
        F.struct(*[F.max(f"_l_{o}").over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias(o) for o in names]).alias("_before"),
    )
    run = order().rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    local = src.select("*", *[F.max(f"_l_{o}").over(run).alias(f"_r_{o}") for o in names])
    carry = F.when(F.col("in_halo"), F.col("_before")).otherwise(F.col("_upto"))
    return (
        local.join(carries, CHUNK_KEY, "left")
        .withColumn("_c", carry)
        .select(*chunked.columns, *[F.greatest(f"_r_{o}", f"_c.{o}").getField("v").alias(o) for o in names])
    )
