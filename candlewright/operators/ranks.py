"""Positions and exact quantiles of groups of any size, without a window over a whole group.

A group is cut into ordered blocks. Windows run inside blocks; what passes from block to block is a
count, one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewright.sources.tables import written

c = F.col
BINS = 4096


def _before(keys: list[str], block: str) -> Window:
    return Window.partitionBy(*keys or [F.lit(0)]).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def positions(df: DataFrame, keys, block: Column, order) -> DataFrame:
    """Adds pos, the row's place from 0 in its group, and _n, the group's rows. `block` ascends with the order."""
    keys = list(keys)
    t = df.withColumn("_pb", block)
    counts = t.groupBy(*keys, "_pb").agg(F.count("*").alias("_c"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_c").over(_before(keys, "_pb")), F.lit(0)))
    base = base.withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys or [F.lit(0)]))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*keys, "_pb").orderBy(*order))
    return t.withColumn("_in", inside).join(base, [*keys, "_pb"]).withColumn("pos", c("_base") + c("_in") - 1).drop("_pb", "_in", "_base")


def ranged_positions(df: DataFrame, keys, order) -> DataFrame:
    """`positions` in any order: the rows are dealt by ranges of (keys, order) and written with the range's number."""
    keys = list(keys)
    t = df.repartitionByRange(*keys, *order)
    t = written(t.withColumn("_range", F.spark_partition_id()), "ranged")
    return positions(t, keys, c("_range"), order).drop("_range")


def exact_quantiles(df: DataFrame, keys, quantiles: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """One row per group with the exact (interpolated) quantile of each column: {name: (column, share)}.

    A wanted rank is searched in the range of its values: rows are counted in BINS equal
    bins, the bin that holds the rank becomes the next range, with the least and the
    greatest value found in it as its bounds, until these are equal. Counts are summed
    in tasks first, and a group never holds more than BINS rows, whatever repeats in it.
    NULL and NaN do not count; a group without values gets NULL.
    """
    keys = list(keys)
    named = [F.struct(F.lit(n).alias("q"), (F.col(x) if isinstance(x, str) else x).cast("double").alias("v")) for n, (x, _) in quantiles.items()]
    values = df.select(*keys, F.explode(F.array(*named)).alias("s")).select(*keys, "s.q", "s.v").where(c("v").isNotNull() & ~F.isnan("v"))
    values = written(values, "quantiles")
    share = F.element_at(F.create_map(*[F.lit(x) for n, (_, p) in quantiles.items() for x in (n, float(p))]), c("q"))
    at = share * (c("n") - 1)
    target = values.groupBy(*keys, "q").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("side"), F.least(F.floor(at) + 1, c("n") - 1).alias("rank")))
    target = target.withColumn("s", F.explode(sides)).select(*keys, "q", "s.side", "s.rank", (at - F.floor(at)).alias("part"), "lo", "hi")
    group = [*keys, "q", "side"]
    while True:
        target = written(target, "quantile_ranges")
        if target.where("lo < hi").isEmpty():
            break
        open_ = target.where("lo < hi").select(*[c(x).alias(x) for x in target.columns])
        inside = values.join(open_, [*keys, "q"]).where(c("v").between(c("lo"), c("hi")))
        # Bins are equal in value where the range spans less than a factor of two, else equal in size on a log scale.
        scale = lambda x: F.signum(x) * (F.log2(F.abs(x)) + 1080)
        u = lambda x: F.when(c(x) == 0, 0.0).otherwise(scale(c(x)))
        narrow = (F.signum("lo") == F.signum("hi")) & (F.greatest(F.abs("lo"), F.abs("hi")) <= 2 * F.least(F.abs("lo"), F.abs("hi")))
        infinite = (F.abs("lo") == float("inf")) | (F.abs("hi") == float("inf"))
        share_of = F.when(infinite, F.when(c("v") == c("lo"), 0.0).when(c("v") == c("hi"), 1.0).otherwise(0.5)).when(narrow, (c("v") - c("lo")) / (c("hi") - c("lo"))).otherwise((u("v") - u("lo")) / (u("hi") - u("lo")))
        bins = inside.withColumn("bin", F.least(F.floor(share_of * BINS), F.lit(BINS - 1)))
        bins = bins.groupBy(*group, "bin").agg(F.count("*").alias("c"), F.min("v").alias("b_lo"), F.max("v").alias("b_hi"), F.first("rank").alias("rank"), F.first("part").alias("part"))
        bins = bins.withColumn("under", F.coalesce(F.sum("c").over(_before(group, "bin")), F.lit(0)))
        found = bins.where((c("under") <= c("rank")) & (c("rank") < c("under") + c("c")))
        target = target.where("lo = hi").unionByName(found.select(*group, (c("rank") - c("under")).alias("rank"), "part", c("b_lo").alias("lo"), c("b_hi").alias("hi")))
    value = lambda n, s: F.max(F.when((c("q") == n) & (c("side") == s), c("lo")))
    part = lambda n: F.max(F.when(c("q") == n, c("part")))
    found = target.groupBy(*keys).agg(*[F.when(part(n) == 0, value(n, 0)).otherwise(value(n, 0) + (value(n, 1) - value(n, 0)) * part(n)).alias(n) for n in quantiles])
    groups = df.select(*keys).distinct()
    return groups.join(found, keys, "left") if keys else found
