"""Join shapes Spark has no single operator for, all reduced to equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from candlewright.core import KEY


def interval_join(points: DataFrame, spans: DataFrame, point: str, lo: str, hi: str, bucket: float, key=tuple(KEY)) -> DataFrame:
    """Rows of `points` whose `point` lies in [lo, hi] of `spans`.

    Each span is sent to the buckets it covers and meets only points of those buckets;
    the bucket is part of the join key, so a hot series spreads over its time axis.
    """
    key = list(key)
    p = points.withColumn("_bk", F.floor(F.col(point) / bucket))
    s = spans.withColumn("_bk", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    return p.join(s, [*key, "_bk"]).where((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi))).drop("_bk")


def asof_join(left: DataFrame, right: DataFrame, on: str, columns, bucket: float, strict: bool = False, key=tuple(KEY)) -> DataFrame:
    """Latest earlier `right` row for each `left` row.

    Both sides are stacked and the latest right row is carried down per (key, bucket);
    buckets pass their last right row on, one row per bucket.
    """
    key, columns = list(key), list(columns)
    r = right.select(*key, F.col(on).alias("_t"), F.struct(F.col(on).alias("_rt"), *columns).alias("_v"))
    marked = left.withColumn("_t", F.col(on)).withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType)).withColumn("_side", F.lit(0 if strict else 1))
    stacked = marked.unionByName(r.withColumn("_side", F.lit(1 if strict else 0)), allowMissingColumns=True).withColumn("_bk", F.floor(F.col("_t") / bucket))
    run = Window.partitionBy(*key, "_bk").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = r.groupBy(*key, F.floor(F.col("_t") / bucket).alias("_bk")).agg(F.max("_v").alias("_v"))
    buckets = left.select(*key, F.floor(F.col(on) / bucket).alias("_bk")).distinct().withColumn("_v", F.lit(None).cast(r.schema["_v"].dataType))
    carried = Window.partitionBy(*key).orderBy("_bk").rangeBetween(Window.unboundedPreceding, -1)
    carry = (
        buckets.unionByName(last).groupBy(*key, "_bk").agg(F.max("_v").alias("_v"))
        .withColumn("_c", F.max("_v").over(carried)).select(*key, "_bk", "_c")
    )
    is_left = F.col("_side") == (0 if strict else 1)
    out = stacked.withColumn("_h", F.last("_v", ignorenulls=True).over(run)).where(is_left)
    return out.join(carry, [*key, "_bk"], "left").withColumn("_f", F.coalesce("_h", "_c")).select(
        *left.columns, *[F.col(f"_f.{c}").alias(c) for c in columns])


def at_offsets(events: DataFrame, bars: DataFrame, offsets, columns) -> DataFrame:
    """Bars at the given offsets before each event."""
    want = events.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).withColumn("_at", F.col("bar_idx") - F.col("offset"))
    return want.join(bars.select(*KEY, F.col("bar_idx").alias("_at"), *columns), [*KEY, "_at"]).drop("_at")


def near_positions(events: DataFrame, reach: int, extra=()) -> DataFrame:
    """Positions within `reach` bars of an event, each once."""
    return events.select(*KEY, *extra, F.explode(F.sequence(F.col("bar_idx") - reach, F.col("bar_idx") + reach)).alias("bar_idx")).distinct()


def nearest(points: DataFrame, centers: DataFrame, point: str, center: str, reach: float, bucket: float, id_cols, key=tuple(KEY)) -> DataFrame:
    """The point nearest to each centre within `reach`; the earlier one on ties."""
    spans = centers.withColumn("_lo", F.col(center) - reach).withColumn("_hi", F.col(center) + reach)
    hit = interval_join(points, spans, point, "_lo", "_hi", bucket, key)
    row = F.struct(*[c for c in points.columns if c not in key])
    return hit.groupBy(*key, *id_cols, center).agg(F.min_by(row, F.struct(F.abs(F.col(point) - F.col(center)), F.col(point))).alias("_p")).select(
        *key, *id_cols, center, "_p.*")


def confirmed_elsewhere(trades: DataFrame, hours: float, who: str = "config", ts: str = "entry_ts") -> DataFrame:
    """Adds `confirmed`: another `who` has an entry within +-hours.

    Each bucket keeps only the two configs' extreme entries it needs: per bucket and
    config the entry times collapse to distinct values, and a trade asks whether any
    other config has an entry in its own or a neighbouring bucket close enough.
    """
    width = hours * 3600
    t = trades.withColumn("_s", F.unix_micros(ts) / 1e6).withColumn("_bk", F.floor(F.col("_s") / width))
    # Bucket width equals the reach, so a match lies in the same bucket or the one next to it.
    # Same bucket: any other config at all is close enough.
    per = t.groupBy("_bk", who).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    two = per.groupBy("_bk").agg(
        F.count("*").alias("_n"),
        F.max_by(who, F.struct("_hi", who)).alias("_who_hi"), F.max("_hi").alias("_top"),
        F.min_by(who, F.struct("_lo", who)).alias("_who_lo"), F.min("_lo").alias("_bot"),
    )
    rest = per.join(two, "_bk").groupBy("_bk").agg(
        F.max(F.when(F.col(who) != F.col("_who_hi"), F.col("_hi"))).alias("_top2"),
        F.min(F.when(F.col(who) != F.col("_who_lo"), F.col("_lo"))).alias("_bot2"),
    )
    edge = two.join(rest, "_bk")
    left = edge.select((F.col("_bk") + 1).alias("_bk"), F.col("_who_hi").alias("_lw"), F.col("_top").alias("_lt"), F.col("_top2").alias("_lt2"))
    right = edge.select((F.col("_bk") - 1).alias("_bk"), F.col("_who_lo").alias("_rw"), F.col("_bot").alias("_rt"), F.col("_bot2").alias("_rt2"))
    same = edge.select("_bk", "_n")
    before = F.when(F.col("_lw") != F.col(who), F.col("_lt")).otherwise(F.col("_lt2"))
    after = F.when(F.col("_rw") != F.col(who), F.col("_rt")).otherwise(F.col("_rt2"))
    ok = (F.col("_n") > 1) | (F.col("_s") - before <= width) | (after - F.col("_s") <= width)
    return (
        t.join(same, "_bk", "left").join(left, "_bk", "left").join(right, "_bk", "left")
        .withColumn("confirmed", F.coalesce(ok, F.lit(False))).select(*trades.columns, "confirmed")
    )
