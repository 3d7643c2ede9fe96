"""Bar tables: reading, cleaning, recent slices, windows around events, gap checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from candlewright.core import BAR_SCHEMA, KEY, ratio, timeframe_minutes
from candlewright.operators.ranks import exact_quantiles
from candlewright.sources.tables import written


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Parquet laid out by timeframe/symbol; filters on either prune directories."""
    return spark.read.schema(BAR_SCHEMA).parquet(path)


def from_epoch_ms(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis(F.col(column)))


def normalize_bars(bars: DataFrame, start=None, end=None, keep: str = "first", order_col: str = "arrival") -> DataFrame:
    """Range filter and one row per (series, ts); `order_col` says which copy came first.

    The duplicate group is (series, ts), so no series is ever gathered: the choice is
    a min_by/max_by that combines on the map side.
    """
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    pick = F.min_by if keep == "first" else F.max_by
    body = F.struct("open", "high", "low", "close", "volume")
    return bars.groupBy(*KEY, "ts").agg(pick(body, F.col(order_col)).alias("_b")).select(*KEY, "ts", "_b.*")


def recent_bars(bars: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """The newest `n` bars of each series after leaving out the newest `skip`.

    A bar can only be among the newest n if fewer than n bars of its own time block
    are newer, so rows are cut per block first and only n rows per block go on.
    """
    block = F.floor(F.unix_seconds("ts") / (timeframe_minutes(F.col("timeframe")) * 60 * 4096))
    in_block = Window.partitionBy(*KEY, "_blk").orderBy(F.desc("ts"))
    overall = Window.partitionBy(*KEY).orderBy(F.desc("ts"))
    newest_blocks = Window.partitionBy(*KEY).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    b = bars.withColumn("_blk", block)
    need = (
        b.groupBy(*KEY, "_blk").agg(F.count("*").alias("_n"))
        .withColumn("_newer", F.coalesce(F.sum("_n").over(newest_blocks), F.lit(0)))
        .where(F.col("_newer") < n + skip)
        .select(*KEY, "_blk")
    )
    return (
        b.join(need, [*KEY, "_blk"], "left_semi")
        .withColumn("_r", F.row_number().over(in_block)).where(F.col("_r") <= n + skip)
        .withColumn("recency", F.row_number().over(overall))
        .where((F.col("recency") > skip) & (F.col("recency") <= n + skip))
        .drop("_blk", "_r")
    )


def drop_open_bar(indexed: DataFrame) -> DataFrame:
    """Leaves out the newest bar of every series (it may still be forming)."""
    last = indexed.groupBy(*KEY).agg(F.max("ts").alias("ts"))
    return indexed.join(last, [*KEY, "ts"], "left_anti")


def long_enough(bars: DataFrame, min_bars: int) -> DataFrame:
    """Only series with at least `min_bars` bars; the count is a partial aggregate."""
    keep = bars.groupBy(*KEY).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_bars).select(*KEY)
    return bars.join(keep, KEY, "left_semi")


def gap_report(bars: DataFrame) -> DataFrame:
    """Median and largest distance between neighbouring bars against the bar length."""
    minutes = timeframe_minutes(F.col("timeframe"))
    span = minutes * 60 * 4096
    block = F.floor(F.unix_seconds("ts") / span)
    # Gaps inside a time block come from lag there; the gap into the next block is
    # taken between the block's edges, so no window holds a whole series.
    w = Window.partitionBy(*KEY, "_blk").orderBy("ts")
    b = bars.select(*KEY, "ts").withColumn("_blk", block)
    inner = b.withColumn("_p", F.lag("ts").over(w)).where("_p is not null").select(
        *KEY, ((F.unix_micros("ts") - F.unix_micros("_p")) / 6e7).alias("gap_min")
    )
    edges = b.groupBy(*KEY, "_blk").agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    prev_hi = F.lag("_hi").over(Window.partitionBy(*KEY).orderBy("_blk"))
    outer = edges.withColumn("_p", prev_hi).where("_p is not null").select(
        *KEY, ((F.unix_micros("_lo") - F.unix_micros("_p")) / 6e7).alias("gap_min")
    )
    gaps = inner.unionByName(outer)
    rated = ratio(F.col("max_gap_min"), F.col("expected_min"))
    gaps = written(gaps, "gaps")
    median = exact_quantiles(gaps, KEY, {"median_gap_min": ("gap_min", 0.5)})
    return (
        gaps.groupBy(*KEY)
        .agg(F.count("*").alias("n_gaps"), F.max("gap_min").alias("max_gap_min"))
        .join(median, KEY)
        .withColumn("expected_min", minutes.cast("double"))
        .withColumn("gap_ratio", rated)
        .withColumn("verdict", F.when(F.col("gap_ratio") > 10, "warning").when(F.col("gap_ratio") > 2, "note").otherwise("ok"))
    )
