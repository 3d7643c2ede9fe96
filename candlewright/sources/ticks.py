"""Candles out of ticks, and coarser candles out of finer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from candlewright.core import KEY, TIMEFRAME_MINUTES


def _bucket(ts, timeframe: str):
    secs = TIMEFRAME_MINUTES[timeframe] * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / secs) * secs)


def bars_from_ticks(df: DataFrame, symbol: str, ts: str, price, qty, timeframe: str, tie_break=()) -> DataFrame:
    """One open/high/low/close/volume row per (symbol, bucket).

    All five aggregates combine on the map side, so a symbol holding most of the
    ticks shuffles one partial row per (map task, bucket), never its ticks.
    `tie_break` orders ticks that share a timestamp.
    """
    price = F.expr(price) if isinstance(price, str) else price
    qty = F.expr(qty) if isinstance(qty, str) else qty
    ticks = df.select(
        F.col(symbol).alias("symbol"),
        F.col(ts).cast("timestamp").alias("_ts"),
        price.cast("double").alias("_p"),
        qty.cast("double").alias("_q"),
        *tie_break,
    ).where("_ts is not null and _p is not null")
    order = F.struct("_ts", *tie_break)
    return (
        ticks.groupBy("symbol", F.lit(timeframe).alias("timeframe"), _bucket(F.col("_ts"), timeframe).alias("ts"))
        .agg(
            F.min_by("_p", order).alias("open"),
            F.max("_p").alias("high"),
            F.min("_p").alias("low"),
            F.max_by("_p", order).alias("close"),
            F.sum("_q").alias("volume"),
        )
    )


def rollup_bars(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars from finer ones; the source timeframe is replaced."""
    return (
        bars.groupBy("symbol", F.lit(timeframe).alias("timeframe"), _bucket(F.col("ts"), timeframe).alias("_t"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(*KEY, F.col("_t").alias("ts"), "open", "high", "low", "close", "volume")
    )
