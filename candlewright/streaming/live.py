"""Live mode: candles, features, signals and alerts on Structured Streaming."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from candlewright.core import KEY, TIMEFRAME_MINUTES, period_scale
from candlewright.functions.features import compute_features
from candlewright.operators import outcomes
from candlewright.operators.detect import DetectorSettings, detect_movements
from candlewright.sources.bars import recent_bars
from candlewright.streaming.recurrent import carried_columns, with_state

c = F.col


def candles(ticks: DataFrame, symbol: str, ts: str, price: str, qty: str, timeframe: str, delay: str = "10 minutes", tie_break: str | None = None, unique=()) -> DataFrame:
    """Closed candles from a tick stream.

    Append mode releases a bucket once the watermark has passed its end, which is the
    closed-candles-only rule; rows later than the watermark are dropped and counted by
    the query's progress. `unique` columns drop repeated deliveries within the delay.
    """
    t = ticks.select(
        c(symbol).alias("symbol"), c(ts).cast("timestamp").alias("_ts"), F.expr(price).cast("double").alias("_p"), F.expr(qty).cast("double").alias("_q"),
        *([c(tie_break)] if tie_break else []), *[u for u in unique if u != tie_break]).withWatermark("_ts", delay)
    if unique:
        t = t.dropDuplicatesWithinWatermark(list(unique))
    order = F.struct("_ts", *([tie_break] if tie_break else []))
    minutes = TIMEFRAME_MINUTES[timeframe]
    return (
        t.groupBy("symbol", F.window("_ts", f"{minutes} minutes"))
        .agg(F.min_by("_p", order).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", order).alias("close"), F.sum("_q").alias("volume"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), c("window.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def dropped_rows(query) -> int:
    """Rows that a stream's stateful steps have dropped as later than the watermark, from the progress it keeps.

    The first such step of `candles` drops ticks one by one where `unique` is given, so
    the count is one of ticks.
    """
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


class DroppedRows(StreamingQueryListener):
    """Appends (query, batch_id, dropped) to a table for every micro-batch that drops late rows."""

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        n = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        if n:
            row = [(str(p.id), int(p.batchId), int(n))]
            self.spark.createDataFrame(row, "query string, batch_id long, dropped long").write.mode("append").parquet(self.path)


def batch_features(history: DataFrame, names, timeframe: str, scale_multiplier: float = 1.0) -> DataFrame:
    """Features of the new bars in a micro-batch of `with_state`, by the same code as in batch mode.

    Columns that state carries are taken as they are. The columns that fold other state
    (supertrend, order-block zones, latest pivots, level distances) see the ring only.
    """
    known = carried_columns(period_scale(timeframe, scale_multiplier))
    f = compute_features(history.drop("is_new", "as_of"), names, timeframe, scale_multiplier, known=known)
    return f.join(history.where("is_new").select(*KEY, "bar_idx"), [*KEY, "bar_idx"], "left_semi")


@contextmanager
def kept(batch: DataFrame):
    """A micro-batch that is read several times: its stateful operator runs once."""
    batch.persist()
    try:
        yield batch
    finally:
        batch.unpersist()


def live_signals(features: DataFrame, conditions: DataFrame, names, params: DataFrame) -> DataFrame:
    """Best signal per new bar: a stream-static join with the stored conditions."""
    ladders = outcomes.signal_ladders(features, conditions, names)
    return outcomes.add_levels(outcomes.best_signals(ladders, params))


def start_signals(bars: DataFrame, conditions: DataFrame, names, params: DataFrame, timeframe: str, sink: str, checkpoint: str, scale_multiplier: float = 1.0):
    """Running query: new candles -> features -> signals -> an append-only table.

    A batch id column makes replays after a failure recognisable. `bars` holds one timeframe.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        with kept(batch):
            f = batch_features(batch, names, timeframe, scale_multiplier)
            live_signals(f, conditions, names, params).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink)

    return with_state(bars, timeframe, names, scale_multiplier).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").start()


def write_alerts(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Alert stream into a Parquet table; any notifier can follow it. `available_now`: one poll of what is there."""
    out = alerts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


# ── views of the latest bars ─────────────────────────────────────────────────


def recent_alerts(features: DataFrame, last: int = 5, min_move_pct: float = 1.0, settings: DetectorSettings | None = None) -> DataFrame:
    """Movements on the last few bars of each series that are large enough."""
    ev = detect_movements(features, settings)
    end = features.groupBy(*KEY).agg(F.max("bar_idx").alias("_n"))
    return ev.join(end, KEY).where((c("bar_idx") > c("_n") - last) & (F.abs("magnitude_pct") >= min_move_pct)).drop("_n")


# Columns of the state of a series, and those that causes are read from.
SNAPSHOT = (
    "regime", "trend_score", "momentum_score", "move_readiness", "rsi_14", "adx", "entropy_20", "hurst_60",
    "atr_pct", "volume_ratio", "ema_alignment", "supertrend_dir", "macd_hist", "bb_position", "wpi",
    "memory_pressure", "phase_regime", "dna_code",
)


def current_state(features: DataFrame, fields=SNAPSHOT) -> DataFrame:
    have = [f for f in fields if f in features.columns]
    row = F.struct("ts", "close", *have)
    return features.groupBy(*KEY).agg(F.max_by(row, "ts").alias("_r")).select(*KEY, "_r.*")


def cooldown(signals: DataFrame) -> DataFrame:
    """At most one signal per series and candle; state clears when the candle ends."""
    secs = {k: v * 60 for k, v in TIMEFRAME_MINUTES.items()}
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in signals.schema]

    def update(key, batches, state):
        until = state.get[0] if state.exists else -1
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("ts", ignore_index=True)
        step = secs.get(key[1], 3600)
        keep = []
        for i, t in enumerate(pd.to_datetime(pdf["ts"])):
            t = int(t.timestamp())
            if t >= until:
                keep.append(i)
                until = (t // step + 1) * step
        state.update((int(until),))
        yield pdf.iloc[keep]

    return signals.groupBy(*KEY).applyInPandasWithState(update, ", ".join(fields), "until long", "append", GroupStateTimeout.NoTimeout)


CAUSE_COLUMNS = (
    "entropy_20", "hurst_60", "rsi_divergence", "rsi_14", "ema_alignment", "volume_ratio", "vol_declining_3",
    "cvd_divergence", "kc_squeeze", "memory_pressure", "breakout_down_20", "breakout_up_20", "bear_engulf",
    "bull_engulf",
)


def explain(events: DataFrame, features: DataFrame, predictors: DataFrame | None = None, names=(), top: int = 10) -> DataFrame:
    """Ranked causes for each movement: fixed rules, then known predictors off their mean."""
    from candlewright.operators.drilldown import look_back

    ev = events.select(*KEY, "bar_idx", "direction")
    df = look_back(ev, features, "bar_idx", range(1, 11), CAUSE_COLUMNS)
    now = features.select(*KEY, "bar_idx", *[c(n).cast("double").alias(f"n_{n}") for n in dict.fromkeys([*CAUSE_COLUMNS, *names])])
    mean = features.groupBy(*KEY).agg(F.avg("entropy_20").alias("_em"))
    df = df.join(now, [*KEY, "bar_idx"]).join(mean, KEY)
    vals = lambda n: F.filter(F.transform("win", lambda b: b.getField(n).cast("double")), lambda v: v.isNotNull())
    first, last = (lambda x: F.try_element_at(x, F.lit(1))), (lambda x: F.try_element_at(x, F.lit(-1)))
    up, n = c("direction") == "UP", lambda x: c(f"n_{x}")
    ent, h = vals("entropy_20"), last(vals("hurst_60"))
    al0 = F.coalesce(first(vals("ema_alignment")), n("ema_alignment"))
    sq = F.aggregate(vals("kc_squeeze"), F.lit(0.0), lambda a, x: a + x)

    def cause(cond: Column, priority: int, category: str, feature: str, value: Column, baseline=0.0) -> Column:
        b = baseline if isinstance(baseline, Column) else F.lit(float(baseline))
        return F.when(cond, F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category"), F.lit(feature).alias("feature"), F.round(value.cast("double"), 4).alias("value"), F.round(b, 4).alias("baseline")))

    high_entropy = (F.size(ent) >= 3) & (last(ent) > c("_em") * 1.15)
    flipped = n("ema_alignment") != al0
    rules = [
        cause(high_entropy, 1, "entropy", "entropy_20", last(ent), c("_em")),
        cause(~high_entropy & (F.size(ent) >= 3) & (last(ent) - first(ent) < -0.1), 2, "entropy squeeze", "entropy_20", last(ent), c("_em")),
        cause(h < 0.42, 1, "regime", "hurst_60", h, 0.5), cause(h > 0.58, 2, "regime", "hurst_60", h, 0.5),
        cause(F.when(up, n("rsi_divergence") > 1).otherwise(n("rsi_divergence") < -1), 1, "rsi divergence", "rsi_divergence", n("rsi_divergence")),
        cause((n("rsi_14") > 75) & ~up, 2, "overbought", "rsi_14", n("rsi_14"), 50.0), cause((n("rsi_14") < 25) & up, 2, "oversold", "rsi_14", n("rsi_14"), 50.0),
        cause(flipped, 2, "ema structure", "ema_alignment", n("ema_alignment")),
        cause(~flipped & ~up & (n("ema_alignment") <= -2), 3, "ema structure", "ema_alignment", n("ema_alignment")),
        cause(n("volume_ratio") > 2.5, 1, "volume", "volume_ratio", n("volume_ratio"), 1.0),
        cause(last(vals("vol_declining_3")) > 0, 2, "volume", "vol_declining_3", F.lit(1.0)),
        cause(F.when(up, n("cvd_divergence") > 1).otherwise(n("cvd_divergence") < -1), 1, "order flow", "cvd_divergence", n("cvd_divergence")),
        cause(sq >= 2, 1, "squeeze", "kc_squeeze", sq),
        cause(F.when(up, n("memory_pressure") > 0.3).otherwise(n("memory_pressure") < -0.3), 2, "wick pressure", "memory_pressure", n("memory_pressure")),
        cause(n("breakout_down_20") > 0, 1, "structure break", "breakout_down_20", F.lit(1.0)), cause(n("breakout_up_20") > 0, 1, "structure break", "breakout_up_20", F.lit(1.0)),
        cause(n("bear_engulf") > 0, 2, "candle pattern", "bear_engulf", F.lit(1.0)), cause(n("bull_engulf") > 0, 2, "candle pattern", "bull_engulf", F.lit(1.0)),
    ]
    df = df.withColumn("_rules", F.array_compact(F.array(*rules)))
    if predictors is None:
        return df.select(*KEY, "bar_idx", "direction", F.slice(F.array_sort("_rules"), 1, top).alias("causes"))
    # strongest record per (series, direction, feature); a few hundred rows per series
    side = F.when(c("move_type").contains("UP"), "UP").otherwise("DOWN").alias("direction")
    known = predictors.where(F.abs("t_statistic") >= 2).select(*KEY, side, "feature", "t_statistic", "mean_all", "std_all")
    known = known.groupBy(*KEY, "direction", "feature").agg(F.max_by(F.struct("mean_all", "std_all"), F.abs("t_statistic")).alias("p"))
    packed = known.groupBy(*KEY, "direction").agg(F.collect_list(F.struct("feature", "p")).alias("_known"))
    values = F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.array(*[n(x) for x in names]))
    df = df.withColumn("_vals", values).join(packed, [*KEY, "direction"], "left")
    told = F.transform("_rules", lambda r: r.feature)
    off = F.filter(F.coalesce("_known", F.array().cast(packed.schema["_known"].dataType)), lambda k: (F.abs(F.try_element_at(c("_vals"), k.feature) - k.p.mean_all) > k.p.std_all * 0.5) & ~F.array_contains(told, k.feature))
    extra = F.transform(off, lambda k: F.struct(F.lit(3).alias("priority"), F.lit("known pattern").alias("category"), k.feature.alias("feature"), F.round(F.try_element_at(c("_vals"), k.feature), 4).alias("value"), F.round(k.p.mean_all, 4).alias("baseline")))
    return df.select(*KEY, "bar_idx", "direction", F.slice(F.concat(F.array_sort("_rules"), F.array_sort(extra)), 1, top).alias("causes"))


def latest(bars: DataFrame, n: int = 250) -> DataFrame:
    """The newest n closed bars per series, for a one-off scan outside a stream."""
    return recent_bars(bars, n, skip=1)
