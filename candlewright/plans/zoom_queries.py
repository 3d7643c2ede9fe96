"""Drill-down, live views, streams and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.core import KEY
from candlewright.functions.features import compute_features
from candlewright.operators import drilldown as dd, ledger, mining, validate
from candlewright.operators.clusters import outlook, similar_events
from candlewright.operators.detect import DetectorSettings, detect_movements
from candlewright.plans import inputs, sql_study
from candlewright.plans.feature_queries import EXTRA as FEATURE_EX, SPEC, sql_value
from candlewright.plans.inputs import LEADING, STUDY
from candlewright.plans.sql_features import P, div_sign, oracle, prev, roll, z
from candlewright.sources import tables
from candlewright.sources.ticks import rollup_bars
from candlewright.streaming import live

QUERIES, ORACLES = {}, {}
c = F.col


def query(name, sql=None, extra=None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, extra)
        return fn

    return put


FOCUS = "SELECT symbol, i, ts, move_type, direction, magnitude_pct, r FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(magnitude_pct) DESC, i) AS r FROM ev) WHERE r <= 20"
# Signals plain SQL can score; the full list runs in dd03b.
SCORED = ["rsi_divergence", "macd_hist", "ema_alignment", "adx", "volume_surge", "wpi", "bear_engulf", "bull_engulf", "breakout_down_20", "breakout_up_20", "at_donchian_high", "at_donchian_low"]
FL = lambda cond: f"CASE WHEN {cond} THEN 1 ELSE 0 END"
UPC = lambda a, b: FL(f"(d.direction = 'UP' AND {a}) OR (d.direction = 'DOWN' AND {b})")
DD = {
    **FEATURE_EX, "foc": FOCUS,
    "sx": f"""SELECT symbol, i, high, low, close, a14, {div_sign('rsi_14', 5)} AS rd, macd - sig AS mh, sign(e9 - e21) + sign(e21 - e50) + sign(e50 - e200) AS al, adx, volume_ratio AS vr, wpi,
 close < open AND pc > po AND open > pc AND close < po AS be, close > open AND pc < po AND open < pc AND close > po AS bu,
 close < min(close) OVER ({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AND i >= 20 AS bd, close > max(close) OVER ({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AND i >= 20 AS bo,
 close >= {prev('hh20')} AS ah, close <= {prev('ll20')} AS al_ FROM ema""",
    "dsc": "SELECT d.symbol, d.i AS event_idx, d.direction, x.i, " + " + ".join([
        UPC("rd > 1", "rd < -1"), UPC("mh > 0", "mh < 0"), UPC("al >= 1", "al <= -1"), FL("adx > 25"), FL("vr > 2"), UPC("wpi > 0", "wpi < 0"),
        UPC("false", "be"), UPC("bu", "false"), UPC("false", "bd"), UPC("bo", "false"), UPC("ah", "false"), UPC("false", "al_")]) + " AS score FROM foc d JOIN sx x ON x.symbol = d.symbol AND x.i BETWEEN d.i - 19 AND d.i",
    "den": "SELECT symbol, event_idx, direction, CASE WHEN max(score) > 0 THEN first(i ORDER BY score DESC, i DESC) ELSE event_idx END AS entry_idx, least(max(score), 10) AS entry_confidence FROM dsc GROUP BY symbol, event_idx, direction",
    "dw": "SELECT e.symbol, e.event_idx, e.direction, e.entry_idx, x.i, x.high, x.low, x.close FROM den e JOIN sx x ON x.symbol = e.symbol AND x.i BETWEEN e.entry_idx - 50 AND e.entry_idx",
    "dp": """SELECT *, i >= entry_idx - 48 AND i <= entry_idx - 2 AND i >= (min(i) OVER (PARTITION BY symbol, event_idx)) + 2 AND low = min(low) OVER q AS pl, i >= (min(i) OVER (PARTITION BY symbol, event_idx)) + 2 AND i <= entry_idx - 2 AND high = max(high) OVER q AS ph
 FROM dw WINDOW q AS (PARTITION BY symbol, event_idx ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "dq": "SELECT symbol, event_idx, direction, entry_idx, CASE WHEN direction = 'UP' THEN max(low) FILTER (WHERE pl) ELSE min(high) FILTER (WHERE ph) END AS sw, max(high) AS hi, min(low) AS lo, last(close ORDER BY i) AS e FROM dp GROUP BY symbol, event_idx, direction, entry_idx",
    "ds": "SELECT q.*, x.a14, CASE WHEN direction = 'UP' THEN 1 ELSE -1 END AS s, e - (CASE WHEN direction = 'UP' THEN 1 ELSE -1 END) * x.a14 * 1.5 AS sa FROM dq q JOIN sx x ON x.symbol = q.symbol AND x.i = q.entry_idx",
    "dt_": "SELECT *, CASE WHEN direction = 'UP' THEN greatest(sa, sw) ELSE least(sa, sw) END AS sl FROM ds",
}
DRILL = [*SCORED, "atr_14"]


def drill_features(spark, sf):
    return inputs.once(spark, sf, "drill", lambda: inputs.features(spark, sf, DRILL))


def focus(spark, sf):
    return dd.focus_events(inputs.movements(spark, sf), 20)


def entries(spark, sf):
    return inputs.once(spark, sf, "entries", lambda: dd.best_entry(focus(spark, sf), drill_features(spark, sf), SCORED))


def setups(spark, sf):
    return inputs.once(spark, sf, "setups", lambda: dd.stops_and_targets(entries(spark, sf).drop("entry_signals"), drill_features(spark, sf)))


@query("dd01_focus_events", "SELECT symbol, i AS bar_idx, move_type, r AS focus_rank FROM foc", DD)
def _(spark, sf):
    return focus(spark, sf).select("symbol", "bar_idx", "move_type", "focus_rank")


@query("dd03_entry_score", "SELECT symbol, event_idx, score FROM dsc WHERE i = event_idx", DD)
def _(spark, sf):
    f = focus(spark, sf).select(*KEY, "bar_idx", "direction").join(drill_features(spark, sf), [*KEY, "bar_idx"])
    return dd.entry_score(f, signals=SCORED).select("symbol", c("bar_idx").alias("event_idx"), c("entry_confidence").alias("score"))


FULL_DRILL = [*dd.ENTRY_SIGNALS, "atr_14", "entropy_20", "rsi_14", "volume_ratio", "vol_declining_3", "memory_pressure"]


def full_drill(spark, sf):
    return inputs.once(spark, sf, "full_drill", lambda: inputs.features(spark, sf, FULL_DRILL))


@query("dd03b_entry_score_all_signals")
def _(spark, sf):
    return dd.entry_score(focus(spark, sf).select(*KEY, "bar_idx", "direction").join(full_drill(spark, sf), [*KEY, "bar_idx"])).select(
        "symbol", "bar_idx", "direction", "entry_confidence", F.concat_ws(",", "entry_signals").alias("entry_signals"))


@query("dd04_best_entry", "SELECT symbol, event_idx, entry_idx, entry_confidence FROM den", DD)
def _(spark, sf):
    return entries(spark, sf).select("symbol", c("bar_idx").alias("event_idx"), "entry_idx", "entry_confidence")


@query("dd05_stop_target", "SELECT symbol, event_idx, round(coalesce(sl, sa) + 1e-7, 5) AS sl_price, CASE WHEN sw IS NULL OR coalesce(sl, sa) = sa THEN 'ATR' ELSE 'Struktur' END AS sl_method, round(e + s * abs(e - coalesce(sl, sa)) * 2.5 + 1e-7, 5) AS tp2 FROM dt_", DD)
def _(spark, sf):
    return setups(spark, sf).select("symbol", c("bar_idx").alias("event_idx"), F.round(c("sl_price") + 1e-7, 5).alias("sl_price"), "sl_method", F.round(c("targets")[1].price + 1e-7, 5).alias("tp2"))


@query("dd06_pivot_stop", "SELECT symbol, event_idx, round(sw, 9) AS sl_swing FROM dt_", DD)
def _(spark, sf):
    return setups(spark, sf).select("symbol", c("bar_idx").alias("event_idx"), F.round("sl_swing", 9).alias("sl_swing"))


@query("dd07_fibonacci", "SELECT symbol, event_idx, fib, round(p, 4) AS price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, event_idx ORDER BY fib) AS k FROM (SELECT symbol, event_idx, direction, e, f.fib, CASE WHEN direction = 'UP' THEN lo + (hi - lo) * f.fib ELSE hi - (hi - lo) * f.fib END AS p FROM dt_ CROSS JOIN (VALUES (0.618::DOUBLE), (1.0), (1.272), (1.618), (2.618)) f(fib)) WHERE CASE WHEN direction = 'UP' THEN round(p, 6) > e ELSE round(p, 6) < e END) WHERE k <= 4", DD)
def _(spark, sf):
    return setups(spark, sf).select("symbol", c("bar_idx").alias("event_idx"), F.explode("fibonacci").alias("f")).select("symbol", "event_idx", "f.fib", F.round("f.price", 4).alias("price"))


@query("dd08_support_resistance")
def _(spark, sf):
    return setups(spark, sf).select("symbol", c("bar_idx").alias("event_idx"), F.posexplode("sr_levels").alias("position", "price"))


@query("dd09_precursors")
def _(spark, sf):
    f = inputs.once(spark, sf, "precursor_features", lambda: inputs.features(spark, sf, [x for x in dd.PRECURSOR_COLUMNS if x not in ("volume", "close")]))
    return dd.precursors(focus(spark, sf), f).select("symbol", "bar_idx", "direction", F.concat_ws(",", "precursors").alias("precursors"))


# Coarse events on four-hour bars, zoomed into hourly and quarter-hour bars.
ZOOM_SIGNALS = ["rsi_divergence", "volume_surge", "wpi", "bear_engulf", "bull_engulf", "breakout_down_20", "breakout_up_20", "struct_score", "at_donchian_high", "at_donchian_low"]


def zoom_levels(spark, sf):
    def build():
        hourly = inputs.event_bars(spark, sf)
        coarse = compute_features(rollup_bars(hourly, "4h"), ["rsi_14", "consec_bull", "consec_bear"], "4h")
        ev = dd.focus_events(detect_movements(coarse, DetectorSettings.for_timeframe("4h")), 10)
        fine = {"1h": compute_features(hourly, ZOOM_SIGNALS, "1h"), "15m": compute_features(inputs.event_bars(spark, sf, "15m"), ZOOM_SIGNALS, "15m")}
        return dd.zoom(ev, fine, "4h", enough=5, signals=ZOOM_SIGNALS)

    return inputs.once(spark, sf, "zoom", build)


@query("dd02_zoom")
def _(spark, sf):
    return zoom_levels(spark, sf).select("symbol", "timeframe", "event_idx", "direction", "depth", "entry_idx", "entry_confidence")


@query("va12_timeframe_timing")
def _(spark, sf):
    return validate.timeframe_timing(zoom_levels(spark, sf).select("symbol", "timeframe", "entry_confidence"))


@query("dd10_trade_setups")
def _(spark, sf):
    ev = focus(spark, sf)
    lv = entries(spark, sf).withColumn("event_idx", c("bar_idx")).withColumn("depth", F.lit(0))
    return dd.trade_setups(lv, setups(spark, sf), ev).withColumn("levels", F.to_json("levels"))


@query("d15_period_scales")
def _(spark, sf):
    """Study repeated per period scale; the scale with most stable types wins."""
    def one(mult):
        f = validate.split_time(compute_features(inputs.bars(spark, sf), [*STUDY, "consec_bull", "consec_bear"], "1d", 24.0 * mult))
        f = inputs.once(spark, sf, f"scale_f_{mult}", lambda: f)
        ev = detect_movements(f, inputs.STUDY_SETTINGS).join(f.select(*KEY, "bar_idx", "is_train"), [*KEY, "bar_idx"])
        ev = inputs.once(spark, sf, f"scale_e_{mult}", lambda: ev)
        tr, te = f.where("is_train"), ev.where("is_train")
        vec = mining.precondition_vectors(tr, te, STUDY, 5)
        bg = mining.background(tr, te, STUDY, 5)
        st = inputs.once(spark, sf, f"scale_s_{mult}", lambda: mining.welch(vec, bg, STUDY))
        v = validate.validate(f, ev, mining.rank_predictors(st), STUDY, leading=LEADING)
        return v.withColumn("scale_mult", F.lit(float(mult)))

    runs = None
    for m in (0.5, 0.75, 1.0, 1.5, 2.0):
        r = one(m)
        runs = r if runs is None else runs.unionByName(r)
    per = runs.groupBy(*KEY, "scale_mult").agg(
        F.count_if(c("label").isin("ROBUST", "STABIL") & (c("n_train") >= 20) & (c("n_test") >= 20)).alias("n_usable"),
        F.coalesce(F.max(F.when(c("label").isin("ROBUST", "STABIL"), c("precision_pct"))), F.lit(0)).alias("best_precision"))
    return per.groupBy(*KEY).agg(F.max_by(F.struct("scale_mult", "n_usable", "best_precision"), F.struct("n_usable", "best_precision", -F.abs(c("scale_mult") - 1))).alias("_b")).select(*KEY, "_b.*")


# ── live views ───────────────────────────────────────────────────────────────


@query("l06_recent_alerts", "SELECT symbol, i AS bar_idx, move_type, magnitude_pct FROM ev JOIN (SELECT symbol, max(i) AS mx FROM b0 GROUP BY ALL) q USING (symbol) WHERE i > mx - 50 AND abs(magnitude_pct) >= 10")
def _(spark, sf):
    return live.recent_alerts(inputs.study(spark, sf), 50, 10.0, inputs.STUDY_SETTINGS).select("symbol", "bar_idx", "move_type", "magnitude_pct")


@query("l07_explain")
def _(spark, sf):
    f = inputs.once(spark, sf, "cause_features", lambda: inputs.features(spark, sf, list(dict.fromkeys([*live.CAUSE_COLUMNS, *STUDY]))))
    e = live.explain(focus(spark, sf), f, inputs.predictors(spark, sf), STUDY)
    return e.select("symbol", "bar_idx", "direction", F.posexplode("causes").alias("position", "x")).select("symbol", "bar_idx", "direction", "position", "x.*")


@query("l08_outlook")
def _(spark, sf):
    v = inputs.event_vectors(spark, sf).select(*KEY, "bar_idx", "ts", "move_type", "direction", "magnitude_pct", *STUDY)
    last = v.groupBy(*KEY).agg(F.max("bar_idx").alias("bar_idx"))
    return outlook(similar_events(v.join(last, [*KEY, "bar_idx"]), v, STUDY, 10))


# Fields of a series' state that plain SQL has over one source, from the twins of their families.
STATE_FIELDS = {k: SPEC[family][1][k] for family, names in {
    "t10_bollinger": ("bb_position",), "t15_adx": ("adx",), "t14_atr_pct_z": ("atr_pct",), "v02_volume_ratio": ("volume_ratio",), "t04_ema_alignment": ("ema_alignment",),
    "t09_macd": ("macd_hist",), "t07_rsi": ("rsi_14",), "ph09_wpi": ("wpi",), "ph10_memory_pressure": ("memory_pressure",), "ph15_phase_regime": ("phase_regime",), "c01_dna_code": ("dna_code",)}.items() for k in names}


@query("l09_current_state", "SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(close, 9) AS close, " + ", ".join(STATE_FIELDS) + " FROM (SELECT symbol, i, ts, close, max(i) OVER (PARTITION BY symbol) AS last, "
       + ", ".join(sql_value(k, e, d) for k, (e, d) in STATE_FIELDS.items()) + " FROM ema) WHERE i = last", FEATURE_EX)
def _(spark, sf):
    s = live.current_state(inputs.features(spark, sf, list(STATE_FIELDS)))
    return s.select("symbol", F.unix_seconds("ts").alias("ts_s"), F.round("close", 9).alias("close"), *[c(k) if d == -99 else F.round(c(k).cast("double"), d).alias(k) for k, (_, d) in STATE_FIELDS.items()])


def tick_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def drain(spark, df, name, mode="append"):
    """Runs a stream over what is there now into a table and reads it back."""
    path, ckpt = tables.scratch_path(spark, name), tables.scratch_path(spark, f"{name}-ckpt")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("l01_stream_candles", """
SELECT symbol, ts_s, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 4) AS volume FROM (
 SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts_s, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume FROM events GROUP BY ALL)
WHERE ts_s + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)""")
def _(spark, sf):
    s = live.candles(tick_stream(spark, sf), "event_type", "ts", "value", "value", "1h", tie_break="event_id", unique=("event_id",))
    bars = drain(spark, s, "stream_candles")
    return bars.select("symbol", F.unix_seconds("ts").alias("ts_s"), *[F.round(x, 6).alias(x) for x in ("open", "high", "low", "close")], F.round("volume", 4).alias("volume"))


def polls(spark, parts, transform, name):
    """The result of a stream that meets `parts` one after the other, as files that arrive between its polls, and the late rows dropped."""
    source, sink, ckpt = (tables.scratch_path(spark, f"{name}_{x}") for x in ("in", "out", "ckpt"))
    dropped = 0
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = transform(spark.readStream.schema(part.schema).parquet(source))
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        dropped += live.dropped_rows(q)
    return spark.read.schema(stream.schema).parquet(sink), dropped


POLLS = 4


def by_quarter(spark, sf):
    """Ticks with the quarter of the whole time they fall in."""
    e = inputs.table(spark, sf, "events").withColumn("ts", c("ts").cast("timestamp"))
    t = e.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    share = (F.unix_micros("ts") - F.unix_micros("_a")) * POLLS / (F.unix_micros("_b") - F.unix_micros("_a"))
    return e.crossJoin(F.broadcast(t)).withColumn("_q", F.least(F.floor(share), F.lit(POLLS - 1))).drop("_a", "_b")


def event_candles(ticks):
    return live.candles(ticks, "event_type", "ts", "value", "value", "1h", tie_break="event_id", unique=("event_id",))


def candle_rows(bars):
    return bars.select("symbol", F.unix_seconds("ts").alias("ts_s"), *[F.round(x, 6).alias(x) for x in ("open", "high", "low", "close")], F.round("volume", 4).alias("volume"))


@query("l02_stream_dedup", ORACLES["l01_stream_candles"])
def _(spark, sf):
    """Four polls; one tick in twenty comes twice in its poll, another one in twenty again in the next poll."""
    e = by_quarter(spark, sf)
    twice = e.where("event_id % 20 = 3")
    parts = [
        e.where(c("_q") == i).unionByName(twice.where(c("_q") == i)).unionByName(e.where((c("_q") == i - 1) & (c("event_id") % 20 == 4))).drop("_q") for i in range(POLLS)]
    return candle_rows(polls(spark, parts, event_candles, "dedup")[0])


LATE = """
WITH e AS (SELECT *, least(floor((epoch_us(ts) - a) * 4.0 / (b - a)), 3) AS q FROM events, (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events)),
d AS (SELECT *, CASE WHEN event_id % 50 = 7 AND q < 2 THEN q + 2 ELSE q END AS poll FROM e),
w AS (SELECT p.p AS poll, (SELECT max(epoch_ms(ts)) - 600000 FROM d WHERE d.poll < p.p) AS mark FROM (SELECT unnest(range(0, 4)) AS p) p),
r AS (SELECT d.*, coalesce(epoch_us(ts) <= mark * 1000, false) AS late FROM d JOIN w USING (poll))
"""


def late_polls(spark, sf):
    """Four polls; one tick in fifty of the first two quarters arrives two polls later."""
    e = by_quarter(spark, sf)
    poll = F.when((c("event_id") % 50 == 7) & (c("_q") < 2), c("_q") + 2).otherwise(c("_q"))
    e = e.withColumn("_p", poll)
    return polls(spark, [e.where(c("_p") == i).drop("_q", "_p") for i in range(POLLS)], event_candles, "late")


@query("l11_late_rows", LATE + "SELECT count(*) FILTER (WHERE late) AS n_dropped FROM r")
def _(spark, sf):
    return spark.range(1).select(F.lit(late_polls(spark, sf)[1]).cast("long").alias("n_dropped"))


@query("l11b_candles_without_late_rows", LATE + """
SELECT symbol, ts_s, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 4) AS volume FROM (
 SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS ts_s, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume FROM r WHERE NOT late GROUP BY ALL)
WHERE ts_s + 3600 <= (SELECT epoch(max(ts)) - 600 FROM events)""")
def _(spark, sf):
    return candle_rows(late_polls(spark, sf)[0])


QUERIES["l03_closed_candles"], ORACLES["l03_closed_candles"] = QUERIES["l01_stream_candles"], ORACLES["l01_stream_candles"]


CARRY_FEATURES = {  # columns whose state crosses polls, windows over them, and plain windows
    "ema_200": ("e200", 4), "dist_ema_50": ("(close - e50) / (e50 + 1e-10)", 6), "macd_hist_slope": (f"(macd - sig) - lag(macd - sig) OVER ({P})", 3),
    "atr_14": ("a14", 4), "atr_z": (z("a14", 50), 6), "adx": ("adx", 6), "memory_pressure": ("mp", 6), "obv": ("obv", 2), "obv_z": (z("obv", 20), 6), "cvd": ("cvd", 2),
    "consec_bull": ("i - bb", 0), "consec_bear": ("i - sb", 0), "rsi_14": ("rsi_14", 6), "stoch_k": ("stoch_k", 6), "sma_200": (roll("avg", "close", 200), 4)}
CARRY = {"cvs": FEATURE_EX["cv"], "iso": FEATURE_EX["isl"],
         "lst": "SELECT ema.*, cvs.obv, cvs.cvd, iso.bb, iso.sb FROM ema JOIN cvs USING (symbol, i) JOIN iso USING (symbol, i)"}


def bar_polls(spark, sf, each, name):
    """Stored bars arrive in four polls by time; every bar of the last tenth of a poll comes again in the next one. `each` gets the new bars with their state."""
    b = inputs.bars(spark, sf).select(*KEY, "ts", "open", "high", "low", "close", "volume")
    t = b.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    at = F.datediff("ts", "_a") * POLLS / (F.datediff("_b", "_a") + 1)
    b = b.crossJoin(F.broadcast(t)).withColumn("_at", at).drop("_a", "_b")
    source, ckpt = (tables.scratch_path(spark, f"{name}_{x}") for x in ("in", "ckpt"))
    for i in range(POLLS):
        b.where((c("_at") >= (i - 0.1 if i else 0)) & (c("_at") < i + 1)).drop("_at").write.mode("append").parquet(source)
        stream = live.with_state(spark.readStream.schema(b.drop("_at").schema).parquet(source), "1d", STUDY, 24.0)
        stream.writeStream.foreachBatch(each).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()


@query("l04_stream_features", "SELECT symbol, i AS bar_idx, " + ", ".join(f"round(CAST({e} AS DOUBLE), {d}) AS {k}" for k, (e, d) in CARRY_FEATURES.items()) + " FROM lst", CARRY)
def _(spark, sf):
    """Features over four polls equal those of the whole table, long means and totals too."""
    path = tables.scratch_path(spark, "stream_features")

    def each(batch, batch_id):
        with live.kept(batch):
            live.batch_features(batch, list(CARRY_FEATURES), "1d", 24.0).write.mode("append").parquet(path)

    bar_polls(spark, sf, each, "features")
    return spark.read.parquet(path).select("symbol", "bar_idx", *[F.round(c(k).cast("double"), d).alias(k) for k, (_, d) in CARRY_FEATURES.items()])


@query("l05_stream_signals", "SELECT symbol, i AS bar_idx, move_type, round(score, 4) AS score FROM bs")
def _(spark, sf):
    """Bars of four polls, their live features, and the stored conditions: the signals after the split."""
    from candlewright.operators import outcomes

    out = tables.scratch_path(spark, "stream_signals")
    grid = outcomes.grid(spark, [{**inputs.BASE_PARAMS, "param_id": 0}])
    split = inputs.test_bars(spark, sf).groupBy(*KEY).agg(F.min("ts").alias("_from"))

    def each(batch, batch_id):
        with live.kept(batch):
            f = live.batch_features(batch, STUDY, "1d", 24.0).join(split, KEY).where("ts >= _from").drop("_from")
            live.live_signals(f, inputs.conditions(spark, sf), STUDY, grid).select(*KEY, "bar_idx", "move_type", "score").write.mode("append").parquet(out)

    bar_polls(spark, sf, each, "signals")
    return spark.read.parquet(out).select("symbol", "bar_idx", "move_type", F.round("score", 4).alias("score"))


@query("l10_cooldown", "SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour_no, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(spark, sf):
    s = tick_stream(spark, sf).select(c("event_type").alias("symbol"), F.lit("1h").alias("timeframe"), c("ts").cast("timestamp").alias("ts"), "event_id")
    out = drain(spark, live.cooldown(s), "cooldown")
    return out.select("symbol", F.floor(F.unix_seconds("ts") / 3600).alias("hour_no"), "event_id")


@query("l12_alert_sink", "SELECT event_type AS symbol, event_id, round(value, 6) AS value FROM events WHERE value > 50")
def _(spark, sf):
    alerts = tick_stream(spark, sf).where("value > 50").select(c("event_type").alias("symbol"), "event_id", "value")
    path = tables.scratch_path(spark, "alerts")
    live.write_alerts(alerts, path, tables.scratch_path(spark, "al-ckpt"), available_now=True).awaitTermination()
    return spark.read.schema(alerts.schema).parquet(path).select("symbol", "event_id", F.round("value", 6).alias("value"))


# ── sinks ────────────────────────────────────────────────────────────────────


@query("snk01_features", "SELECT symbol, epoch(ts)::BIGINT AS ts_s, round(rsi_14, 6) AS rsi_14 FROM sf")
def _(spark, sf):
    path = tables.scratch_path(spark, "snk01")
    tables.write_series(inputs.study(spark, sf), path)
    return spark.read.parquet(path).select("symbol", F.unix_seconds("ts").alias("ts_s"), F.round("rsi_14", 6).alias("rsi_14"))


@query("snk02_replace_movements", "SELECT symbol, i AS bar_idx, move_type FROM ev WHERE symbol <> 'A' OR move_type = 'BREAKOUT_UP'")
def _(spark, sf):
    """A second write replaces one series and leaves the others."""
    path = tables.scratch_path(spark, "snk02")
    ev = inputs.movements(spark, sf)
    tables.replace_movements(ev, path)
    tables.replace_movements(ev.where("symbol = 'A' and move_type = 'BREAKOUT_UP'"), path)
    return spark.read.parquet(path).select("symbol", "bar_idx", "move_type")


@query("snk03_upsert_predictors", "SELECT symbol, move_type, feature, CASE WHEN abs(t_statistic) >= 1.5 THEN round(t_statistic + 1, 4) ELSE t_statistic END AS t_statistic FROM pred")
def _(spark, sf):
    old = tables.scratch_path(spark, "snk03a")
    p = inputs.predictors(spark, sf)
    p.write.parquet(old)
    new = p.where(F.abs("t_statistic") >= 1.5).withColumn("t_statistic", F.round(c("t_statistic") + 1, 4))
    return tables.upsert_predictors(spark, new, old, tables.scratch_path(spark, "snk03b"), 0.0).select("symbol", "move_type", "feature", "t_statistic")


@query("snk04_attach_drill_down", "SELECT v.symbol, v.i AS bar_idx, CASE WHEN e.event_idx IS NULL THEN 0 ELSE 1 END AS n_levels FROM ev v LEFT JOIN den e ON e.symbol = v.symbol AND e.event_idx = v.i", DD)
def _(spark, sf):
    m = tables.attach_drill_down(inputs.movements(spark, sf), entries(spark, sf))
    return m.select("symbol", "bar_idx", F.coalesce(F.when(c("drill_down").isNotNull(), F.size("drill_down")), F.lit(0)).alias("n_levels"))


@query("snk05_scan_log", "SELECT symbol, count(*) AS n_movements FROM ev GROUP BY ALL")
def _(spark, sf):
    path = tables.scratch_path(spark, "snk05")
    tables.append_scan_log(inputs.movements(spark, sf), inputs.bars(spark, sf), path)
    return spark.read.parquet(path).select("symbol", "n_movements")


@query("snk06_spec_documents", "SELECT symbol, count(*) AS n_conditions FROM cond GROUP BY ALL")
def _(spark, sf):
    from candlewright.plans.study_queries import validation

    docs = tables.spec_documents(inputs.conditions(spark, sf), validation(spark, sf))
    path = tables.scratch_path(spark, "snk06")
    tables.write_documents(docs, path)
    return tables.read_documents(spark, path, docs.schema).select("symbol", F.size("entry_conditions").cast("long").alias("n_conditions"))


QUERIES["src09_load_conditions"], ORACLES["src09_load_conditions"] = QUERIES["snk06_spec_documents"], ORACLES["snk06_spec_documents"]


@query("snk07_report_rows", "SELECT symbol, 'movement' AS section, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT symbol, 'predictor', count(*) FROM pred WHERE rank <= 20 GROUP BY ALL")
def _(spark, sf):
    return tables.report_rows(inputs.movements(spark, sf), inputs.predictors(spark, sf)).groupBy("symbol", "section").agg(F.count("*").alias("n"))


@query("snk08_add_configs", "SELECT symbol, CASE WHEN symbol = 'A' THEN 50.0 ELSE 100.0 END AS start_capital FROM (SELECT DISTINCT symbol FROM bars)")
def _(spark, sf):
    series = inputs.bars(spark, sf).select(*KEY).distinct()
    known = series.where("symbol = 'A'").withColumn("start_capital", F.lit(50.0))
    return tables.add_configs(known, series.withColumn("start_capital", F.lit(100.0))).select("symbol", "start_capital")


@query("src10_load_configs", "SELECT symbol, 100.0 AS start_capital FROM (SELECT DISTINCT symbol FROM bars)")
def _(spark, sf):
    path = tables.scratch_path(spark, "src10")
    conf = inputs.bars(spark, sf).select(*KEY).distinct().withColumn("start_capital", F.lit(100.0))
    tables.write_documents(conf, path)
    return tables.read_documents(spark, path, conf.schema).select("symbol", "start_capital")


@query("snk09_trade_ledger", "SELECT symbol, entry_idx, pnl FROM tr")
def _(spark, sf):
    path = tables.scratch_path(spark, "snk09")
    t = ledger.equity(inputs.base_trades(spark, sf))
    tables.write_ledger(t, path, "csv")
    return spark.read.schema(t.schema).option("header", True).csv(path).select("symbol", "entry_idx", "pnl")
