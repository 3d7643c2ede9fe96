"""Sources, filters, row expressions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.core import KEY, TIMEFRAME_MINUTES, timeframe_minutes
from candlewright.operators import analyses, chunks, joins, mining, reports, validate
from candlewright.plans import inputs, sql_study  # noqa: F401  (registers the study tables)
from candlewright.plans.sql_features import oracle
from candlewright.sources import bars as bar_ops
from candlewright.sources.ticks import rollup_bars

QUERIES, ORACLES = {}, {}
c = F.col


def query(name, sql=None, extra=None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, extra)
        return fn

    return put


EVENT_BARS = """SELECT event_type AS symbol, '{tf}' AS timeframe, to_timestamp(floor(epoch(ts) / {s}) * {s})::TIMESTAMP AS ts,
 first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume
FROM events GROUP BY ALL"""
ORDER_BARS = """SELECT o_orderpriority AS symbol, '1d' AS timeframe, o_orderdate AS ts, first(o_totalprice ORDER BY o_orderkey) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM orders GROUP BY ALL"""
EX = {
    "eb": EVENT_BARS.format(tf="1h", s=3600), "eb4": EVENT_BARS.format(tf="4h", s=14400), "ob": ORDER_BARS,
    "ebi": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM eb",
}
OHLCV = "symbol, timeframe, epoch(ts)::BIGINT AS ts_s, round(open, 9) AS open, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, round(volume, 4) AS volume"


def ohlcv(df, *more):
    return df.select(*KEY, F.unix_seconds("ts").alias("ts_s"), *[F.round(x, 9).alias(x) for x in ("open", "high", "low", "close")], F.round("volume", 4).alias("volume"), *more)


@query("src01_read_bars", f"SELECT {OHLCV} FROM eb", EX)
def _(spark, sf):
    """Bars written by timeframe and symbol and read back with the fixed schema."""
    from candlewright.sources import tables

    path = tables.scratch_path(spark, "bars")
    tables.write_series(inputs.event_bars(spark, sf), path)
    return ohlcv(bar_ops.read_bars(spark, path))


@query("src02_normalize_bars", """
SELECT symbol, timeframe, epoch(ts)::BIGINT AS ts_s, first(close ORDER BY arrival) AS close FROM (
  SELECT event_type AS symbol, '1m' AS timeframe, date_trunc('hour', ts) AS ts, value AS close, event_id AS arrival FROM events WHERE date_trunc('hour', ts) <= TIMESTAMP '2024-01-20')
GROUP BY ALL""")
def _(spark, sf):
    raw = inputs.table(spark, sf, "events").select(
        c("event_type").alias("symbol"), F.lit("1m").alias("timeframe"), F.date_trunc("hour", c("ts").cast("timestamp")).alias("ts"),
        *[c("value").alias(x) for x in ("open", "high", "low", "close", "volume")], c("event_id").alias("arrival"))
    return bar_ops.normalize_bars(raw, end="2024-01-20").select(*KEY, F.unix_seconds("ts").alias("ts_s"), "close")


@query("src03_recent_bars", """
SELECT symbol, timeframe, epoch(ts)::BIGINT AS ts_s, round(close, 6) AS close, recency FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS recency FROM eb) WHERE recency <= 250""", EX)
def _(spark, sf):
    return bar_ops.recent_bars(inputs.event_bars(spark, sf), 250).select(*KEY, F.unix_seconds("ts").alias("ts_s"), F.round("close", 6).alias("close"), c("recency").cast("long").alias("recency"))


@query("src05_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 * 1000 AS ts_us FROM events")
def _(spark, sf):
    ms = inputs.table(spark, sf, "events").select("event_id", F.unix_millis(c("ts").cast("timestamp")).alias("ms"))
    return bar_ops.from_epoch_ms(ms, "ms").select("event_id", F.unix_micros("ts").alias("ts_us"))


@query("src06_bars_from_ticks", f"SELECT {OHLCV} FROM bars")
def _(spark, sf):
    return ohlcv(inputs.line_bars(spark, sf))


@query("src06b_event_bars_hourly", f"SELECT {OHLCV} FROM eb", EX)
def _(spark, sf):
    return ohlcv(inputs.event_bars(spark, sf))


@query("src06c_order_bars", f"SELECT {OHLCV} FROM ob", EX)
def _(spark, sf):
    return ohlcv(inputs.order_bars(spark, sf))


@query("src07_rollup_bars", f"SELECT {OHLCV} FROM eb4", EX)
def _(spark, sf):
    return ohlcv(rollup_bars(inputs.event_bars(spark, sf), "4h"))


@query("src08_gap_report", """
SELECT symbol, timeframe, count(*) AS n_gaps, round(median(g), 4) AS median_gap_min, round(max(g), 4) AS max_gap_min, round(max(g) / 60, 4) AS gap_ratio,
 CASE WHEN max(g) / 60 > 10 THEN 'warning' WHEN max(g) / 60 > 2 THEN 'note' ELSE 'ok' END AS verdict
FROM (SELECT *, (epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 60 AS g FROM eb) WHERE g IS NOT NULL GROUP BY ALL""", EX)
def _(spark, sf):
    r = bar_ops.gap_report(inputs.event_bars(spark, sf))
    return r.select(*KEY, "n_gaps", *[F.round(x, 4).alias(x) for x in ("median_gap_min", "max_gap_min", "gap_ratio")], "verdict")


@query("fp01_min_candles", f"SELECT {OHLCV} FROM eb WHERE symbol IN (SELECT symbol FROM eb GROUP BY symbol HAVING count(*) >= 670)", EX)
def _(spark, sf):
    return ohlcv(bar_ops.long_enough(inputs.event_bars(spark, sf), 670))


@query("fp02_numeric_projection", """
SELECT symbol, i AS bar_idx, feature, round(value, 6) AS value FROM (
 SELECT symbol, i, 'body_ratio' AS feature, body / (rng + 1e-10) AS value FROM l3 UNION ALL
 SELECT symbol, i, 'stoch_k', stoch_k FROM l3 UNION ALL SELECT symbol, i, 'candle_dir', CAST(sign(close - open) AS DOUBLE) FROM l3) WHERE value IS NOT NULL""")
def _(spark, sf):
    f = inputs.features(spark, sf, ["body_ratio", "stoch_k", "candle_dir"])
    return mining.unpivot(f, ["symbol", "bar_idx"], ["body_ratio", "stoch_k", "candle_dir"]).withColumn("value", F.round("value", 6))


@query("fp09_custom_range", """
SELECT symbol, timeframe, count(*) AS n_bars, count(*) FILTER (WHERE i < floor(n * 0.7::DOUBLE)) AS n_before_split, round(count(*) FILTER (WHERE i < floor(n * 0.7::DOUBLE)) * 100.0 / count(*), 1) AS pct_before_split
FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM b0) WHERE ts >= TIMESTAMP '1999-01-01' AND ts < TIMESTAMP '2001-01-01' + INTERVAL 1 DAY GROUP BY ALL""")
def _(spark, sf):
    b = validate.split_time(inputs.bars(spark, sf))
    r = b.where((c("ts") >= F.lit("1999-01-01").cast("timestamp")) & (c("ts") < F.lit("2001-01-02").cast("timestamp")))
    return r.groupBy(*KEY).agg(F.count("*").alias("n_bars"), F.count_if("is_train").alias("n_before_split")).withColumn("pct_before_split", F.round(c("n_before_split") * 100.0 / c("n_bars"), 1))


@query("fp10_drop_open_bar", f"SELECT {OHLCV} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM eb) WHERE r > 1", EX)
def _(spark, sf):
    return ohlcv(bar_ops.drop_open_bar(inputs.event_bars(spark, sf)))


@query("r09_symbol_names", "SELECT DISTINCT split_part(event_type || '/USDT:USDT', '/', 1) AS coin, replace(replace(event_type || '/USDT:USDT', '/', '_'), ':', '_') AS file_key FROM events")
def _(spark, sf):
    s = inputs.table(spark, sf, "events").select(F.concat("event_type", F.lit("/USDT:USDT")).alias("s")).distinct()
    return s.select(F.get(F.split("s", "/"), F.lit(0)).alias("coin"), F.translate("s", "/:", "__").alias("file_key"))


@query("r10_timeframe_minutes", "SELECT tf, n, CASE tf " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TIMEFRAME_MINUTES.items()) + " ELSE 60 END AS minutes FROM (SELECT CASE user_id % 5 WHEN 0 THEN '1m' WHEN 1 THEN '4h' WHEN 2 THEN '1w' WHEN 3 THEN '3d' ELSE 'xx' END AS tf, count(*) AS n FROM events GROUP BY ALL)")
def _(spark, sf):
    m = c("user_id") % 5
    tf = F.when(m == 0, "1m").when(m == 1, "4h").when(m == 2, "1w").when(m == 3, "3d").otherwise("xx")
    return inputs.table(spark, sf, "events").groupBy(tf.alias("tf")).agg(F.count("*").alias("n")).withColumn("minutes", timeframe_minutes(c("tf")))


@query("r11_session", "SELECT session, count(*) AS n FROM (SELECT CASE WHEN hour(ts) < 8 THEN 'Asien' WHEN hour(ts) < 16 THEN 'Europa' ELSE 'US' END AS session FROM events) GROUP BY ALL")
def _(spark, sf):
    return inputs.table(spark, sf, "events").groupBy(analyses.session_of(c("ts")).alias("session")).agg(F.count("*").alias("n"))


@query("r12_format_threshold", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN v >= 1000 THEN printf('%.0f', v) WHEN v >= 10 THEN printf('%.2f', v) ELSE printf('%.4f', v) END AS text FROM (SELECT *, l_extendedprice / l_quantity / 3.14159 AS v FROM lineitem)")
def _(spark, sf):
    v = c("l_extendedprice") / c("l_quantity") / 3.14159
    return inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", reports.format_threshold(v).alias("text"))


@query("r14_json_context", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    e = inputs.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", F.from_json(F.to_json("p"), "k bigint").k.alias("k"))


@query("r15_feature_family", "SELECT symbol, move_type, feature, CASE WHEN feature IN ('rsi_14', 'stoch_k', 'roc_5') THEN 'MOMENTUM' WHEN feature = 'volume_ratio' THEN 'ORDERFLOW' WHEN feature IN ('bb_position', 'donchian_pos') THEN 'BREAKOUT' END AS family FROM pred")
def _(spark, sf):
    return inputs.predictors(spark, sf).select("symbol", "move_type", "feature", validate.feature_family(c("feature")).alias("family"))


@query("jn02_asof", """
SELECT e.event_id, b.close, epoch(b.ts)::BIGINT AS bar_s FROM (SELECT * FROM events) e ASOF LEFT JOIN eb b ON e.event_type = b.symbol AND e.ts > b.ts + INTERVAL 1 HOUR""", EX)
def _(spark, sf):
    b = inputs.event_bars(spark, sf).withColumn("t", F.unix_micros("ts") + 3600 * 1000000)
    e = inputs.table(spark, sf, "events").select(c("event_type").alias("symbol"), F.lit("1h").alias("timeframe"), "event_id", F.unix_micros(c("ts").cast("timestamp")).alias("t"))
    j = joins.asof_join(e, b.withColumn("bar_s", F.unix_seconds("ts")), "t", ["close", "bar_s"], 86400e6, strict=True)
    return j.select("event_id", "close", "bar_s")


@query("jn03_interval_window", """
SELECT v.symbol, v.i AS event_idx, count(*) AS n_bars, round(max(b.high), 6) AS hi FROM ev v JOIN b0 e ON e.symbol = v.symbol AND e.i = v.i
JOIN b0 b ON b.symbol = v.symbol AND b.ts BETWEEN e.ts - INTERVAL 60 DAY AND e.ts + INTERVAL 20 DAY GROUP BY ALL""")
def _(spark, sf):
    ev = inputs.movements(spark, sf).select(*KEY, c("bar_idx").alias("event_idx"), (F.unix_seconds("ts") - 60 * 86400).alias("lo"), (F.unix_seconds("ts") + 20 * 86400).alias("hi_s"))
    b = inputs.bars(spark, sf).withColumn("s", F.unix_seconds("ts"))
    j = joins.interval_join(b, ev, "s", "lo", "hi_s", 80 * 86400)
    return j.groupBy("symbol", "event_idx").agg(F.count("*").alias("n_bars"), F.round(F.max("high"), 6).alias("hi"))


QUERIES["src04_window_around_event"], ORACLES["src04_window_around_event"] = QUERIES["jn03_interval_window"], ORACLES.get("jn03_interval_window")


@query("jn04_offsets", "SELECT v.symbol, v.i AS event_idx, k.o AS bar_offset, round(b.close, 9) AS close FROM ev v CROSS JOIN (VALUES (1), (2), (3), (4), (5)) k(o) JOIN b0 b ON b.symbol = v.symbol AND b.i = v.i - k.o")
def _(spark, sf):
    ev = inputs.movements(spark, sf).select(*KEY, "bar_idx")
    return joins.at_offsets(ev, inputs.bars(spark, sf), range(1, 6), ["close"]).select("symbol", c("bar_idx").alias("event_idx"), c("offset").alias("bar_offset"), F.round("close", 9).alias("close"))


@query("jn05_range_anti", "SELECT b.symbol, count(*) AS n, sum(b.i) AS sum_idx FROM b0 b WHERE NOT EXISTS (SELECT 1 FROM ev v WHERE v.symbol = b.symbol AND v.move_type = 'BREAKOUT_UP' AND abs(v.i - b.i) <= 7) GROUP BY ALL")
def _(spark, sf):
    near = joins.near_positions(inputs.movements(spark, sf).where("move_type = 'BREAKOUT_UP'"), 7)
    return inputs.bars(spark, sf).join(near, [*KEY, "bar_idx"], "left_anti").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("bar_idx").alias("sum_idx"))


@query("jn06_range_semi", "SELECT b.symbol, count(*) AS n, sum(b.i) AS sum_idx FROM b0 b WHERE EXISTS (SELECT 1 FROM ev v WHERE v.symbol = b.symbol AND v.i BETWEEN b.i + 1 AND b.i + 2) GROUP BY ALL")
def _(spark, sf):
    ahead = inputs.movements(spark, sf).select(*KEY, F.explode(F.sequence(c("bar_idx") - 2, c("bar_idx") - 1)).alias("bar_idx")).distinct()
    return inputs.bars(spark, sf).join(ahead, [*KEY, "bar_idx"], "left_semi").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("bar_idx").alias("sum_idx"))


@query("jn11_nearest_row", """
SELECT symbol, event_idx, epoch(ts)::BIGINT AS bar_s, round(close, 9) AS close FROM (
 SELECT v.symbol, v.i AS event_idx, o.ts, o.close, row_number() OVER (PARTITION BY v.symbol, v.i ORDER BY abs(epoch(o.ts) - epoch(e.ts) - 43200), o.ts) AS r
 FROM ev v JOIN b0 e ON e.symbol = v.symbol AND e.i = v.i JOIN b0 o ON o.symbol = v.symbol AND abs(epoch(o.ts) - epoch(e.ts) - 43200) <= 259200) WHERE r = 1""")
def _(spark, sf):
    pts = inputs.bars(spark, sf).select(*KEY, F.unix_seconds("ts").alias("bar_s"), "close")
    ctr = inputs.movements(spark, sf).select(*KEY, c("bar_idx").alias("event_idx"), (F.unix_seconds("ts") + 43200).alias("t"))
    return joins.nearest(pts, ctr, "bar_s", "t", 259200, 6 * 86400, ["event_idx"]).select("symbol", "event_idx", "bar_s", F.round("close", 9).alias("close"))


@query("jn10_feature_pairs", """
SELECT a.symbol, a.move_type, count(*) AS n, round(corr(a.v, b.v), 5) AS r FROM (SELECT symbol, i, move_type, value AS v FROM pre WHERE feature = 'rsi_14') a
JOIN (SELECT symbol, i, move_type, value AS v FROM pre WHERE feature = 'stoch_k') b USING (symbol, i, move_type) GROUP BY ALL""")
def _(spark, sf):
    r = mining.correlations(inputs.event_vectors(spark, sf), ["rsi_14", "stoch_k"])
    return r.select("symbol", "move_type", "n", F.round("r", 5).alias("r"))


@query("jn10b_all_feature_pairs")
def _(spark, sf):
    return mining.correlations(inputs.event_vectors(spark, sf), inputs.STUDY)


@query("ps21_robust_ranges", """
SELECT symbol, round(lo - (hi - lo) * 0.05, 3) AS price_lo, round(hi + (hi - lo) * 0.05, 3) AS price_hi, round(v, 4) AS volume_p99 FROM (
 SELECT symbol, quantile_cont(low, 0.005) AS lo, quantile_cont(high, 0.995) AS hi, quantile_cont(volume, 0.99) AS v FROM bars GROUP BY ALL)""")
def _(spark, sf):
    return reports.robust_ranges(inputs.bars(spark, sf)).select("symbol", F.round("price_lo", 3).alias("price_lo"), F.round("price_hi", 3).alias("price_hi"), F.round("volume_p99", 4).alias("volume_p99"))


@query("ps22_parse_level", """
SELECT event_id, nullif(regexp_extract(s, '([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*([0-9.]+)\\s*$', 1), '') AS name, CAST(nullif(regexp_extract(s, '([A-Za-z_][A-Za-z0-9_]*)\\s*=\\s*([0-9.]+)\\s*$', 2), '') AS DOUBLE) AS value
FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'config sl_pct' ELSE 'below swing_low=' || CAST(user_id AS VARCHAR) || '.25' END AS s FROM events)""")
def _(spark, sf):
    s = F.when(c("user_id") % 3 == 0, "config sl_pct").otherwise(F.concat(F.lit("below swing_low="), c("user_id").cast("string"), F.lit(".25")))
    return inputs.table(spark, sf, "events").select("event_id", reports.parse_level(s).alias("p")).select("event_id", c("p.name").alias("name"), c("p.value").alias("value"))
