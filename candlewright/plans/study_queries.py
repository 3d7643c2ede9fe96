"""Detection, mining, statistics, validation and condition building."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewright.core import KEY
from candlewright.operators import clusters, mining, reports, validate
from candlewright.operators.detect import (
    ATR_LADDER, DetectorSettings, calibrate_min_move, detect_movements, direction_of, impulse_ladder, most_specific, rule_matches, target_events_per_year,
)
from candlewright.plans import inputs, sql_study
from candlewright.functions.features import ALL_FEATURES
from candlewright.plans.inputs import LEADING, STUDY, STUDY_SETTINGS
from candlewright.plans.sql_features import P, oracle, z
from candlewright.plans.sql_study import SIDE, type_case

QUERIES, ORACLES = {}, {}
c = F.col
TK = ["symbol", "move_type"]


def query(name, sql=None, extra=None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, extra)
        return fn

    return put


EVENT_COLS = "symbol, i AS bar_idx, move_type, direction, magnitude_pct, atr_multiple"


@query("flagship_breakouts_and_reversals", """
SELECT symbol, move_type, count(*) AS n_events, round(avg(abs(magnitude_pct)), 4) AS avg_magnitude FROM ev WHERE move_type IN ('BREAKOUT_UP', 'BREAKDOWN', 'REVERSAL_UP', 'REVERSAL_DOWN') GROUP BY ALL""")
def _(spark, sf):
    ev = inputs.movements(spark, sf).where(c("move_type").isin("BREAKOUT_UP", "BREAKDOWN", "REVERSAL_UP", "REVERSAL_DOWN"))
    return ev.groupBy(*TK).agg(F.count("*").alias("n_events"), F.round(F.avg(F.abs("magnitude_pct")), 4).alias("avg_magnitude"))


@query("d07_detect", f"SELECT {EVENT_COLS} FROM ev")
def _(spark, sf):
    return inputs.movements(spark, sf).select("symbol", "bar_idx", "move_type", "direction", "magnitude_pct", "atr_multiple")


# The same bars with every input the detector can use, on the exact ATR.
FULL = ["atr_14", "atr_z", "energy_z", "consec_bull", "consec_bear", "rsi_14", "adx", "volume_ratio", "atr_pct"]
FULL_SETTINGS = DetectorSettings(atr_impulse=3.0, breakout_bars=20, reversal_min_run=3, squeeze_atr_z=-0.5, gap_pct=0.5)
FULL_EX = {
    "dz": f"SELECT symbol, i, a14, energy, {z('a14', 50)} AS az, {z('energy', 50)} AS ez, rsi_14 AS rsi, adx AS adx_, volume_ratio AS vr, a14 / (close + 1e-10) AS ap FROM ema",
    "dz1": f"SELECT *, lag(az, 3) OVER ({P}) AS az3 FROM dz",
    "df": "SELECT dt.* EXCLUDE (atr0), dz1.a14 AS atr0, az, az3, ez, rsi, adx_, vr, ap FROM dt JOIN dz1 USING (symbol, i)",
    "fev0": "SELECT *, " + type_case("3.0", 0.5, 3, "WHEN az3 < -0.5 AND az > 0.5 AND mv > 0.003 THEN 'SQUEEZE_RELEASE_UP' WHEN az3 < -0.5 AND az > 0.5 AND mv < -0.003 THEN 'SQUEEZE_RELEASE_DOWN' WHEN ez > 3 AND mv > 0.01 THEN 'ACCELERATION_UP' WHEN ez > 3 AND mv < -0.01 THEN 'ACCELERATION_DOWN'") + " AS move_type FROM df WHERE i >= 50",
    "fev": f"SELECT *, {SIDE} AS direction, round(mv * 100, 4) AS magnitude_pct, round(rng / (atr0 + 1e-10), 2) AS atr_multiple FROM fev0 WHERE move_type IS NOT NULL",
}


def full(spark, sf):
    return inputs.once(spark, sf, "full", lambda: inputs.features(spark, sf, FULL))


def full_events(spark, sf):
    return inputs.once(spark, sf, "full_events", lambda: detect_movements(full(spark, sf), FULL_SETTINGS, context=True))


for _n, _types in {
    "d01_impulse": ("IMPULSE_UP", "IMPULSE_DOWN"), "d02_breakout": ("BREAKOUT_UP", "BREAKDOWN"), "d03_reversal": ("REVERSAL_UP", "REVERSAL_DOWN"),
    "d04_squeeze_release": ("SQUEEZE_RELEASE_UP", "SQUEEZE_RELEASE_DOWN"), "d05_acceleration": ("ACCELERATION_UP", "ACCELERATION_DOWN"), "d06_gap": ("GAP_UP", "GAP_DOWN"),
}.items():
    @query(_n, f"SELECT {EVENT_COLS} FROM fev WHERE move_type IN {_types}", FULL_EX)
    def _(spark, sf, types=_types):
        return full_events(spark, sf).where(c("move_type").isin(*types)).select("symbol", "bar_idx", "move_type", "direction", "magnitude_pct", "atr_multiple")


@query("d08_context", "SELECT symbol, i AS bar_idx, move_type, round(rsi, 5) AS rsi_14, round(adx_, 5) AS adx, round(vr, 5) AS volume_ratio, round(ap, 5) AS atr_pct FROM fev", FULL_EX)
def _(spark, sf):
    return full_events(spark, sf).select("symbol", "bar_idx", "move_type", *[F.round(f"context.{f}", 5).alias(f) for f in ("rsi_14", "adx", "volume_ratio", "atr_pct")])


D9 = {"rm": """
SELECT symbol, i, 'IMPULSE_UP' AS t, 3 AS p FROM dt WHERE i >= 50 AND rng > 2.5 * atr0 AND mv > 0 UNION ALL SELECT symbol, i, 'IMPULSE_DOWN', 3 FROM dt WHERE i >= 50 AND rng > 2.5 * atr0 AND NOT mv > 0
UNION ALL SELECT symbol, i, 'BREAKOUT_UP', 1 FROM dt WHERE i >= 50 AND close > hi * 1.001 AND pc <= hi UNION ALL SELECT symbol, i, 'BREAKDOWN', 1 FROM dt WHERE i >= 50 AND close < lo * 0.999 AND pc >= lo
UNION ALL SELECT symbol, i, 'REVERSAL_DOWN', 2 FROM dt WHERE i >= 50 AND mv < -0.005 AND bull >= 3 UNION ALL SELECT symbol, i, 'REVERSAL_UP', 2 FROM dt WHERE i >= 50 AND mv > 0.005 AND bear >= 3
UNION ALL SELECT symbol, i, 'GAP_UP', 5 FROM dt WHERE i >= 50 AND gap > 4.0 UNION ALL SELECT symbol, i, 'GAP_DOWN', 5 FROM dt WHERE i >= 50 AND gap < -4.0"""}


@query("d09_most_specific", "SELECT symbol, i AS bar_idx, first(t ORDER BY p, t) AS move_type FROM rm GROUP BY ALL", D9)
def _(spark, sf):
    return most_specific(rule_matches(inputs.study(spark, sf), STUDY_SETTINGS)).select("symbol", "bar_idx", "move_type")


@query("d10_timeframe_settings", f"SELECT {EVENT_COLS} FROM (SELECT *, {SIDE} AS direction, round(mv * 100, 4) AS magnitude_pct, round(rng / (atr0 + 1e-10), 2) AS atr_multiple FROM (SELECT *, {type_case('1.5', 0.005, 5)} AS move_type FROM dt WHERE i >= 50)) WHERE move_type IS NOT NULL")
def _(spark, sf):
    return detect_movements(inputs.study(spark, sf), DetectorSettings.for_timeframe("1d")).select("symbol", "bar_idx", "move_type", "direction", "magnitude_pct", "atr_multiple")


EPY = 60.0


@query("d11_impulse_ladder", f"""
SELECT symbol, n_needed, first(k ORDER BY CASE WHEN n >= n_needed THEN s ELSE 10 - s END, s) AS atr_impulse, first(n ORDER BY CASE WHEN n >= n_needed THEN s ELSE 10 - s END, s) AS n_events FROM (
 SELECT symbol, s, k, count(*) FILTER (WHERE (rng > k * atr0) OR other IS NOT NULL) AS n FROM (SELECT *, {type_case('1e18', 4.0, 3)} AS other FROM dt WHERE i >= 50) CROSS JOIN (VALUES (0, 1.5::DOUBLE), (1, 1.2), (2, 1.0), (3, 0.75), (4, 0.5)) r(s, k) GROUP BY ALL)
JOIN (SELECT symbol, CAST(floor({EPY} * greatest((epoch(max(ts)) - epoch(min(ts))) / (365.25 * 86400), 0.1)) AS BIGINT) AS n_needed FROM b0 GROUP BY ALL) USING (symbol) GROUP BY ALL""")
def _(spark, sf):
    return impulse_ladder(inputs.study(spark, sf), STUDY_SETTINGS, EPY, ATR_LADDER).select("symbol", "n_needed", "atr_impulse", "n_events")


@query("d12_min_move", f"""
SELECT symbol, round(med, 6) AS median_atr, min_total, coalesce(max(th) FILTER (WHERE n >= min_total), min(th)) AS min_move_pct FROM (
 SELECT symbol, med, min_total, th, (SELECT count(*) FROM fev v WHERE v.symbol = q.symbol AND abs(v.magnitude_pct) >= q.th) AS n FROM (
  SELECT DISTINCT symbol, med, min_total, th FROM (SELECT symbol, med, min_total, unnest(list_concat([0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.5, 10.0]::DOUBLE[],
   list_filter(list_transform([0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]::DOUBLE[], lambda m: round(med * m, 2)), lambda x: x >= 0.05 AND x <= 15.0))) AS th
   FROM (SELECT symbol, median(ap) AS med, CAST(floor({EPY} * greatest(date_diff('day', min(ts), max(ts)) / 365.25, 0.25)) AS BIGINT) AS min_total FROM df GROUP BY ALL))) q) GROUP BY ALL""", FULL_EX)
def _(spark, sf):
    r = calibrate_min_move(full_events(spark, sf), full(spark, sf), EPY)
    return r.select("symbol", F.round("median_atr", 6).alias("median_atr"), "min_total", "min_move_pct")


@query("d13_event_targets", "SELECT timeframe, round(greatest(20, n), 6) AS per_year, cnt FROM (SELECT '1d' AS timeframe, 365.25 * 300.0 / (365.25 * 24) AS n, count(*) AS cnt FROM bars)")
def _(spark, sf):
    return inputs.bars(spark, sf).groupBy("timeframe").agg(F.count("*").alias("cnt")).withColumn("per_year", F.round(F.lit(target_events_per_year("1d")), 6))


@query("r13_direction", "SELECT DISTINCT move_type, CASE WHEN contains(move_type, 'UP') THEN 'LONG' ELSE 'SHORT' END AS side FROM ev")
def _(spark, sf):
    return inputs.movements(spark, sf).select("move_type", direction_of(c("move_type")).alias("side")).distinct()


@query("fp03_type_filter", f"SELECT {EVENT_COLS} FROM ev WHERE move_type IN ('BREAKOUT_UP', 'REVERSAL_DOWN')")
def _(spark, sf):
    return inputs.movements(spark, sf).where(c("move_type").isin("BREAKOUT_UP", "REVERSAL_DOWN")).select("symbol", "bar_idx", "move_type", "direction", "magnitude_pct", "atr_multiple")


@query("fp04_min_magnitude", f"SELECT {EVENT_COLS} FROM ev WHERE abs(magnitude_pct) >= 80")
def _(spark, sf):
    return inputs.movements(spark, sf).where(F.abs("magnitude_pct") >= 80).select("symbol", "bar_idx", "move_type", "direction", "magnitude_pct", "atr_multiple")


@query("fp05_get_movements", "SELECT epoch(ts)::BIGINT AS ts_s, move_type, direction, magnitude_pct FROM ev WHERE symbol = 'A' AND timeframe = '1d' AND direction = 'UP' ORDER BY ts")
def _(spark, sf):
    m = inputs.movements(spark, sf).where("symbol = 'A' and timeframe = '1d' and direction = 'UP'").orderBy("ts")
    return m.select(F.unix_seconds("ts").alias("ts_s"), "move_type", "direction", "magnitude_pct")


@query("fp06_get_commonalities", "SELECT * FROM (SELECT symbol, move_type, feature, t_statistic, row_number() OVER (PARTITION BY symbol, move_type ORDER BY abs(t_statistic) DESC, feature) AS pos FROM pred WHERE abs(t_statistic) >= 0.5) WHERE pos <= 3")
def _(spark, sf):
    r = mining.rerank(inputs.predictors(spark, sf).where(F.abs("t_statistic") >= 0.5)).where("rank <= 3")
    return r.select(*TK, "feature", "t_statistic", c("rank").cast("long").alias("pos"))


@query("fp07_by_date", f"SELECT {EVENT_COLS} FROM ev WHERE CAST(ts AS VARCHAR) LIKE '2000-0%'")
def _(spark, sf):
    m = inputs.movements(spark, sf).where((F.year("ts") == 2000) & (F.month("ts") < 10))
    return m.select("symbol", "bar_idx", "move_type", "direction", "magnitude_pct", "atr_multiple")


@query("fp08_last_movements", "SELECT symbol, i AS bar_idx, move_type FROM ev ORDER BY symbol, timeframe, ts DESC LIMIT 50")
def _(spark, sf):
    return inputs.movements(spark, sf).orderBy("symbol", "timeframe", F.desc("ts")).limit(50).select("symbol", "bar_idx", "move_type")


@query("fp08b_newest_movements", "SELECT symbol, i AS bar_idx, move_type FROM ev ORDER BY ts DESC, symbol LIMIT 50")
def _(spark, sf):
    return inputs.movements(spark, sf).orderBy(F.desc("ts"), "symbol").limit(50).select("symbol", "bar_idx", "move_type")


@query("pm01_precondition_vectors", "SELECT symbol, move_type, i AS bar_idx, feature, round(value, 6) AS value FROM pre")
def _(spark, sf):
    return mining.unpivot(inputs.event_vectors(spark, sf), [*TK, "bar_idx"], STUDY).withColumn("value", F.round("value", 6))


@query("pm02_snapshots", "SELECT v.symbol, v.move_type, v.i AS bar_idx, k.o AS bar_offset, round(s.rsi_14, 6) AS rsi_14, round(s.stoch_k, 6) AS stoch_k FROM ev v CROSS JOIN (VALUES (0), (1), (3), (5)) k(o) JOIN sf s ON s.symbol = v.symbol AND s.i = v.i - k.o")
def _(spark, sf):
    s = mining.event_snapshots(inputs.study(spark, sf), inputs.movements(spark, sf), ["rsi_14", "stoch_k"])
    return s.select(*TK, "bar_idx", c("offset").alias("bar_offset"), F.round("rsi_14", 6).alias("rsi_14"), F.round("stoch_k", 6).alias("stoch_k"))


@query("pm03_mine", "SELECT v.symbol, v.i AS bar_idx, v.move_type, round(p.rsi_14, 6) AS pre_rsi_14, round(s.rsi_14, 6) AS now_rsi_14 FROM ev v JOIN (SELECT symbol, i, avg(rsi_14) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS rsi_14 FROM sf) p USING (symbol, i) JOIN sf s USING (symbol, i)")
def _(spark, sf):
    m = mining.mine(inputs.study(spark, sf), inputs.movements(spark, sf), STUDY, 10)
    return m.select("symbol", "bar_idx", "move_type", F.round(c("preconditions")["rsi_14"], 6).alias("pre_rsi_14"), F.round(c("during")["rsi_14"], 6).alias("now_rsi_14"))


@query("pm04_background", "SELECT symbol, move_type, count(DISTINCT i) AS n, sum(i) AS sum_idx FROM bgw GROUP BY ALL")
def _(spark, sf):
    return inputs.background(spark, sf).groupBy(*TK).agg(F.count("*").alias("n"), F.sum("bar_idx").alias("sum_idx"))


STAT = ["mean_before", "std_before", "mean_all", "std_all", "t_statistic", "dof", "cohens_d", "lift_factor", "threshold", "predictive_pct"]


@query("ps01_welch", "SELECT symbol, move_type, feature, n_events, n_background, " + ", ".join(f"round({x}, 5) AS {x}" for x in STAT[:6]) + " FROM stats")
def _(spark, sf):
    return inputs.statistics(spark, sf).select(*TK, "feature", "n_events", "n_background", *[F.round(x, 5).alias(x) for x in STAT[:6]])


@query("c06_all_features")
def _(spark, sf):
    return inputs.full_study(spark, sf).select(*KEY, "ts", "bar_idx", *ALL_FEATURES)


@query("ps01c_welch_all_columns")
def _(spark, sf):
    return inputs.full_statistics(spark, sf).select(*TK, "feature", "n_events", "n_background", *[F.round(x, 5).alias(x) for x in STAT])


@query("ps05b_rank_all_columns")
def _(spark, sf):
    return mining.rank_predictors(inputs.full_statistics(spark, sf)).select(*TK, "feature", "t_statistic", "predictive_pct", "rank")


@query("ps01b_p_values")
def _(spark, sf):
    return inputs.statistics(spark, sf).select(*TK, "feature", F.round(mining.t_p_value("t_statistic", "dof"), 6).alias("p_value"))


@query("ps02_effect_sizes", "SELECT symbol, move_type, feature, round(cohens_d, 5) AS cohens_d, round(lift_factor, 5) AS lift_factor, round(threshold, 5) AS threshold FROM stats")
def _(spark, sf):
    return inputs.statistics(spark, sf).select(*TK, "feature", *[F.round(x, 5).alias(x) for x in ("cohens_d", "lift_factor", "threshold")])


@query("ps03_hit_rate", "SELECT symbol, move_type, feature, round(predictive_pct, 5) AS predictive_pct FROM stats")
def _(spark, sf):
    return inputs.statistics(spark, sf).select(*TK, "feature", F.round("predictive_pct", 5).alias("predictive_pct"))


@query("ps04_enough_events", "SELECT symbol, move_type, count(*) AS n_events, count(*) < 20 AS low_count_warning FROM tev GROUP BY ALL HAVING count(*) >= 3")
def _(spark, sf):
    return mining.enough_events(inputs.train(spark, sf)[1]).select(*TK, "n_events", "low_count_warning")


@query("ps05_rank", "SELECT symbol, move_type, feature, t_statistic, rank FROM pred")
def _(spark, sf):
    return inputs.predictors(spark, sf).select(*TK, "feature", "t_statistic", "rank")


@query("ps06_drop_correlated")
def _(spark, sf):
    return mining.drop_correlated(inputs.predictors(spark, sf), inputs.event_vectors(spark, sf), STUDY).select(*TK, "feature", "rank")


@query("ps07_bootstrap_hit_rate")
def _(spark, sf):
    return mining.bootstrap_hit_rate(inputs.predictors(spark, sf)).select(*TK, "feature", "predictive_pct", "hit_rate_ci_low", "hit_rate_ci_high")


def regime_frame(spark, sf):
    return inputs.once(spark, sf, "regimes", lambda: inputs.features(spark, sf, ["regime", "atr_z"]))


from candlewright.plans.feature_queries import EXTRA as FEATURE_EX  # noqa: E402

REG_EX = {**FEATURE_EX, "rgm": f"SELECT symbol, i, ts, CASE WHEN cv >= tv AND cv >= rgv THEN 'CHAOS' WHEN rgv >= tv THEN 'RANGE' ELSE 'TREND' END AS regime, {z('a14', 50)} AS atr_z FROM rv"}


@query("ps08_regime_split", """
SELECT * FROM (SELECT symbol, move_type, regime, count(*) AS n_events, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol, move_type), 1) AS pct_total
 FROM ev v JOIN (SELECT symbol, i + 1 AS i, regime FROM rgm) r USING (symbol, i) GROUP BY symbol, move_type, regime) WHERE n_events >= 4""", REG_EX)
def _(spark, sf):
    return mining.regime_split(inputs.movements(spark, sf), regime_frame(spark, sf)).select(*TK, "regime", "n_events", "pct_total")


COMP = """
SELECT symbol, move_type, n AS n_conditions, first(ms ORDER BY step) AS min_score, round(first(ev ORDER BY step), 1) AS event_hit_rate, round(first(bgr ORDER BY step), 1) AS baseline_rate, round(first(ev / (bgr + 1e-3) ORDER BY step), 2) AS lift FROM (
 SELECT l.*, (SELECT avg(CASE WHEN coalesce(e.s, 0) >= l.ms THEN 100.0 ELSE 0 END) FROM ces e WHERE e.symbol = l.symbol AND e.move_type = l.move_type) AS ev,
  (SELECT avg(CASE WHEN coalesce(e.s, 0) >= l.ms THEN 100.0 ELSE 0 END) FROM cbs e WHERE e.symbol = l.symbol AND e.move_type = l.move_type) AS bgr FROM clv l)
WHERE ev >= 30 OR ev / (bgr + 1e-3) >= 1.5 GROUP BY ALL"""
CM = "count(*) FILTER (WHERE (t.t_statistic > 0 AND x.value > t.threshold * 0.9) OR (t.t_statistic < 0 AND x.value < t.threshold * 1.1))"
COMP_EX = {
    "top5": "SELECT * FROM pred WHERE rank <= 5",
    "clv": "SELECT symbol, move_type, n, step, ms FROM (SELECT symbol, move_type, count(*) AS n FROM top5 GROUP BY ALL) CROSS JOIN LATERAL (SELECT unnest([0, 1, 2, 3, 4]) AS step, unnest([n, n - 1, n - 2, 2, 1]) AS ms) WHERE ms >= 1 AND (step < 3 OR n >= 3)",
    "ces": f"SELECT p.symbol, p.move_type, p.i, q.s FROM prew p LEFT JOIN (SELECT x.symbol, x.move_type, x.i, {CM} AS s FROM pre x JOIN top5 t USING (symbol, move_type, feature) GROUP BY ALL) q USING (symbol, move_type, i)",
    "cbs": f"SELECT p.symbol, p.move_type, p.i, q.s FROM bgw p LEFT JOIN (SELECT x.symbol, x.move_type, x.i, {CM} AS s FROM bg x JOIN top5 t USING (symbol, move_type, feature) GROUP BY ALL) q USING (symbol, move_type, i)",
}


@query("ps09_composite", COMP, COMP_EX)
def _(spark, sf):
    r = mining.composite_score(inputs.predictors(spark, sf), inputs.event_vectors(spark, sf), inputs.background(spark, sf), STUDY)
    return r.select(*TK, "n_conditions", "min_score", "event_hit_rate", "baseline_rate", "lift")


def clustered(spark, sf):
    return inputs.once(spark, sf, "clusters", lambda: clusters.cluster_events(inputs.event_vectors(spark, sf), STUDY))


@query("ps10_clusters")
def _(spark, sf):
    return clustered(spark, sf).drop("key_features")


@query("va13_cluster_fingerprints")
def _(spark, sf):
    r = validate.cluster_fingerprints(clustered(spark, sf))
    return r.select(*KEY, "cluster", "n_events", F.explode("distinguishing_features").alias("f")).select(*KEY, "cluster", "n_events", "f.*")


@query("pm05_similar_events")
def _(spark, sf):
    v = inputs.event_vectors(spark, sf).select(*KEY, "bar_idx", "ts", "move_type", "direction", "magnitude_pct", *STUDY)
    latest = v.groupBy(*KEY).agg(F.max("bar_idx").alias("bar_idx"))
    return clusters.similar_events(v.join(latest, [*KEY, "bar_idx"]), v, STUDY, 5)


QUERIES["jn12_similarity_join"] = QUERIES["pm05_similar_events"]


@query("ps11_type_statistics", "SELECT symbol, move_type, count(*) AS n_events, round(min(abs(magnitude_pct)), 2) AS magnitude_min, round(max(abs(magnitude_pct)), 2) AS magnitude_max, round(avg(abs(magnitude_pct)), 2) AS magnitude_avg, round(min(atr_multiple), 2) AS atr_min, round(max(atr_multiple), 2) AS atr_max, round(avg(atr_multiple), 2) AS atr_avg FROM ev GROUP BY ALL")
def _(spark, sf):
    return reports.type_statistics(inputs.movements(spark, sf)).drop("timeframe")


@query("ps12_regime_profile", """
SELECT symbol, move_type, first(regime ORDER BY k DESC, regime DESC) AS dominant_regime, round(max(k) * 100.0 / sum(k), 1) AS dominant_pct, round(sum(rs) / sum(k), 3) AS avg_rsi_14,
 round(sum(ad) / sum(n_ad), 3) AS avg_adx, round(sum(en) / sum(n_en), 3) AS avg_entropy_20, round(sum(hu) / sum(n_hu), 3) AS avg_hurst_60 FROM (
 SELECT symbol, move_type, regime, count(*) AS k, sum(s.rsi_14) AS rs, sum(e.adx) AS ad, count(e.adx) AS n_ad, sum(t.h20) AS en, count(t.h20) AS n_en, sum(u.h) AS hu, count(u.h) AS n_hu
 FROM ev JOIN rgm USING (symbol, i) JOIN (SELECT symbol, i, rsi_14 FROM sf) s USING (symbol, i) JOIN (SELECT symbol, i, adx FROM ema) e USING (symbol, i)
 LEFT JOIN (SELECT symbol, i, h20 FROM ent4) t USING (symbol, i) LEFT JOIN (SELECT symbol, i, h FROM hu3 WHERE n = 60) u USING (symbol, i) GROUP BY ALL) GROUP BY ALL""", REG_EX)
def _(spark, sf):
    state = ["regime", "rsi_14", "adx", "entropy_20", "hurst_60"]
    f = inputs.once(spark, sf, "event_state", lambda: inputs.features(spark, sf, state).select(*KEY, "bar_idx", *state))
    r = reports.regime_profile(inputs.movements(spark, sf).join(f, [*KEY, "bar_idx"]).withColumn("context", F.struct(*state)))
    return r.select(*TK, "dominant_regime", c("regime_distribution")[c("dominant_regime")].alias("dominant_pct"), *[f"avg_{x}" for x in state[1:]])


@query("ps13_series_status", "SELECT symbol, timeframe, move_type, direction, count(*) AS n_events, epoch(min(ts))::BIGINT AS first_s, epoch(max(ts))::BIGINT AS last_s FROM ev GROUP BY ALL")
def _(spark, sf):
    return reports.series_status(inputs.movements(spark, sf)).select(*KEY, "move_type", "direction", "n_events", F.unix_seconds("first_ts").alias("first_s"), F.unix_seconds("last_ts").alias("last_s"))


@query("ps14_up_down", "SELECT symbol, move_type, count(*) FILTER (WHERE direction = 'UP') AS n_up, count(*) FILTER (WHERE direction = 'DOWN') AS n_down FROM ev GROUP BY ALL")
def _(spark, sf):
    return reports.up_down_counts(inputs.movements(spark, sf)).drop("timeframe")


@query("ps15_direction_bias", """
SELECT *, CASE WHEN n_up / greatest(n_down, 1) > 1.35 THEN 'LONG' WHEN n_up / greatest(n_down, 1) < 0.74 THEN 'SHORT' ELSE 'NEUTRAL' END AS bias, CASE WHEN avg_magnitude > 5 THEN 'HOCH' WHEN avg_magnitude > 2.5 THEN 'MITTEL' ELSE 'NIEDRIG' END AS volatility FROM (
 SELECT symbol, count(*) FILTER (WHERE direction = 'UP') AS n_up, count(*) FILTER (WHERE direction = 'DOWN') AS n_down, round(avg(abs(magnitude_pct)), 2) AS avg_magnitude, round(max(abs(magnitude_pct)), 2) AS max_magnitude FROM ev GROUP BY ALL)""")
def _(spark, sf):
    return reports.direction_bias(inputs.movements(spark, sf)).drop("timeframe")


# The given tables are noise and hold no strong predictors, so these ask for less than the defaults.
WEAK_T, WEAK_HIT = 1.0, 16.0


@query("ps16_best_signals", f"""
SELECT symbol, move_type, feature, strength, position FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY strength DESC, move_type, feature) AS position FROM (
 SELECT *, round(predictive_pct * abs(round(t_statistic, 2)), 4) AS strength FROM pred WHERE abs(t_statistic) >= {WEAK_T} AND predictive_pct >= {WEAK_HIT})) WHERE position <= 8""")
def _(spark, sf):
    return reports.best_signals(inputs.predictors(spark, sf), min_t=WEAK_T, min_hit=WEAK_HIT).drop("timeframe")


@query("ps17_type_summary", f"""
SELECT g.symbol, g.move_type, signals, n_events, avg_magnitude, CASE WHEN contains(g.move_type, 'UP') OR contains(g.move_type, 'BREAKOUT') THEN 'LONG' ELSE 'SHORT' END AS direction FROM (
 SELECT symbol, move_type, string_agg(feature, ',' ORDER BY p) AS signals FROM (SELECT *, row_number() OVER (PARTITION BY symbol, move_type ORDER BY rank) AS p FROM pred WHERE abs(t_statistic) >= {WEAK_T} AND predictive_pct >= {WEAK_HIT}) WHERE p <= 3 GROUP BY ALL) g
JOIN (SELECT symbol, move_type, count(*) AS n_events, round(avg(abs(magnitude_pct)), 2) AS avg_magnitude FROM ev GROUP BY ALL HAVING count(*) >= 3) n USING (symbol, move_type)""")
def _(spark, sf):
    return reports.type_summary(inputs.predictors(spark, sf), inputs.movements(spark, sf), min_t=WEAK_T, min_hit=WEAK_HIT).drop("timeframe")


def validation(spark, sf):
    return inputs.once(spark, sf, "validation", lambda: validate.validate(inputs.study(spark, sf), inputs.movements(spark, sf), inputs.predictors(spark, sf), STUDY, leading=LEADING))


@query("ps18_verdict", """
SELECT *, CASE WHEN n_stable >= n_types * 0.6 THEN 'generalised' WHEN n_overfitted > n_types * 0.5 THEN 'overfitting' ELSE 'mixed' END AS verdict FROM (
 SELECT symbol, count(*) AS n_types, count(*) FILTER (WHERE label IN ('ROBUST', 'STABIL')) AS n_stable, count(*) FILTER (WHERE label = 'OVERFITTED') AS n_overfitted FROM val GROUP BY ALL)""")
def _(spark, sf):
    return reports.validation_verdict(validation(spark, sf)).drop("timeframe")


@query("ps19_fingerprints", f"""
SELECT symbol, move_type, position, feature, round((least(greatest(lift_factor, -2), 2) / 2 + 1) / 2, 6) AS value FROM (
 SELECT *, row_number() OVER (PARTITION BY symbol, move_type ORDER BY rank) AS position, count(*) OVER (PARTITION BY symbol, move_type) AS k FROM pred WHERE abs(t_statistic) >= {WEAK_T}) WHERE k >= 3 AND position <= 8""")
def _(spark, sf):
    return reports.fingerprints(inputs.predictors(spark, sf), min_t=WEAK_T).drop("timeframe")


@query("ps20_regime_spans", """
SELECT symbol, span, regime, epoch(min(ts))::BIGINT AS start_s, epoch(max(ts))::BIGINT AS end_s, count(*) AS n_bars FROM (
 SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY i) AS span FROM (SELECT *, CASE WHEN regime = lag(regime) OVER (PARTITION BY symbol ORDER BY i) THEN 0 ELSE 1 END AS nw FROM rgm)) GROUP BY ALL""", REG_EX)
def _(spark, sf):
    return reports.regime_spans(regime_frame(spark, sf)).select("symbol", "span", "regime", F.unix_seconds("start_ts").alias("start_s"), F.unix_seconds("end_ts").alias("end_s"), "n_bars")


@query("va01_split", "SELECT symbol, n AS n_bars, CAST(floor(n * 0.7::DOUBLE) AS BIGINT) AS split_idx, count(*) FILTER (WHERE is_train) AS n_train, epoch(min(ts) FILTER (WHERE NOT is_train))::BIGINT AS split_s FROM sf GROUP BY ALL")
def _(spark, sf):
    s = inputs.study(spark, sf)
    return s.groupBy("symbol", "n_bars", "split_idx").agg(F.count_if("is_train").alias("n_train"), F.unix_seconds(F.min(F.when(~c("is_train"), c("ts")))).alias("split_s"))


@query("va02_leading_conditions", "SELECT symbol, move_type, feature, t_statistic, predictive_pct, pos FROM lead")
def _(spark, sf):
    return validate.leading_conditions(inputs.predictors(spark, sf), **LEADING).select(*TK, "feature", "t_statistic", "predictive_pct", "pos")


def hits(spark, sf):
    return inputs.once(spark, sf, "hits", lambda: validate.condition_hits(
        inputs.study(spark, sf), inputs.movements(spark, sf).where("not is_train"), validate.leading_conditions(inputs.predictors(spark, sf), **LEADING), STUDY, 3))


@query("va03_condition_check", "SELECT symbol, move_type, i AS bar_idx, feature, met FROM hits")
def _(spark, sf):
    return hits(spark, sf).select(*TK, "bar_idx", "feature", "met")


@query("va04_recall", "SELECT symbol, move_type, n_test, recall_pct FROM rec_")
def _(spark, sf):
    return validate.recall(hits(spark, sf)).drop("timeframe")


@query("va05_precision", "SELECT symbol, move_type, signal_fires, signal_confirmed FROM prc")
def _(spark, sf):
    f = inputs.study(spark, sf).where("not is_train")
    cond = validate.leading_conditions(inputs.predictors(spark, sf), **LEADING)
    return validate.precision(f, inputs.movements(spark, sf).where("not is_train"), cond, STUDY, 2).drop("timeframe")


QUERIES["jn09_bar_condition"], ORACLES["jn09_bar_condition"] = QUERIES["va05_precision"], ORACLES["va05_precision"]
VAL = "symbol, move_type, n_conditions, insample_hit, n_train, n_test, recall_pct, signal_fires, signal_confirmed, precision_pct, degradation, label"


@query("va06_validate", f"SELECT {VAL} FROM val")
def _(spark, sf):
    return validation(spark, sf).select(*VAL.split(", "))


@query("va07_condition_performance", "SELECT l.symbol, l.move_type, l.feature, l.predictive_pct AS train_hit, round(l.t_statistic, 2) AS t_statistic, coalesce(h.test_hit, 0) AS test_hit FROM lead l LEFT JOIN (SELECT symbol, move_type, feature, round(avg(CASE WHEN met THEN 100.0 ELSE 0 END), 1) AS test_hit FROM hits GROUP BY ALL) h USING (symbol, move_type, feature)")
def _(spark, sf):
    return validate.condition_performance(hits(spark, sf), validate.leading_conditions(inputs.predictors(spark, sf), **LEADING)).drop("timeframe")


@query("va08_usable", "SELECT symbol, move_type, label IN ('ROBUST', 'STABIL') AND precision_pct >= 10 AND n_train >= 20 AND n_test >= 20 AS use_in_bot, CASE WHEN n_train < 20 THEN 'n_train < 20' WHEN n_test < 20 THEN 'n_test < 20' WHEN precision_pct < 10 THEN 'precision < 10%' END AS excluded_reason FROM val")
def _(spark, sf):
    return validate.usable(validation(spark, sf)).select(*TK, "use_in_bot", "excluded_reason")


# Noise gives few robust types, so the label that a weak type carries is let through as well.
TRADE_LABELS = ("ROBUST", "STABIL", "SCHWACH", "OVERFITTED")


@query("va09_tradeable", f"SELECT symbol, move_type, CASE WHEN contains(move_type, 'UP') THEN 'LONG' ELSE 'SHORT' END AS direction, n_train, n_test FROM val WHERE label IN {TRADE_LABELS} AND n_train >= 20 AND n_test >= 20")
def _(spark, sf):
    return validate.tradeable(validation(spark, sf), TRADE_LABELS).drop("timeframe")


@query("va10_entry_conditions", "SELECT symbol, move_type, tier, tier_rank, feature, direction, threshold, baseline_avg, deviation_pct, t_statistic, hit_rate_pct FROM cond")
def _(spark, sf):
    return inputs.conditions(spark, sf).drop("timeframe")


STRAT_EX = {
    "sh": "SELECT symbol, count(*) AS n, count(*) FILTER (WHERE move_type LIKE 'IMPULSE%' OR move_type LIKE 'ACCEL%') AS mo, count(*) FILTER (WHERE move_type LIKE 'BREAK%') AS br, count(*) FILTER (WHERE move_type LIKE 'REVERSAL%') AS mr, count(*) FILTER (WHERE move_type LIKE 'SQUEEZE%') AS sq FROM ev GROUP BY ALL",
    "fam": f"SELECT symbol, CASE WHEN feature IN ('rsi_14', 'stoch_k', 'roc_5') THEN 'MOMENTUM' WHEN feature = 'volume_ratio' THEN 'ORDERFLOW' WHEN feature IN ('bb_position', 'donchian_pos') THEN 'BREAKOUT' END AS strategy, abs(t_statistic) * predictive_pct / 100 AS score FROM pred WHERE abs(t_statistic) >= {WEAK_T} AND predictive_pct >= {WEAK_HIT}",
    "sco": "SELECT symbol, strategy, sum(score) AS score FROM (SELECT symbol, 'MOMENTUM' AS strategy, mo * 100.0 / n AS score FROM sh UNION ALL SELECT symbol, 'BREAKOUT', br * 100.0 / n FROM sh UNION ALL SELECT symbol, 'MEAN_REV', mr * 100.0 / n FROM sh UNION ALL SELECT symbol, 'SQUEEZE', sq * 100.0 / n + CASE WHEN sq / n > 0.1 THEN sq * 2.0 ELSE 0 END FROM sh UNION ALL SELECT symbol, 'ORDERFLOW', 0 FROM sh UNION ALL SELECT symbol, 'COMPLEXITY', 0 FROM sh UNION ALL SELECT symbol, strategy, score FROM fam WHERE strategy IS NOT NULL) GROUP BY ALL",
    "stg": "SELECT symbol, first(strategy ORDER BY score DESC) AS leader, max(score) AS best_score, list_sort(list(score), 'DESC')[2] AS second_score FROM sco GROUP BY ALL",
}
STG = "symbol, leader, round(best_score, 4) AS best_score, round(second_score, 4) AS second_score, CASE WHEN best_score > 0 AND second_score / best_score > 0.75 THEN 'HYBRID' ELSE leader END AS strategy"


def strategy(spark, sf):
    return validate.select_strategy(inputs.movements(spark, sf), inputs.predictors(spark, sf), WEAK_T, WEAK_HIT)


@query("va11_select_strategy", f"SELECT {STG} FROM stg", STRAT_EX)
def _(spark, sf):
    return strategy(spark, sf).select("symbol", "leader", F.round("best_score", 4).alias("best_score"), F.round("second_score", 4).alias("second_score"), "strategy")


@query("ps18b_dominance", "SELECT symbol, CASE WHEN r >= 2.5 THEN 'clear' WHEN r >= 1.7 THEN 'strong' WHEN r >= 1.3 THEN 'ahead' ELSE 'narrow' END AS dominance, least(100, CAST(floor(best_score) AS INT)) AS confidence FROM (SELECT *, CASE WHEN second_score > 0 THEN best_score / second_score ELSE 99 END AS r FROM stg)", STRAT_EX)
def _(spark, sf):
    return reports.dominance(strategy(spark, sf)).select("symbol", "dominance", "confidence")


@query("va14_signal_template", f"SELECT symbol, move_type, string_agg(feature, ',' ORDER BY p) AS key_features, round(avg(predictive_pct), 1) AS estimated_hit_rate, greatest(2, count(*) - 1) AS min_score, CASE WHEN contains(move_type, 'UP') OR contains(move_type, 'BREAKOUT') THEN 'LONG' ELSE 'SHORT' END AS direction FROM (SELECT *, row_number() OVER (PARTITION BY symbol, move_type ORDER BY rank) AS p FROM pred WHERE abs(t_statistic) >= {WEAK_T}) WHERE p <= 5 GROUP BY ALL")
def _(spark, sf):
    return validate.signal_template(inputs.predictors(spark, sf), WEAK_T).drop("timeframe").withColumn("key_features", F.concat_ws(",", "key_features"))


@query("va15_edge_scan", "SELECT symbol, count(*) AS n_types, count(*) FILTER (WHERE label IN ('ROBUST', 'STABIL') AND precision_pct >= 10 AND n_train >= 20 AND n_test >= 20) AS n_usable FROM val GROUP BY ALL")
def _(spark, sf):
    return validate.edge_scan(validation(spark, sf)).drop("timeframe")


