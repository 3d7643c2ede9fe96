"""Tables the registered queries start from, each built once per session and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from candlewright.core import KEY
from candlewright.functions.features import ALL_FEATURES, candidate_features, compute_features
from candlewright.operators import mining, outcomes
from candlewright.operators.detect import DetectorSettings, detect_movements
from candlewright.operators.validate import entry_conditions, split_time
from candlewright.sources.tables import scratch_path
from candlewright.sources.ticks import bars_from_ticks

# Daily bars with one-hour periods: the multiplier undoes the scaling to one day.
DAILY = {"timeframe": "1d", "scale_multiplier": 24.0}
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

STUDY = ["rsi_14", "bb_position", "donchian_pos", "volume_ratio", "roc_5", "body_ratio", "range_compression_10", "stoch_k"]
STUDY_SETTINGS = DetectorSettings(atr_impulse=2.5, breakout_bars=20, reversal_min_run=3, gap_pct=4.0)

_TABLES: dict[tuple, tuple] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A shared intermediate as a written table: later plans start from it.

    The forensics run is a chain of materialised tables (bars, features, events, vectors,
    statistics, conditions, trades). Writing each cuts lineage, survives lost executors
    and keeps plans small; the folder is the session's shared checkpoint folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        df, path = build(), scratch_path(spark, name)
        df.write.parquet(path)
        _TABLES[key] = (path, df.schema)
    path, schema = _TABLES[key]
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_bars(spark, sf_dir) -> DataFrame:
    return bars_from_ticks(
        table(spark, sf_dir, "lineitem"), "l_returnflag", "l_shipdate", "l_extendedprice / l_quantity", "l_quantity", "1d", LINE_ORDER)


def order_bars(spark, sf_dir) -> DataFrame:
    return bars_from_ticks(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "1", "1d", ("o_orderkey",))


def event_bars(spark, sf_dir, timeframe="1h") -> DataFrame:
    return bars_from_ticks(table(spark, sf_dir, "events"), "event_type", "ts", "value", "value", timeframe, ("event_id",))


def bars(spark, sf_dir) -> DataFrame:
    from candlewright.operators.chunks import index_bars

    # Indexing reads the bars twice, so they are written first: ticks are read and aggregated once.
    return once(spark, sf_dir, "bars", lambda: index_bars(once(spark, sf_dir, "plain_bars", lambda: line_bars(spark, sf_dir))))


def features(spark, sf_dir, names) -> DataFrame:
    return compute_features(bars(spark, sf_dir), names, **DAILY)


def study(spark, sf_dir) -> DataFrame:
    """Bars with the study columns, the split and the run lengths the detector wants."""
    return once(spark, sf_dir, "study", lambda: split_time(features(spark, sf_dir, [*STUDY, "consec_bull", "consec_bear"])))


def movements(spark, sf_dir) -> DataFrame:
    def build():
        ev = detect_movements(study(spark, sf_dir), STUDY_SETTINGS)
        return ev.join(study(spark, sf_dir).select(*KEY, "bar_idx", "is_train"), [*KEY, "bar_idx"])

    return once(spark, sf_dir, "movements", build)


def train(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return study(spark, sf_dir).where("is_train"), movements(spark, sf_dir).where("is_train").drop("is_train")


def enough_train(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Training bars, and the training events of types with enough of them."""
    f, ev = train(spark, sf_dir)
    return f, ev.join(mining.enough_events(ev).select(*mining.TYPE_KEY), mining.TYPE_KEY, "left_semi")


def event_vectors(spark, sf_dir) -> DataFrame:
    def build():
        return mining.precondition_vectors(*enough_train(spark, sf_dir), STUDY, 5)

    return once(spark, sf_dir, "event_vectors", build)


def background(spark, sf_dir) -> DataFrame:
    def build():
        f, ev = train(spark, sf_dir)
        return mining.background(f, ev, STUDY, 5)

    return once(spark, sf_dir, "background", build)


def statistics(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "statistics", lambda: mining.welch_of_bars(*enough_train(spark, sf_dir), STUDY, 5))


def predictors(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "predictors", lambda: mining.rank_predictors(statistics(spark, sf_dir)))


def full_study(spark, sf_dir) -> DataFrame:
    """Bars with every column of the catalogue and the split."""
    return once(spark, sf_dir, "full_study", lambda: split_time(features(spark, sf_dir, ALL_FEATURES)))


def full_statistics(spark, sf_dir) -> DataFrame:
    """Which of all candidate columns differ before a movement: the statistics over the whole catalogue."""
    def build():
        f, ev = full_study(spark, sf_dir).where("is_train"), enough_train(spark, sf_dir)[1]
        return mining.welch_of_bars(f, ev, candidate_features(), 5)

    return once(spark, sf_dir, "full_statistics", build)


# The test tables are noise, so the studies use lower bars than the defaults.
LEADING = {"min_t": 0.5, "min_hit": 5.0, "top": 6}
TIERS = {"strong_t": 0.3, "must": (1.5, 15.0), "should": (0.6, 10.0)}


def conditions(spark, sf_dir) -> DataFrame:
    return once(spark, sf_dir, "conditions", lambda: entry_conditions(predictors(spark, sf_dir), **TIERS))


BASE_PARAMS = {"t_threshold": 0.5, "min_score": 2.5, "min_hit_rate": 0.5, "sl_pct": 20.0, "tp_rr": 2.0, "leverage": 4.0,
               "risk_per_trade_pct": 1.0, "max_hold_bars": 12, "fee_pct_per_side": 0.06}


def test_bars(spark, sf_dir) -> DataFrame:
    return study(spark, sf_dir).where("not is_train")


def run_grid(spark, sf_dir, name: str, rows: list[dict], data=None) -> DataFrame:
    """Trades of the held-out bars under every row of a grid."""
    def build():
        hold = max(int(r.get("max_hold_bars", 24)) for r in rows)
        src = data if data is not None else test_bars(spark, sf_dir)
        return outcomes.simulate(src, conditions(spark, sf_dir), STUDY, outcomes.grid(spark, rows), hold)

    return once(spark, sf_dir, f"trades_{name}", build)


def base_trades(spark, sf_dir) -> DataFrame:
    return run_grid(spark, sf_dir, "base", [{**BASE_PARAMS, "param_id": 0}])
