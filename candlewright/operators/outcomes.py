"""Signals under parameter grids, their outcomes, and the trades that result.

Every trade is sized from a fixed start capital, so an outcome depends only on its own
signal. Outcomes are labelled for all signals at once; a separate pass picks, per
parameter set, the signals that do not overlap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from candlewright.core import KEY
from candlewright.operators import chunks, touch
from candlewright.operators.mining import TYPE_KEY
from candlewright.operators.validate import feature_position, pack_values
from candlewright.sources.tables import written

c = F.col

# Distance kept from liquidation in percent, and the share of capital a position may bind.
LIQUIDATION_BUFFER_PCT = 0.5
BINDABLE_SHARE = 0.9
WARM_UP_BARS = 10
MOST_SETS = 100_000

# Parameter defaults and the ranges a search draws from.
DEFAULTS = {
    "t_threshold": 4.0, "min_score": 20.0, "min_hit_rate": 0.4, "sl_pct": 1.5, "tp_rr": 2.0, "leverage": 10.0,
    "risk_per_trade_pct": 1.0, "max_hold_bars": 24, "fee_pct_per_side": 0.06,
}
SEARCH_SPACE = {
    "t_threshold": (2.0, 8.0), "min_score": (5.0, 100.0), "min_hit_rate": (0.2, 0.85), "sl_pct": (0.5, 5.0),
    "tp_rr": (1.0, 5.0), "leverage": (3, 20), "risk_per_trade_pct": (0.5, 3.0), "max_hold_bars": (3, 96),
}
GRID_SCHEMA = ("param_id long, t_threshold double, min_score double, min_hit_rate double, sl_pct double, tp_rr double, "
               "leverage double, risk_per_trade_pct double, max_hold_bars int, fee_pct_per_side double")


def grid(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Parameter sets as a table; missing entries take the defaults."""
    full = [{**DEFAULTS, **r, "param_id": r.get("param_id", i)} for i, r in enumerate(rows)]
    data = [(int(r["param_id"]), float(r["t_threshold"]), float(r["min_score"]), float(r["min_hit_rate"]), float(r["sl_pct"]), float(r["tp_rr"]),
             max(float(r["leverage"]), 1.0), float(r["risk_per_trade_pct"]), int(r["max_hold_bars"]), float(r["fee_pct_per_side"])) for r in full]
    return spark.createDataFrame(data, GRID_SCHEMA)


def random_grid(n: int, seed: int = 7) -> list[dict]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        row = {k: float(rng.uniform(lo, hi)) for k, (lo, hi) in SEARCH_SPACE.items()}
        row["leverage"], row["max_hold_bars"] = int(rng.integers(3, 21)), int(rng.integers(3, 97))
        out.append(row)
    return out


# ── signals ──────────────────────────────────────────────────────────────────


def score_signals(features: DataFrame, conditions: DataFrame, names, t_threshold: float = 4.0) -> DataFrame:
    """Per bar and type: score, conditions met, conditions eligible."""
    names = list(names)
    packed = _packed(conditions, names).select(*KEY, F.explode("_types").alias("_t"))
    bars = features.select(*KEY, "bar_idx", "ts", pack_values(names).alias("_v")).join(packed, KEY)
    conds = F.filter(c("_t.conds"), lambda x: (x.t >= t_threshold) & F.get(c("_v"), x.p).isNotNull())
    df = bars.withColumn("_c", conds)
    hit = F.filter("_c", _is_met)
    return df.select(
        *KEY, "bar_idx", "ts", c("_t.move_type").alias("move_type"),
        F.aggregate(hit, F.lit(0.0), lambda a, x: a + x.t).alias("score"), F.size(hit).alias("n_met"), F.size("_c").alias("n_total"))


def _is_met(x) -> Column:
    v = F.get(c("_v"), x.p)
    return F.when(x.above, v > x.base).otherwise(v < x.base)


def _packed(conditions: DataFrame, names) -> DataFrame:
    """All entry conditions of a series as one array of types, strongest first."""
    conds = conditions.where(c("tier").isin("must_have", "should_have")).withColumn("_p", feature_position(names))
    cond = F.struct(
        (-F.abs("t_statistic")).alias("n"), c("feature").alias("f"), F.abs("t_statistic").alias("t"), c("_p").alias("p"),
        (c("direction") == "above").alias("above"), c("baseline_avg").alias("base"))
    per_type = conds.groupBy(*TYPE_KEY).agg(F.sort_array(F.collect_list(cond)).alias("conds"))
    side = F.when(c("move_type").contains("UP"), "LONG").otherwise("SHORT").alias("direction")
    return per_type.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("move_type", side, "conds"))).alias("_types"))


def signal_ladders(features: DataFrame, conditions: DataFrame, names, carry=()) -> DataFrame:
    """Per bar and type the running score, hits and eligible count from the strongest
    condition down. Any t threshold then reads one rung, so a grid costs no rescoring."""
    names = list(names)
    on = ["base_symbol", "timeframe"] if "base_symbol" in features.columns else KEY
    packed = _packed(conditions, names)
    if on != KEY:
        packed = packed.withColumnRenamed("symbol", "base_symbol")
    bars = features.select(*dict.fromkeys([*KEY, *on, "bar_idx", "ts", "high", "low", "close", *carry]), pack_values(names).alias("_v")).join(packed, on)

    def ladder(t):
        start = F.struct(F.array().cast("array<double>").alias("s"), F.array().cast("array<int>").alias("m"), F.array().cast("array<int>").alias("n"))

        def step(a, x):
            there = F.get(c("_v"), x.p).isNotNull()
            met = F.coalesce(_is_met(x), F.lit(False))
            last = lambda arr, zero: F.coalesce(F.try_element_at(arr, F.lit(-1)), zero)
            return F.struct(
                F.concat(a.s, F.array(last(a.s, F.lit(0.0)) + F.when(met, x.t).otherwise(0.0))).alias("s"),
                F.concat(a.m, F.array(last(a.m, F.lit(0)) + F.when(met, 1).otherwise(0))).alias("m"),
                F.concat(a.n, F.array(last(a.n, F.lit(0)) + F.when(there, 1).otherwise(0))).alias("n"))

        run = F.aggregate(t.conds, start, step)
        return F.struct(t.move_type.alias("move_type"), t.direction.alias("direction"), F.transform(t.conds, lambda x: x.t).alias("t"), run.alias("r"))

    return bars.withColumn("_types", F.transform("_types", ladder)).drop("_v")


def best_signals(ladders: DataFrame, params: DataFrame) -> DataFrame:
    """The strongest qualifying type per bar and parameter set.

    `params` is broadcast up to MOST_SETS rows; beyond, the optimizer places it.
    """
    df = ladders.where(c("close") > 0).crossJoin(F.broadcast(params) if params.count() <= MOST_SETS else params)

    def judged(t, i):
        k = F.size(F.filter(t.t, lambda x: x >= c("t_threshold")))
        total = F.coalesce(F.try_element_at(t.r.n, k), F.lit(0))
        score = F.coalesce(F.try_element_at(t.r.s, k), F.lit(0.0))
        hit = F.try_divide(F.try_element_at(t.r.m, k), total)
        ok = (k > 0) & (total > 0) & (score >= c("min_score")) & (hit >= c("min_hit_rate"))
        return F.when(ok, F.struct(score.alias("score"), (-i).alias("o"), hit.alias("hit_rate"), t.move_type.alias("move_type"), t.direction.alias("direction")))

    # k = 0 would be an invalid position
    safe = F.transform("_types", lambda t, i: F.when(F.exists(t.t, lambda x: x >= c("t_threshold")), judged(t, i)))
    df = df.withColumn("_q", F.filter(safe, lambda x: x.isNotNull()))
    df = df.withColumn("_b", F.array_max("_q")).where(c("_b.score") > 0)
    return df.select(*[x for x in df.columns if x not in ("_q", "_b", "_types")], c("_b.move_type").alias("move_type"), c("_b.direction").alias("direction"),
                     c("_b.score").alias("score"), c("_b.hit_rate").alias("hit_rate"), F.size("_q").alias("n_types_signaling"))


# ── price levels and size ────────────────────────────────────────────────────


def add_levels(signals: DataFrame, start_capital: float = 100.0) -> DataFrame:
    """Stop, target, liquidation price, the stop that bites first, size and fee."""
    long = c("direction") == "LONG"
    side = F.when(long, 1.0).otherwise(-1.0)
    e = c("close")
    liq_pct = F.greatest(100.0 / c("leverage") - LIQUIDATION_BUFFER_PCT, F.lit(0.05))
    df = signals.withColumn("entry_price", e).withColumn("sl_dist", e * c("sl_pct") / 100)
    df = df.withColumn("sl", e - side * c("sl_dist")).withColumn("tp", e + side * c("sl_dist") * c("tp_rr")).withColumn("liq_price", e - side * (e * liq_pct / 100))
    df = df.withColumn("is_liquidation", F.when(long, c("liq_price") > c("sl")).otherwise(c("liq_price") < c("sl")))
    df = df.withColumn("effective_stop", F.when(c("is_liquidation"), c("liq_price")).otherwise(c("sl")))
    risk = F.lit(float(start_capital)) * c("risk_per_trade_pct") / 100
    notional = risk / (c("sl_pct") / 100)
    cap = float(start_capital) * BINDABLE_SHARE
    shrink = F.when(notional / c("leverage") > cap, cap / (notional / c("leverage"))).otherwise(1.0)
    df = df.withColumn("risk_amount", risk * shrink).withColumn("notional", notional * shrink)
    df = df.withColumn("margin_required", F.least(notional / c("leverage"), F.lit(cap)))
    return df.withColumn("fee_cost", c("notional") * (c("fee_pct_per_side") / 100) * 2)


# ── outcomes ─────────────────────────────────────────────────────────────────


def tradable(bars: DataFrame, *keep: str | Column) -> DataFrame:
    """Bars with a close above zero, numbered densely (v_idx) beside their index in the series (orig_idx)."""
    valid = bars.where(c("close") > 0).select(*KEY, "ts", c("bar_idx").alias("orig_idx"), "high", "low", "close", *keep)
    return chunks.index_bars(valid).withColumnRenamed("bar_idx", "v_idx")


def _with_following(valid: DataFrame, hold: int, size: int) -> DataFrame:
    """Each bar in its own chunk and in those before it that reach it within `hold` bars."""
    first = F.greatest(F.floor((c("v_idx") - hold) / size), F.lit(0))
    return valid.withColumn("chunk", F.explode(F.sequence(first, F.floor(c("v_idx") / size))))


def series_ends(bars: DataFrame) -> DataFrame:
    """First and last bar of each series."""
    return bars.groupBy(*KEY).agg(F.max("bar_idx").alias("_n"), F.max_by("close", "bar_idx").alias("_last"), F.max("ts").alias("_last_ts"), F.min("bar_idx").alias("_first"))


def _bars_of(table: pa.Table, hold: int) -> tuple[touch.Bars, pa.Table]:
    table = table.sort_by("v_idx")
    num = lambda n: table[n].to_numpy(zero_copy_only=False)
    return touch.Bars(num("orig_idx"), num("high").astype(float), num("low").astype(float), hold), table


REASONS = np.array(["TIMEOUT", "STOP", "TP", "END"], object)


def label_outcomes(signals: DataFrame, bars: DataFrame, hold: int, chunk: int = chunks.CHUNK) -> DataFrame:
    """First later bar that touches the stop (checked first) or the target, or times out.

    A signal the series ends on is closed at its last bar. Signals meet the bars of their
    chunk once, whatever the parameter sets, and search its extremes together.
    """
    valid = tradable(bars)
    places = valid.select(*KEY, c("orig_idx").alias("bar_idx"), "v_idx", F.floor(c("v_idx") / chunk).alias("chunk"))
    placed = signals.join(places, [*KEY, "bar_idx"]).join(series_ends(bars), KEY)
    out = StructType(placed.schema.fields + _parse_datatype_string("_reason string, _exit long, _price double, _exit_ts timestamp").fields)
    arrow, columns = to_arrow_schema(out), placed.columns

    def label(key: tuple, mine: pa.Table, group: pa.Table) -> pa.Table:
        path, group = _bars_of(group, hold)
        if not len(mine) or not path.n:
            return arrow.empty_table()
        num = lambda n: mine[n].to_numpy(zero_copy_only=False)
        at = num("v_idx") - group["v_idx"][0].as_py()
        long = np.array(mine["direction"].to_pylist()) == "LONG"
        place, why = path.exits(at, long, num("effective_stop").astype(float), num("tp").astype(float), num("max_hold_bars"))
        pick = pa.array(np.where(place < path.n, place, 0), mask=place >= path.n)
        found = [pa.array(REASONS[why], pa.string()), *(group[n].combine_chunks().take(pick) for n in ("orig_idx", "close", "ts"))]
        return pa.Table.from_arrays([*(mine[n] for n in columns), *found], names=arrow.names).cast(arrow)

    on = [*KEY, "chunk"]
    following = _with_following(valid, hold, chunk)
    following = following.select(*[c(x).alias(x) for x in following.columns])  # columns of its own beside the signals'
    done = placed.groupBy(*on).cogroup(following.groupBy(*on)).applyInArrow(label, out)
    reason = F.when(c("_reason") == "STOP", F.when(c("is_liquidation"), "LIQ").otherwise("SL")).otherwise(c("_reason"))
    last_price = F.when(c("_last") != 0, c("_last")).otherwise(c("entry_price"))
    done = done.withColumn("close_reason", reason).withColumn("exit_idx", F.coalesce("_exit", "_n"))
    done = done.withColumn("close_price", F.coalesce("_price", last_price)).withColumn("close_ts", F.coalesce("_exit_ts", "_last_ts"))
    side = F.when(c("direction") == "LONG", 1.0).otherwise(-1.0)
    drift = side * (c("close_price") - c("entry_price")) / c("sl_dist") * c("risk_amount")
    gross = (
        F.when(c("close_reason") == "LIQ", -c("margin_required")).when(c("close_reason") == "SL", -c("risk_amount"))
        .when(c("close_reason") == "TP", c("risk_amount") * c("tp_rr")).otherwise(drift))
    done = done.withColumn("pnl", gross - c("fee_cost")).withColumn("bars_held", c("exit_idx") - c("bar_idx"))
    return done.drop("_reason", "_exit", "_price", "_exit_ts", "_n", "_last", "_last_ts", "chunk", "v_idx")


# ── non-overlapping selection ────────────────────────────────────────────────

RUN_KEY = [*KEY, "param_id"]
CELL = [*KEY, "sets", "chunk"]
CELL_TYPES = "symbol string, timeframe string, sets int, chunk long"
EFFECTS = f"{CELL_TYPES}, ids array<long>, effects array<array<double>>"
#: Parameter sets that one task works through together.
SETS_PER_TASK = 256


def _free_bars(effects: DataFrame) -> DataFrame:
    """The first free bar of every parameter set at the start of each chunk: the chunks' effects chained in time order."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", ignore_index=True)
        state: dict[int, float] = {}
        rows = []
        for ids, found in zip(pdf["ids"], pdf["effects"], strict=True):
            rows.append([state.get(i, -1.0) for i in ids])
            for i, effect in zip(ids, found, strict=True):
                state[i] = touch.after_effect(state.get(i, -1.0), effect)
        return pdf[CELL].assign(ids=pdf["ids"], free=rows)

    return effects.groupBy(*KEY, "sets").applyInPandas(walk, f"{CELL_TYPES}, ids array<long>, free array<double>")


def select_non_overlapping(outcomes: DataFrame, hold: int, chunk: int = chunks.CHUNK) -> DataFrame:
    """One open trade at a time per (series, parameter set).

    The signals of a time chunk act on a single number, the first bar that is free. A
    trade ends within `hold` tradable bars, so a chunk's whole effect is a table of
    hold + 1 entries; those tables are chained per run, and then every chunk picks its
    trades on its own, for all its parameter sets together.
    """
    # The exit bar may open the next trade, except where the series itself ended.
    lean = outcomes.where(c("bar_idx") - c("_first") >= WARM_UP_BARS).select(
        *RUN_KEY, F.pmod(F.xxhash64("param_id"), F.lit(64)).cast("int").alias("sets"), F.floor(c("bar_idx") / chunk).alias("chunk"), "bar_idx",
        F.when(c("close_reason") == "END", touch.NEVER).otherwise(c("exit_idx")).alias("exit_idx"))

    def runs(table: pa.Table):
        table = table.sort_by([("param_id", "ascending"), ("bar_idx", "ascending")])
        ids, starts, exits = (table[n].to_numpy(zero_copy_only=False) for n in ("param_id", "bar_idx", "exit_idx"))
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1], True])
        return [(int(ids[lo]), starts[lo:hi], exits[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def effects(key: tuple, group: pa.Table) -> pa.Table:
        # Bars that cannot be traded may lie between, so a table holds all the chunk's starts.
        found = [(i, touch.effect(s, e, touch.NEVER, 0)) for i, s, e in runs(group)]
        return pa.table({**{n: group[n][:1] for n in CELL}, "ids": [[i for i, _ in found]], "effects": [[x for _, x in found]]})

    def pick(key: tuple, group: pa.Table, state: pa.Table) -> pa.Table:
        free = dict(zip(state["ids"][0].as_py(), state["free"][0].as_py(), strict=True)) if len(state) else {}
        got = [(i, s[touch.taken(s, e, free.get(i, -1.0))]) for i, s, e in runs(group)]
        n = sum(len(s) for _, s in got)
        ids = np.concatenate([np.full(len(s), i) for i, s in got]) if got else np.zeros(0, np.int64)
        return pa.table({"symbol": pa.array([k.as_py() for k in key[:1]] * n, pa.string()), "timeframe": pa.array([k.as_py() for k in key[1:2]] * n, pa.string()),
                         "param_id": pa.array(ids, pa.int64()), "bar_idx": pa.array(np.concatenate([s for _, s in got]) if got else [], pa.int64())})

    states = _free_bars(lean.groupBy(*CELL).applyInArrow(effects, EFFECTS))
    chosen = lean.groupBy(*CELL).cogroup(states.groupBy(*CELL)).applyInArrow(pick, "symbol string, timeframe string, param_id long, bar_idx long")
    return outcomes.join(chosen, [*RUN_KEY, "bar_idx"])


TRADE_COLUMNS = [
    *RUN_KEY, "entry_ts", "close_ts", "move_type", "direction", "entry_price", "close_price", "sl", "tp", "liq_price", "leverage",
    "score", "hit_rate", "n_types_signaling", "pnl", "pnl_pct", "close_reason", "bars_held", "entry_idx", "exit_idx", "raw_pnl", "start_capital",
]


def _scored(types: list, values: pa.ListArray, n: int, width: int) -> list[dict]:
    """Per type its strengths and, for every rung from the strongest condition down, score and share of conditions met by each bar."""
    flat = values.flatten()
    known = ~np.asarray(flat.is_null()).reshape(n, width)
    v = flat.to_numpy(zero_copy_only=False).reshape(n, width)
    out = []
    for t in types:
        conds = t["conds"]
        at = np.array([x["p"] for x in conds])
        base, above, strength = (np.array([x[k] for x in conds]) for k in ("base", "above", "t"))
        x, there = v[:, at], known[:, at]
        # NaN counts as larger than any number, as it does in SQL
        met = there & np.where(above[None, :], (x > base) | np.isnan(x), x < base)
        total = np.cumsum(there, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.cumsum(met, axis=1) / total
        out.append({"t": strength, "score": np.cumsum(np.where(met, strength, 0.0), axis=1), "share": share, "move_type": t["move_type"], "long": t["direction"] == "LONG"})
    return out


def _best(scored: list[dict], p: dict, n: int) -> tuple[np.ndarray, ...]:
    """Bars with a signal under one parameter set, and its score, share, type and the number of types that signal."""
    best, share, kind, count = np.zeros(n), np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
    for i, t in enumerate(scored):
        rung = int(np.searchsorted(-t["t"], -p["t_threshold"], side="right")) - 1
        if rung < 0:
            continue
        score, met = t["score"][:, rung], t["share"][:, rung]
        ok = (score >= p["min_score"]) & (met >= p["min_hit_rate"])
        count += ok
        better = ok & (score > best)
        best[better], share[better], kind[better] = score[better], met[better], i
    at = np.flatnonzero(kind >= 0)
    return at, best[at], share[at], kind[at], count[at]


def _levels(p: dict, entry: np.ndarray, long: np.ndarray, start_capital: float) -> dict[str, np.ndarray | float]:
    """The numbers of add_levels for the signals of one parameter set."""
    side = np.where(long, 1.0, -1.0)
    liq_pct = max(100.0 / p["leverage"] - LIQUIDATION_BUFFER_PCT, 0.05)
    dist = entry * p["sl_pct"] / 100
    sl, tp, liq = entry - side * dist, entry + side * dist * p["tp_rr"], entry - side * (entry * liq_pct / 100)
    liquidated = np.where(long, liq > sl, liq < sl)
    risk = start_capital * p["risk_per_trade_pct"] / 100
    notional = risk / (p["sl_pct"] / 100)
    cap = start_capital * BINDABLE_SHARE
    bound = notional / p["leverage"]
    shrink = cap / bound if bound > cap else 1.0
    fee = notional * shrink * (p["fee_pct_per_side"] / 100) * 2
    return {"side": side, "dist": dist, "sl": sl, "tp": tp, "liq": liq, "liquidated": liquidated, "stop": np.where(liquidated, liq, sl), "risk": risk * shrink, "margin": min(bound, cap), "fee": fee}


RAW = ("symbol string, timeframe string, param_id long, ts timestamp, close_ts timestamp, move_type string, direction string, entry_price double, close_price double, "
       "sl double, tp double, liq_price double, leverage double, score double, hit_rate double, n_types_signaling int, pnl double, close_reason string, bars_held long, bar_idx long, exit_idx long")


def simulate(
    features: DataFrame, conditions: DataFrame, names, params: DataFrame, hold: int, start_capital: float = 100.0, chunk: int = chunks.CHUNK, sets_per_task: int = SETS_PER_TASK,
) -> DataFrame:
    """Trades of every series under every parameter set. `hold`: longest max_hold_bars.

    One group per (series, chunk, block of parameter sets) scores its bars once, reads
    every set's signals from the rungs, and finds all exits by the chunk's extremes. It
    runs twice, first for the chunks' effects on the first free bar and, once these are
    chained, for the trades. Only bars, effects and trades are shuffled, never a row per
    bar and set.
    """
    names, on = list(names), ["base_symbol", "timeframe"] if "base_symbol" in features.columns else KEY
    packed = _packed(conditions, names)
    if on != KEY:
        packed = packed.withColumnRenamed("symbol", "base_symbol")
    valid = tradable(features, *[x for x in on if x not in KEY], pack_values(names).alias("_v"))
    blocks = max(1, -(-params.count() // sets_per_task))
    grid_rows = params.groupBy(F.pmod(F.xxhash64("param_id"), F.lit(blocks)).cast("int").alias("sets")).agg(F.sort_array(F.collect_list(F.struct(*params.columns))).alias("params"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    # The head of a chunk brings what the series and the parameter sets give.
    heads = valid.where(c("v_idx") % chunk == 0).select(*dict.fromkeys([*KEY, *on]), F.floor(c("v_idx") / chunk).alias("chunk")).join(packed, on)
    heads = heads.join(series_ends(features), KEY).withColumn("sets", spread).join(grid_rows, "sets").select(*CELL, "_types", "params", "_n", "_last", "_last_ts", "_first")
    heads = written(heads, "heads")
    rows = _with_following(valid, hold, chunk).withColumn("_v", F.when(F.floor(c("v_idx") / chunk) == c("chunk"), c("_v")))
    rows = rows.withColumn("sets", spread).select(*CELL, "v_idx", "orig_idx", "ts", "high", "low", "close", "_v")
    rows = rows.repartition(chunks.chunk_tasks(features), *CELL)
    width = len(names)

    def signals(group: pa.Table, head: pa.Table):
        """Per parameter set its signals with their exits."""
        path, group = _bars_of(group, hold)
        h = head.slice(0, 1).to_pylist()[0]
        base = h["chunk"] * chunk
        v = group["v_idx"].to_numpy()
        n = int(np.searchsorted(v, base + chunk))
        scored = _scored(h["_types"], group["_v"].combine_chunks().slice(0, n), n, width)
        warm = path.index[:n] - h["_first"] >= WARM_UP_BARS
        close = group["close"].to_numpy(zero_copy_only=False).astype(float)
        long_of = np.array([t["long"] for t in scored])
        for p in h["params"]:
            at, score, share, kind, count = _best(scored, p, n)
            keep = warm[at]
            at, score, share, kind, count = (x[keep] for x in (at, score, share, kind, count))
            lv = _levels(p, close[at], long_of[kind], start_capital)
            place, why = path.exits(at, long_of[kind], lv["stop"], lv["tp"], np.full(len(at), p["max_hold_bars"]))
            exits = np.where(place < path.n, base + place, touch.NEVER)
            yield h, group, path, p, scored, (at, score, share, kind, count), lv, place, why, base + at, exits

    no_effects = to_arrow_schema(_parse_datatype_string(EFFECTS))

    def effects(key: tuple, group: pa.Table, head: pa.Table) -> pa.Table:
        if not len(group) or not len(head):
            return no_effects.empty_table()
        ids, found = [], []
        for h, _, _, p, *_, starts, exits in signals(group, head):
            ids.append(p["param_id"])
            found.append(touch.effect(starts, exits, h["chunk"] * chunk, hold))
        return pa.table({**{n: head[n][:1] for n in CELL}, "ids": pa.array([ids], pa.list_(pa.int64())), "effects": pa.array([found], pa.list_(pa.list_(pa.float64())))})

    arrow = to_arrow_schema(_parse_datatype_string(RAW))

    def trades(key: tuple, group: pa.Table, head: pa.Table) -> pa.Table:
        out = []
        if len(group) and len(head):
            free = dict(zip(head["ids"][0].as_py(), head["free"][0].as_py(), strict=True))
            for h, bars, path, p, scored, (at, score, share, kind, count), lv, place, why, starts, exits in signals(group, head):
                pick = touch.taken(starts, exits, free[p["param_id"]])
                if not pick:
                    continue
                at, score, share, kind, count, place, why = (x[pick] for x in (at, score, share, kind, count, place, why))
                close = bars["close"].to_numpy(zero_copy_only=False).astype(float)
                ts = bars["ts"].combine_chunks()
                entry, ended, there = close[at], place >= path.n, np.minimum(place, path.n - 1)
                last = h["_last"]
                price = np.where(ended, np.where(last is not None and last != 0, last or 0.0, entry), close[there])
                dead = lv["liquidated"][pick]
                reason = np.where(why == 1, np.where(dead, "LIQ", "SL"), REASONS[why])
                drift = lv["side"][pick] * (price - entry) / lv["dist"][pick] * lv["risk"]
                gross = np.where(reason == "LIQ", -lv["margin"], np.where(reason == "SL", -lv["risk"], np.where(reason == "TP", lv["risk"] * p["tp_rr"], drift)))
                exit_idx = np.where(ended, h["_n"], path.index[there])
                n = len(pick)
                close_ts = pc.if_else(pa.array(ended), pa.scalar(h["_last_ts"], ts.type), ts.take(pa.array(there)))
                out.append(pa.table([
                    pa.array([h["symbol"]] * n), pa.array([h["timeframe"]] * n), pa.array(np.full(n, p["param_id"])), ts.take(pa.array(at)), close_ts,
                    pa.array([scored[i]["move_type"] for i in kind]), pa.array(["LONG" if scored[i]["long"] else "SHORT" for i in kind]), pa.array(entry), pa.array(price),
                    pa.array(lv["sl"][pick]), pa.array(lv["tp"][pick]), pa.array(lv["liq"][pick]), pa.array(np.full(n, p["leverage"])), pa.array(score), pa.array(share),
                    pa.array(count), pa.array(gross - lv["fee"]), pa.array(reason.tolist()), pa.array(exit_idx - path.index[at]), pa.array(path.index[at]), pa.array(exit_idx),
                ], names=arrow.names).cast(arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    states = _free_bars(rows.groupBy(*CELL).cogroup(heads.groupBy(*CELL)).applyInArrow(effects, EFFECTS))
    ready = heads.join(states, CELL)
    picked = rows.groupBy(*CELL).cogroup(ready.groupBy(*CELL)).applyInArrow(trades, RAW)
    r = lambda name, d: F.round(name, d).alias(name)
    return picked.select(
        *RUN_KEY, c("ts").alias("entry_ts"), "close_ts", "move_type", "direction", r("entry_price", 4), r("close_price", 4), r("sl", 4), r("tp", 4),
        r("liq_price", 4), "leverage", r("score", 2), r("hit_rate", 3), "n_types_signaling", r("pnl", 4),
        F.round(c("pnl") / start_capital * 100, 3).alias("pnl_pct"), "close_reason", "bars_held", c("bar_idx").alias("entry_idx"), "exit_idx",
        c("pnl").alias("raw_pnl"), F.lit(float(start_capital)).alias("start_capital"))
