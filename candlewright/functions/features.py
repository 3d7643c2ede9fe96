"""compute_features: the requested columns for every series of one timeframe."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from candlewright.core import KEY, period_scale, scaled
from candlewright.functions import composite, kernels, physics, structure, technical, volume
from candlewright.functions.registry import BASE, USER_FEATURES, Catalogue, Feature
from candlewright.operators import chunks
from candlewright.operators.chunks import CHUNK_KEY

ALL_FEATURES = [*technical.NAMES, *physics.NAMES, *structure.NAMES, *volume.NAMES, *composite.NAMES]
TEXT_FEATURES = ("dna_code", "regime")
# Running totals depend on where the table starts, so they are never candidates.
BARRED_FEATURES = ("cvd", "obv")
# Pivots look `k` bars ahead; barred from predictors unless parity is asked for.
LOOK_AHEAD_FEATURES = ("swing_high", "swing_low", "dist_to_nearest_resistance", "dist_to_nearest_support")


def candidate_features(names=None, parity: bool = True) -> list[str]:
    """Numeric columns that may enter statistics."""
    skip = set(TEXT_FEATURES) | set(BARRED_FEATURES) | (set() if parity else set(LOOK_AHEAD_FEATURES))
    return [n for n in (names or ALL_FEATURES) if n not in skip]


@lru_cache(maxsize=64)
def _catalogue(scale: float, user: tuple) -> Catalogue:
    cat = Catalogue()
    for family in (technical, physics, structure, volume, composite):
        family.define(cat, scale)
    for name in user:
        deps, build, look = USER_FEATURES[name]
        cat.column(name, deps, build, look)
    return cat


def catalogue(scale: float = 1.0) -> Catalogue:
    return _catalogue(scale, tuple(sorted(USER_FEATURES)))


def _columns_until_stuck(df: DataFrame, todo: dict[str, Feature], have: set[str]) -> DataFrame:
    """Adds every `column` feature whose inputs exist, level by level.

    A level becomes one select, so all its windows share one sort of the chunk.
    """
    while True:
        level = [f for f in todo.values() if f.stage == "column" and set(f.deps) <= have]
        if not level:
            return df
        df = df.select("*", *[f.build().alias(f.name) for f in level])
        for f in level:
            have.add(f.name)
            del todo[f.name]


def _scans(df: DataFrame, todo: dict[str, Feature], have: set[str], halo: int, size: int) -> DataFrame:
    """Adds the recurrences of `todo` and the columns they rest on, one pass per level of recurrences."""
    while todo:
        df = _columns_until_stuck(df, todo, have)
        level = [f for f in todo.values() if f.stage == "scan" and set(f.deps) <= have]
        if todo and not level:
            raise RuntimeError(f"cannot resolve {sorted(todo)}")
        if not level:
            return df
        inputs = {f.name: F.when(F.col("bar_idx") == 0, F.col(f.deps[0]) * f.kernel[2]).otherwise(F.col(f.deps[0]) * f.kernel[1]) for f in level}
        df = df.select("*", *[x.alias(f"_in_{n}") for n, x in inputs.items()])
        df = chunks.linear_scan(df, {f.name: (f"_in_{f.name}", f.kernel[0]) for f in level}, halo, size).drop(*[f"_in_{n}" for n in inputs])
        for f in level:
            have.add(f.name)
            del todo[f.name]
    return df


def _arrays(pdf: pd.DataFrame, jobs: list[Feature]) -> dict:
    data = {k: pdf[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume")}
    data |= {d: pdf[d].to_numpy(float) for j in jobs for d in j.deps if d in pdf.columns and d not in data}
    data["bar_idx"] = pdf["bar_idx"].to_numpy()
    data["own"] = ~pdf["in_halo"].to_numpy(bool)
    data["state"] = {}
    return data


def _in_order(todo: dict[str, Feature], known: Sequence[str] = ()) -> list[Feature]:
    jobs, placed = [], BASE | set(known) | {f.name for f in todo.values() if f.stage == "scan"}
    waiting = [f for f in todo.values() if f.stage == "array"]
    while waiting:
        ready = [f for f in waiting if set(f.deps) <= placed]
        if not ready:
            raise RuntimeError(f"cannot order {[f.name for f in waiting]}")
        jobs += ready
        placed |= {f.name for f in ready}
        waiting = [f for f in waiting if f.name not in placed]
    return jobs


def _run(job: Feature, data: dict) -> np.ndarray:
    fn, args = job.kernel
    with np.errstate(all="ignore"):
        return np.asarray(fn(data, *args), dtype=float)


def _array_stage(df: DataFrame, jobs: list[Feature], out_names: list[str]) -> DataFrame:
    """One Arrow pass per (series, chunk) for recurrences, kernels and machines.

    Machines need their state at the chunk's start. It comes from chunk reductions over
    the same shuffled chunks (the exchange is reused), folded per series. The band side
    depends on the bands, so it takes a second round of reductions.
    """
    cols = df.columns
    machines = {j.name: kernels.machine(j.name, *j.kernel) for j in jobs}
    machines = {n: m for n, m in machines.items() if m}
    rounds = [[n for n in machines if n != "supertrend_dir"], [n for n in machines if n == "supertrend_dir"]]
    state_cols: dict[str, str] = {}
    joined = df
    for names in rounds:
        if not names:
            continue
        needed = catalogue_closure(jobs, names)

        def effects(pdf, names=names, needed=needed, known=dict(state_cols)):
            data = _arrays(pdf, needed)
            data["state"] = {n: list(pdf[c].iloc[0]) for n, c in known.items()}
            for j in needed:
                if j.name not in names:
                    data[j.name] = _run(j, data)
            with np.errstate(all="ignore"):
                return {n: machines[n][0](data) for n in names}

        states = chunks.chunk_states(joined, effects, {n: machines[n][1:] for n in names})
        states = states.select(*CHUNK_KEY, *[F.col(n).alias(f"_s_{n}") for n in names])
        joined = joined.join(states, CHUNK_KEY)
        state_cols |= {n: f"_s_{n}" for n in names}

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("chunk", "in_halo")] + [f"`{n}` double" for n in out_names])
    keep = [c for c in cols if c not in ("chunk", "in_halo")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        data = _arrays(pdf, jobs)
        own = data["own"]
        if not own.any():
            return pd.DataFrame(columns=[*keep, *out_names])
        data["state"] = {n: list(pdf[c].iloc[0]) for n, c in state_cols.items()}
        for j in jobs:
            data[j.name] = _run(j, data)
        return pd.concat([pdf[keep], pd.DataFrame({n: data[n] for n in out_names}, index=pdf.index)], axis=1)[own]

    out = joined.groupBy(*CHUNK_KEY).applyInPandas(run, schema)
    return out.select(*keep, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in out_names])


def catalogue_closure(jobs: list[Feature], names) -> list[Feature]:
    """The jobs that `names` depend on, in running order."""
    by_name = {j.name: j for j in jobs}
    need, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n in by_name and n not in need:
            need.add(n)
            todo.extend(by_name[n].deps)
    return [j for j in jobs if j.name in need]


def compute_features(
    bars: DataFrame,
    names=None,
    timeframe: str | Sequence[str] = "1h",
    scale_multiplier: float = 1.0,
    min_bars: int = 0,
    chunk: int | None = None,
    halo: int | None = None,
    known: Sequence[str] = (),
) -> DataFrame:
    """Bars plus bar_idx plus the named columns (all of them by default).

    `bars` holds any number of series of one `timeframe`; periods are scaled from their
    one-hour values. Only what the names need is computed. Given several timeframes, the
    bars of each are scaled by their own and those of no other are returned. `known`
    columns stand in `bars` already, as those a stream carries, and are not computed.
    """
    if not isinstance(timeframe, str):
        parts = [compute_features(bars.where(F.col("timeframe") == t), names, t, scale_multiplier, min_bars, chunk, halo, known) for t in dict.fromkeys(timeframe)]
        return reduce(DataFrame.unionByName, parts)
    scale = period_scale(timeframe, scale_multiplier)
    names = list(names or ALL_FEATURES)
    cat = catalogue(scale)
    todo = cat.closure(names, known)
    jobs = _in_order(todo, known)
    ahead = scaled(3, scale, 1)

    idx = bars if "bar_idx" in bars.columns else chunks.index_bars(bars)
    if min_bars:
        keep = idx.groupBy(*KEY).agg(F.max("bar_idx").alias("_m")).where(F.col("_m") + 1 >= min_bars).select(*KEY)
        idx = idx.join(keep, KEY, "left_semi")
    base_cols = [c for c in (*KEY, "ts", "open", "high", "low", "close", "volume", "bar_idx") if c in idx.columns]
    df = idx.select(*base_cols, *known)

    have = BASE | set(known)
    pre = cat.closure([f.name for f in todo.values() if f.stage == "scan"], known)
    later = [f for f in todo.values() if f.name not in pre and f.stage == "column"]
    look = max([f.lookback for f in later], default=1) + scaled(52, scale) + scaled(26, scale)
    near = max([f.lookback for f in (*jobs, *pre.values())], default=1)
    if pre or jobs:
        # Recurrences carry over from block to block, so the halo is that of the longest window.
        size, warm = chunks.chunk_rows(max(halo or 0, near if jobs else look), chunk)
        df = _scans(chunks.with_halo(df, warm, size, ahead), dict(pre), have, warm, size)
        used = {d for f in (*later, *jobs) for d in f.deps} | set(names)
        for n in pre:
            todo.pop(n, None)
        df = df.drop(*[n for n in pre if n not in used])
        if jobs:
            outs = [f.name for f in jobs if f.name in used]
            df = _array_stage(df, jobs, outs)
            have |= {f.name for f in jobs}
            for f in jobs:
                del todo[f.name]
            if not todo:
                return df.select(*base_cols, *[n for n in names if n not in base_cols])
    if jobs or not pre:
        size, look = chunks.chunk_rows(max(halo or 0, look), chunk)
        df = chunks.with_halo(df, look, size, ahead)
    df = _columns_until_stuck(df, todo, have)
    if todo:
        raise RuntimeError(f"cannot resolve {sorted(todo)}")
    out = df.where(~F.col("in_halo"))
    picked = [n for n in names if n not in base_cols]
    return out.select(*base_cols, *picked)
