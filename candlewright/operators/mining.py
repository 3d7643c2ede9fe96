"""Event vectors, background samples and the statistics that rank predictors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from candlewright.core import KEY, ratio
from candlewright.operators import chunks, joins
from candlewright.operators.chunks import order
from candlewright.sources.tables import written

TYPE_KEY = [*KEY, "move_type"]
MIN_EVENTS = 20
DEDUP_CORRELATION = 0.85
BOOTSTRAP_DRAWS = 200


def unpivot(df: DataFrame, ids, names) -> DataFrame:
    """Long (ids, feature, value) rows; NULL values stay out."""
    wide = df.select(*ids, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(list(ids), list(names), "feature", "value").where("value is not null and not isnan(value)")


def precondition_vectors(features: DataFrame, events: DataFrame, names, lookback: int = 5) -> DataFrame:
    """Per event the NULL-skipping mean of each feature over the bars before it.

    The mean is a window aggregate computed once per bar and joined on the bar's key,
    so events never multiply by the look-back.
    """
    before = order().rowsBetween(-lookback, -1)
    df = chunks.with_halo(features.select(*KEY, "bar_idx", *[F.col(n).cast("double").alias(n) for n in names]), lookback)
    means = chunks.own_rows(df.select(*KEY, "bar_idx", "chunk", "in_halo", *[F.avg(n).over(before).alias(n) for n in names]))
    return events.join(means, [*KEY, "bar_idx"])


def event_snapshots(features: DataFrame, events: DataFrame, names, offsets=(0, 1, 3, 5)) -> DataFrame:
    """Feature values on the event bar and at fixed distances before it."""
    base = events.select(*KEY, "bar_idx", "move_type")
    return joins.at_offsets(base, features, offsets, names)


def mine(features: DataFrame, events: DataFrame, names, lookback: int = 10) -> DataFrame:
    """The movements table: each event with its maps of earlier and present values."""
    def as_map(prefix=""):
        return F.map_from_entries(F.array(*[F.struct(F.lit(n), F.col(prefix + n).cast("double")) for n in names]))

    pre = precondition_vectors(features, events.select(*KEY, "bar_idx"), names, lookback).select(*KEY, "bar_idx", as_map().alias("preconditions"))
    now = features.select(*KEY, "bar_idx", as_map().alias("during"))
    return events.join(pre, [*KEY, "bar_idx"]).join(now, [*KEY, "bar_idx"])


def background(features: DataFrame, events: DataFrame, names, lookback: int = 5, per_series: int | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """The bars of each series for each of its types, away from its events.

    All bars count. With `per_series`, a sampling parameter (600 to match older reports),
    about so many evenly spaced ones do.
    """
    sample = features.where(F.col("bar_idx") >= 50)
    if per_series is not None:
        n = lengths if lengths is not None else features.groupBy(*KEY).agg((F.max("bar_idx") + 1).alias("n_bars"))
        step = F.greatest(F.lit(1), F.floor(F.col("n_bars") / per_series))
        sample = sample.join(n, KEY).where((F.col("bar_idx") - 50) % step == 0)
    types = events.select(*TYPE_KEY).distinct()
    near = joins.near_positions(events, lookback + 2, ("move_type",))
    return (
        sample.select(*KEY, "bar_idx", *names).join(types, KEY)
        .join(near, [*TYPE_KEY, "bar_idx"], "left_anti")
    )


def _compared(st: DataFrame) -> DataFrame:
    """Statistics of each (series, type, feature) from the moments of its event vectors and its background."""
    c = F.col
    st = st.where((c("n_ev") >= 2) & (c("n_bg") >= 2) & ~((c("std_ev") < 1e-10) & (c("std_bg") < 1e-10)))
    a, b = c("var_ev") / c("n_ev"), c("var_bg") / c("n_bg")
    diff = c("mean_ev") - c("mean_bg")
    return st.select(
        *TYPE_KEY, "feature", c("n_ev").alias("n_events"), c("n_bg").alias("n_background"),
        c("mean_ev").alias("mean_before"), c("std_ev").alias("std_before"), c("mean_bg").alias("mean_all"), c("std_bg").alias("std_all"),
        ratio(diff, F.sqrt(a + b)).alias("t_statistic"),
        ratio((a + b) * (a + b), a * a / (c("n_ev") - 1) + b * b / (c("n_bg") - 1)).alias("dof"),
        (diff / (F.sqrt((c("std_ev") * c("std_ev") + c("std_bg") * c("std_bg")) / 2) + 1e-10)).alias("cohens_d"),
        (diff / (F.abs(c("mean_bg")) + 1e-10)).alias("lift_factor"),
    ).withColumn("threshold", c("mean_all") + F.signum("t_statistic") * c("std_all"))


def welch(event_vectors: DataFrame, bg: DataFrame, names) -> DataFrame:
    """Welch t, effect size, lift, threshold and hit rate per (series, type, feature)."""
    ids = [*TYPE_KEY, "bar_idx"]
    key = [*TYPE_KEY, "feature"]

    def moments(df, tag):
        return unpivot(df, ids, names).groupBy(*key).agg(
            F.count("*").alias(f"n_{tag}"), F.avg("value").alias(f"mean_{tag}"),
            F.stddev_pop("value").alias(f"std_{tag}"), F.var_samp("value").alias(f"var_{tag}"))

    st = _compared(moments(event_vectors, "ev").join(moments(bg, "bg"), key))
    c = F.col
    beyond = F.when(c("t_statistic") > 0, c("value") > c("threshold")).otherwise(c("value") < c("threshold"))
    hits = (
        unpivot(event_vectors, ids, names).join(st.select(*key, "t_statistic", "threshold"), key)
        .groupBy(*key).agg((F.avg(F.when(beyond, 1.0).otherwise(0.0)) * 100).alias("predictive_pct"))
    )
    return st.join(hits, key)


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and sum of squared distances from the mean of each column; NaN does not count."""
    there, finite = ~np.isnan(x), np.isfinite(x)
    n = there.sum(axis=0)
    # Distances from one of the values, so a column of equal values has exactly that value as its mean.
    shift = np.where(finite.any(axis=0), x[finite.argmax(axis=0), np.arange(x.shape[1])], 0.0)
    with np.errstate(all="ignore"):
        mean = shift + np.where(there, x - shift, 0.0).sum(axis=0) / n
        return n, mean, np.where(there, (x - mean) ** 2, 0.0).sum(axis=0)


def _chunk_parts(features: DataFrame, events: DataFrame, names: list[str], lookback: int) -> DataFrame:
    """What each chunk hands on, in one pass over its bars, whatever the number of types.

    A `vector` row holds an event's means over the bars before it; per type an `ev` and a `bg` row
    hold the moments of these vectors and of the bars away from its events.
    """
    reach = lookback + 2
    size, _ = chunks.chunk_rows(reach)
    bars = chunks.with_halo(features.select(*KEY, "bar_idx", *[F.col(n).cast("double").alias(n) for n in names]), reach)
    near = F.array_distinct(F.array(*[F.floor((F.col("bar_idx") + d) / size) for d in (-reach, 0, reach)]))
    at = events.select(*TYPE_KEY, "bar_idx", F.explode(near).alias("chunk"))
    every = features.select(*KEY, F.floor(F.col("bar_idx") / size).alias("chunk")).distinct()
    every = every.join(events.select(*TYPE_KEY).distinct(), KEY).select(*TYPE_KEY, F.lit(None).cast("long").alias("bar_idx"), "chunk")
    schema = "symbol string, timeframe string, move_type string, part string, n array<bigint>, mean array<double>, m2 array<double>"
    around, kinds = np.arange(-reach, reach + 1), pa.schema([
        *[(k, pa.string()) for k in (*TYPE_KEY, "part")], ("n", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])

    def reduce_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            idx = left["bar_idx"].to_numpy()
            rank = np.argsort(idx)
            idx, own = idx[rank], ~left["in_halo"].to_numpy()[rank]
            x = np.column_stack([left[n].to_numpy() for n in names])[rank]
            given = ~np.column_stack([left[n].is_null().to_numpy() for n in names])[rank]
            series = left["symbol"][0].as_py(), left["timeframe"][0].as_py()
            types, bar = right["move_type"].to_numpy(), right["bar_idx"].to_numpy().astype(float)
            for name in sorted(set(types)):
                events = bar[(types == name) & ~np.isnan(bar)].astype(np.int64)
                place = np.searchsorted(idx, events)
                place = place[(place < len(idx)) & (idx[np.minimum(place, len(idx) - 1)] == events)]
                place = place[own[place]]
                if len(place):
                    total, count = np.zeros((len(place), len(names))), np.zeros((len(place), len(names)))
                    for back in range(lookback, 0, -1):
                        row, inside = np.maximum(place - back, 0), (place >= back)[:, None]
                        total += np.where(given[row] & inside, x[row], 0.0)
                        count += given[row] & inside
                    with np.errstate(all="ignore"):
                        vectors = total / count
                    rows += [(*series, name, "vector", None, v, None) for v in vectors]
                    rows.append((*series, name, "ev", *_moments(vectors)))
                away = own & (idx >= 50) & ~np.isin(idx, (events[:, None] + around).ravel())
                if away.any():
                    rows.append((*series, name, "bg", *_moments(x[away])))
        return pa.table([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds.types)], schema=kinds)

    return bars.groupBy(*chunks.CHUNK_KEY).cogroup(at.unionByName(every).groupBy(*chunks.CHUNK_KEY)).applyInArrow(reduce_chunk, schema)


def _hits(vectors: DataFrame, limits: DataFrame, width: int) -> DataFrame:
    """Per (series, type, column's place): values beyond the limit in per cent. Tasks hand on counts."""
    def counts(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            value, level, above = (batch[k].flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for k in ("mean", "level", "above"))
            beyond = np.where(above, value > level, value < level)
            keys = pd.MultiIndex.from_arrays([batch[k].to_pandas() for k in TYPE_KEY])
            code, found = pd.factorize(keys)
            for j, key in enumerate(found):
                own = code == j
                there = ~np.isnan(value[own])
                out = {**dict(zip(TYPE_KEY, key)), "pos": np.arange(width, dtype=np.int32), "n": there.sum(axis=0), "hits": (there & beyond[own]).sum(axis=0)}
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out), preserve_index=False)

    both = vectors.join(limits, TYPE_KEY).select(*TYPE_KEY, "mean", "level", "above")
    per_batch = both.mapInArrow(counts, "symbol string, timeframe string, move_type string, pos int, n long, hits long")
    return per_batch.groupBy(*TYPE_KEY, "pos").agg((F.sum("hits") / F.sum("n") * 100).alias("predictive_pct"))


def welch_of_bars(features: DataFrame, events: DataFrame, names, lookback: int = 5) -> DataFrame:
    """`welch` of the event vectors and the whole background, from the bars themselves.

    Neither the background rows of a type nor a row per value are made: every chunk hands on
    moments per type, which are merged by their counts.
    """
    c, names = F.col, list(names)
    parts = written(_chunk_parts(features, events, names, lookback), "welch_parts")
    one = parts.where("part <> 'vector'").select(*TYPE_KEY, "part", F.posexplode(F.arrays_zip("n", "mean", "m2")).alias("pos", "m"))
    one = one.select(*TYPE_KEY, "part", "pos", "m.*").where("n > 0")
    group = Window.partitionBy(*TYPE_KEY, "part", "pos")
    shift = F.coalesce(F.min(F.when(F.abs("mean") < float("inf"), c("mean"))).over(group), F.lit(0.0))
    whole = shift + F.sum(c("n") * (c("mean") - shift)).over(group) / F.sum("n").over(group)
    one = one.withColumn("whole", whole).groupBy(*TYPE_KEY, "part", "pos").agg(
        F.sum("n").alias("n"), F.max("whole").alias("mean"), F.sum(c("m2") + c("n") * (c("mean") - c("whole")) * (c("mean") - c("whole"))).alias("m2"))

    def of(tag):
        part = one.where(c("part") == tag)
        return part.select(*TYPE_KEY, "pos", c("n").alias(f"n_{tag}"), c("mean").alias(f"mean_{tag}"), F.sqrt(c("m2") / c("n")).alias(f"std_{tag}"),
                           F.when(c("n") > 1, F.try_divide(c("m2"), c("n") - 1)).alias(f"var_{tag}"))

    place = F.element_at(F.array(*[F.lit(n) for n in names]), c("pos") + 1)
    st = written(_compared(of("ev").join(of("bg"), [*TYPE_KEY, "pos"]).withColumn("feature", place)), "welch")
    found = F.map_from_entries(F.collect_list(F.struct("feature", F.struct("threshold", "t_statistic"))))
    at = lambda field: F.array(*[F.try_element_at("_m", F.lit(n)).getField(field) for n in names])
    limits = st.groupBy(*TYPE_KEY).agg(found.alias("_m")).select(*TYPE_KEY, at("threshold").alias("level"), F.transform(at("t_statistic"), lambda t: F.coalesce(t > 0, F.lit(False))).alias("above"))
    hits = _hits(parts.where("part = 'vector'"), limits, len(names)).withColumn("feature", place).drop("pos")
    return st.join(hits, [*TYPE_KEY, "feature"])


def _log_beta(a, b):
    from math import lgamma
    g = np.vectorize(lgamma, otypes=[float])
    return g(a) + g(b) - g(a + b)


def student_tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided tail by the continued fraction of the incomplete beta function."""
    x = dof / (dof + t * t)
    a, b = dof / 2, np.full_like(dof, 0.5)
    swap = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(xx), 1 - (aa + bb) * xx / (aa + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
                    -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(all="ignore"):
        front = np.exp(aa * np.log(xx) + bb * np.log1p(-xx) - _log_beta(aa, bb)) / aa
    part = np.where(xx <= 0, 0.0, front * h)
    return np.where(swap, 1 - part, part)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=t.index)
    ok = t.notna() & dof.notna() & (dof > 0)
    if ok.any():
        out[ok] = student_tail(np.abs(t[ok].to_numpy(float)), dof[ok].to_numpy(float))
    return out


# Decimals kept per statistic in a predictor record.
DECIMALS = {
    "mean_before": 6, "std_before": 6, "mean_all": 6, "std_all": 6, "t_statistic": 4,
    "cohens_d": 4, "lift_factor": 4, "predictive_pct": 1, "threshold": 6,
}


def rank_predictors(stats: DataFrame, top: int | None = None) -> DataFrame:
    """Rounded records ranked by |t|, names breaking ties.

    The group is one (series, type): at most one row per catalogue column.
    """
    rec = stats.select(*[F.round(c, DECIMALS[c]).alias(c) if c in DECIMALS else F.col(c) for c in stats.columns])
    w = Window.partitionBy(*TYPE_KEY).orderBy(F.desc(F.abs("t_statistic")), "feature")
    df = rec.where("t_statistic is not null").withColumn("rank", F.row_number().over(w))
    return df.where(F.col("rank") <= top) if top else df


def rerank(ranked: DataFrame) -> DataFrame:
    """Consecutive ranks again after rows were dropped."""
    w = Window.partitionBy(*TYPE_KEY).orderBy("rank")
    return ranked.withColumn("rank", F.row_number().over(w))


def enough_events(events: DataFrame, at_least: int = 3) -> DataFrame:
    counts = events.groupBy(*TYPE_KEY).agg(F.count("*").alias("n_events"))
    return counts.where(F.col("n_events") >= at_least).withColumn("low_count_warning", F.col("n_events") < MIN_EVENTS)


def correlations(event_vectors: DataFrame, names) -> DataFrame:
    """Pearson r of every feature pair over the events of one type, pairwise complete.

    Each task folds its rows into sums per pair; only those sums are shuffled.
    """
    names = list(names)
    schema = "symbol string, timeframe string, move_type string, fa string, fb string, n double, sx double, sy double, sxx double, syy double, sxy double"
    ia, ib = np.triu_indices(len(names), 1)
    fa, fb = np.array(names, dtype=object)[ia], np.array(names, dtype=object)[ib]

    def sums(batches):
        for pdf in batches:
            for key, g in pdf.groupby(TYPE_KEY, sort=False):
                x = g[names].to_numpy(float)
                m = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                n, sx, sxx, sxy = m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x
                yield pd.DataFrame({
                    "symbol": key[0], "timeframe": key[1], "move_type": key[2], "fa": fa, "fb": fb,
                    "n": n[ia, ib], "sx": sx[ia, ib], "sy": sx.T[ia, ib], "sxx": sxx[ia, ib], "syy": sxx.T[ia, ib], "sxy": sxy[ia, ib]})

    wide = event_vectors.select(*TYPE_KEY, *[F.col(n).cast("double").alias(n) for n in names])
    s = wide.mapInPandas(sums, schema).groupBy(*TYPE_KEY, "fa", "fb").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    c = F.col
    cov = c("n") * c("sxy") - c("sx") * c("sy")
    var = (c("n") * c("sxx") - c("sx") * c("sx")) * (c("n") * c("syy") - c("sy") * c("sy"))
    return s.select(*TYPE_KEY, "fa", "fb", c("n").cast("long").alias("n"), F.when(var > 0, cov / F.sqrt(var)).alias("r"))


def drop_correlated(ranked: DataFrame, event_vectors: DataFrame, names, top: int | None = None, limit: float = DEDUP_CORRELATION) -> DataFrame:
    """Of two strongly correlated predictors the weaker one goes.

    The greedy pass sees one row per pair of columns of a (series, type), whose number the
    catalogue bounds; `top` narrows it to the leading ranks.
    """
    lead = (ranked if top is None else ranked.where(F.col("rank") <= top)).select(*TYPE_KEY, "feature", "rank", "t_statistic")
    a = lead.select(*TYPE_KEY, F.col("feature").alias("fa"), F.col("rank").alias("ra"), F.col("t_statistic").alias("ta"))
    b = lead.select(*TYPE_KEY, F.col("feature").alias("fb"), F.col("rank").alias("rb"), F.col("t_statistic").alias("tb"))
    strong = (
        correlations(event_vectors, names).where((F.abs("r") > limit) & (F.col("n") >= 3))
        .join(a, [*TYPE_KEY, "fa"]).join(b, [*TYPE_KEY, "fb"])
    )

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[str] = set()
        swap = pdf["ra"] > pdf["rb"]
        first = pdf["fa"].where(~swap, pdf["fb"])
        second = pdf["fb"].where(~swap, pdf["fa"])
        t = dict(zip(pdf["fa"], pdf["ta"].abs())) | dict(zip(pdf["fb"], pdf["tb"].abs()))
        lo, hi = pdf[["ra", "rb"]].min(axis=1), pdf[["ra", "rb"]].max(axis=1)
        for f, s in pd.DataFrame({"f": first, "s": second, "lo": lo, "hi": hi}).sort_values(["lo", "hi"])[["f", "s"]].itertuples(index=False):
            if f in gone or s in gone:
                continue
            gone.add(s if round(t[f], 4) >= round(t[s], 4) else f)
        out = pdf[TYPE_KEY].iloc[:1].merge(pd.DataFrame({"feature": sorted(gone)}), how="cross")
        return out

    dropped = strong.groupBy(*TYPE_KEY).applyInPandas(greedy, "symbol string, timeframe string, move_type string, feature string")
    return ranked.join(dropped, [*TYPE_KEY, "feature"], "left_anti")


@F.pandas_udf(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType())]))
def _hit_interval(n: pd.Series, pct: pd.Series, key: pd.Series) -> pd.DataFrame:
    rows = []
    for k, p, seed in zip(n, pct, key):
        draws = np.random.default_rng(abs(int(seed))).binomial(int(k), p / 100.0, BOOTSTRAP_DRAWS) / k * 100
        rows.append((round(float(np.percentile(draws, 5)), 1), round(float(np.percentile(draws, 95)), 1)))
    return pd.DataFrame(rows, columns=["lo", "hi"])


def bootstrap_hit_rate(ranked: DataFrame, top: int | None = None) -> DataFrame:
    """90 % interval of the hit rate from 200 resamples.

    Resampling n events with replacement and counting hits is a binomial draw, so the
    group's values never have to be brought together. Seeds come from the row's key.
    """
    r = ranked.where("n_events >= 5")
    if top is not None:
        r = r.withColumn("_pos", F.row_number().over(Window.partitionBy(*TYPE_KEY).orderBy("rank"))).where(F.col("_pos") <= top)
    ci = _hit_interval("n_events", "predictive_pct", F.xxhash64(*TYPE_KEY, "feature"))
    return r.withColumn("_ci", ci).select(*ranked.columns, F.col("_ci.lo").alias("hit_rate_ci_low"), F.col("_ci.hi").alias("hit_rate_ci_high"))


def regime_split(events: DataFrame, features: DataFrame) -> DataFrame:
    """Events of a type by the regime of the bar before; groups of four or more."""
    prior = joins.at_offsets(events.select(*TYPE_KEY, "bar_idx"), features, [1], ["regime"])
    counts = prior.groupBy(*TYPE_KEY, "regime").agg(F.count("*").alias("n_events"))
    total = F.sum("n_events").over(Window.partitionBy(*TYPE_KEY))
    return counts.withColumn("pct_total", F.round(F.col("n_events") / total * 100, 1)).where(F.col("n_events") >= 4)


def composite_score(ranked: DataFrame, event_vectors: DataFrame, bg: DataFrame, names, top: int = 5) -> DataFrame:
    """How many of the leading conditions events meet against background bars."""
    w = Window.partitionBy(*TYPE_KEY).orderBy("rank")
    conds = ranked.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= top).select(*TYPE_KEY, "feature", "t_statistic", "threshold")
    n_conds = conds.groupBy(*TYPE_KEY).agg(F.count("*").alias("n_conditions"))
    c = F.col
    met = F.when(c("t_statistic") > 0, c("value") > c("threshold") * 0.9).when(c("t_statistic") < 0, c("value") < c("threshold") * 1.1).otherwise(False)

    def scores(df):
        ids = [*TYPE_KEY, "bar_idx"]
        hit = unpivot(df, ids, names).join(conds, [*TYPE_KEY, "feature"]).groupBy(*ids).agg(F.count_if(met).alias("score"))
        return df.select(*ids).join(hit, ids, "left").select(*ids, F.coalesce("score", F.lit(0)).alias("score"))

    levels = n_conds.select(
        *TYPE_KEY, "n_conditions",
        F.posexplode(F.array(c("n_conditions"), c("n_conditions") - 1, c("n_conditions") - 2, F.lit(2).cast("long"), F.lit(1).cast("long"))).alias("step", "min_score"))
    # the ladder stops at the first level under one
    levels = levels.where((c("min_score") >= 1) & ((c("step") < 3) | (c("n_conditions") >= 3)))

    def rate(df, tag):
        dist = scores(df).groupBy(*TYPE_KEY, "score").agg(F.count("*").alias("n"))
        return levels.join(dist, TYPE_KEY).groupBy(*TYPE_KEY, "step").agg(
            (F.sum(F.when(c("score") >= c("min_score"), c("n")).otherwise(0)) / F.sum("n") * 100).alias(tag))

    both = levels.join(rate(event_vectors, "ev"), [*TYPE_KEY, "step"]).join(rate(bg, "bg"), [*TYPE_KEY, "step"])
    both = both.withColumn("lift", c("ev") / (c("bg") + 1e-3)).where((c("ev") >= 30) | (c("lift") >= 1.5))
    return both.groupBy(*TYPE_KEY, "n_conditions").agg(F.min_by(F.struct("min_score", "ev", "bg", "lift"), "step").alias("_b")).select(
        *TYPE_KEY, "n_conditions", "_b.min_score", F.round("_b.ev", 1).alias("event_hit_rate"),
        F.round("_b.bg", 1).alias("baseline_rate"), F.round("_b.lift", 2).alias("lift"))
