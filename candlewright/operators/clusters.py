"""Clusters of events and look-ups of similar past events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from candlewright.core import KEY
from candlewright.sources.tables import scratch_path

c = F.col


def robust_scaled(df: DataFrame, names, group=()) -> DataFrame:
    """(x - median) / (q75 - q25) per group; NULL counts as 0, a zero spread as 1.

    Quantiles are off by at most 1e-4 of the ranks and take bounded memory per group.
    """
    names, group = list(names), list(group)
    filled = df.select(*[x for x in df.columns if x not in names], *[F.coalesce(F.when(~F.isnan(n), c(n)), F.lit(0.0)).alias(n) for n in names])
    q = filled.groupBy(*group).agg(*[F.percentile_approx(n, [0.25, 0.5, 0.75], 10_000).alias(f"_q_{n}") for n in names])
    j = filled.join(q, group) if group else filled.crossJoin(F.broadcast(q))

    def scaled(n):
        iqr = c(f"_q_{n}")[2] - c(f"_q_{n}")[0]
        return ((c(n) - c(f"_q_{n}")[1]) / F.when(iqr == 0, 1.0).otherwise(iqr)).alias(f"_s_{n}")

    return j.select(*filled.columns, *[scaled(n) for n in names])


def _nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points (key, _x) with the cluster of the nearest of their series' centres; ties go to the first."""
    gap = lambda m: F.aggregate(F.zip_with("_x", m.x, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, d: t + d)
    best = F.array_min(F.transform("_centres", lambda m: F.struct(gap(m).alias("d"), m.cluster.alias("cluster"))))
    return points.join(centres, KEY).withColumn("cluster", best.cluster).drop("_centres")


def k_means(points: DataFrame, size: int, k: int = 4, rounds: int = 10) -> DataFrame:
    """Lloyd steps for every series at once: points (key, _x of length size) with their cluster.

    A series with fewer than k points gets half as many clusters as points. Seeds are the
    different points with the smallest hashes, so a run can be repeated. Each step is one
    sum per cluster, combined on the map side; only the centres, k per series, are written.
    """
    number = points.groupBy(*KEY).agg(F.count("*").alias("_n")).select(*KEY, F.when(c("_n") < k, F.greatest(F.lit(1), F.floor(c("_n") / 2))).otherwise(k).alias("_k"))
    w = Window.partitionBy(*KEY).orderBy(F.xxhash64("_x"), "_x")
    seeds = points.select(*KEY, "_x").distinct().withColumn("_r", F.row_number().over(w)).where(c("_r") <= k).join(number, KEY).where("_r <= _k")
    own = seeds.select(*KEY, (c("_r") - 1).cast("int").alias("cluster"), c("_x").alias("x"))
    spark = points.sparkSession
    for step in range(rounds + 1):
        centres = own.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("cluster", "x"))).alias("_centres"))
        path = scratch_path(spark, "centres")
        centres.write.parquet(path)
        assigned = _nearest(points, spark.read.schema(centres.schema).parquet(path))
        if step < rounds:
            own = assigned.groupBy(*KEY, "cluster").agg(F.array(*[F.avg(F.get("_x", F.lit(i))) for i in range(size)]).alias("x"))
    return assigned


def cluster_events(vectors: DataFrame, names, k: int = 4, min_t: float = 1.5, top: int = 12) -> DataFrame:
    """k-means per series over robust-scaled event vectors, each cluster described against the rest of its series.

    Sums for "the rest" are the totals minus the cluster's own, so nothing is scanned
    twice per cluster.
    """
    names = list(names)
    s = robust_scaled(vectors.drop("cluster"), names, KEY)
    labelled = k_means(s.withColumn("_x", F.array(*[c(f"_s_{n}") for n in names])), len(names), k)
    one = [*KEY, "cluster"]
    long = labelled.select(*one, *names).unpivot(one, names, "feature", "value")
    per = long.groupBy(*one, "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("var"))
    tot = per.groupBy(*KEY, "feature").agg(F.sum("n").alias("n_all"), (F.sum(c("n") * c("mean")) / F.sum("n")).alias("mean_all"))
    per = per.join(tot, [*KEY, "feature"]).withColumn("_d", c("mean") - c("mean_all"))
    own_ss = c("n") * (c("var") + c("_d") * c("_d"))
    per = per.join(per.groupBy(*KEY, "feature").agg(F.sum(own_ss).alias("ss_all")), [*KEY, "feature"])
    p = per.withColumn("n_rest", c("n_all") - c("n")).where((c("n_rest") >= 2) & (c("n") >= 2) & (F.sqrt("var") >= 1e-10))
    p = p.withColumn("mean_rest", (c("n_all") * c("mean_all") - c("n") * c("mean")) / c("n_rest"))
    shift = c("mean_rest") - c("mean_all")
    p = p.withColumn("var_rest", F.greatest(c("ss_all") - own_ss - c("n_rest") * shift * shift, F.lit(0.0)) / (c("n_rest") - 1))
    se = F.sqrt(c("var") / (c("n") - 1) + c("var_rest") / c("n_rest"))
    p = p.withColumn("t_stat", F.try_divide(c("mean") - c("mean_rest"), se)).where(F.abs("t_stat") > min_t)
    w = Window.partitionBy(*one).orderBy(F.desc(F.abs("t_stat")), "feature")
    p = p.withColumn("_r", F.row_number().over(w)).where(c("_r") <= top)
    feats = p.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct(
        c("_r").alias("rank"), "feature", F.round("t_stat", 3).alias("t_stat"), F.round("mean", 4).alias("cluster_mean"), F.round("mean_rest", 4).alias("global_mean"), F.round(c("mean") - c("mean_rest"), 4).alias("diff")))).alias("key_features"))
    up = F.count_if(c("direction") == "UP")
    head = labelled.groupBy(*one).agg(
        F.count("*").alias("n_events"), F.when(up > F.count_if(c("direction") == "DOWN"), "UP").otherwise("DOWN").alias("dominant_direction"),
        F.round(F.avg("magnitude_pct"), 3).alias("avg_magnitude_pct"))
    types = labelled.groupBy(*one, "move_type").agg(F.count("*").alias("_k")).groupBy(*one).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("move_type", "_k"))))).alias("move_types"))
    return head.join(types, one).join(feats, one, "left")


def similar_events(targets: DataFrame, history: DataFrame, names, k: int = 5, min_common: int = 5, block: int = 20_000) -> DataFrame:
    """The k past events of the same series closest in direction to each target.

    Columns are centred and scaled per series, then compared by cosine. A series' history
    is cut into blocks of about `block` events, its targets go to every block, and each
    block gives its k best per target; the best of these few are kept. So a series that
    holds most events is compared by many tasks.
    """
    names = list(names)
    known = sum((c(n).isNotNull().cast("int") for n in names), F.lit(0))
    hist = robust_scaled(history.where(known >= min_common), names, KEY)
    vec = F.array(*[F.when(F.abs(c(f"_s_{n}")) < 1e300, c(f"_s_{n}")).otherwise(0.0) for n in names])
    hist = hist.withColumn("_x", vec).withColumn("_len", F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)))
    blocks = hist.groupBy(*KEY).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    hist = hist.join(blocks, KEY).withColumn("_blk", F.pmod(F.xxhash64("bar_idx"), c("_blocks")).cast("int"))
    t = targets.select(*KEY, "bar_idx").join(hist, [*KEY, "bar_idx"]).select(*KEY, c("bar_idx").alias("target_idx"), c("direction").alias("target_direction"), c("_x").alias("_tx"), c("_len").alias("_tl"), F.explode(F.sequence(F.lit(0), c("_blocks") - 1)).alias("_blk"))
    j = hist.join(t, [*KEY, "_blk"]).where(c("bar_idx") != c("target_idx"))
    dot = F.aggregate(F.zip_with("_x", "_tx", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    j = j.withColumn("similarity", F.round(F.coalesce(F.try_divide(dot, c("_len") * c("_tl")), F.lit(0.0)), 4))
    best = [F.desc("similarity"), "bar_idx"]
    j = j.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY, "target_idx", "_blk").orderBy(*best))).where(c("_r") <= k)
    w = Window.partitionBy(*KEY, "target_idx").orderBy(*best)
    return j.withColumn("position", F.row_number().over(w)).where(c("position") <= k).select(
        *KEY, "target_idx", "target_direction", "position", "bar_idx", "move_type", "direction", "magnitude_pct", "similarity")


def outlook(similar: DataFrame) -> DataFrame:
    """What similar events did: share in the same direction, median and largest size."""
    m = F.abs("magnitude_pct")
    return similar.groupBy(*KEY, "target_idx").agg(
        F.count("*").alias("n_similar"), F.round(F.avg(F.when(c("direction") == c("target_direction"), 100.0).otherwise(0.0)), 1).alias("hit_rate_pct"),
        F.round(F.percentile(m, F.lit(0.5)), 2).alias("median_magnitude"), F.round(F.max(m), 2).alias("max_magnitude"))
