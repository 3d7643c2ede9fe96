"""Sinks and stored tables. Every writer replaces or appends whole partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from candlewright.core import KEY


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder.

    Only a session on one machine, as in tests, may do without one and gets a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="candlewright-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and what follows has a plain input."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_series(df: DataFrame, path: str) -> None:
    """Partitioned by timeframe and symbol; only the partitions present are replaced.

    Rows are spread by series and time block, so a series holding most rows is written
    by many tasks.
    """
    block = F.floor(F.unix_seconds("ts") / (86400 * 365))
    (
        df.repartition(*KEY, block).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("timeframe", "symbol").parquet(path)
    )


def replace_movements(events: DataFrame, path: str) -> None:
    """Clears the series present in `events` and writes their rows."""
    write_series(events, path)


def upsert_predictors(spark: SparkSession, records: DataFrame, path: str, target: str, min_t: float = 1.5) -> DataFrame:
    """Stored predictors with these records put in by key, written to `target`."""
    key = [*KEY, "move_type", "feature"]
    new = records.where(F.abs("t_statistic") >= min_t)
    old = spark.read.parquet(path) if path else None
    merged = new if old is None else old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    merged.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def attach_drill_down(movements: DataFrame, drill: DataFrame) -> DataFrame:
    """Movements with their drill-down rows as a nested array."""
    nested = drill.groupBy(*KEY, "bar_idx").agg(F.collect_list(F.struct(*[x for x in drill.columns if x not in (*KEY, "bar_idx")])).alias("drill_down"))
    return movements.join(nested, [*KEY, "bar_idx"], "left")


def append_scan_log(events: DataFrame, bars: DataFrame, path: str) -> None:
    span = bars.groupBy(*KEY).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    n = events.groupBy(*KEY).agg(F.count("*").alias("n_movements"))
    log = span.join(n, KEY, "left").select(*KEY, "start_ts", "end_ts", F.coalesce("n_movements", F.lit(0)).alias("n_movements"), F.current_timestamp().alias("ran_at"))
    log.write.mode("append").parquet(path)


def spec_documents(conditions: DataFrame, validation: DataFrame) -> DataFrame:
    """One nested document per series with its conditions and hold-out results."""
    cond = conditions.groupBy(*KEY).agg(F.collect_list(F.struct(*[x for x in conditions.columns if x not in KEY])).alias("entry_conditions"))
    val = validation.groupBy(*KEY).agg(F.collect_list(F.struct(*[x for x in validation.columns if x not in KEY])).alias("out_of_sample"))
    return cond.join(val, KEY, "left")


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def report_rows(events: DataFrame, ranked: DataFrame, top: int = 20) -> DataFrame:
    """Report lines as (series, section, body JSON): movements and leading predictors.

    One line per item, so a series with millions of movements never becomes one row.
    """
    ev = events.select(*KEY, F.lit("movement").alias("section"), F.to_json(F.struct("ts", "move_type", "direction", "magnitude_pct", "atr_multiple")).alias("body"))
    pr = ranked.where(F.col("rank") <= top).select(*KEY, F.lit("predictor").alias("section"), F.to_json(F.struct(*[x for x in ranked.columns if x not in KEY])).alias("body"))
    return ev.unionByName(pr)


def add_configs(existing: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Configs by series; known ones stay unless `force`."""
    if force:
        return existing.join(new.select(*KEY), KEY, "left_anti").unionByName(new)
    return existing.unionByName(new.join(existing.select(*KEY), KEY, "left_anti"))


def write_ledger(trades: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = trades.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)
