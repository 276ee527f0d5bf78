"""Experiment runs: (run_id, name, status, start_time, parent_run_id, tags, final_metrics) and metric rows (run_id, key, value, step)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def list_runs(runs: DataFrame, status: str | None = None, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; any of the tags will do."""
    if status is not None:
        runs = runs.where(F.col("status") == status)
    if tags:
        runs = runs.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    runs = runs.orderBy(F.desc("start_time"), "run_id")
    return runs.limit(limit) if limit else runs


def best_run(runs: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """The run with the best final value; the newest wins ties."""
    r = runs.withColumn("value", F.element_at("final_metrics", metric)).where("value is not null")
    return r.orderBy(F.desc("value") if higher_is_better else F.asc("value"), F.desc("start_time"), "run_id").limit(1)


def compare_runs(runs: DataFrame, ids: list[str], baseline: str | None = None) -> DataFrame:
    """metric, run_id, value, delta to the baseline (the first id); null where either lacks the metric."""
    long = runs.where(F.col("run_id").isin(ids)).select("run_id", F.explode("final_metrics").alias("metric", "value"))
    every = long.select("metric").distinct().crossJoin(F.broadcast(runs.where(F.col("run_id").isin(ids)).select("run_id")))
    base = long.where(F.col("run_id") == (baseline or ids[0])).select("metric", F.col("value").alias("base"))
    return every.join(long, ["metric", "run_id"], "left").join(base, "metric", "left").select("metric", "run_id", "value", (F.col("value") - F.col("base")).alias("delta"))


def metric_history(metrics: DataFrame, run_id: str, key: str) -> DataFrame:
    """step, value, timestamp; steps that weren't given are numbered from 0 in order of time."""
    m = metrics.where((F.col("run_id") == run_id) & (F.col("key") == key))
    n = F.row_number().over(Window.partitionBy("run_id", "key").orderBy("timestamp")) - 1
    return m.select(F.coalesce("step", n).alias("step"), "value", "timestamp").orderBy("step")


def lineage(runs: DataFrame, run_id: str, max_depth: int = 100) -> DataFrame:
    """depth, run_id from a run up to its first ancestor; a cycle ends at the depth guard."""
    view = f"runs_{uuid.uuid4().hex}"
    runs.createOrReplaceTempView(view)
    out = runs.sparkSession.sql(
        f"WITH RECURSIVE up(depth, run_id, parent_run_id) AS (SELECT 0, run_id, parent_run_id FROM {view} WHERE run_id = :id UNION ALL "
        f"SELECT depth + 1, r.run_id, r.parent_run_id FROM up JOIN {view} r ON r.run_id = up.parent_run_id WHERE depth < {int(max_depth)}) SELECT depth, run_id FROM up",
        args={"id": run_id},
    )
    runs.sparkSession.catalog.dropTempView(view)  # the plan is resolved by now
    return out


def by_name(runs: DataFrame, name: str) -> DataFrame:
    return runs.where(F.col("name") == name).orderBy(F.desc("start_time"), "run_id").limit(1)


def latest_model(runs: DataFrame) -> DataFrame:
    """The newest completed run that names a model version."""
    return runs.where("status = 'completed' and model_version is not null").orderBy(F.desc("start_time"), "run_id").limit(1)


def without_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") != run_id)


def summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count(F.lit(1)).alias("total_runs"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "running")])
