"""Monitoring of embeddings, scores and latencies: anomalies, drift, calibration, timing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import vector as V

FLOOR = 1e-10


def dims(vectors: DataFrame, *keep: str) -> DataFrame:
    """keep, dim, x: one row a component."""
    return vectors.select(*keep, F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x"))


def dimension_stats(reference: DataFrame) -> DataFrame:
    """dim, mean, std, q1, q3; a few rows, whatever the number of vectors."""
    return dims(reference).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3"))


def _arrays(stats: DataFrame, *names: str) -> DataFrame:
    """The one row of the statistics as arrays in the order of the dimensions."""
    s = F.sort_array(F.collect_list(F.struct("dim", *names)))
    def pick(name: str) -> Column:
        return F.transform("s", lambda x: x[name])

    return stats.agg(s.alias("s")).select(*[pick(n).alias(f"__{n}") for n in names])


def _mean(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.size(arr)


def zscore(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """doc_id, score: the mean over dimensions of the absolute standard score. The statistics ride along as one row, so vectors are never shuffled."""
    one = _arrays(dimension_stats(reference), "mean", "std")
    v = vectors.select("doc_id", V.doubles(F.col("embedding")).alias("v")).crossJoin(F.broadcast(one))
    z = F.transform("v", lambda x, i: F.abs(x - F.get("__mean", i)) / F.greatest(F.get("__std", i), F.lit(FLOOR)))
    return v.select("doc_id", _mean(z).alias("score"))


def iqr(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """doc_id, score: the mean over dimensions of how many interquartile ranges a component lies outside."""
    one = _arrays(dimension_stats(reference), "q1", "q3")
    v = vectors.select("doc_id", V.doubles(F.col("embedding")).alias("v")).crossJoin(F.broadcast(one))
    q1, q3 = (lambda i: F.get("__q1", i)), (lambda i: F.get("__q3", i))
    out = F.transform("v", lambda x, i: (F.greatest(F.lit(0.0), q1(i) - x) + F.greatest(F.lit(0.0), x - q3(i))) / F.greatest(q3(i) - q1(i), F.lit(FLOOR)))
    return v.select("doc_id", _mean(out).alias("score"))


def isolation(vectors: DataFrame, reference: DataFrame) -> DataFrame:
    """doc_id, score: the absolute standardised distance from the centroid."""
    one = _arrays(dimension_stats(reference), "mean")
    dist = lambda df: df.select("doc_id", V.doubles(F.col("embedding")).alias("v")).crossJoin(F.broadcast(one)).select("doc_id", V.distance(F.col("v"), F.col("__mean")).alias("d"))
    s = dist(reference).agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("s"))
    return dist(vectors).crossJoin(F.broadcast(s)).select("doc_id", F.abs(F.when(F.col("s") > FLOOR, (F.col("d") - F.col("m")) / F.col("s")).otherwise(F.col("d") - F.col("m"))).alias("score"))


def knn_distance(vectors: DataFrame, reference: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, score: the mean distance to the k nearest reference vectors (itself, at 0, if it is one of them)."""
    from gleanery.operators.search import nearest

    d = nearest(reference, vectors.select(F.col("doc_id").alias("query_id"), "embedding"), k, distance=True).select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("r"), F.col("score").alias("d"))
    w = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("d"), "r")
    return d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("doc_id").agg(F.avg("d").alias("score"))


def covariance(reference: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance): sums of tasks, of which only d x d numbers reach the driver."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy())
                n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        if n:
            yield pd.DataFrame({"i": range(len(s)), "n": n, "s": s, "g": list(g)})

    rows = reference.select(V.doubles(F.col("embedding")).alias("v")).mapInPandas(sums, "i int, n bigint, s double, g array<double>")
    rows = rows.select("i", "n", "s", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("x").alias("x")).collect()
    d = max(r["i"] for r in rows) + 1
    n = rows[0]["n"]
    mean, g = np.zeros(d), np.zeros((d, d))
    for r in rows:
        mean[r["i"]] = r["s"] / n
        g[r["i"], r["j"]] = r["x"]
    return mean, (g - n * np.outer(mean, mean)) / max(1, n - 1)


def mahalanobis(vectors: DataFrame, reference: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """doc_id, score."""
    mean, cov = covariance(reference)
    inverse = np.linalg.inv(cov + np.eye(len(mean)) * ridge)
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = np.stack(pdf["v"].to_numpy()) - mean if len(pdf) else np.zeros((0, len(mean)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.sqrt(np.einsum("ij,jk,ik->i", d, inverse, d))})

    return vectors.select("doc_id", V.doubles(F.col("embedding")).alias("v")).mapInPandas(run, f"doc_id {kind}, score double")


METHODS = {"zscore": zscore, "iqr": iqr, "isolation": isolation, "lof": knn_distance, "mahalanobis": mahalanobis}


def detect(vectors: DataFrame, reference: DataFrame, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """doc_id, score, is_anomaly (above the threshold)."""
    return METHODS[method](vectors, reference).withColumn("is_anomaly", F.col("score") > threshold)


def anomaly_rate(found: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return found.agg(n.alias("n"), F.count_if("is_anomaly").alias("n_anomalies"), F.when(n > 0, F.count_if("is_anomaly") / n).otherwise(0.0).alias("anomaly_rate"))


# ---- drift ----


def drift_dims(reference: DataFrame, current: DataFrame) -> DataFrame:
    """dim, score: the shift of the mean over the pooled deviation. Both sides in one aggregation, so no join."""
    both = dims(reference).withColumn("c", F.lit(0)).unionByName(dims(current).withColumn("c", F.lit(1)))
    m = lambda i: F.avg(F.when(F.col("c") == i, F.col("x")))
    s = lambda i: F.stddev_pop(F.when(F.col("c") == i, F.col("x")))
    g = both.groupBy("dim").agg(m(0).alias("m0"), m(1).alias("m1"), s(0).alias("s0"), s(1).alias("s1"))
    pooled = F.sqrt((F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")) / 2)
    return g.select("dim", (F.abs(F.col("m1") - F.col("m0")) / F.greatest(pooled, F.lit(FLOOR))).alias("score"))


def drift(reference: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """One row: the root mean square of the dimensions' shifts, and whether it is above the threshold."""
    return drift_dims(reference, current).agg(F.sqrt(F.avg(F.col("score") * F.col("score"))).alias("drift_score")).withColumn("is_drifted", F.col("drift_score") > threshold)


def window_drift(vectors: DataFrame, order: str, size: int = 100, threshold: float = 0.1, keys: list[str] | None = None) -> DataFrame:
    """window_id, drift_score, is_drifted of full count-based windows against the one before. The row number over all rows comes from sorted ranges and their offsets, not from one task."""
    numbered = row_numbers(vectors, order)
    n = numbered.withColumn("w", F.floor((F.col("row") - 1) / size)).select("w", F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x"))
    g = n.groupBy("w", "dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size)
    b = g.select((F.col("w") + 1).alias("w"), "dim", F.col("m").alias("m0"), F.col("s").alias("s0"))
    pooled = F.sqrt((F.col("s") * F.col("s") + F.col("s0") * F.col("s0")) / 2)
    j = g.join(b, ["w", "dim"]).select("w", (F.abs(F.col("m") - F.col("m0")) / F.greatest(pooled, F.lit(FLOOR))).alias("d"))
    return j.groupBy("w").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("drift_score")).select(F.col("w").alias("window_id"), "drift_score", (F.col("drift_score") > threshold).alias("is_drifted"))


def row_numbers(df: DataFrame, order: str) -> DataFrame:
    """row: 1-based, by order. Ranges of the key (by approximate quantiles) are numbered apart and moved by the counts before them, so no task sorts all rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(df.agg(F.percentile_approx(F.col(order), [i / n for i in range(1, n)] or [0.5], 10000)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    d = df.withColumn("__p", part)
    counts = sorted((r["__p"], r["count"]) for r in d.groupBy("__p").count().collect())
    offset, rows = 0, []
    for p, c in counts:
        rows.append((p, offset))
        offset += c
    small = df.sparkSession.createDataFrame(rows, "__p int, __o bigint")
    w = Window.partitionBy("__p").orderBy(order)
    return d.join(F.broadcast(small), "__p").withColumn("row", F.row_number().over(w) + F.col("__o")).drop("__p", "__o")


def psi_bins(values: DataFrame, n_bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """bin, baseline_count, current_count, baseline_pct, current_pct, contribution of values (x, is_current) in equal-width bins over the joint range; empty bins stay."""
    r = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_if(~F.col("is_current")).alias("nb"), F.count_if("is_current").alias("nc")).withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
    counted = values.crossJoin(F.broadcast(r)).select(V.bin_index(F.col("x"), F.col("lo"), F.col("hi"), n_bins).alias("bin"), "is_current").groupBy("bin").agg(F.count_if(~F.col("is_current")).alias("b"), F.count_if("is_current").alias("c"))
    every = values.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    j = every.join(counted, "bin", "left").crossJoin(F.broadcast(r)).select("bin", F.coalesce("b", F.lit(0)).alias("baseline_count"), F.coalesce("c", F.lit(0)).alias("current_count"), "nb", "nc")
    j = j.withColumn("baseline_pct", F.greatest(F.col("baseline_count") / F.col("nb"), F.lit(epsilon))).withColumn("current_pct", F.greatest(F.col("current_count") / F.col("nc"), F.lit(epsilon)))
    return j.select("bin", "baseline_count", "current_count", "baseline_pct", "current_pct", ((F.col("current_pct") - F.col("baseline_pct")) * F.log(F.col("current_pct") / F.col("baseline_pct"))).alias("contribution"))


def psi(values: DataFrame, **how) -> DataFrame:
    """One row: psi and its severity (low below .1, moderate below .25, high)."""
    p = psi_bins(values, **how).agg(F.sum("contribution").alias("psi"))
    return p.withColumn("severity", F.when(F.col("psi") < 0.1, "low").when(F.col("psi") < 0.25, "moderate").otherwise("high"))


def calibration_bins(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """bin, count, avg_score, positive_rate, gap of scored rows (score in [0, 1], label 0 or 1); empty bins are left out."""
    b = scored.withColumn("bin", V.bin_index(F.col("score"), F.lit(0.0), F.lit(1.0), n_bins))
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("avg_score"), F.avg(F.col("label").cast("double")).alias("positive_rate"))
    return g.withColumn("gap", F.abs(F.col("avg_score") - F.col("positive_rate")))


def calibration(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row: n, positive_rate, brier_score, expected and greatest calibration error."""
    bins = calibration_bins(scored, n_bins).agg((F.sum(F.col("count") * F.col("gap")) / F.sum("count")).alias("ece"), F.max("gap").alias("mce"))
    d = F.col("score") - F.col("label")
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("positive_rate"), F.avg(d * d).alias("brier_score")).crossJoin(bins)


# ---- timing and metrics ----


def stage_latency(samples: DataFrame) -> DataFrame:
    """stage, count, total, mean, median, max of samples (stage, ms)."""
    return samples.groupBy("stage").agg(F.count(F.lit(1)).alias("count"), F.sum("ms").alias("total"), F.avg("ms").alias("mean"), F.percentile("ms", F.lit(0.5)).alias("median"), F.max("ms").alias("max"))


def latency_quantiles(samples: DataFrame) -> DataFrame:
    """stage, p50, p95, p99, mean, min, max, std: quantiles without interpolation (the upper neighbour), p95 and p99 the maximum below 20 and 100 samples. Equal samples are counted before any are ranked, so only distinct values are sorted in a stage."""
    w = Window.partitionBy("stage")
    whole = samples.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean"), F.min("ms").alias("min"), F.max("ms").alias("max"), F.coalesce(F.stddev_samp("ms"), F.lit(0.0)).alias("std"))
    r = samples.groupBy("stage", "ms").agg(F.count(F.lit(1)).alias("c"))
    r = r.withColumn("upto", F.sum("c").over(w.orderBy("ms"))).withColumn("n", F.sum("c").over(w))
    place = lambda p: F.floor(F.col("n") * F.lit(p))
    at = lambda p: F.max(F.when((place(p) >= F.col("upto") - F.col("c")) & (place(p) < F.col("upto")), F.col("ms")))
    at = r.groupBy("stage").agg(at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    tail = lambda p, least: F.when(F.col("n") >= least, F.col(p)).otherwise(F.col("max")).alias(p)
    same = F.col("w.stage").eqNullSafe(F.col("q.stage"))
    return whole.alias("w").join(at.alias("q"), same).select("w.stage", "p50", tail("p95", 20), tail("p99", 100), "mean", "min", "max", "std")


BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(samples: DataFrame, by: str, value: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """by, le, n: cumulative counts, with +Inf as the last."""
    counts = samples.groupBy(by).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(F.lit(1)).alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return counts.select(by, F.explode(F.array(*rows)).alias("x")).select(by, "x.le", "x.n")


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def gauges(events: DataFrame, value: str, at: str, *labels: str) -> DataFrame:
    """The last value of each; ties in time by the greater value."""
    return events.groupBy(*labels).agg(F.max_by(F.col(value), F.struct(at, value)).alias("last"))


def timed(make, repeats: int = 3) -> list[float]:
    """Milliseconds that it takes to run what make() returns, to Spark's noop sink."""
    import time

    out = []
    for _ in range(repeats):
        t = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        out.append((time.perf_counter() - t) * 1000)
    return out
