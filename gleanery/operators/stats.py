"""Significance tests, gates and comparisons of per-query metrics (query_id, metric, value)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.search import saved


def paired(a: DataFrame, b: DataFrame, strict: bool = True) -> DataFrame:
    """metric, query_id, a, b: aligned by key; strict raises if either side has a query that the other lacks."""
    both = a.select("metric", "query_id", F.col("value").alias("a"), F.lit(1).alias("__a")).join(b.select("metric", "query_id", F.col("value").alias("b"), F.lit(1).alias("__b")), ["metric", "query_id"], "full")
    ok = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    if strict:  # in the projection: a filter would let the optimizer make this an inner join
        return both.select("metric", "query_id", F.when(ok, F.col("a")).otherwise(F.raise_error(F.lit("the systems' queries differ")).cast("double")).alias("a"), "b")
    return both.where(ok).select("metric", "query_id", "a", "b")


def outcomes(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("metric").agg(F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"), F.count_if(F.col("b") == F.col("a")).alias("ties"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count(F.lit(1)).alias("n"))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X <= k) for n fair coins, summed in log space."""
    log_fact = lambda m: F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda s, x: s + F.log(x.cast("double")))
    term = lambda j: F.exp(log_fact(n) - log_fact(j) - log_fact(n - j) + n * F.lit(math.log(0.5)))
    return F.when(k < 0, F.lit(0.0)).when(k >= n, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(0))), F.lit(0.0), lambda s, j: s + term(j)))


def sign_test(pairs: DataFrame, ties: str = "split") -> DataFrame:
    """metric, delta, p_value, n: two-sided; ties are split or dropped, halves rounded to even."""
    if ties not in ("split", "drop"):
        raise ValueError("ties must be 'split' or 'drop'")
    o = outcomes(pairs)
    wins = F.col("wins") + F.col("ties") / 2 if ties == "split" else F.col("wins").cast("double")
    n = (F.col("n") if ties == "split" else F.col("wins") + F.col("losses")).cast("int")
    o = o.withColumn("n_eff", n).withColumn("k", F.bround(F.least(wins, n - wins)).cast("int"))
    p = F.when(F.col("n_eff") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.col("k"), F.col("n_eff"))))
    return o.select("metric", (F.col("mean_b") - F.col("mean_a")).alias("delta"), p.alias("p_value"), "n")


#: Values of which every task may hold a copy, to draw from.
DRAW_VALUES = 1 << 20


def _draws(values: DataFrame, resamples: int, seed: int) -> DataFrame:
    """metric, r, mean: the mean of each bootstrap resample. The i-th draw of resample r is chosen by a hash of (seed, r, i): any task can make it. The draws of a resample are the same for all metrics of as many queries, so each task makes those of some resamples once, and the means are a product of draws and values; values beyond DRAW_VALUES are joined to their draws instead."""
    w = Window.partitionBy("metric").orderBy("query_id")
    rows = values.where("metric is not null").select("metric", "value", (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.count(F.lit(1)).over(Window.partitionBy("metric")).alias("n"))
    if values.limit(DRAW_VALUES + 1).count() > DRAW_VALUES:
        return _draws_joined(rows, resamples, seed)
    by_n: dict[int, dict] = {}
    got = rows.select("metric", "i", "n", F.col("value").cast("double").alias("value")).toArrow()
    for metric, i, n, value in zip(*(got.column(c).to_pylist() for c in ("metric", "i", "n", "value")), strict=True):
        by_n.setdefault(n, {}).setdefault(metric, np.full(n, np.nan))[i] = np.nan if value is None else value
    tables = [(n, list(cols), np.stack(list(cols.values()), 1)) for n, cols in by_n.items()]
    spark = values.sparkSession
    sent = spark.sparkContext.broadcast(tables)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column("id").to_pylist():
                for n, metrics, table in sent.value:
                    times = np.bincount([int(md5(b"%d:%d:%d" % (seed, r, i)).hexdigest()[:8], 16) % n for i in range(n)], minlength=n)
                    known = ~np.isnan(table)
                    sums, sizes = times @ np.where(known, table, 0.0), times @ known
                    means = [s / c if c else None for s, c in zip(sums.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(metrics, pa.string()), pa.array([r] * len(metrics), pa.int32()), pa.array(means, pa.float64())], ["metric", "r", "mean"])

    return spark.range(0, resamples, 1, max(1, min(64, resamples // 8))).mapInArrow(draw, "metric string, r int, mean double")


def _draws_joined(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    r = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    picks = rows.select("metric", "i", "n", r.alias("r"))
    head = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("r"), F.col("i"))), 1, 8), 16, 10).cast("bigint")
    picks = picks.select("metric", "r", F.pmod(head, F.col("n")).alias("i"))
    return picks.join(rows.select("metric", "i", "value"), ["metric", "i"]).groupBy("metric", "r").agg(F.avg("value").alias("mean"))


def bootstrap_ci(values: DataFrame, confidence: float = 0.95, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """metric, mean, lower, upper."""
    tail, values = (1 - confidence) / 2, saved(values.select("metric", "query_id", "value"))
    d = _draws(values, resamples, seed).groupBy("metric").agg(F.percentile("mean", F.lit(tail)).alias("lower"), F.percentile("mean", F.lit(1 - tail)).alias("upper"))
    return values.groupBy("metric").agg(F.avg("value").alias("mean")).join(d, "metric")


def paired_bootstrap(pairs: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """metric, delta, p_value: one-sided, the share of resampled mean differences b - a at or below 0."""
    diff = saved(pairs.select("metric", "query_id", (F.col("b") - F.col("a")).alias("value")))
    d = _draws(diff, resamples, seed).groupBy("metric").agg(F.avg((F.col("mean") <= 0).cast("double")).alias("p_value"))
    return diff.groupBy("metric").agg(F.avg("value").alias("delta")).join(d, "metric")


def compare_systems(a: DataFrame, b: DataFrame, resamples: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """One row a metric: means, deltas, outcomes, intervals, tests and the winner. The one-sided p speaks for B only, so A can win by the two-sided sign test alone; winner_one_sided keeps the narrower rule."""
    pairs = saved(paired(a, b))
    a, b = (pairs.select("metric", "query_id", F.col(c).alias("value")) for c in ("a", "b"))
    o = outcomes(pairs).withColumn("delta", F.col("mean_b") - F.col("mean_a")).withColumn("relative_delta", F.when(F.col("mean_a") == 0, 0.0).otherwise((F.col("mean_b") - F.col("mean_a")) / F.col("mean_a")))
    ci = lambda df, s, name: bootstrap_ci(df, resamples=resamples, seed=s).select("metric", F.col("lower").alias(f"{name}_lower"), F.col("upper").alias(f"{name}_upper"))
    out = o.join(ci(a, seed, "a"), "metric").join(ci(b, seed + 1, "b"), "metric").join(paired_bootstrap(pairs, resamples, seed + 2).select("metric", "p_value"), "metric").join(sign_test(pairs).select("metric", F.col("p_value").alias("sign_p_value")), "metric")
    one = F.when((F.col("p_value") < alpha) & (F.col("delta") > 0), "B").when((F.col("p_value") < alpha) & (F.col("delta") < 0), "A").otherwise("tie")
    two = F.when((F.col("sign_p_value") < alpha) & (F.col("delta") > 0), "B").when((F.col("sign_p_value") < alpha) & (F.col("delta") < 0), "A").otherwise("tie")
    return out.withColumn("winner_one_sided", one).withColumn("winner", two)


# ---- gates ----


@dataclass(frozen=True)
class Threshold:
    abs_drop: float = 0.02
    rel_drop: float = 0.05
    min_value: float = 0.0


@dataclass(frozen=True)
class GateConfig:
    default: Threshold = Threshold()
    thresholds: dict[str, Threshold] = field(default_factory=dict)
    per_query_drop: float = 0.10
    per_query_max_listed: int = 5

    @classmethod
    def strict(cls) -> GateConfig:
        return cls(Threshold(0.01, 0.02), per_query_drop=0.05)

    @classmethod
    def from_dict(cls, d: dict) -> GateConfig:
        """default_threshold or, as older files have it, default."""
        return cls(Threshold(**(d.get("default_threshold") or d.get("default") or {})), {k: Threshold(**v) for k, v in (d.get("thresholds") or {}).items()}, d.get("per_query_drop", 0.10), d.get("per_query_max_listed", 5))


def _reason(base: Column, now: Column, t: Threshold) -> Column:
    """The first rule that is broken: floor, absolute drop, relative drop."""
    return F.when(now < t.min_value, f"below floor {t.min_value:.4f}").when(now < base - t.abs_drop, f"absolute drop > {t.abs_drop:.4f}").when((base > 0) & (now < base * (1 - t.rel_drop)), f"relative drop > {t.rel_drop * 100:.1f}%")


def gate_changes(baseline: DataFrame, current: DataFrame, config: GateConfig | None = None) -> DataFrame:
    """key, baseline, current, delta, pct_delta, regressed, reason of mean metrics (metric, k, value): headline metrics, missing ones as 0, and those at shared cutoffs."""
    config = config or GateConfig()
    head = ("trec_rr", "trec_ap")
    a = baseline.select("metric", "k", F.col("value").alias("a"))
    b = current.select("metric", "k", F.col("value").alias("b"))
    both = a.join(b, ["metric", "k"], "full").where((F.col("a").isNotNull() & F.col("b").isNotNull()) | F.col("metric").isin(*head))
    both = both.select(F.when(F.col("metric") == "trec_rr", "mrr").when(F.col("metric") == "trec_ap", "map").otherwise(F.concat(F.regexp_replace("metric", "^trec_", ""), F.lit("@"), F.col("k").cast("string"))).alias("key"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    reason = _reason(F.col("a"), F.col("b"), config.default)
    for key, t in config.thresholds.items():
        reason = F.when(F.col("key") == key, _reason(F.col("a"), F.col("b"), t)).otherwise(reason)
    delta = F.col("b") - F.col("a")
    pct = F.when(F.col("a") > 0, delta / F.col("a") * 100).otherwise(0.0)
    return both.select("key", F.round("a", 6).alias("baseline"), F.round("b", 6).alias("current"), F.round(delta, 6).alias("delta"), F.round(pct, 4).alias("pct_delta"), reason.isNotNull().alias("regressed"), reason.alias("reason"))


def gate_passed(changes: DataFrame) -> DataFrame:
    return changes.agg((F.count_if("regressed") == 0).alias("passed"), F.count_if("regressed").alias("n_regressed"), F.count(F.lit(1)).alias("n_metrics"))


def gate_queries(baseline: DataFrame, current: DataFrame, config: GateConfig | None = None) -> DataFrame:
    """The queries that lost most in reciprocal rank, average precision or nDCG, up to the number to list."""
    config = config or GateConfig()
    keep = F.col("metric").isin("trec_rr", "trec_ap", "trec_ndcg")
    key = ["query_id", "metric", "k"]
    both = baseline.where(keep).dropDuplicates(key).select(*key, F.col("value").alias("baseline")).join(current.where(keep).select(*key, F.col("value").alias("current")), key)
    if config.per_query_drop <= 0:
        return both.where("false").withColumn("delta", F.lit(0.0))
    lost = both.withColumn("delta", F.col("current") - F.col("baseline")).where(F.col("baseline") - F.col("current") > config.per_query_drop)
    return lost.orderBy(F.round("delta", 9), "query_id", "metric", "k").limit(config.per_query_max_listed)


def snapshots(before: DataFrame, after: DataFrame, k: int = 10) -> DataFrame:
    """query_id, jaccard, changed_top, dropped, added of ranked lists (query_id, doc_id, rank); raises unless both have the same queries."""
    top = lambda df, name: df.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))
    both = top(before, "b").join(top(after, "a"), "query_id", "full")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    both = both.select("query_id", "b", F.when(ok, F.col("a")).otherwise(F.raise_error(F.lit("the snapshots' queries differ")).cast(both.schema["b"].dataType)).alias("a"))
    union = F.size(F.array_union("a", "b"))
    return both.select("query_id", F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union).alias("jaccard"), (~F.element_at("b", 1).eqNullSafe(F.element_at("a", 1))).alias("changed_top"), F.filter("b", lambda x: ~F.array_contains("a", x)).alias("dropped"), F.filter("a", lambda x: ~F.array_contains("b", x)).alias("added"))


def snapshot_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count(F.lit(1)).alias("n_queries"), F.count_if("changed_top").alias("changed_top"), F.coalesce(F.avg("jaccard"), F.lit(1.0)).alias("mean_jaccard"))
