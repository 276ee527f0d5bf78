"""Stateful streams: count-window drift, rate limiting, live counters. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_counters(events: DataFrame, *labels: str) -> DataFrame:
    """Counts a label set, for a stream in update or complete mode."""
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def windowed_average(events: DataFrame, ts: str = "ts", value: str = "value", window: str = "1 day", late: str = "1 day", *labels: str) -> DataFrame:
    """Event-time windows with a watermark; an extension beyond count windows. ts is cast: watermarks want a TIMESTAMP."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, window), *labels).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *labels, "mean", "n")


def _refill(tokens: float, last: float, now: float, rate: float, capacity: float) -> float:
    return min(capacity, tokens + max(0.0, now - last) * rate)


def token_bucket(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", capacity: float = 10.0, refill_rate: float = 1.0, cost: float = 1.0) -> DataFrame:
    """Batch: key, order, allowed, tokens of each event, in order of (ts, order) within its key. A fold over a key's events, so Python; rows of a key arrive in Arrow batches, not as one frame, so a hot key needs no more memory."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    rows = events.select(key, order, F.col(ts).cast("timestamp").cast("double").alias("__t")).repartition(key).sortWithinPartitions(key, "__t", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, last = object(), 0.0, 0.0
        for pdf in batches:
            allowed, left = [], []
            for k, t in zip(pdf[key], pdf["__t"]):
                if k != now:
                    now, tokens, last = k, capacity, t
                tokens, last = _refill(tokens, last, t, refill_rate, capacity), t
                ok = tokens >= cost
                tokens -= cost * ok
                allowed.append(ok)
                left.append(tokens)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": allowed, "tokens": left})

    return rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean, tokens double")


def token_bucket_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id", capacity: float = 10.0, refill_rate: float = 1.0, cost: float = 1.0) -> DataFrame:
    """Stream: the same, with each key's tokens in Spark's state store."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (None, None)
        for pdf in frames:
            pdf = pdf.sort_values(["__t", order])
            allowed, left = [], []
            for t in pdf["__t"]:
                tokens = capacity if tokens is None else _refill(tokens, last, t, refill_rate, capacity)
                last = t
                ok = tokens >= cost
                tokens -= cost * ok
                allowed.append(ok)
                left.append(tokens)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": allowed, "tokens": left})
        state.update((tokens, last))

    rows = events.select(key, order, F.col(ts).cast("timestamp").cast("double").alias("__t"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean, tokens double", "tokens double, last double", "append", "NoTimeout")


def retry_after(buckets: DataFrame, cost: float = 1.0, refill_rate: float = 1.0) -> DataFrame:
    """Seconds until a bucket (with tokens) has cost again."""
    return buckets.withColumn("retry_after_seconds", F.when(F.col("tokens") >= cost, 0.0).otherwise((cost - F.col("tokens")) / refill_rate))


def window_drift_stream(vectors: DataFrame, size: int = 100, threshold: float = 0.1, key: str = "stream", order: str = "doc_id") -> DataFrame:
    """Stream: key, window_id, drift_score, is_drifted at the end of each full window of size vectors of a key, against its window before. State: the sums of the open window and the moments of the last."""
    import numpy as np

    kind = vectors.schema[key].dataType.simpleString()

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, n, s1, s2, m0, v0 = state.get if state.exists else (0, 0, [], [], [], [])
        s1, s2 = np.array(s1), np.array(s2)
        out = []
        for pdf in frames:
            pdf = pdf.sort_values(order)
            for v in pdf["v"]:
                v = np.asarray(v, float)
                s1, s2, n = (v.copy(), v * v, 1) if n == 0 else (s1 + v, s2 + v * v, n + 1)
                if n == size:
                    m, var = s1 / n, np.maximum(s2 / n - (s1 / n) ** 2, 0)
                    if len(m0):
                        d = np.abs(m - np.array(m0)) / np.maximum(np.sqrt((var + np.array(v0)) / 2), 1e-10)
                        score = float(np.sqrt(np.mean(d * d)))
                        out.append((k[0], number, score, score > threshold))
                    m0, v0, number, n = m.tolist(), var.tolist(), number + 1, 0
        state.update((number, n, list(map(float, s1)), list(map(float, s2)), list(m0), list(v0)))
        yield pd.DataFrame(out, columns=[key, "window_id", "drift_score", "is_drifted"])

    rows = vectors.select(key, order, F.col("embedding").cast("array<double>").alias("v"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, window_id bigint, drift_score double, is_drifted boolean", "number bigint, n bigint, s1 array<double>, s2 array<double>, m0 array<double>, v0 array<double>", "append", "NoTimeout")
