"""Monitoring queries: anomalies, drift, calibration, latency, rate limits, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators import monitor as MO
from gleanery.operators import runs as R
from gleanery.plans.registry import query, r, table
from gleanery.plans.retrieval import VEC, vectors
from gleanery.streaming import monitors as ST

DIMS = f"{VEC}, x AS (SELECT doc_id, label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM e)"
STATS = f"{DIMS}, st AS (SELECT d, avg(x) AS m, stddev_pop(x) AS s, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM x WHERE label < 5 GROUP BY d)"


def reference(spark, sf) -> DataFrame:
    return vectors(spark, sf).where("label < 5")


@query(f"WITH {STATS}, z AS (SELECT doc_id, avg(abs(x - m) / greatest(s, 1e-10)) AS score FROM x JOIN st USING (d) GROUP BY 1) SELECT doc_id, {r('score')} AS score, score > 0.9 AS is_anomaly FROM z")
def anomaly_zscore(spark, sf):
    return MO.detect(vectors(spark, sf), reference(spark, sf), "zscore", 0.9)


@query(f"WITH {STATS}, z AS (SELECT doc_id, avg((greatest(0, q1 - x) + greatest(0, x - q3)) / greatest(q3 - q1, 1e-10)) AS score FROM x JOIN st USING (d) GROUP BY 1) SELECT doc_id, {r('score')} AS score, score > 0.3 AS is_anomaly FROM z")
def anomaly_iqr(spark, sf):
    return MO.detect(vectors(spark, sf), reference(spark, sf), "iqr", 0.3)


@query(f"WITH {STATS}, ds AS (SELECT doc_id, label, sqrt(sum(pow(x - m, 2))) AS d FROM x JOIN st USING (d) GROUP BY ALL), ms AS (SELECT avg(d) AS m, stddev_pop(d) AS s FROM ds WHERE label < 5) SELECT doc_id, {r('abs((d - m) / s)')} AS score, abs((d - m) / s) > 2 AS is_anomaly FROM ds, ms")
def anomaly_isolation(spark, sf):
    return MO.detect(vectors(spark, sf), reference(spark, sf), "isolation", 2.0)


@query(f"WITH {VEC}, p AS (SELECT a.doc_id, b.doc_id AS rd, list_distance(a.v, b.v) AS d FROM e a, e b WHERE b.label < 5), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, rd) AS n FROM p), z AS (SELECT doc_id, avg(d) AS score FROM k WHERE n <= 10 GROUP BY 1) SELECT doc_id, {r('score')} AS score, score > 1.2 AS is_anomaly FROM z")
def anomaly_knn(spark, sf):
    return MO.detect(vectors(spark, sf), reference(spark, sf), "lof", 1.2)


@query()
def anomaly_mahalanobis(spark, sf):
    return MO.detect(vectors(spark, sf), reference(spark, sf), "mahalanobis", 9.0)


@query(f"WITH {STATS}, z AS (SELECT doc_id, avg(abs(x - m) / greatest(s, 1e-10)) AS score FROM x JOIN st USING (d) GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (score > 0.9) AS n_anomalies, {r('(count(*) FILTER (score > 0.9))::DOUBLE / count(*)')} AS anomaly_rate FROM z")
def anomaly_rate(spark, sf):
    return MO.anomaly_rate(MO.detect(vectors(spark, sf), reference(spark, sf), "zscore", 0.9))


DRIFT = f"{DIMS}, g AS (SELECT d - 1 AS dim, avg(x) FILTER (label < 5) AS m0, avg(x) FILTER (label >= 5) AS m1, stddev_pop(x) FILTER (label < 5) AS s0, stddev_pop(x) FILTER (label >= 5) AS s1 FROM x GROUP BY d), dd AS (SELECT dim, abs(m1 - m0) / greatest(sqrt((s0 * s0 + s1 * s1) / 2), 1e-10) AS score FROM g)"


@query(f"WITH {DRIFT} SELECT dim, {r('score')} AS score FROM dd")
def drift_dims(spark, sf):
    return MO.drift_dims(reference(spark, sf), vectors(spark, sf).where("label >= 5"))


@query(f"WITH {DRIFT} SELECT {r('sqrt(avg(score * score))')} AS drift_score, sqrt(avg(score * score)) > 0.1 AS is_drifted FROM dd")
def drift_score(spark, sf):
    return MO.drift(reference(spark, sf), vectors(spark, sf).where("label >= 5"))


@query(f"WITH {DIMS}, w AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS w FROM e), g AS (SELECT w, d, avg(x) AS m, stddev_pop(x) AS s FROM x JOIN w USING (doc_id) GROUP BY ALL HAVING count(*) = 100), j AS (SELECT a.w AS window_id, sqrt(avg(pow(abs(a.m - b.m) / greatest(sqrt((a.s * a.s + b.s * b.s) / 2), 1e-10), 2))) AS score FROM g a JOIN g b ON b.w = a.w - 1 AND b.d = a.d GROUP BY a.w) SELECT window_id, {r('score')} AS drift_score, score > 0.1 AS is_drifted FROM j")
def window_drift(spark, sf):
    return MO.window_drift(vectors(spark, sf), "doc_id", 100)


EV = "ev AS (SELECT value AS x, ts >= TIMESTAMP '2024-01-16' AS cur FROM events)"
EDGE = "(x >= lo + (hi - lo) / 10 * {i})::INT"
PSI = f"{EV}, rg AS (SELECT min(x) AS lo, max(x) AS hi, count(*) FILTER (NOT cur) AS nb, count(*) FILTER (cur) AS nc FROM ev), bn AS (SELECT {' + '.join(EDGE.format(i=i) for i in range(1, 10))} AS bin, cur FROM ev, rg), ct AS (SELECT b.bin, count(bn.bin) FILTER (NOT cur) AS b, count(bn.bin) FILTER (cur) AS c FROM range(10) b(bin) LEFT JOIN bn USING (bin) GROUP BY 1), pb AS (SELECT bin, b, c, greatest(b::DOUBLE / nb, 1e-6) AS bp, greatest(c::DOUBLE / nc, 1e-6) AS cp FROM ct, rg)"


def values(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("value").alias("x"), (F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("is_current"))


@query(f"WITH {PSI} SELECT bin, b AS baseline_count, c AS current_count, {r('bp')} AS baseline_pct, {r('cp')} AS current_pct, {r('(cp - bp) * ln(cp / bp)')} AS contribution FROM pb")
def psi_bins(spark, sf):
    return MO.psi_bins(values(spark, sf))


@query(f"WITH {PSI}, s AS (SELECT sum((cp - bp) * ln(cp / bp)) AS psi FROM pb) SELECT {r('psi')} AS psi, CASE WHEN psi < 0.1 THEN 'low' WHEN psi < 0.25 THEN 'moderate' ELSE 'high' END AS severity FROM s")
def psi_events(spark, sf):
    return MO.psi(values(spark, sf))


CAL = "s AS (SELECT least(n_chars, 4000) / 4000.0::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id)), b AS (SELECT " + " + ".join(f"(score >= (0.0::DOUBLE + (1.0::DOUBLE - 0.0::DOUBLE) / 10 * {i}))::INT" for i in range(1, 10)) + " AS bin, * FROM s), g AS (SELECT bin, count(*) AS n, avg(score) AS sc, avg(label::DOUBLE) AS pr FROM b GROUP BY bin)"


def scored(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return d.select((F.least("n_chars", F.lit(4000)) / F.lit(4000.0)).alias("score"), F.col("quality").alias("label"))


@query(f"WITH {CAL} SELECT bin, n AS count, {r('sc')} AS avg_score, {r('pr')} AS positive_rate, {r('abs(sc - pr)')} AS gap FROM g")
def calibration_bins(spark, sf):
    return MO.calibration_bins(scored(spark, sf))


@query(f"WITH {CAL}, e AS (SELECT sum(n * abs(sc - pr)) / sum(n) AS ece, max(abs(sc - pr)) AS mce FROM g) SELECT count(*) AS n, {r('avg(label::DOUBLE)')} AS positive_rate, {r('avg(pow(score - label, 2))')} AS brier_score, {r('any_value(ece)')} AS ece, {r('any_value(mce)')} AS mce FROM s, e")
def calibration(spark, sf):
    return MO.calibration(scored(spark, sf))


def samples(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))


@query(f"SELECT event_type AS stage, count(*) AS count, {r('sum(value)')} AS total, {r('avg(value)')} AS mean, {r('median(value)')} AS median, {r('max(value)')} AS max FROM events GROUP BY 1")
def latency_stats(spark, sf):
    return MO.stage_latency(samples(spark, sf))


@query(f"WITH x AS (SELECT event_type AS stage, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT stage, {r('max(ms) FILTER (i = floor(n * 0.5))')} AS p50, {r('CASE WHEN max(n) >= 20 THEN max(ms) FILTER (i = floor(n * 0.95::DOUBLE)) ELSE max(ms) END')} AS p95, {r('CASE WHEN max(n) >= 100 THEN max(ms) FILTER (i = floor(n * 0.99::DOUBLE)) ELSE max(ms) END')} AS p99, {r('avg(ms)')} AS mean, {r('min(ms)')} AS min, {r('max(ms)')} AS max, {r('stddev_samp(ms)')} AS std FROM x GROUP BY stage")
def latency_quantiles(spark, sf):
    return MO.latency_quantiles(samples(spark, sf))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def counters(spark, sf):
    return MO.counters(table(spark, sf, "events"), "event_type", "user_id")


@query(f"SELECT event_type, {r('arg_max(value, (ts, value))')} AS last FROM events GROUP BY 1")
def gauges(spark, sf):
    return MO.gauges(table(spark, sf, "events"), "value", "ts", "event_type")


LE = (1.0, 5.0, 10.0, 50.0, 100.0)


@query(" UNION ALL ".join([f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY 1" for b in LE] + ["SELECT event_type, '+Inf', count(*) FROM events GROUP BY 1"]))
def histogram(spark, sf):
    return MO.histogram(table(spark, sf, "events"), "event_type", "value", LE)


@query()
def token_bucket(spark, sf):
    return ST.token_bucket(table(spark, sf, "events"), capacity=5.0, refill_rate=1 / 7200)


# -- runs: one a user and event type, with that type's mean value as its metric; a user's runs follow one another --


def experiment_runs(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("start_time"), F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    parent = F.lag("run_id").over(Window.partitionBy("user_id").orderBy("event_type"))
    e = e.withColumn("run_id", name).withColumn("parent_run_id", parent)
    return e.select("run_id", "event_type", F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), "start_time", "parent_run_id", F.array("event_type").alias("tags"), F.create_map(F.lit("mean"), F.col("m"), F.lit("n"), F.col("n").cast("double")).alias("final_metrics"))


RUNS = "rn AS (SELECT user_id || '-' || event_type AS run_id, event_type, user_id, min(ts) AS start_time, avg(value) AS m, count(*) AS n FROM events GROUP BY event_type, user_id)"


@query(f"WITH {RUNS} SELECT run_id, {r('m')} AS value FROM rn ORDER BY m DESC, start_time DESC, run_id LIMIT 1")
def best_run(spark, sf):
    return R.best_run(experiment_runs(spark, sf), "mean").select("run_id", "value")


@query(f"WITH {RUNS} SELECT run_id FROM rn WHERE event_type IN ('click', 'purchase')")
def list_runs(spark, sf):
    return R.list_runs(experiment_runs(spark, sf), "completed", ["click", "purchase"]).select("run_id")


@query(f"WITH {RUNS} SELECT count(*) AS total_runs, count(*) FILTER (event_type <> 'error') AS completed, count(*) FILTER (event_type = 'error') AS failed, 0::BIGINT AS running FROM rn")
def run_summary(spark, sf):
    return R.summary(experiment_runs(spark, sf))


@query("WITH RECURSIVE l AS (SELECT '1-' || event_type AS run_id, lag('1-' || event_type) OVER (ORDER BY event_type) AS parent_run_id FROM (SELECT DISTINCT event_type FROM events WHERE user_id = 1)), up AS (SELECT 0::BIGINT AS depth, run_id, parent_run_id FROM l WHERE run_id = '1-view' UNION ALL SELECT depth + 1, l.run_id, l.parent_run_id FROM up JOIN l ON l.run_id = up.parent_run_id) SELECT depth, run_id FROM up")
def run_lineage(spark, sf):
    return R.lineage(experiment_runs(spark, sf), "1-view")


@query(f"WITH {RUNS}, p AS (SELECT 'mean' AS metric, run_id, m AS value FROM rn WHERE run_id IN ('1-click', '1-view') UNION ALL SELECT 'n', run_id, n FROM rn WHERE run_id IN ('1-click', '1-view')) SELECT p.metric, p.run_id, {r('p.value')} AS value, {r('p.value - b.value')} AS delta FROM p JOIN p b ON b.metric = p.metric AND b.run_id = '1-click'")
def compare_runs(spark, sf):
    return R.compare_runs(experiment_runs(spark, sf), ["1-click", "1-view"])
