"""Metrics, tests and gates over lexical runs of the benchmark items; judged by verbatim containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import metrics as E
from gleanery.operators import search as S
from gleanery.operators import stats as ST
from gleanery.plans.registry import query, r, table
from gleanery.plans.retrieval import TWO, benchmark, bm25_sql, documents, ranked_sql, two_runs

QRELS = "qrels AS (SELECT query_id, doc_id, max(grade) AS grade FROM (SELECT b.item_id AS query_id, d.doc_id, 1 + coalesce(l.quality, 0) AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT b.item_id, l.doc_id, 0 FROM benchmark b, labels l WHERE l.toxic = 1) GROUP BY ALL)"


def qrels(spark, sf) -> DataFrame:
    """A document that contains an item has grade 1, 2 if its quality is good; toxic documents are judged not relevant."""
    d, q, lab = documents(spark, sf), benchmark(spark, sf), table(spark, sf, "labels")
    hit = S.saved(S.containing(d, q)).join(lab, "doc_id", "left").select("query_id", "doc_id", (1 + F.coalesce("quality", F.lit(0))).alias("grade"))
    bad = S.compared(lab.where("toxic = 1").select("doc_id"), q.select("query_id")).select("query_id", "doc_id", F.lit(0).alias("grade"))
    return hit.unionByName(bad).groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def metrics_sql(run: str, n: str) -> str:
    """CTE m{n}: query_id, metric, k, value; run: a table of query_id, doc_id, rank."""
    per_k = {
        "trec_precision": "hits / k", "trec_recall": "hits / nullif(n_rel, 0)", "trec_dcg": "dcg", "trec_ndcg": "dcg / nullif(ideal, 0)", "rag_precision": "hits / nullif(got, 0)", "rag_rr": "1.0::DOUBLE / first_hit", "rag_ap": "ap / nullif(least(n_rel, k), 0)",
        "rag_hit": "CASE WHEN hits > 0 THEN 1 ELSE 0 END", "rag_f1": "2 * (hits / nullif(got, 0)) * (hits / nullif(n_rel, 0)) / nullif(hits / nullif(got, 0) + hits / nullif(n_rel, 0), 0)", "rag_ndcg": "bdcg / nullif(bideal, 0)", "rag_graded_ndcg": "dcg / nullif(ideal, 0)", "rag_rbp": "rbp", "rag_err": "err",
    }
    whole = {"trec_rr": "1.0::DOUBLE / first_hit", "trec_ap": "ap / nullif(n_rel, 0)", "rag_r_precision": "r_hits / nullif(n_rel, 0)", "rag_bpref": "bpref / nullif(n_rel, 0)"}
    rows = " UNION ALL ".join([f"SELECT query_id, '{m}' AS metric, k::BIGINT AS k, coalesce({x}, 0)::DOUBLE AS value FROM pk{n} WHERE k < 1000" for m, x in per_k.items()] + [f"SELECT query_id, '{m}', 0::BIGINT, coalesce({x}, 0)::DOUBLE FROM pk{n} WHERE k = 1000" for m, x in whole.items()])
    return (
        f"rel{n} AS (SELECT query_id, grade::DOUBLE AS g, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS i FROM qrels WHERE grade > 0), "
        f"nr{n} AS (SELECT item_id AS query_id, count(g)::DOUBLE AS n_rel, coalesce(max(g), 0) AS top FROM benchmark LEFT JOIN rel{n} ON query_id = item_id GROUP BY item_id), "
        f"h0{n} AS (SELECT r.query_id, r.rank, coalesce(q.grade, 0)::DOUBLE AS g, CASE WHEN q.grade <= 0 THEN 1 ELSE 0 END AS bad, n.n_rel, n.top FROM {run} r LEFT JOIN qrels q USING (query_id, doc_id) JOIN nr{n} n ON n.query_id = r.query_id), "
        f"h{n} AS (SELECT *, sum(CASE WHEN g > 0 THEN 1 ELSE 0 END) OVER w AS cum, sum(bad) OVER w AS cumbad, (pow(2, g) - 1) / pow(2, top) AS stop, coalesce(exp(sum(ln(1 - (pow(2, g) - 1) / pow(2, top))) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS survival FROM h0{n} WINDOW w AS (PARTITION BY query_id ORDER BY rank)), "
        f"ks{n} AS (SELECT unnest([1, 3, 5, 10, 1000]) AS k), "
        f"id{n} AS (SELECT query_id, k, sum(g / log2(i + 1)) AS ideal, sum(1.0::DOUBLE / log2(i + 1)) AS bideal FROM rel{n}, ks{n} WHERE i <= k GROUP BY ALL), "
        f"pk{n} AS (SELECT nr.query_id, ks.k, any_value(nr.n_rel) AS n_rel, any_value(id.ideal) AS ideal, any_value(id.bideal) AS bideal, coalesce(sum(CASE WHEN h.g > 0 THEN 1 ELSE 0 END), 0)::DOUBLE AS hits, count(h.rank)::DOUBLE AS got, coalesce(sum(h.g / log2(h.rank + 1)), 0) AS dcg, coalesce(sum(CASE WHEN h.g > 0 THEN 1.0::DOUBLE / log2(h.rank + 1) END), 0) AS bdcg, min(CASE WHEN h.g > 0 THEN h.rank END) AS first_hit, sum(CASE WHEN h.g > 0 THEN h.cum::DOUBLE / h.rank ELSE 0 END) AS ap, "
        f"0.2::DOUBLE * sum(CASE WHEN h.g > 0 THEN pow(0.8::DOUBLE, h.rank - 1) END) AS rbp, sum(h.survival * h.stop / h.rank) AS err, sum(CASE WHEN h.g > 0 AND h.rank <= h.n_rel THEN 1 ELSE 0 END)::DOUBLE AS r_hits, sum(CASE WHEN h.g > 0 THEN 1 - least(h.cumbad, h.n_rel) / h.n_rel END) AS bpref "
        f"FROM nr{n} nr CROSS JOIN ks{n} ks LEFT JOIN h{n} h ON h.query_id = nr.query_id AND h.rank <= ks.k LEFT JOIN id{n} id ON id.query_id = nr.query_id AND id.k = ks.k GROUP BY nr.query_id, ks.k), m{n} AS ({rows})"
    )


ONE = f"{bm25_sql()}, {QRELS}, ra AS ({ranked_sql('SELECT * FROM scored', 20)}), {metrics_sql('ra', '1')}"
BOTH = f"{TWO}, {QRELS}, {metrics_sql('ra', '1')}, {metrics_sql('rb', '2')}"


def metrics(spark, sf) -> DataFrame:
    return E.per_query(S.bm25_topk(documents(spark, sf), benchmark(spark, sf), 20), qrels(spark, sf), benchmark(spark, sf))


def two_metrics(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Of both runs in one job."""
    runs, q = two_runs(spark, sf), benchmark(spark, sf)
    rel = qrels(spark, sf)
    return tuple(E.per_query(runs.where(F.col("run_id") == name).drop("run_id"), rel, q) for name in ("a", "b"))


@query(f"WITH {ONE} SELECT query_id, metric, k, {r('value')} AS value FROM m1")
def eval_metrics_per_query(spark, sf):
    return metrics(spark, sf)


@query(f"WITH {ONE} SELECT metric, k, {r('avg(value)')} AS value FROM m1 GROUP BY ALL")
def eval_metrics_mean(spark, sf):
    return E.means(metrics(spark, sf))


@query(f"WITH {ONE} SELECT k, {r('exp(avg(ln(value + 0.00001::DOUBLE))) - 0.00001::DOUBLE')} AS value FROM m1 WHERE metric = 'rag_ap' GROUP BY k")
def eval_gmap(spark, sf):
    return E.geometric_map(metrics(spark, sf))


@query(f"WITH {ONE} SELECT p.query_id, {r('p.value')} AS precision, {r('c.value')} AS recall, {r('f.value')} AS rr, {r('n.value')} AS ndcg FROM m1 p JOIN m1 c USING (query_id) JOIN m1 f USING (query_id) JOIN m1 n USING (query_id) WHERE p.metric = 'rag_precision' AND p.k = 10 AND c.metric = 'trec_recall' AND c.k = 10 AND f.metric = 'rag_rr' AND f.k = 10 AND n.metric = 'rag_ndcg' AND n.k = 10 AND EXISTS (SELECT 1 FROM qrels q WHERE q.query_id = p.query_id)")
def search_quality(spark, sf):
    return E.search_quality(S.bm25_topk(documents(spark, sf), benchmark(spark, sf), 20), qrels(spark, sf), 10)


@query(f"WITH {BOTH}, l AS (SELECT 'a' AS model, * FROM m1 UNION ALL SELECT 'b', * FROM m2), g AS (SELECT model, avg(value) AS mrr FROM l WHERE metric = 'trec_rr' GROUP BY model) SELECT model, {r('mrr')} AS mrr, row_number() OVER (ORDER BY ROUND(mrr, 9) DESC, model) AS rank FROM g")
def model_ranking(spark, sf):
    a, b = two_metrics(spark, sf)
    return E.model_ranking(a.withColumn("model", F.lit("a")).unionByName(b.withColumn("model", F.lit("b"))))


# -- comparisons of the two runs --

NAMES = "CASE metric WHEN 'trec_rr' THEN 'mrr' WHEN 'trec_ap' THEN 'map' ELSE replace(metric, 'trec_', '') || '@' || k END"
GATED = "('trec_rr', 'trec_ap', 'trec_ndcg', 'trec_precision', 'trec_recall')"


@query(
    f"WITH {BOTH}, ma AS (SELECT metric, k, avg(value) AS a FROM m1 WHERE metric IN {GATED} GROUP BY ALL), mb AS (SELECT metric, k, avg(value) AS b FROM m2 WHERE metric IN {GATED} GROUP BY ALL), j AS (SELECT {NAMES} AS key, a, b, CASE WHEN b < 0 THEN 'below floor 0.0000' WHEN b < a - 0.02::DOUBLE THEN 'absolute drop > 0.0200' WHEN a > 0 AND b < a * 0.95::DOUBLE THEN 'relative drop > 5.0%' END AS reason FROM ma JOIN mb USING (metric, k)) "
    f"SELECT key, {r('a')} AS baseline, {r('b')} AS current, {r('b - a')} AS delta, ROUND(CASE WHEN a > 0 THEN (b - a) / a * 100 ELSE 0 END, 4) + 0.0::DOUBLE AS pct_delta, reason IS NOT NULL AS regressed, reason FROM j"
)
def gate_changes(spark, sf):
    a, b = two_metrics(spark, sf)
    keep = F.col("metric").isin("trec_rr", "trec_ap", "trec_ndcg", "trec_precision", "trec_recall")
    return ST.gate_changes(E.means(a.where(keep)), E.means(b.where(keep)))


@query(f"WITH {BOTH}, d AS (SELECT a.query_id, a.metric, a.k, a.value AS baseline, b.value AS current, b.value - a.value AS delta FROM m1 a JOIN m2 b USING (query_id, metric, k) WHERE metric IN ('trec_rr', 'trec_ap', 'trec_ndcg') AND a.value - b.value > 0.1::DOUBLE) SELECT query_id, metric, k, {r('baseline')} AS baseline, {r('current')} AS current, {r('delta')} AS delta FROM d ORDER BY ROUND(d.delta, 9), query_id, metric, k LIMIT 5")
def gate_per_query(spark, sf):
    a, b = two_metrics(spark, sf)
    return ST.gate_queries(a, b)


PAIRED = f"{BOTH}, p AS (SELECT a.metric || '@' || a.k AS metric, a.query_id, a.value AS a, b.value AS b FROM m1 a JOIN m2 b USING (query_id, metric, k))"


def pairs(spark, sf) -> DataFrame:
    a, b = (m.select(F.concat_ws("@", "metric", F.col("k").cast("string")).alias("metric"), "query_id", "value") for m in two_metrics(spark, sf))
    return ST.paired(a, b)


OUTCOMES = "o AS (SELECT metric, count(*) FILTER (b > a) AS wins, count(*) FILTER (b < a) AS losses, count(*) FILTER (b = a) AS ties, avg(a) AS mean_a, avg(b) AS mean_b, count(*) AS n FROM p GROUP BY metric)"


@query(f"WITH {PAIRED}, {OUTCOMES} SELECT metric, wins, losses, ties, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b, n FROM o")
def ab_outcomes(spark, sf):
    return ST.outcomes(pairs(spark, sf))


@query(
    f"WITH {PAIRED}, {OUTCOMES}, s AS (SELECT *, least(wins + ties / 2.0::DOUBLE, n - (wins + ties / 2.0::DOUBLE)) AS k0 FROM o), t AS (SELECT *, CASE WHEN k0 - floor(k0) = 0.5 THEN 2 * round(k0 / 2) ELSE round(k0) END::BIGINT AS k FROM s), "
    f"lf AS (SELECT i, coalesce(sum(ln(i::DOUBLE)) OVER (ORDER BY i), 0) AS f FROM range(1, 2000) x(i) UNION ALL SELECT 0, 0), c AS (SELECT t.metric, sum(exp(fn.f - fj.f - fm.f + t.n * ln(0.5::DOUBLE))) AS cdf FROM t JOIN lf fj ON fj.i <= t.k JOIN lf fn ON fn.i = t.n JOIN lf fm ON fm.i = t.n - fj.i GROUP BY t.metric) SELECT metric, {r('mean_b - mean_a')} AS delta, {r('least(1, 2 * CASE WHEN k >= n THEN 1 ELSE cdf END)')} AS p_value, n FROM t JOIN c USING (metric)"
)
def sign_test(spark, sf):
    return ST.sign_test(pairs(spark, sf))


def draws(src: str, seed: int, n: int) -> str:
    """CTE of the means of n resamples a metric, drawn by hash."""
    return f"SELECT metric, r, avg(value) AS mean FROM (SELECT w.metric, g.r, v.value FROM (SELECT metric, row_number() OVER (PARTITION BY metric ORDER BY query_id) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM {src}) w CROSS JOIN range({n}) g(r) JOIN (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY query_id) - 1 AS i FROM {src}) v ON v.metric = w.metric AND v.i = ('0x' || substr(md5('{seed}:' || g.r || ':' || w.i), 1, 8))::BIGINT % w.n) GROUP BY ALL"


RR = "metric IN ('trec_rr@0', 'trec_ap@0')"


@query(f"WITH {PAIRED}, x AS (SELECT metric, query_id, a AS value FROM p WHERE {RR}), d AS ({draws('x', 42, 500)}), q AS (SELECT metric, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM d GROUP BY metric) SELECT metric, {r('avg(value)')} AS mean, {r('any_value(lo)')} AS lower, {r('any_value(hi)')} AS upper FROM x JOIN q USING (metric) GROUP BY metric")
def bootstrap_ci(spark, sf):
    return ST.bootstrap_ci(pairs(spark, sf).where(RR).select("metric", "query_id", F.col("a").alias("value")), resamples=500)


@query(f"WITH {PAIRED}, x AS (SELECT metric, query_id, b - a AS value FROM p WHERE {RR}), d AS ({draws('x', 42, 500)}), q AS (SELECT metric, avg(CASE WHEN mean <= 0 THEN 1.0::DOUBLE ELSE 0 END) AS pv FROM d GROUP BY metric) SELECT metric, {r('avg(value)')} AS delta, {r('any_value(pv)')} AS p_value FROM x JOIN q USING (metric) GROUP BY metric")
def paired_bootstrap(spark, sf):
    return ST.paired_bootstrap(pairs(spark, sf).where(RR), resamples=500)


@query()
def ab_compare(spark, sf):
    a, b = (m.select(F.concat_ws("@", "metric", F.col("k").cast("string")).alias("metric"), "query_id", "value") for m in two_metrics(spark, sf))
    return ST.compare_systems(a, b)


SNAP = f"{TWO}, la AS (SELECT query_id, list(doc_id ORDER BY rank) AS b FROM ra WHERE rank <= 10 GROUP BY 1), lb AS (SELECT query_id, list(doc_id ORDER BY rank) AS a FROM rb WHERE rank <= 10 GROUP BY 1), s AS (SELECT query_id, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS jaccard, a[1] <> b[1] AS changed_top, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS dropped, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS added FROM la JOIN lb USING (query_id))"


def snaps(spark, sf) -> DataFrame:
    runs = two_runs(spark, sf)
    return ST.snapshots(runs.where("run_id = 'a'"), runs.where("run_id = 'b'"), 10)


@query(f"WITH {SNAP} SELECT query_id, {r('jaccard')} AS jaccard, changed_top, dropped, added FROM s")
def snapshot_regression(spark, sf):
    ids = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return snaps(spark, sf).select("query_id", "jaccard", "changed_top", ids("dropped"), ids("added"))


@query(f"WITH {SNAP} SELECT count(*) AS n_queries, count(*) FILTER (changed_top) AS changed_top, {r('avg(jaccard)')} AS mean_jaccard FROM s")
def snapshot_summary(spark, sf):
    return ST.snapshot_summary(snaps(spark, sf))
