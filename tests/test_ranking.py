"""Metrics, fusion, tests, gates against hand values."""

import math

import numpy as np
import pytest

from gleanery.operators import metrics as E
from gleanery.operators import search as S
from gleanery.operators import stats as ST


def metric(spark, ranked, grades, name, k=0, **how):
    run = spark.createDataFrame([("q", d, i) for i, d in enumerate(ranked, 1)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("q", d, g) for d, g in grades.items()], "query_id string, doc_id string, grade int")
    rows = E.per_query(run, rel, ks=(k or 1,), only=(name,), **how).where(f"k = {k}").collect()
    return rows[0]["value"]


@pytest.mark.parametrize(
    "ranked, grades, name, k, want",
    [
        ("abc", {"b": 1, "c": 1, "d": 1}, "rag_precision", 2, 0.5), ("abc", {"b": 1, "c": 1, "d": 1}, "trec_recall", 2, 1 / 3), ("xab", {"a": 1, "b": 1}, "rag_ap", 3, (1 / 2 + 2 / 3) / 2),
        ("abcd", {"a": 1, "b": 1}, "rag_f1", 4, 2 / 3), ("axb", {"a": 1, "b": 1}, "rag_r_precision", 0, 0.5), ("ab", {"a": 2, "b": 1}, "rag_err", 2, 0.78125), ("xyz", {"a": 1}, "trec_rr", 0, 0.0),
        ("axb", {"a": 1, "b": 1, "x": 0}, "rag_bpref", 0, 0.75), ("ab", {"a": 1, "b": 2}, "trec_ndcg", 2, (1 + 2 / math.log2(3)) / (2 + 1 / math.log2(3))),
    ],
)
def test_metric_values(spark, ranked, grades, name, k, want):
    assert metric(spark, ranked, grades, name, k) == pytest.approx(want)


def test_rbp(spark):
    assert metric(spark, "abc", {"a": 1, "b": 1, "c": 1}, "rag_rbp", 3, persistence=0.5) == pytest.approx(0.875)
    assert metric(spark, "xyc", {"c": 1}, "rag_rbp", 3, persistence=0.5) == pytest.approx(0.125)


def test_query_without_hits_scores_zero(spark):
    run = spark.createDataFrame([("a", "x", 1)], "query_id string, doc_id string, rank int")
    rel = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "query_id string, doc_id string, grade int")
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    got = {r["query_id"]: r["value"] for r in E.per_query(run, rel, q, ks=(1,), only=("trec_rr",)).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.0}


def runs(spark, **lists):
    rows = [(name, "q", d, float(s), i) for name, hits in lists.items() for i, (d, s) in enumerate(hits, 1)]
    return spark.createDataFrame(rows, "run_id string, query_id string, doc_id string, score double, rank int")


def test_fusion(spark):
    r = runs(spark, x=[("a", 0.9), ("b", 0.6)], y=[("c", 0.8), ("b", 0.2)])
    got = {x["doc_id"]: x["score"] for x in S.rrf_weighted(r, {"x": 2.0, "y": 1.0}).collect()}
    assert got["b"] == pytest.approx(2 / 62 + 1 / 62)
    same = runs(spark, x=[("a", 0.5), ("b", 0.5)], y=[("a", 0.3)])
    assert [(x["doc_id"], x["score"]) for x in S.combsum(same).orderBy("rank").collect()] == [("a", 2.0), ("b", 1.0)]
    twice = runs(spark, x=[("a", 1.0), ("a", 0.5)])
    assert S.rrf(twice).first()["score"] == pytest.approx(1 / 61 + 1 / 62) and S.rrf_weighted(twice).first()["score"] == pytest.approx(1 / 61)


def test_fusion_ignores_order_of_runs(spark):
    a = runs(spark, x=[("a", 0.9), ("b", 0.6)], y=[("c", 0.8), ("b", 0.2)])
    b = a.orderBy("score")
    assert sorted(map(tuple, S.rrf(a).collect())) == sorted(map(tuple, S.rrf(b).collect()))


def test_mmr_ends():
    rng = np.random.default_rng(0)
    c = rng.standard_normal((20, 8))
    q = rng.standard_normal(8)
    assert S.mmr_order(q, c, 5, 1.0) == list(np.argsort(-(c @ q))[:5])
    twins = np.array([[1, 0], [1, 0], [0.8, 0.6]])
    assert S.mmr_order(np.array([1, 0.1]), twins, 2, 0.3) == [0, 2]


def test_blocks_equal_broadcast(spark):
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(60)], "doc_id long, embedding array<double>")
    q = v.select("doc_id", "embedding").withColumnRenamed("doc_id", "query_id")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    left, right = v.select("doc_id"), q.select("query_id")
    assert pairs(S.compared(left, right)) == pairs(S.compared(left, right, max_rows=10, block_rows=7))
    a, b = S.dense_topk(v, q, 3), S.dense_topk_blocks(v, q, 3)
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())
    assert key(a) == key(b)


def values(spark, xs, metric="m"):
    return spark.createDataFrame([(metric, i, float(x)) for i, x in enumerate(xs)], "metric string, query_id int, value double")


def test_paired_tests(spark):
    p = ST.paired(values(spark, [0.1, 0.2, 0.3]), values(spark, [0.3, 0.4, 0.5]))
    r = ST.paired_bootstrap(p, 200).first()
    assert (r["delta"], r["p_value"]) == (pytest.approx(0.2), 0.0)
    assert ST.sign_test(p).first()["p_value"] == pytest.approx(0.25)
    with pytest.raises(Exception, match="differ"):
        ST.paired(values(spark, [1]), values(spark, [1, 2])).collect()


def test_gate(spark):
    row = lambda m, k, v: (m, k, v)
    base = spark.createDataFrame([row("trec_rr", 0, 0.9), row("trec_ndcg", 5, 0.8), row("trec_ndcg", 9, 1.0)], "metric string, k int, value double")
    now = spark.createDataFrame([row("trec_rr", 0, 0.85), row("trec_ndcg", 5, 0.79)], "metric string, k int, value double")
    got = {r["key"]: (r["regressed"], r["reason"]) for r in ST.gate_changes(base, now).collect()}
    assert got == {"mrr": (True, "absolute drop > 0.0200"), "ndcg@5": (False, None)}


def test_snapshots(spark):
    df = lambda ids: spark.createDataFrame([("q", d, i) for i, d in enumerate(ids, 1)], "query_id string, doc_id string, rank int")
    r = ST.snapshots(df(["d1", "d2", "d3"]), df(["d2", "d3", "d4"]), 3).first()
    assert (r["jaccard"], r["dropped"], r["added"], r["changed_top"]) == (0.5, ["d1"], ["d4"], True)


def test_span_explain_covers_the_documents(spark):
    from pyspark.sql import functions as F

    from gleanery.functions import text as T
    from gleanery.plans import retrieval

    sf = "/root/testdata/sf0.001"
    want = {(r["query_id"], r["doc_id"]): r["n"] for r in retrieval.explained_pairs(spark, sf).select("query_id", "doc_id", F.size(T.explain_tokens(F.col("text"))).alias("n")).collect()}
    got = {(r["query_id"], r["doc_id"]): r["n"] for r in retrieval.span_explain(spark, sf).groupBy("query_id", "doc_id").agg(F.max("end").alias("n")).collect()}
    assert want and got == want


def test_registered_over_the_whole_job(spark, monkeypatch):
    from gleanery.plans import evaluation, retrieval

    sf, asked = "/root/testdata/sf0.001", []
    monkeypatch.setattr(evaluation.ST, "compare_systems", lambda a, b, **kw: asked.append((a.select("metric").distinct().count(), kw)))
    evaluation.ab_compare(spark, sf)
    n = evaluation.two_metrics(spark, sf)[0].select("metric", "k").distinct().count()
    assert n > 2 and asked == [(n, {})]
    fit = S.kmeans
    monkeypatch.setattr(retrieval.S, "kmeans", lambda *args, **kw: asked.append(kw) or fit(*args, n_init=1, max_iter=1))
    retrieval.kmeans_fit(spark, sf)
    assert asked[1] == {}


def test_containing_and_compared_by_bytes(spark):
    from pyspark.sql import functions as F

    from gleanery.operators import search as S

    d = spark.createDataFrame([(1, "zz one two three four five six sevenish x"), (2, "ab"), (3, None), (4, "one two  three four five six seven"), (5, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "one two three four five six seven"), (2, "b"), (3, "e two  three four five six s"), (4, None), (5, "")], "query_id int, query string")
    want = sorted(map(tuple, d.crossJoin(q).where(F.contains("text", "query")).select("doc_id", "query_id").collect()))
    assert sorted(map(tuple, S.containing(d, q).collect())) == want and (1, 1) in want and (4, 3) in want
    assert S.containing(d, q.limit(0)).count() == 0
    pairs = {tuple(r) for r in S.compared(d, q).collect()}
    assert {tuple(r) for r in S.compared(d, q, max_bytes=50).collect()} == pairs and len(pairs) == 25


def test_bm25_of_empty_rows_and_repeated_terms(spark):
    import math

    from gleanery.operators import search as S

    kind = "doc_id int, text string"
    q = spark.createDataFrame([(1, "cat cat dog"), (2, None), (3, "...")], "query_id int, query string")
    assert S.bm25_scores(spark.createDataFrame([], kind), q).count() == 0
    assert S.bm25_scores(spark.createDataFrame([(1, None), (2, "")], kind), q).count() == 0
    docs = [(1, "cat sat"), (2, None), (3, "dog dog cat run"), (4, "")]
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in S.bm25_scores(spark.createDataFrame(docs, kind), q).collect()}
    bag = {i: (t or "").split() for i, t in docs}
    avg = sum(map(len, bag.values())) / len(bag)

    def part(term, words):
        df, tf = sum(term in w for w in bag.values()), words.count(term)
        return math.log((len(bag) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))

    want = {(1, i): 2 * part("cat", w) + part("dog", w) for i, w in bag.items() if w}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
