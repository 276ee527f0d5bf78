"""Lexical runs, judgments and resamples by passes over the documents, against joins and plain loops."""

import pytest
from pyspark.sql import functions as F

from gleanery.operators import profile as P
from gleanery.operators import search as S
from gleanery.operators import stats as ST
from gleanery.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries whose plans read no documents: these were read in passes whose few rows were saved.
SAVED = [
    "ab_compare", "bootstrap_ci", "paired_bootstrap", "snapshot_summary", "ab_outcomes", "sign_test", "snapshot_regression", "model_ranking", "gate_per_query", "gate_changes", "combsum", "eval_metrics_per_query", "combsum_raw", "rrf", "rrf_weighted", "eval_metrics_mean", "coverage_verdicts", "score_distribution", "eval_gmap",
]


def refuse(*args, **kw):
    raise AssertionError("a join")


def rows(df, *cols):
    return {tuple(r[c] for c in cols): r["score"] for r in df.collect()}


def test_bm25_runs_in_passes(spark, monkeypatch):
    texts = ["cat sat on a mat", "dog dog cat run", None, "", "Cat CAT the dog's mat 7", "ÉCAT über", "mat"] * 3 + ["cat sat on a mat"] * 4
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(3)
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["cat cat dog", "the mat", None, "...", "unheard", "Mat 7 dog", "sat"])], "query_id int, query string")
    params = {"a": (1.5, 0.75), "b": (0.9, 0.4)}
    for fill in (False, True):
        for k in (1, 4, 100):
            with monkeypatch.context() as m:
                m.setattr(S, "WEIGHT_CELLS", 0)
                want = rows(S.bm25_runs(docs, asked, k, params, fill), "run_id", "query_id", "doc_id", "rank")
            with monkeypatch.context() as m:
                m.setattr(S, "bm25_scores", refuse)
                m.setattr(S, "QUERY_BLOCK", 2)
                got = rows(S.bm25_runs(docs, asked, k, params, fill), "run_id", "query_id", "doc_id", "rank")
            assert got == pytest.approx(want) and len(got) > 0
    assert S.bm25_topk(docs.limit(0), asked, 3).count() == S.bm25_topk(docs, asked.limit(0), 3).count() == 0


def test_containing_in_a_pass(spark, monkeypatch):
    d = spark.createDataFrame([(1, "zz one two three four five six sevenish x"), (2, "ab"), (3, None), (4, "one two  three four five six seven"), (5, ""), (6, "é one two three four five six seven")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "one two three four five six seven"), (2, "b"), (3, "e two  three four five six s"), (4, None), (5, ""), (6, " one two three four five six seven")], "query_id int, query string")
    want = sorted(map(tuple, d.crossJoin(q).where(F.contains("text", "query")).select("doc_id", "query_id").collect()))
    with monkeypatch.context() as m:
        m.setattr(S, "BROADCAST_ROWS", 2)
        assert sorted(map(tuple, S.containing(d, q).collect())) == want
    monkeypatch.setattr(S, "_containing_joined", refuse)
    assert sorted(map(tuple, S.containing(d, q).collect())) == want and (6, 6) in want


def test_draws_of_all_metrics_at_once(spark, monkeypatch):
    values = [("m", i, i / 7) for i in range(20)] + [("n", i, None if i % 3 else -i / 3) for i in range(20)] + [("few", i, float(i)) for i in range(3)] + [("none", 1, None)]
    df = spark.createDataFrame(values, "metric string, query_id int, value double")
    means = lambda: {(r["metric"], r["r"]): r["mean"] for r in ST._draws(df, 30, 7).collect()}
    with monkeypatch.context() as m:
        m.setattr(ST, "DRAW_VALUES", 5)
        want = means()
    monkeypatch.setattr(ST, "_draws_joined", refuse)
    got = means()
    assert got.keys() == want.keys() and len(want) == 120
    assert all(got[k] == (None if want[k] is None else pytest.approx(want[k])) for k in want)


@pytest.mark.parametrize("name", SAVED)
def test_documents_are_read_in_passes(spark, name):
    assert "documents.parquet" not in catalogue.queries()[name](spark, SF)._jdf.queryExecution().simpleString()


def test_passages_leave_documents_in_place(spark):
    plan = catalogue.queries()["rag_prompt"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_text_is_folded_once(spark):
    texts = ["", " ", "\u00a0\t", "\u3000\n", " x", "X  ", None, "a\u00a0 b", "A b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    groups = P.exact_duplicate_groups(docs)
    assert groups._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert sorted((r["first_id"], r["size"]) for r in groups.collect()) == [(4, 2), (7, 2)]
    assert P.length_stats(docs).first()["empty_count"] == 5
