"""Queries of the catalogue against DuckDB over whole tables of the small scale."""

import pytest

from gleanery.plans import catalogue

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "dense_topk", "dense_batch", "metadata_filter_events", "bm25_topk", "combsum", "hybrid_topk", "rerank_topk", "nearest_cluster_topk", "loo_explain", "eval_metrics_per_query", "gate_changes", "sign_test",
    "length_stats", "vocab_stats", "exact_dup_summary", "near_dup_groups", "result_diversity", "coverage_verdicts", "anomaly_zscore", "window_drift", "psi_bins", "calibration", "latency_quantiles", "run_lineage", "chunk_words", "markdown_sections", "query_variants", "citation_check",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: tuple(str(v) for v in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
    c = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(k)] for k in cols) for r in c.fetchall()), key=key)
    assert got == want


def test_every_sql_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
