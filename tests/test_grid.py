"""Comparisons of all with all by matrix products of blocks, against plain loops."""

import numpy as np
import pyarrow as pa
import pytest

from gleanery.operators import monitor as MO
from gleanery.operators import profile as P
from gleanery.operators import search as S

KIND = "doc_id long, embedding array<double>"


@pytest.fixture
def rows(spark, monkeypatch):
    """Vectors in few values, so many scores are equal, dealt to several blocks; none of their pairs by row."""
    monkeypatch.setattr(S, "GRID_ROWS", 40)

    def refuse(*args, **kw):
        raise AssertionError("pairs of rows")

    for module in (S, P):
        monkeypatch.setattr(module, "compared", refuse)
    rng = np.random.default_rng(5)
    v = rng.integers(-1, 2, (150, 6)).astype(float)
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], KIND), v


def first(scores, k):
    return np.lexsort((np.arange(len(scores)), -scores))[:k]


def as_queries(df):
    return df.withColumnRenamed("doc_id", "query_id")


def hits(df):
    return {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


def test_dense_batch_of_many_queries(rows, monkeypatch):
    df, v = rows
    monkeypatch.setattr(S, "BROADCAST_ROWS", 100)
    want = {(q, n): (d, (v @ v[q])[d]) for q in range(len(v)) for n, d in enumerate(first(v @ v[q], 5), 1)}
    assert hits(S.dense_topk_blocks(df, as_queries(df), 5)) == want
    assert len(S.dense_topk_blocks(df, as_queries(df), 200).collect()) == 150 * 150


def test_tiles_of_two_blocks(monkeypatch):
    monkeypatch.setattr(S, "TILE", 7)
    v = np.random.default_rng(6).integers(-1, 2, (30, 4)).astype(float)
    table = lambda ids, name: pa.table({name: ids, "v": [list(v[i % 30]) for i in range(30)]})
    for k in (1, 3, 9, 40):
        for names in (list(range(30)), [f"d{i:02}" for i in range(30)]):
            got = [(r, c, x) for part in S._block_topk(table(names, "query_id"), table(names, "doc_id"), k, False, True) for r, c, x in zip(*part, strict=True)]
            want = [(r, c, v[r] @ v[c]) for r in range(30) for c in [c for c in first(v @ v[r], 30) if c != r][:k]]
            assert got == want


def test_unusable_vectors_and_lengths(spark):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.5, 0.5]), (4, [None, 1.0])], KIND)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in S.nearest(few, as_queries(few), 9).collect()}
    assert got.keys() == {(a, b) for a in range(1, 5) for b in range(1, 5)} and {k for k, x in got.items() if x is not None} == {(a, b) for a in (1, 3) for b in (1, 3)}
    with pytest.raises(Exception, match="differ in length"):
        S.nearest(few.unionByName(spark.createDataFrame([(5, [1.0])], KIND)), as_queries(few), 9).collect()


def test_hard_negatives_without_themselves(rows):
    df, v = rows
    pairs = df.selectExpr("doc_id as pair_id", "embedding as query_embedding", "embedding")
    want = {(q, n): (d, (v @ v[q])[d]) for q in range(len(v)) for n, d in enumerate([d for d in first(v @ v[q], 3) if d != q][:2], 1)}
    assert hits(S.hard_negatives(pairs, 2)) == want


def test_hubness(rows):
    df, v = rows
    n = np.bincount([d for q in range(len(v)) for d in [d for d in first(v @ v[q], 5) if d != q][:4]], minlength=len(v)).astype(float)
    r = P.hubness(df, 4).first()
    assert r["hubness_skewness"] == pytest.approx(((n - n.mean()) ** 3).mean() / n.std() ** 3) and r["max_in_degree"] == n.max()


def test_knn_distance(rows, spark):
    df, v = rows
    some = df.where("doc_id % 3 = 0")
    want = [np.sort(np.sqrt(((v[::3] - x) ** 2).sum(1)))[:4].mean() for x in v]
    got = {r["doc_id"]: r["score"] for r in MO.knn_distance(df, some, 4).collect()}
    assert [got[i] for i in range(len(v))] == pytest.approx(want, abs=1e-9)


def test_pairwise_stats_in_few_values_at_a_time(rows, monkeypatch):
    df, v = rows
    for values in (0, 50):  # none or few products may reach the driver
        monkeypatch.setattr(P, "PAIR_VALUES", values)
        for n in (1, 3, 150):
            s = (v[:n] @ v[:n].T)[np.triu_indices(n, 1)]
            r = P.pairwise_stats(df.where(f"doc_id < {n}")).first()
            if n == 1:
                assert tuple(r) == (None, None, 0)
            else:
                assert (r["mean_dot"], r["median_dot"], r["n_pairs"]) == (pytest.approx(s.mean()), pytest.approx(np.median(s), abs=1e-12), len(s))


def test_near_edges_of_blocks(rows):
    df, v = rows
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if round(u[a] @ u[b], 9) >= 0.8}
    got = [(r["a"], r["b"]) for r in P.near_edges(df, 0.8).collect()]
    assert set(got) == want and len(got) == len(want)
