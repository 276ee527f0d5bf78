"""Corpus health, monitoring, files and streams."""

import numpy as np
import pytest

from gleanery.operators import monitor as MO
from gleanery.operators import profile as P
from gleanery.operators import runs as R
from gleanery.sources import files
from gleanery.streaming import monitors as ST


def test_lengths(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate((10, 50, 100, 200))] + [(9, None)], "doc_id int, text string")
    r = P.length_stats(docs.where("doc_id < 9")).first()
    assert (r["char_median"], r["char_mean"], r["very_short_count"]) == (75, 90, 1)
    assert P.length_stats(docs).first()["empty_count"] == 1


def test_near_duplicates_chain(spark):
    v = [[1, 0, 0], [0.99, 0.14, 0], [0.96, 0.28, 0], [0, 1, 0], [0, 0.99, 0.1], [0, 0, 1]]
    df = spark.createDataFrame([(i, [float(x) for x in u]) for i, u in enumerate(v)], "doc_id long, embedding array<double>")
    assert sorted(r["size"] for r in P.near_duplicate_groups(df, 0.95).collect()) == [2, 3]


def test_effective_rank(spark):
    df = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)], "doc_id long, embedding array<double>")
    assert P.effective_rank(df).first()["effective_rank"] == pytest.approx(4.0)


def test_calibration(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)], "score double, label int")
    r = MO.calibration(df, 2).first()
    assert (r["brier_score"], r["ece"], r["mce"]) == (pytest.approx(0.025), pytest.approx(0.15), pytest.approx(0.15))


def test_psi_of_equal_samples(spark):
    df = spark.createDataFrame([(float(x), c) for x in range(4) for c in (True, False)], "x double, is_current boolean")
    r = MO.psi(df).first()
    assert (r["psi"], r["severity"]) == (pytest.approx(0.0), "low")


def test_mahalanobis_against_numpy(spark):
    x = np.random.default_rng(3).standard_normal((50, 4))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    inv = np.linalg.inv(np.cov(x.T) + np.eye(4) * 1e-6)
    d = x - x.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", d, inv, d))
    got = [r["score"] for r in MO.mahalanobis(df, df).orderBy("doc_id").collect()]
    assert np.allclose(got, want)


def test_window_drift_counts(spark):
    x = np.random.default_rng(4).standard_normal((30, 3))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    assert MO.window_drift(df, "doc_id", 10).count() == 2
    assert [r["row"] for r in MO.row_numbers(df, "doc_id").orderBy("doc_id").collect()] == list(range(1, 31))


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i % 60:02d}", i % 3, [float(i % 7), float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, embedding array<double>").selectExpr("event_id", "timestamp(t) ts", "user_id", "embedding", "event_id doc_id", "'s' stream")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def drained(out, name):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    batch = sorted(map(tuple, ST.token_bucket(df, capacity=2.0, refill_rate=0.1).collect()))
    assert drained(ST.token_bucket_stream(stream, capacity=2.0, refill_rate=0.1), "bucket") == batch
    want = [(r["window_id"], round(r["drift_score"], 9)) for r in MO.window_drift(df.select("doc_id", "embedding"), "doc_id", 20).orderBy("window_id").collect()]
    got = [(w, round(s, 9)) for _, w, s, _ in drained(ST.window_drift_stream(stream, 20), "drift")]
    assert got == want


def test_files(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('"one"\n\n{"text": "two"}\n')
    assert [r["text"] for r in files.documents(spark, str(tmp_path / "d.jsonl")).orderBy("line").collect()] == ["one", "two"]
    (tmp_path / "bad.jsonl").write_text('"one"\n{"x": 1}\n')
    with pytest.raises(Exception, match=":2: neither"):
        files.documents(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "q.jsonl").write_text('{"text": "", "query": "q"}\n"s"\n')
    assert [r["query"] for r in files.queries(spark, str(tmp_path / "q.jsonl")).orderBy("line").collect()] == ["q", "s"]
    (tmp_path / "corpus.tsv").write_text("d1\ttext one\nd2\ttitle\tbody\twith tab\n")
    (tmp_path / "queries.tsv").write_text("q1\twhat\nq2\tnothing\n")
    (tmp_path / "qrels.tsv").write_text("q1\t0\td1\t2\nq1\t0\td1\t1\nq1\t0\tgone\t1\nq2\t0\td2\t0\n")
    c, q, rel = files.dataset(spark, str(tmp_path))
    assert dict(map(tuple, c.collect())) == {"d1": "text one", "d2": "title body\twith tab"}
    assert [tuple(r) for r in q.collect()] == [("q1", "what")] and [tuple(r) for r in rel.collect()] == [("q1", "d1", 1)]
    (tmp_path / "s.json").write_text('{"scores": [0.1, 0.9], "labels": [0, 1]}')
    assert sorted(map(tuple, files.scores_and_labels(spark, str(tmp_path / "s.json")).collect())) == [(0.1, 0.0), (0.9, 1.0)]
    (tmp_path / "n.json").write_text('{"values": [1, 2.5]}')
    assert [r["x"] for r in files.numbers(spark, str(tmp_path / "n.json")).collect()] == [1.0, 2.5]


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.1, 0.2], 0)], "doc_id long, embedding array<double>, cluster_id int")
    files.save_index(df, str(tmp_path / "ix"), {"dims": 2}, "cluster_id")
    back, config = files.load_index(spark, str(tmp_path / "ix"))
    assert config == {"dims": 2} and back.count() == 1


def test_lineage_survives_cycles(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "run_id string, parent_run_id string")
    assert R.lineage(r, "c", 3).count() == 4


def test_markdown_sections_of_one_row(spark):
    from gleanery.operators.chunking import markdown_sections

    docs = spark.createDataFrame([(1, "pre\n# A \nx \n  y\n## B\n\n# C\nz"), (2, ""), (3, None), (4, "# only"), (5, "#x\n###### six\r\nq")], "doc_id int, text string")
    got = [tuple(r) for r in markdown_sections(docs).orderBy("doc_id", "section_no").collect()]
    assert got == [(1, None, None, "pre", 1), (1, "A", 1, "x\ny", 2), (1, "B", 2, "", 3), (1, "C", 1, "z", 4), (4, "only", 1, "", 1), (5, None, None, "#x", 1), (5, "six", 6, "q", 2)]


def test_latency_quantiles_of_ties(spark):
    from gleanery.operators.monitor import latency_quantiles

    s = spark.createDataFrame([("a", float(v)) for v in [1, 1, 1, 2, 2, 9]] + [("b", float(v // 2)) for v in range(200)] + [(None, 3.0)], "stage string, ms double")
    got = {r["stage"]: (r["p50"], r["p95"], r["p99"], r["max"]) for r in latency_quantiles(s).collect()}
    assert got == {"a": (2.0, 9.0, 9.0, 9.0), "b": (50.0, 95.0, 99.0, 99.0), None: (3.0, 3.0, 3.0, 3.0)}
