"""The command line. Exit codes: 0 fine, 1 a gate failed or the corpus needs attention, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import __version__
from gleanery.config import Settings
from gleanery.functions import vector as V


class JsonFormatter(logging.Formatter):
    """One JSON object a line."""

    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}, ensure_ascii=False)


def show(df: DataFrame) -> list[dict]:
    """Prints a report, whole."""
    rows = [json.loads(r) for r in df.toJSON().toLocalIterator()]
    for r in rows:
        print(json.dumps(r, ensure_ascii=False))
    return rows


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleanery")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        return c

    command("index", "documents", "index")
    c = command("search", "index", "query")
    c.add_argument("--top-k", type=int, default=5)
    c.add_argument("--threshold", type=float)
    command("info", "index")
    command("evaluate", "dataset")
    c = command("quality-gate", "baseline", "current")
    c.add_argument("--strict", action="store_true")
    command("ab-compare", "a", "b")
    c = command("calibrate", "scores")
    c.add_argument("--bins", type=int, default=10)
    command("drift-report", "baseline", "current")
    c = command("audit", "documents")
    c.add_argument("--queries")
    command("version")
    return p


def numbered(df: DataFrame) -> DataFrame:
    """doc_id, text of lines of files."""
    return df.select(F.xxhash64("file", "line").alias("doc_id"), "text")


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    from gleanery.operators import metrics as E
    from gleanery.operators import monitor as MO
    from gleanery.operators import profile as P
    from gleanery.operators import search as S
    from gleanery.operators import stats as ST
    from gleanery.sources import files

    settings = Settings()
    spark = settings.session()
    if a.command == "index":
        docs = numbered(files.documents(spark, a.documents))
        files.save_index(docs.withColumn("embedding", V.hashed_embedding(F.col("text"))), a.index, {"encoder": "hashed", "dims": 64})
        return 0
    if a.command == "search":
        if not a.query.strip() or a.top_k <= 0:
            print("a query and a positive --top-k are needed", file=sys.stderr)
            return 2
        corpus, _ = files.load_index(spark, a.index)
        q = spark.createDataFrame([(0, a.query)], "query_id int, query string").withColumn("embedding", V.hashed_embedding(F.col("query")))
        run = S.dense_topk(corpus, q, min(a.top_k, settings.max_top_k), a.threshold)
        show(run.join(corpus.select("doc_id", "text"), "doc_id").orderBy("rank").select("rank", F.round("score", 4).alias("score"), "text"))
        return 0
    if a.command == "info":
        corpus, config = files.load_index(spark, a.index)
        print(json.dumps(config | {"documents": corpus.count()}))
        return 0
    if a.command == "evaluate":
        corpus, q, rel = files.dataset(spark, a.dataset)
        enc = lambda df, c: df.withColumn("embedding", V.hashed_embedding(F.col(c)))
        show(E.report(E.per_query(S.dense_topk(enc(corpus, "text"), enc(q, "query"), 20), rel, q, (1, 3, 5, 10, 20)), "hashed"))
        return 0
    if a.command == "quality-gate":

        def means(path: str) -> DataFrame:
            r = json.loads(open(path, encoding="utf-8").read())
            rows = [("trec_rr", 0, float(r.get("mrr", 0))), ("trec_ap", 0, float(r.get("map", 0)))]
            rows += [(f"trec_{m}", int(k), float(v)) for m in ("ndcg", "precision", "recall") for k, v in (r.get(m) or {}).items()]
            return spark.createDataFrame(rows, "metric string, k int, value double")

        changes = ST.gate_changes(means(a.baseline), means(a.current), ST.GateConfig.strict() if a.strict else None)
        show(changes)
        return int(changes.where("regressed").limit(1).count())
    if a.command == "ab-compare":
        show(ST.compare_systems(files.metric_vectors(spark, a.a), files.metric_vectors(spark, a.b)))
        return 0
    if a.command == "calibrate":
        show(MO.calibration(files.scores_and_labels(spark, a.scores), a.bins))
        return 0
    if a.command == "drift-report":
        both = files.numbers(spark, a.baseline).withColumn("is_current", F.lit(False)).unionByName(files.numbers(spark, a.current).withColumn("is_current", F.lit(True)))
        show(MO.psi(both))
        return 0
    docs = numbered(files.documents(spark, a.documents))
    enc = docs.withColumn("embedding", V.hashed_embedding(F.col("text")))
    verdicts = None
    if a.queries:
        q = files.queries(spark, a.queries).select(F.xxhash64("file", "line").alias("query_id"), "query").withColumn("embedding", V.hashed_embedding(F.col("query")))
        verdicts = P.query_coverage(S.dense_topk(enc, q, 5), q)
    return int(show(P.audit(docs, enc, 0.99, verdicts))[0]["status"] != "ready")


if __name__ == "__main__":
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter())
    logging.basicConfig(level=logging.WARNING, handlers=[handler])
    sys.exit(main())
