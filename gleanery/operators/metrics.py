"""Ranking metrics: a run (query_id, doc_id, rank) against judgments (query_id, doc_id, grade), all queries and cutoffs in one job.

Two families with different edge rules, named apart. `trec_*`: precision divides by k; average precision has no cutoff and divides
by the number of relevant documents; gains are grades (linear). `rag_*`: precision divides by what was returned; average precision
is cut at k and divides by min(k, relevant). A query with judgments but no hits scores 0; one without relevant documents too.

Results are long: query_id, metric, k (0 where there is no cutoff), value. Grades of 0 or less aren't relevant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row a query: hits (its ranked list with grades and whether judged), gains (relevant grades, best first), n_rel. Ranks are made dense first."""
    w = Window.partitionBy("query_id").orderBy("rank")
    run = run.select("query_id", "doc_id", F.row_number().over(w).alias("rank"))
    q = qrels.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))
    hits = run.join(q, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.greatest(F.coalesce("grade", F.lit(0)), F.lit(0)).cast("double").alias("g"), (F.coalesce("grade", F.lit(1)) <= 0).alias("bad")))).alias("hits"))
    rel = q.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("grade") > 0, F.col("grade").cast("double"))), asc=False).alias("gains"))
    base = rel.select("query_id") if queries is None else queries.select("query_id")
    empty = F.array().cast(hits.schema["hits"].dataType)
    out = base.join(hits, "query_id", "left").join(rel, "query_id", "left").select("query_id", F.coalesce("hits", empty).alias("hits"), F.coalesce("gains", F.array().cast("array<double>")).alias("gains"))
    return out.withColumn("n_rel", F.size("gains"))


def _sum(arr: Column, term) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + term(x))


def _top(k: int) -> Column:
    return F.filter("hits", lambda h: h["rank"] <= k)


def _hits(k: int | None = None) -> Column:
    return _sum(F.col("hits") if k is None else _top(k), lambda h: (h["g"] > 0).cast("double"))


def _over(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def reciprocal_rank(k: int | None = None) -> Column:
    first = F.array_min(F.transform(F.filter("hits" if k is None else _top(k), lambda h: h["g"] > 0), lambda h: h["rank"]))
    return F.coalesce(1.0 / first, F.lit(0.0))


def _precision_sum(arr: Column) -> Column:
    """Sum over hits of the precision at their ranks."""
    step = lambda a, h: F.struct((a["n"] + (h["g"] > 0).cast("double")).alias("n"), (a["s"] + F.when(h["g"] > 0, (a["n"] + 1) / h["rank"]).otherwise(0.0)).alias("s"))
    return F.aggregate(arr, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s")), step, lambda a: a["s"])


def _dcg(arr: Column, gain) -> Column:
    return F.aggregate(F.transform(arr, lambda h: gain(h) / F.log2(h["rank"] + F.lit(1.0))), F.lit(0.0), lambda s, x: s + x)


def _ideal(k: int, binary: bool) -> Column:
    return F.aggregate(F.transform(F.slice("gains", 1, k), lambda g, i: (F.lit(1.0) if binary else g) / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def _err(k: int) -> Column:
    top = F.pow(F.lit(2.0), F.coalesce(F.get("gains", F.lit(0)), F.lit(0.0)))
    step = lambda a, h: F.struct((a["s"] + a["p"] * ((F.pow(F.lit(2.0), h["g"]) - 1) / top) / h["rank"]).alias("s"), (a["p"] * (1 - (F.pow(F.lit(2.0), h["g"]) - 1) / top)).alias("p"))
    return F.aggregate(_top(k), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("p")), step, lambda a: a["s"])


def _bpref() -> Column:
    r = F.col("n_rel").cast("double")
    step = lambda a, h: F.struct((a["n"] + h["bad"].cast("double")).alias("n"), (a["s"] + F.when(h["g"] > 0, 1 - F.least(a["n"], r) / r).otherwise(0.0)).alias("s"))
    return F.aggregate("hits", F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s")), step, lambda a: a["s"])


def definitions(ks: tuple[int, ...] = (1, 3, 5, 10), persistence: float = 0.8) -> dict[tuple[str, int], Column]:
    rel = F.col("n_rel").cast("double")
    out: dict[tuple[str, int], Column] = {
        ("trec_rr", 0): reciprocal_rank(),
        ("trec_ap", 0): _over(_precision_sum(F.col("hits")), rel),
        ("rag_r_precision", 0): _over(_sum(F.filter("hits", lambda h: h["rank"] <= F.col("n_rel")), lambda h: (h["g"] > 0).cast("double")), rel),
        ("rag_bpref", 0): _over(_bpref(), rel),
    }
    for k in ks:
        hits, got = _hits(k), F.size(_top(k)).cast("double")
        p, r = _over(hits, got), _over(hits, rel)
        out |= {
            ("trec_precision", k): hits / k, ("trec_recall", k): r, ("trec_dcg", k): _dcg(_top(k), lambda h: h["g"]), ("trec_ndcg", k): _over(_dcg(_top(k), lambda h: h["g"]), _ideal(k, False)),
            ("rag_precision", k): p, ("rag_rr", k): reciprocal_rank(k), ("rag_ap", k): _over(_precision_sum(_top(k)), F.least(rel, F.lit(float(k)))), ("rag_hit", k): (hits > 0).cast("double"),
            ("rag_f1", k): _over(2 * p * r, p + r), ("rag_ndcg", k): _over(_dcg(_top(k), lambda h: (h["g"] > 0).cast("double")), _ideal(k, True)), ("rag_graded_ndcg", k): _over(_dcg(_top(k), lambda h: h["g"]), _ideal(k, False)),
            ("rag_rbp", k): (1 - persistence) * _sum(_top(k), lambda h: F.when(h["g"] > 0, F.pow(F.lit(persistence), h["rank"] - 1)).otherwise(0.0)), ("rag_err", k): _err(k),
        }
    return out


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame | None = None, ks: tuple[int, ...] = (1, 3, 5, 10), only: tuple[str, ...] | None = None, persistence: float = 0.8) -> DataFrame:
    """query_id, metric, k, value: lists are gathered once and all metrics folded over them."""
    wanted = {n: c for n, c in definitions(ks, persistence).items() if only is None or n[0] in only}
    rows = judged(run, qrels, queries)
    return rows.select("query_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), c.cast("double").alias("value")) for (m, k), c in wanted.items()])).alias("x")).select("query_id", "x.metric", "x.k", "x.value")


def means(metrics: DataFrame) -> DataFrame:
    """metric, k, value: over all queries."""
    return metrics.groupBy("metric", "k").agg(F.avg("value").alias("value"))


def geometric_map(metrics: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """k, value: exp of the mean log of rag_ap, smoothed by epsilon."""
    return metrics.where("metric = 'rag_ap'").groupBy("k").agg((F.exp(F.avg(F.log(F.col("value") + epsilon))) - epsilon).alias("value"))


def report(metrics: DataFrame, model: str = "") -> DataFrame:
    """One row: num_queries, mrr, map, and ndcg, precision, recall as maps by k, rounded to four digits."""
    m = means(metrics).select("metric", "k", F.round("value", 4).alias("v"))
    n = metrics.agg(F.countDistinct("query_id").alias("num_queries"))
    by = lambda name: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("metric") == name, F.struct(F.col("k").cast("string"), "v"))))).alias(name.removeprefix("trec_"))
    one = lambda name, as_: F.max(F.when(F.col("metric") == name, F.col("v"))).alias(as_)
    return m.agg(one("trec_rr", "mrr"), one("trec_ap", "map"), by("trec_ndcg"), by("trec_precision"), by("trec_recall")).crossJoin(n).withColumn("model_name", F.lit(model))


def model_ranking(reports: DataFrame) -> DataFrame:
    """model, mrr, rank: models by mean reciprocal rank. reports: long rows with model."""
    m = reports.where("metric = 'trec_rr'").groupBy("model").agg(F.avg("value").alias("mrr"))
    return m.withColumn("rank", F.row_number().over(Window.orderBy(F.round("mrr", 9).desc(), "model")))


def search_quality(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """The benchmark's variant: precision over what was returned, recall that counts repeats, binary gains."""
    rows = judged(run, qrels)
    hits = _hits(k)
    return rows.select("query_id", _over(hits, F.size(_top(k)).cast("double")).alias("precision"), _over(hits, F.col("n_rel").cast("double")).alias("recall"), reciprocal_rank(k).alias("rr"), _over(_dcg(_top(k), lambda h: (h["g"] > 0).cast("double")), _ideal(k, True)).alias("ndcg"))
