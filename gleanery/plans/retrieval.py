"""Search queries: dense, lexical, fused, diversified, clustered, explained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import metadata as M
from gleanery.functions import text as T
from gleanery.functions import vector as V
from gleanery.operators import search as S
from gleanery.plans.registry import query, r, table

# -- tables as the operators name them --


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return S.mean_centroids(vectors(spark, sf), "label")


def centroid_queries(spark: SparkSession, sf: str) -> DataFrame:
    return centroids(spark, sf).select(F.col("cluster_id").cast("bigint").alias("query_id"), F.col("centroid").alias("embedding"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


VEC = "e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
CENT = f"{VEC}, ed AS (SELECT label, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM e), cm AS (SELECT label, d, avg(x) AS m FROM ed GROUP BY ALL), c AS (SELECT label AS cluster_id, list(m ORDER BY d) AS centroid FROM cm GROUP BY label)"
DOT = "list_dot_product"


def ranked_sql(src: str, k: int, by: str = "query_id", tie: str = "doc_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ROUND(score, 9) DESC, {tie}) AS rank FROM ({src})) WHERE rank <= {k}"


DENSE = f"WITH {CENT}, run AS ({ranked_sql('SELECT cluster_id::BIGINT AS query_id, doc_id, list_dot_product(v, centroid) AS score FROM e, c', 10)})"
OUT = f"SELECT query_id, doc_id, {r('score')} AS score, rank FROM "


@query(f"{DENSE} {OUT} run")
def dense_topk(spark, sf):
    return S.dense_topk(vectors(spark, sf), centroid_queries(spark, sf), 10)


@query(f"{DENSE} {OUT} run WHERE score >= 0.06")
def dense_threshold(spark, sf):
    return S.dense_topk(vectors(spark, sf), centroid_queries(spark, sf), 10, threshold=0.06)


@query(f"WITH {VEC}, run AS ({ranked_sql('SELECT a.doc_id AS query_id, b.doc_id, list_dot_product(a.v, b.v) AS score FROM e a, e b', 5)}) {OUT} run")
def dense_batch(spark, sf):
    v = vectors(spark, sf)
    return S.dense_topk_blocks(v, v.select(F.col("doc_id").alias("query_id"), "embedding"), 5)


@query(f"WITH {CENT}, run AS ({ranked_sql('SELECT cluster_id::BIGINT AS query_id, doc_id, list_dot_product(v, centroid) AS score FROM e, c WHERE label IN (1, 2, 3)', 5)}) {OUT} run")
def metadata_filter_topk(spark, sf):
    v = vectors(spark, sf)
    return S.dense_topk(v.where(M.matches({"label": {"min": 1, "max": 3}}, lambda p: v[p])), centroid_queries(spark, sf), 5)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events WHERE event_type IN ('click', 'purchase') AND value >= 10 AND json_extract_string(props, '$.k') IS NOT NULL")
def metadata_filter_events(spark, sf):
    e = table(spark, sf, "events").withColumn("meta", F.try_parse_json("props"))
    cols = {"event_type": F.col("event_type"), "value": F.col("value"), "k": M.field(F.col("meta"), "k")}
    return e.where(M.matches({"event_type": ["click", "purchase"], "value": {"min": 10}}, cols.__getitem__) & cols["k"].isNotNull()).select("event_id", cols["k"].alias("k"))


# -- lexical --


def bm25_sql(k1: str = "1.5", b: str = "0.75", n: str = "") -> str:
    """CTEs tok, post, stats, terms, and scored (query_id, doc_id, score)."""
    return (
        f"tok{n} AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), dl{n} AS (SELECT doc_id, len(t) AS dl FROM tok{n}), "
        f"post{n} AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok{n}) GROUP BY ALL), corpus{n} AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM dl{n}), "
        f"terms{n} AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM post{n}, corpus{n} GROUP BY term), "
        f"qt{n} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL), "
        f"scored{n} AS (SELECT query_id, doc_id, sum(qtf * idf * (tf * ({k1}::DOUBLE + 1)) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avg_dl))) AS score FROM qt{n} JOIN terms{n} USING (term) JOIN post{n} USING (term) JOIN dl{n} USING (doc_id), corpus{n} GROUP BY ALL)"
    )


BM25 = f"{bm25_sql()}, bm AS ({ranked_sql('SELECT * FROM scored', 10)})"


@query(f"WITH {bm25_sql()} SELECT term, df, {r('idf')} AS idf FROM terms")
def bm25_terms(spark, sf):
    return S.bm25_stats(documents(spark, sf))[0]


@query(f"WITH {bm25_sql()} SELECT n, {r('avg_dl')} AS avg_dl FROM corpus")
def bm25_corpus(spark, sf):
    return S.bm25_stats(documents(spark, sf))[1]


@query(f"WITH {BM25} {OUT} bm")
def bm25_topk(spark, sf):
    return S.bm25_topk(documents(spark, sf), benchmark(spark, sf), 10)


@query(f"WITH {bm25_sql()}, full_scores AS (SELECT q.item_id AS query_id, d.doc_id, coalesce(s.score, 0) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN scored s ON s.query_id = q.item_id AND s.doc_id = d.doc_id), f AS ({ranked_sql('SELECT * FROM full_scores', 10)}) {OUT} f")
def bm25_fill_zero(spark, sf):
    return S.bm25_topk(documents(spark, sf), benchmark(spark, sf), 10, fill_zero=True)


# -- fusion: two lexical runs with different parameters, and a dense one from the hashing encoder --

TWO = f"{bm25_sql()}, {bm25_sql('0.9', '0.4', '2')}, ra AS ({ranked_sql('SELECT * FROM scored', 20)}), rb AS ({ranked_sql('SELECT * FROM scored2', 20)}), runs AS (SELECT 'a' AS run_id, * FROM ra UNION ALL SELECT 'b', * FROM rb)"


def two_runs(spark, sf, k: int = 20) -> DataFrame:
    return S.bm25_runs(documents(spark, sf), benchmark(spark, sf), k, {"a": (1.5, 0.75), "b": (0.9, 0.4)})


@query(f"WITH {TWO}, f AS ({ranked_sql('SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM runs GROUP BY ALL', 10)}) {OUT} f")
def rrf(spark, sf):
    return S.rrf(two_runs(spark, sf), top_k=10)


@query(f"WITH {TWO}, f AS ({ranked_sql('''SELECT query_id, doc_id, sum((CASE run_id WHEN 'a' THEN 2 ELSE 1 END)::DOUBLE / (60 + rank)) AS score FROM runs GROUP BY ALL''', 10)}) {OUT} f")
def rrf_weighted(spark, sf):
    return S.rrf_weighted(two_runs(spark, sf), {"a": 2.0, "b": 1.0}, top_k=10)


COMB = "SELECT query_id, doc_id, sum(s) AS score FROM (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS s FROM runs WINDOW w AS (PARTITION BY run_id, query_id)) GROUP BY ALL"


@query(f"WITH {TWO}, f AS ({ranked_sql(COMB, 10)}) {OUT} f")
def combsum(spark, sf):
    return S.combsum(two_runs(spark, sf), top_k=10)


@query(f"WITH {TWO}, f AS ({ranked_sql('SELECT query_id, doc_id, sum(CASE run_id WHEN chr(97) THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * score) AS score FROM runs GROUP BY ALL', 10)}) {OUT} f")
def combsum_raw(spark, sf):
    return S.combsum(two_runs(spark, sf), {"a": 0.7, "b": 0.3}, normalize=False, top_k=10)


def hash_vec_sql(src: str, key: str, text: str) -> str:
    """The hashing encoder: key and a unit vector of 64 buckets."""
    return (
        f"SELECT {key}, list(CASE WHEN nn = 0 THEN 0 ELSE cnt / sqrt(nn) END ORDER BY i) AS v FROM (SELECT k.{key}, g.i, coalesce(b.c, 0)::DOUBLE AS cnt, sum(coalesce(b.c, 0)::DOUBLE * coalesce(b.c, 0)) OVER (PARTITION BY k.{key}) AS nn "
        f"FROM (SELECT DISTINCT {key} FROM {src}) k CROSS JOIN range(64) g(i) LEFT JOIN (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS i, count(*) AS c FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM {src}) GROUP BY ALL) b ON b.{key} = k.{key} AND b.i = g.i) GROUP BY {key}"
    )


def encoded(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("embedding", V.hashed_embedding(F.col(text)))


HASH_DENSE = f"dv AS ({hash_vec_sql('documents', 'doc_id', 'text')}), qv AS ({hash_vec_sql('benchmark', 'item_id', 'text')}), dn AS ({ranked_sql('SELECT item_id AS query_id, doc_id, list_dot_product(dv.v, qv.v) AS score FROM dv, qv', 20)})"


@query(f"WITH {HASH_DENSE} {OUT} dn")
def encoded_topk(spark, sf):
    return S.dense_topk_blocks(encoded(documents(spark, sf), "text"), encoded(benchmark(spark, sf), "query"), 20)


@query(f"WITH {bm25_sql()}, lx AS ({ranked_sql('SELECT * FROM scored', 20)}), {HASH_DENSE}, u AS (SELECT query_id, doc_id, rank, 'l' AS s FROM lx UNION ALL SELECT query_id, doc_id, rank, 'd' FROM dn), f AS ({ranked_sql('''SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, max(CASE WHEN s = 'l' THEN rank END) AS bm25_rank, max(CASE WHEN s = 'd' THEN rank END) AS dense_rank FROM u GROUP BY ALL''', 5)}) SELECT query_id, doc_id, {r('score')} AS score, bm25_rank, dense_rank, rank FROM f")
def hybrid_topk(spark, sf):
    d, q = documents(spark, sf), benchmark(spark, sf)
    return S.hybrid(S.bm25_topk(d, q, 20), S.dense_topk_blocks(encoded(d, "text"), encoded(q, "query"), 20), top_k=5)


# -- diversity, reranking, negatives --


@query()
def mmr_topk(spark, sf):
    return S.mmr(vectors(spark, sf), centroid_queries(spark, sf), 5, 0.5)


OVER = "len(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')))"
RERANK = f"SELECT bm.query_id, bm.doc_id, bm.score AS original_score, bm.rank AS original_rank, len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+'))))::DOUBLE / {OVER} AS score FROM bm JOIN benchmark q ON q.item_id = bm.query_id JOIN documents d USING (doc_id)"


@query(f"WITH {bm25_sql()}, bm AS ({ranked_sql('SELECT * FROM scored', 50)}), f AS ({ranked_sql(RERANK, 5)}) SELECT query_id, doc_id, {r('original_score')} AS original_score, original_rank, {r('score')} AS score, rank, original_rank - rank AS rank_change FROM f")
def rerank_topk(spark, sf):
    return S.two_stage(documents(spark, sf), benchmark(spark, sf), 5)


@query(f"WITH {VEC}, run AS ({ranked_sql('SELECT a.doc_id AS query_id, b.doc_id, list_dot_product(a.v, b.v) AS score FROM e a, e b WHERE a.doc_id <> b.doc_id', 2)}) {OUT} run")
def hard_negatives(spark, sf):
    v = vectors(spark, sf).select(F.col("doc_id").alias("pair_id"), F.col("embedding").alias("query_embedding"), "embedding")
    return S.hard_negatives(v, 2)


# -- clusters: fixed centroids, the labels' means --

ASSIGN = f"{CENT}, a AS (SELECT doc_id, cluster_id, score FROM (SELECT doc_id, cluster_id, list_cosine_similarity(v, centroid) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY ROUND(list_cosine_similarity(v, centroid), 9) DESC, cluster_id) AS n FROM e, c) WHERE n = 1)"


def assigned(spark, sf) -> DataFrame:
    return S.assign(vectors(spark, sf), centroids(spark, sf))


@query(f"WITH {ASSIGN} SELECT doc_id, cluster_id, {r('score')} AS score FROM a")
def cluster_assign(spark, sf):
    return assigned(spark, sf)


@query(f"WITH {ASSIGN} SELECT cluster_id, count(*) AS size, {r('sum(2 - 2 * score)')} AS inertia FROM a GROUP BY cluster_id")
def cluster_sizes(spark, sf):
    return assigned(spark, sf).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.sum(2 - 2 * F.col("score")).alias("inertia"))


@query(f"WITH {ASSIGN}, run AS ({ranked_sql('SELECT q.cluster_id::BIGINT AS query_id, e.doc_id, list_cosine_similarity(e.v, q.centroid) AS score FROM e JOIN a USING (doc_id), c q WHERE a.cluster_id = 3', 5)}) {OUT} run")
def cluster_topk(spark, sf):
    return S.cluster_topk(vectors(spark, sf), assigned(spark, sf), centroid_queries(spark, sf), 3, 5)


NEAREST = f"{ASSIGN}, near AS (SELECT * FROM (SELECT q.cluster_id AS query_id, q.centroid AS qv, c.cluster_id, row_number() OVER (PARTITION BY q.cluster_id ORDER BY ROUND(list_cosine_similarity(q.centroid, c.centroid), 9) DESC, c.cluster_id) AS n FROM c q, c) WHERE n <= 2)"


@query(f"WITH {NEAREST}, run AS ({ranked_sql('SELECT near.query_id::BIGINT AS query_id, e.doc_id, list_cosine_similarity(e.v, near.qv) AS score FROM e JOIN a USING (doc_id) JOIN near USING (cluster_id)', 5)}) {OUT} run")
def nearest_cluster_topk(spark, sf):
    return S.nearest_cluster_topk(vectors(spark, sf), assigned(spark, sf), centroids(spark, sf), centroid_queries(spark, sf), 5, 2)


STOP = ", ".join(f"'{w}'" for w in T.CLUSTER_STOP_WORDS)
LANG = "SELECT doc_id, lang AS cluster_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents"


@query(f"SELECT * FROM (SELECT cluster_id, term, n, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, term) AS rank FROM (SELECT cluster_id, term, count(*) AS n FROM ({LANG}) WHERE term NOT IN ({STOP}) GROUP BY ALL)) WHERE rank <= 5")
def cluster_terms(spark, sf):
    d = documents(spark, sf)
    return S.cluster_terms(d, d.select("doc_id", F.col("lang").alias("cluster_id")))


@query(f"WITH {ASSIGN}, f AS ({ranked_sql('SELECT cluster_id, doc_id, list_cosine_similarity(v, centroid) AS score FROM e JOIN a USING (doc_id) JOIN c USING (cluster_id)', 3, 'cluster_id')}) SELECT cluster_id, doc_id, {r('score')} AS score, rank FROM f")
def centroid_docs(spark, sf):
    return S.centroid_docs(vectors(spark, sf), assigned(spark, sf), centroids(spark, sf))


@query()
def kmeans_fit(spark, sf):
    labels, _, inertia = S.kmeans(vectors(spark, sf), 8)
    return labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).withColumn("inertia", F.lit(float(inertia)))


# -- explanations: each benchmark item against the documents it was taken from --


def explained_pairs(spark, sf) -> DataFrame:
    q = benchmark(spark, sf)
    d = documents(spark, sf).select("doc_id", "text")
    first = S.containing(d, q).groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return q.join(first, "query_id").join(d, "doc_id").select("query_id", "query", "text", "doc_id")


def hash_encoder(text):
    return V.hashed_embedding(text)


EXPLAIN = (
    "p AS (SELECT b.item_id AS query_id, b.text AS query, min(d.doc_id) AS doc_id, arg_min(d.text, d.doc_id) AS text FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL), "
    "tk AS (SELECT query_id, regexp_extract_all(query, '[A-Za-z0-9][A-Za-z0-9''_-]*') AS t FROM p), pos AS (SELECT query_id, t, unnest(range(len(t))) AS position FROM tk), "
    "var AS (SELECT query_id::VARCHAR || ':' || position AS vid, query_id, position, t[position + 1] AS token, array_to_string(list_concat(t[1:position], t[position + 2:]), ' ') AS rest FROM pos), "
    f"vv AS ({hash_vec_sql('var', 'vid', 'rest')}), dv AS ({hash_vec_sql('p', 'doc_id', 'text')}), qv AS ({hash_vec_sql('p', 'query_id', 'query')})"
)


@query(f"WITH {EXPLAIN} SELECT p.query_id, p.doc_id, position, token, {r('list_dot_product(qv.v, dv.v) - list_dot_product(vv.v, dv.v)')} AS importance, {r('list_dot_product(qv.v, dv.v)')} AS score_with, {r('list_dot_product(vv.v, dv.v)')} AS score_without FROM var JOIN vv USING (vid) JOIN p ON p.query_id = var.query_id JOIN dv ON dv.doc_id = p.doc_id JOIN qv ON qv.query_id = p.query_id")
def loo_explain(spark, sf):
    return S.query_attributions(explained_pairs(spark, sf), hash_encoder)


@query()
def span_explain(spark, sf):
    return S.document_attributions(explained_pairs(spark, sf), hash_encoder, 5)
