"""Corpus health queries: lengths, vocabulary, duplicates, embedding statistics, coverage, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import profile as P
from gleanery.operators import search as S
from gleanery.plans.registry import query, r
from gleanery.plans.retrieval import BM25, CENT, VEC, benchmark, centroid_queries, documents, ranked_sql, vectors

TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+')"
PCT = "char", "word"
FOLD = "trim(regexp_replace(lower(text), '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+', ' ', 'g'))"


@query(
    f"WITH d AS (SELECT length(text) AS c, len({TOKENS}) AS w, {FOLD} = '' AS e FROM documents) SELECT count(*) AS n, "
    + ", ".join(f"{r(f'avg({x})')} AS {n}_mean, {r(f'quantile_cont({x}, 0.5)')} AS {n}_median, {r(f'quantile_cont({x}, 0.9)')} AS {n}_p90, {r(f'quantile_cont({x}, 0.99)')} AS {n}_p99" for x, n in (("c", "char"), ("w", "word")))
    + ", count(*) FILTER (e) AS empty_count, count(*) FILTER (NOT e AND c < 20) AS very_short_count, count(*) FILTER (NOT e AND c > 4000) AS very_long_count FROM d"
)
def length_stats(spark, sf):
    return P.length_stats(documents(spark, sf))


@query("(SELECT 'longest' AS kind, row_number() OVER (ORDER BY length(text) DESC, doc_id DESC) AS rank, doc_id, length(text)::BIGINT AS n_chars FROM documents ORDER BY rank LIMIT 5) UNION ALL (SELECT 'shortest', row_number() OVER (ORDER BY length(text), doc_id) AS rank, doc_id, length(text)::BIGINT FROM documents ORDER BY rank LIMIT 5)")
def length_extremes(spark, sf):
    return P.length_extremes(documents(spark, sf))


TERMS = f"t AS (SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS}) AS term FROM documents) GROUP BY term)"


@query(f"WITH {TERMS} SELECT sum(n)::BIGINT AS total_tokens, count(*) AS unique_tokens, {r('count(*)::DOUBLE / sum(n)')} AS type_token_ratio, {r('(count(*) FILTER (n = 1))::DOUBLE / count(*)')} AS hapax_ratio FROM t")
def vocab_stats(spark, sf):
    return P.vocabulary_stats(documents(spark, sf))


@query(f"WITH {TERMS} SELECT term, n FROM t ORDER BY n DESC, term LIMIT 20")
def top_tokens(spark, sf):
    return P.top_terms(documents(spark, sf))


DUPS = f"k AS (SELECT doc_id, sha1({FOLD}) AS doc_key FROM documents WHERE {FOLD} <> ''), g AS (SELECT doc_key, count(*) AS size, min(doc_id) AS first_id FROM k GROUP BY doc_key HAVING count(*) > 1)"


@query(f"WITH {DUPS} SELECT doc_key, size, first_id FROM g")
def exact_dup_groups(spark, sf):
    return P.exact_duplicate_groups(documents(spark, sf))


@query(f"WITH {DUPS}, top AS (SELECT * FROM g ORDER BY size DESC, first_id LIMIT 25) SELECT doc_key, doc_id FROM k JOIN top USING (doc_key)")
def exact_dup_members(spark, sf):
    return P.exact_duplicate_members(documents(spark, sf))


@query(f"WITH {DUPS}, s AS (SELECT count(*) AS n_groups, coalesce(sum(size - 1), 0)::BIGINT AS n_duplicates FROM g), n AS (SELECT count(*) AS n_documents FROM documents) SELECT n_documents, n_groups, n_duplicates, n_documents - n_duplicates AS n_unique, {r('n_duplicates::DOUBLE / n_documents')} AS duplication_ratio FROM n, s")
def exact_dup_summary(spark, sf):
    return P.exact_duplicate_summary(documents(spark, sf))


EDGES = f"{VEC}, u AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), ed AS (SELECT a.doc_id AS a, b.doc_id AS b, list_dot_product(a.v, b.v) AS score FROM u a, u b WHERE a.doc_id < b.doc_id AND ROUND(list_dot_product(a.v, b.v), 9) >= 0.4)"
COMPONENTS = f"{EDGES}, pairs2 AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), reach AS (SELECT DISTINCT a AS id, a AS m FROM pairs2 UNION SELECT pairs2.b, reach.m FROM reach JOIN pairs2 ON pairs2.a = reach.id), comp AS (SELECT id, min(m) AS component FROM reach GROUP BY id)"


@query(f"WITH {EDGES} SELECT a, b, {r('score')} AS score FROM ed")
def near_dup_edges(spark, sf):
    return P.near_edges(vectors(spark, sf), 0.40)


@query(f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM comp")
def near_dup_components(spark, sf):
    return P.components(P.near_edges(vectors(spark, sf), 0.40))


@query(f"WITH RECURSIVE {COMPONENTS}, m AS (SELECT c1.component, c1.id AS a, avg(list_dot_product(x.v, y.v)) AS m FROM comp c1 JOIN comp c2 ON c1.component = c2.component AND c1.id <> c2.id JOIN u x ON x.doc_id = c1.id JOIN u y ON y.doc_id = c2.id GROUP BY ALL) SELECT component, count(*) AS size, {r('avg(m)')} AS mean_similarity, arg_min(a, (-ROUND(m, 9), a)) AS medoid FROM m GROUP BY component")
def near_dup_groups(spark, sf):
    return P.near_duplicate_groups(vectors(spark, sf), 0.40)


@query(f"WITH {VEC} SELECT d - 1 AS dim, {r('avg(x)')} AS mean FROM (SELECT generate_subscripts(v, 1) AS d, unnest(v) AS x FROM e) GROUP BY d")
def embedding_centroid(spark, sf):
    return P.centroid(vectors(spark, sf))


@query(f"WITH {VEC}, p AS (SELECT list_dot_product(a.v, b.v) AS s FROM e a, e b WHERE a.doc_id < b.doc_id) SELECT {r('avg(s)')} AS mean_dot, {r('quantile_cont(s, 0.5)')} AS median_dot, count(*) AS n_pairs FROM p")
def pairwise_stats(spark, sf):
    return P.pairwise_stats(vectors(spark, sf))


@query(f"WITH {VEC}, run AS ({ranked_sql('SELECT a.doc_id AS query_id, b.doc_id, list_dot_product(a.v, b.v) AS score FROM e a, e b WHERE a.doc_id <> b.doc_id', 10)}), n AS (SELECT e.doc_id, count(run.query_id)::DOUBLE AS n FROM e LEFT JOIN run ON run.doc_id = e.doc_id GROUP BY 1), m AS (SELECT avg(n) AS m FROM n) SELECT {r('avg(pow(n - m, 3)) / pow(sqrt(avg(pow(n - m, 2))), 3)')} AS hubness_skewness, max(n)::BIGINT AS max_in_degree FROM n, m")
def hubness(spark, sf):
    return P.hubness(vectors(spark, sf))


@query()
def effective_rank(spark, sf):
    return P.effective_rank(vectors(spark, sf))


# -- difficulty and coverage of the lexical run, and of a dense one --

DIFF = "df AS (SELECT query_id, arg_min(score, rank) AS top1, arg_max(score, rank) AS topk, avg(score) AS m, stddev_pop(score) AS sd, avg(CASE WHEN score < 20 THEN 1.0::DOUBLE ELSE 0 END) AS below FROM bm GROUP BY query_id), q AS (SELECT item_id AS query_id, coalesce(greatest(0, least(1, (top1 - m) / (abs(top1) + 1e-9::DOUBLE))), 0) AS clarity, coalesce(top1 - topk, 0) AS score_drop, coalesce(sd, 0) AS score_std, below, coalesce(top1, 0) AS top1 FROM benchmark LEFT JOIN df ON query_id = item_id)"


def run(spark, sf):
    return S.bm25_topk(documents(spark, sf), benchmark(spark, sf), 10)


@query(f"WITH {BM25}, {DIFF} SELECT query_id, {r('clarity')} AS clarity, {r('score_drop')} AS score_drop, {r('score_std')} AS score_std, {r('below')} AS below_threshold_ratio, {r('top1')} AS top1 FROM q")
def query_difficulty(spark, sf):
    return P.query_difficulty(run(spark, sf), benchmark(spark, sf), 20.0)


@query(f"WITH {BM25}, g AS (SELECT query_id, arg_min(score, rank) AS top1, arg_max(score, rank) AS topk, avg(score) AS mean, stddev_pop(score) AS std FROM bm GROUP BY 1) SELECT query_id, {r('top1')} AS top1, {r('topk')} AS topk, {r('mean')} AS mean, {r('std')} AS std, {r('CASE WHEN std > 1e-12 THEN (SELECT avg(pow(b.score - g.mean, 3)) FROM bm b WHERE b.query_id = g.query_id) / pow(std, 3) ELSE 0 END')} AS skewness FROM g")
def score_distribution(spark, sf):
    return P.score_distribution(run(spark, sf))


DIVERSE = f"{CENT}, run AS ({ranked_sql('SELECT cluster_id::BIGINT AS query_id, doc_id, list_dot_product(v, centroid) AS score FROM e, c', 10)}), u AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), pr AS (SELECT a.query_id, avg(list_dot_product(x.v, y.v)) AS ils FROM run a JOIN run b ON a.query_id = b.query_id AND a.rank < b.rank JOIN u x ON x.doc_id = a.doc_id JOIN u y ON y.doc_id = b.doc_id GROUP BY 1), sm AS (SELECT query_id, exp(score - max(score) OVER (PARTITION BY query_id)) AS x FROM run), pp AS (SELECT query_id, x / sum(x) OVER (PARTITION BY query_id) AS p FROM sm), en AS (SELECT query_id, -sum(p * ln(greatest(p, 1e-12))) AS entropy, count(*) AS n FROM pp GROUP BY 1)"


@query(f"WITH {DIVERSE} SELECT query_id, {r('ils')} AS intra_list_similarity, {r('greatest(0, least(1, 1 - ils))')} AS coverage, {r('entropy')} AS entropy, n AS n_results FROM pr JOIN en USING (query_id)")
def result_diversity(spark, sf):
    v = vectors(spark, sf)
    return P.result_diversity(S.dense_topk(v, centroid_queries(spark, sf), 10), v)


COVER = f"{BM25}, {DIFF}, best AS (SELECT query_id, arg_min(doc_id, rank) AS top1_doc, count(*) AS hits FROM bm GROUP BY 1), v AS (SELECT q.query_id, CASE WHEN hits IS NULL OR top1 < 30 THEN 'uncovered' WHEN clarity < 0.1 THEN 'ambiguous' ELSE 'confident' END AS bucket, top1, top1_doc, clarity, score_drop FROM q LEFT JOIN best USING (query_id))"


def verdicts(spark, sf):
    return P.query_coverage(run(spark, sf), benchmark(spark, sf), coverage=30.0)


@query(f"WITH {COVER} SELECT query_id, bucket, {r('top1')} AS top1, top1_doc, {r('clarity')} AS clarity, {r('score_drop')} AS score_drop FROM v")
def coverage_verdicts(spark, sf):
    return verdicts(spark, sf)


SUMMARY = "count(*) AS n_queries, count(*) FILTER (bucket = 'uncovered') AS n_uncovered, count(*) FILTER (bucket = 'ambiguous') AS n_ambiguous, count(*) FILTER (bucket = 'confident') AS n_confident"


@query(f"WITH {COVER}, s AS (SELECT {SUMMARY} FROM v) SELECT *, {r('(n_queries - n_uncovered)::DOUBLE / n_queries')} AS coverage_rate, {r('n_confident::DOUBLE / n_queries')} AS confidence_rate FROM s")
def coverage_buckets(spark, sf):
    return P.coverage_summary(verdicts(spark, sf))


@query(f"WITH {COVER}, x AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ROUND(CASE WHEN bucket = 'uncovered' THEN top1 ELSE clarity END, 9), query_id) AS rank FROM v WHERE bucket <> 'confident') SELECT query_id, bucket, {r('top1')} AS top1, top1_doc, {r('clarity')} AS clarity, {r('score_drop')} AS score_drop, rank FROM x WHERE rank <= 10")
def coverage_examples(spark, sf):
    return P.coverage_examples(verdicts(spark, sf))


@query()
def audit(spark, sf):
    return P.audit(documents(spark, sf), vectors(spark, sf), 0.92, verdicts(spark, sf)).withColumn("notes", F.array_join("notes", "\n"))
