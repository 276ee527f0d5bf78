"""Text queries for grounded generation: chunks, query forms, citations, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import chunking as C
from gleanery.operators import search as S
from gleanery.plans.registry import query, table
from gleanery.plans.retrieval import BM25, benchmark, documents

WS = "[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+"
NWS = "[^\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+"
CHUNK = f"w AS (SELECT doc_id, regexp_extract_all(text, '{NWS}') AS w FROM documents), s AS (SELECT doc_id, w, unnest(list_filter(range(0, len(w), 150), lambda s: s = 0 OR s + 30 < len(w))) AS start_word FROM w), c AS (SELECT doc_id, start_word // 150 AS chunk_no, start_word, least(start_word + 180, len(w)) AS end_word, array_to_string(w[start_word + 1:least(start_word + 180, len(w))], ' ') AS text FROM s)"
ROUND_EVEN = "round_even((end_word - start_word) * 1.33::DOUBLE, 0)::BIGINT"


@query(f"WITH {CHUNK} SELECT doc_id, doc_id || ':' || lpad(chunk_no::VARCHAR, 4, '0') AS chunk_id, chunk_no, text, start_word, end_word, greatest(1, {ROUND_EVEN}) AS token_estimate FROM c")
def chunk_words(spark, sf):
    return C.chunk_text(documents(spark, sf))


@query(f"WITH {CHUNK} SELECT doc_id, count(*) AS n_chunks, sum(greatest(1, {ROUND_EVEN}))::BIGINT AS tokens FROM c GROUP BY doc_id")
def chunk_counts(spark, sf):
    return C.chunk_text(documents(spark, sf)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_estimate").alias("tokens"))


def markdown(spark, sf) -> DataFrame:
    """Pages as Markdown: first-level headings become lines with #, other tags line breaks."""
    t = F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "<[^>]*>", "\n")
    return table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), t.alias("text"))


MD = "md AS (SELECT page_id AS doc_id, regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'), '<[^>]*>', chr(10), 'g') AS text FROM pages), ln AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS l FROM md)), hd AS (SELECT *, regexp_matches(line, '^(#{1,6})\\s+(.+?)\\s*$') AS h FROM ln), sc AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM hd), bd AS (SELECT doc_id, n, max(CASE WHEN h THEN trim(regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*$', 2)) END) AS heading, max(CASE WHEN h THEN length(regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*$', 1)) END) AS level, regexp_replace(coalesce(string_agg(CASE WHEN NOT h THEN trim(line) END, chr(10) ORDER BY i), ''), '^\\s+|\\s+$', '', 'g') AS body FROM sc GROUP BY ALL)"


@query(f"WITH {MD} SELECT doc_id, heading, level::BIGINT AS level, body, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS section_no FROM bd WHERE body <> '' OR heading IS NOT NULL")
def markdown_sections(spark, sf):
    return C.markdown_sections(markdown(spark, sf))


@query()
def markdown_chunks(spark, sf):
    return C.chunk_markdown(markdown(spark, sf)).drop("text")


def asked(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


NORM = f"trim(regexp_replace(lower(text), '{WS}', ' ', 'g'))"
USER = f"u AS (SELECT conv_id, turn, text, {NORM} AS n FROM conversations WHERE role = 'user')"
VARIANTS = (
    f"{USER}, k AS (SELECT *, string_split(n, ' ') AS t FROM u), x AS (SELECT *, list_filter(list_transform(t, lambda y: CASE y WHEN 'ai' THEN 'artificial intelligence' WHEN 'rag' THEN 'retrieval augmented generation' WHEN 'llm' THEN 'large language model' END), lambda y: y IS NOT NULL) AS ex, "
    f"array_to_string(list_filter(t, lambda y: NOT list_contains([{quoted(T.VARIANT_STOP_WORDS)}], y)), ' ') AS kw, regexp_replace(n, '^(what|how|why|when|where)\\s+', '') AS bare FROM k), a AS (SELECT *, CASE WHEN len(ex) > 0 THEN [n, n || ' ' || array_to_string(ex, ' ')] ELSE [n] END AS l FROM x), b AS (SELECT *, CASE WHEN kw <> '' AND NOT list_contains(l, kw) THEN list_append(l, kw) ELSE l END AS l2 FROM a), "
    "v AS (SELECT conv_id, turn, CASE WHEN n = '' THEN [] WHEN bare <> '' AND NOT list_contains(l2, bare) THEN list_append(l2, bare) ELSE l2 END[1:4] AS variants FROM b)"
)


@query(f"WITH {VARIANTS} SELECT conv_id, turn, array_to_string(variants, '|') AS variants, len(variants) AS n_variants, len(variants) > 1 AS use_hybrid FROM v")
def query_variants(spark, sf):
    p = asked(spark, sf).select("conv_id", "turn", T.retrieval_plan(F.col("text")).alias("p"))
    return p.select("conv_id", "turn", F.array_join("p.variants", "|").alias("variants"), F.size("p.variants").alias("n_variants"), "p.use_hybrid")


FILTER = f"{USER}, k AS (SELECT *, regexp_extract_all(n, '{NWS}') AS t FROM u), f AS (SELECT *, list_filter(t, lambda y: NOT list_contains([{quoted(T.STOP_WORDS)}], y)) AS c FROM k), g AS (SELECT *, CASE WHEN len(t) <= 1 THEN t WHEN len(c) < 1 THEN t[1:1] ELSE c END AS tokens FROM f)"


@query(f"WITH {FILTER} SELECT conv_id, turn, CASE WHEN len(t) <= 1 THEN n ELSE array_to_string(tokens, ' ') END AS filtered, len(tokens) AS n_tokens FROM g")
def stopword_filter(spark, sf):
    n = T.folded(F.col("text"))
    return asked(spark, sf).select("conv_id", "turn", T.filtered_query(n).alias("filtered"), F.size(T.content_tokens(n)).alias("n_tokens"))


CASE = "CASE y " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in T.SYNONYMS.items()) + " END"


@query(f"WITH u AS (SELECT conv_id, turn, regexp_replace(regexp_replace({NORM}, ' the ', ' ml ', 'g'), ' de ', ' nlp ', 'g') AS n FROM conversations WHERE role = 'user'), k AS (SELECT *, list_filter(list_transform(regexp_extract_all(n, '{NWS}'), lambda y: {CASE}), lambda y: y IS NOT NULL) AS a FROM u), d AS (SELECT *, list_filter(a, lambda y, i: list_position(a, y) = i)[1:3] AS ex FROM k) SELECT conv_id, turn, array_to_string(ex, '|') AS expansions, CASE WHEN len(ex) > 0 THEN n || ' ' || array_to_string(ex, ' ') ELSE n END AS expanded FROM d")
def query_expand(spark, sf):
    """Synonyms; the invented prose has none, so two of its words stand for abbreviations."""
    n = F.regexp_replace(F.regexp_replace(T.folded(F.col("text")), " the ", " ml "), " de ", " nlp ")
    q = asked(spark, sf).select("conv_id", "turn", n.alias("n")).withColumn("ex", T.expansions(T.chunk_tokens(F.col("n"))))
    return q.select("conv_id", "turn", F.array_join("ex", "|").alias("expansions"), T.expanded_query(F.col("n"), F.col("ex")).alias("expanded"))


@query()
def query_normalise(spark, sf):
    return asked(spark, sf).select("conv_id", "turn", T.normalised_query(F.col("text")).alias("normalised"), T.normalised_query(F.col("text"), strip_accents=True, max_length=64).alias("plain"))


@query("SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS slug, sha1(trim(regexp_replace(lower(text), '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}]+', ' ', 'g'))) AS doc_key FROM documents")
def slugs_and_keys(spark, sf):
    return documents(spark, sf).select("doc_id", T.slug(F.concat_ws(" ", "source", "lang")).alias("slug"), T.duplicate_key(F.col("text")).alias("doc_key"))


# -- citations: every second turn's full stops become citations of its number --

ANSWERS = "an AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN replace(text, '.', ' [S' || (turn % 4 + 1) || '].') ELSE text END AS answer FROM conversations)"
CLAIMS = f"{ANSWERS}, cl AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(trim(answer), '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda y: trim(y)), lambda y: y <> '') AS claims FROM an), ci AS (SELECT *, list_sort(list_distinct(regexp_extract_all(answer, '\\[(S\\d+)\\]', 1))) AS cited, list_filter(claims, lambda y: len(regexp_extract_all(y, '{NWS}')) >= 5 AND NOT regexp_matches(y, '\\[S\\d+\\]')) AS uncited FROM cl)"


def answers(spark, sf) -> DataFrame:
    cite = F.concat(F.lit(" [S"), (F.col("turn") % 4 + 1).cast("string"), F.lit("]."))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.replace("text", F.lit("."), cite)).otherwise(F.col("text")).alias("answer"))


@query(f"WITH {CLAIMS} SELECT conv_id, turn, array_to_string(cited, ',') AS cited, len(claims) AS n_claims, len(uncited) AS n_uncited FROM ci")
def citations(spark, sf):
    a = F.col("answer")
    return answers(spark, sf).select("conv_id", "turn", F.array_join(T.citation_labels(a), ",").alias("cited"), F.size(T.claims(a)).alias("n_claims"), F.size(T.uncited_claims(a)).alias("n_uncited"))


@query(f"WITH {CLAIMS} SELECT conv_id, turn, unnest(uncited) AS claim FROM ci")
def uncited_claims(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", F.explode(T.uncited_claims(F.col("answer"))).alias("claim"))


@query(f"WITH {CLAIMS} SELECT conv_id, turn, len(list_filter(cited, lambda y: y NOT IN ('S1', 'S2'))) = 0 AND len(uncited) = 0 AS ok, array_to_string(list_filter(cited, lambda y: y NOT IN ('S1', 'S2')), ',') AS unknown_labels FROM ci")
def citation_check(spark, sf):
    c = answers(spark, sf).select("conv_id", "turn", T.citation_check(F.col("answer"), T.words_array("S1", "S2")).alias("c"))
    return c.select("conv_id", "turn", "c.ok", F.array_join("c.unknown_labels", ",").alias("unknown_labels"))


def passages(spark, sf) -> DataFrame:
    """query_id, query, passages: the hits of the lexical run in order."""
    hits = S.beside(S.bm25_topk(documents(spark, sf), benchmark(spark, sf), 5), documents(spark, sf))
    p = F.struct("rank", "text", "source", "score", F.lit("").alias("title"))
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(p)).alias("passages")).join(benchmark(spark, sf), "query_id")


@query()
def context_window(spark, sf):
    return passages(spark, sf).select("query_id", T.context_window(F.col("passages"), 4000, True).alias("context"))


@query()
def rag_prompt(spark, sf):
    return passages(spark, sf).select("query_id", T.rag_prompt(F.col("query"), T.context_window(F.col("passages"))).alias("prompt"), T.refusal_prompt(F.col("query"), F.lit("no passage")).alias("refusal"))


@query(f"WITH {BM25}, h AS (SELECT query_id, rank, source FROM bm JOIN documents USING (doc_id)) SELECT query_id, string_agg('[S' || rank || '] ' || source, chr(10) ORDER BY rank) AS bibliography FROM h GROUP BY query_id")
def bibliography(spark, sf):
    hits = S.beside(S.bm25_topk(documents(spark, sf), benchmark(spark, sf), 10), documents(spark, sf).select("doc_id", "source"))
    return hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("s")).select("query_id", T.bibliography(F.col("s")).alias("bibliography"))


@query("SELECT conv_id, turn, 'S' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations")
def citation_labels(spark, sf):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("S"), n.cast("string")).alias("label"))
