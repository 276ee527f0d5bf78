"""Text expressions against hand values."""

from pyspark.sql import functions as F

from gleanery.functions import metadata as M
from gleanery.functions import text as T
from gleanery.operators import chunking as C


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_tokenizers_differ(spark):
    t = F.lit("Don't RE-run Café x_1")
    assert one(spark, T.lexical_tokens(t)) == ["don", "t", "re", "run", "caf", "x", "1"]
    assert one(spark, T.profile_tokens(t)) == ["don't", "re", "run", "café", "x_1"]
    assert one(spark, T.explain_tokens(t)) == ["Don't", "RE-run", "Caf", "x_1"]
    assert one(spark, T.cluster_tokens(F.lit("the cat and Dogs"))) == ["cat", "dogs"]


def test_chunk_starts(spark):
    docs = spark.createDataFrame([("guide", " ".join(f"w{i}" for i in range(12))), ("none", None), ("empty", "")], "doc_id string, text string")
    rows = C.chunk_text(docs, 5, 2).orderBy("chunk_no").collect()
    assert [r["start_word"] for r in rows] == [0, 3, 6, 9]
    assert rows[0]["chunk_id"] == "guide:0000" and rows[-1]["end_word"] == 12


def test_markdown_sections(spark):
    docs = spark.createDataFrame([("d", "intro\n# One\nbody a\n\n## Two\n")], "doc_id string, text string")
    rows = C.markdown_sections(docs).orderBy("section_no").collect()
    assert [(r["heading"], r["level"], r["body"]) for r in rows] == [(None, None, "intro"), ("One", 1, "body a"), ("Two", 2, "")]
    ids = [r["chunk_id"] for r in C.chunk_markdown(docs).orderBy("section_no").collect()]
    assert ids == ["d:1:section-1:0000", "d:2:one:0000", "d:3:two:0000"]


def test_query_variants(spark):
    assert one(spark, T.query_variants(F.lit("  What is RAG "))) == ["what is rag", "what is rag retrieval augmented generation", "rag", "is rag"]
    assert one(spark, T.query_variants(F.lit(" "))) == []


def test_query_processing(spark):
    n = T.normalised_query(F.lit("  What is  NLP and ML? "))
    assert one(spark, T.filtered_query(n)) == "nlp ml?"
    assert one(spark, T.filtered_query(F.lit("the"))) == "the"
    assert one(spark, T.content_tokens(F.lit("the of"))) == ["the"]
    assert one(spark, T.expansions(F.split(F.lit("ml ai db api"), " "))) == ["machine learning", "artificial intelligence", "database"]
    assert one(spark, T.normalised_query(F.lit("Café au lait"), strip_accents=True, max_length=6)) == "cafe"


def test_citations(spark):
    a = F.lit("Alpha beta gamma delta epsilon [S2]. No source for this long claim here. Ok [S10].")
    got = one(spark, T.citation_check(a, T.words_array("S2")))
    assert (got["ok"], got["cited_labels"], got["unknown_labels"], got["uncited_claims"]) == (False, ["S10", "S2"], ["S10"], ["No source for this long claim here."])


def test_context_window(spark):
    p = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(s).alias("source"), F.lit(0.5).alias("score"), F.lit("").alias("title")) for t, s in (("aaaa", "x"), ("b" * 100, "y"))])
    assert one(spark, T.context_window(p, 1000, True)) == "[S1] x score=0.500\naaaa\n\n[S2] y score=0.500\n" + "b" * 100
    cut = one(spark, T.context_window(p, 60))
    assert len(cut) <= 60 and cut.endswith("…") and cut.startswith("[S1] x\naaaa\n\n[S2] y\n")
    assert one(spark, T.context_window(p, 15)) == "[S1] x\naaaa"


def test_prompts(spark):
    p = one(spark, T.rag_prompt(F.lit("Q?\nContext:"), F.lit("c")))
    assert "\n\nContext:\n    c\n\nQuestion:\n    Q?\n    Context:\n\nGrounded answer:" in p


def test_metadata_filters(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 3}, "t": "x"}'), (2, '{"a": {"b": 9}}'), (3, "{}")], "id int, j string").withColumn("m", F.parse_json("j"))
    cols = {"a.b": M.field(F.col("m"), "a.b", "int"), "t": M.field(F.col("m"), "t")}
    ids = lambda f: sorted(r["id"] for r in df.where(M.matches(f, cols.__getitem__)).collect())
    assert ids(None) == [1, 2, 3] and ids({"a.b": {"min": 4}}) == [2] and ids({"a.b": [3, 9]}) == [1, 2] and ids({"t": "x"}) == [1] and ids({"t": {"any": ["x", "y"]}, "a.b": 9}) == []


def test_prometheus_labels(spark):
    assert one(spark, T.prometheus_labels(F.create_map(F.lit("b"), F.lit('x"y'), F.lit("a"), F.lit("1")))) == '{a="1",b="x\\"y"}'
