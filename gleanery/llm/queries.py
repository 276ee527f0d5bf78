"""The queries opN_<name> of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import stash, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.warc import derive, responses_of_pages

    return derive(responses_of_pages(table(spark, sf_dir, "pages")), keep=("page_id",))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.html_text import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.language_id import predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.packing import packed
    from gleanery.llm.token_counts import counted

    docs = stash(counted(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
    return packed(docs, tokens=F.col("n_tokens"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.ngram_jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.mixing import mixture
    from gleanery.llm.token_counts import counted

    docs = stash(counted(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep=("doc_id", "source"), memo_words=1_000_000))
    return mixture(docs, tokens=F.col("n_tokens")).drop("n_tokens")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.line_dedup import without_repeated_lines

    return without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.fingerprints import edit_report

    return edit_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_html_main_text": op2_html_main_text,
    "op3_token_counts": op3_token_counts,
    "op4_nn_descent": op4_nn_descent,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_source_mixing": op8_source_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_fingerprints": op10_fingerprints,
}

ORACLE_SQL: dict[str, str] = {}
