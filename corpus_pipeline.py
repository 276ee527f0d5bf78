"""The corpus pipeline: documents in, packed training sequences out.

STAGES are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame that the next one gets,
written as Parquet and read again by whoever runs the stages one by one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import stash
from gleanery.llm.language_id import UNKNOWN, predict, train
from gleanery.llm.line_dedup import without_repeated_lines
from gleanery.llm.mixing import mixture
from gleanery.llm.ngram_jaccard import jaccard_components
from gleanery.llm.packing import packed
from gleanery.llm.queries import tokenizer_path
from gleanery.llm.token_counts import counted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of whose letter trigrams less than that share occur in the learning texts is in none of their languages. Of sf0.1 documents
#: all have 0.76 or more, 99 % 0.99; letters at random have 0.1, Finnish 0.36, Russian 0.
LEAST_KNOWN = 0.5
#: How often the mixture repeats a source at most.
MAX_REPEAT = 2.0
#: Whose tokens the mixture and the packing count.
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: texts without letters, and those whose trigrams mostly occur in none, go. The label is learned from the documents' own; a null one is filled in with the prediction. Without any label all documents stay."""
    docs = docs.select(*COLUMNS)
    if (model := train(docs)) is None:  # nothing to tell languages by
        return docs
    found = predict(docs, model, keep=COLUMNS[:1] + COLUMNS[2:] + COLUMNS[1:2])
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= LEAST_KNOWN))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that repeat an earlier one, exactly or but for one character. Documents with nothing left, copies of earlier ones, go."""
    out = without_repeated_lines(docs.select(*COLUMNS), exact_chars=1)
    some = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")) > 0
    return out.where(some | ((F.col("n_exact") == 0) & (F.col("n_near") == 0))).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of near copies."""
    found = jaccard_components(docs)
    kept = found.where(F.col("component_id") == F.col("doc_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").select(*COLUMNS)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture, by tokens: every document once, those of small sources again, up to MAX_REPEAT times on average."""
    docs = stash(counted(docs, tokenizer_path(TOKENIZER), name="__tokens", keep=COLUMNS))
    return mixture(docs, tokens=F.col("__tokens"), max_repeat=MAX_REPEAT).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in packed training sequences, by tokens."""
    return packed(stash(counted(docs, tokenizer_path(TOKENIZER))), tokens=F.col("n_tokens"))


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("source mixing", sources), ("best-fit packing", sequences)]

#: No SQL for a classifier, the sets' components and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
