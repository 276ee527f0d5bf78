"""Readers and writers of the engine's file formats. Schemas are declared, never inferred."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVAL_QUERIES = T.StructType([T.StructField("query", T.StringType()), T.StructField("relevant_docs", T.ArrayType(T.StringType())), T.StructField("relevance_grades", T.MapType(T.StringType(), T.IntegerType()))])
PAIRS = T.StructType([T.StructField(n, T.StringType()) for n in ("query", "positive", "negative")])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value. A file is one row of the reader and is cut in its task, so numbers are right however Spark splits files; meant for text files that fit a task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r\n|\n|\r").alias("v"))
    return whole.select("file", F.posexplode("v").alias("line", "value")).withColumn("line", F.col("line") + 1)


def _checked(ok: Column, value: Column, problem: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(f": {problem}"))))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text: one document a line; of .jsonl, strings or objects with text. Blank lines are skipped; a bad one raises with its number."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    if not path.endswith(".jsonl"):
        return rows.select("file", "line", F.trim("value").alias("text"))
    v = F.try_parse_json("value")
    text = F.coalesce(F.try_variant_get(v, "$.text", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return rows.select("file", "line", _checked(text.isNotNull(), text, "neither a string nor an object with text").alias("text"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """file, line, query: as documents; objects may have text or query (an empty text gives way to query)."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    if not path.endswith(".jsonl"):
        return rows.select("file", "line", F.trim("value").alias("query"))
    v = F.try_parse_json("value")
    get = lambda p: F.try_variant_get(v, p, "string")
    q = F.coalesce(F.nullif(get("$.text"), F.lit("")), get("$.query"), F.when(F.schema_of_variant(v) == "STRING", get("$")))
    return rows.select("file", "line", _checked(q.isNotNull(), q, "neither a string nor an object with text or query").alias("query"))


def tsv(spark: SparkSession, path: str, min_cols: int) -> DataFrame:
    """file, line, cols: tab-separated without quoting; too few columns raise."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("cols", F.split("value", "\t"))
    return rows.select("file", "line", _checked(F.size("cols") >= min_cols, F.col("cols"), f"fewer than {min_cols} columns").alias("cols"))


def corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text: id and text, or id, title and text (joined by a space). A repeated id raises."""
    c = F.col("cols")
    rest = F.array_join(F.slice(c, 3, F.greatest(F.size(c) - 2, F.lit(1))), "\t")
    text = F.when(F.size(c) == 2, F.element_at(c, 2)).otherwise(F.trim(F.concat(F.element_at(c, 2), F.lit(" "), rest)))
    d = tsv(spark, path, 2).select(F.element_at(c, 1).alias("doc_id"), text.alias("text"))
    g = d.groupBy("doc_id").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    return g.select("doc_id", F.when(F.col("n") == 1, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("repeated doc_id "), F.col("doc_id")))).alias("text"))


def queries_tsv(spark: SparkSession, path: str) -> DataFrame:
    c = F.col("cols")
    return tsv(spark, path, 2).select(F.element_at(c, 1).alias("query_id"), F.array_join(F.slice(c, 2, F.size(c) - 1), "\t").alias("query"))


def qrels_tsv(spark: SparkSession, path: str, drop_zero: bool = True) -> DataFrame:
    """query_id, doc_id, grade: grades of 0 or less are dropped first; of a repeated pair the last line counts."""
    c = F.col("cols")
    q = tsv(spark, path, 4).select("file", "line", F.element_at(c, 1).alias("query_id"), F.element_at(c, 3).alias("doc_id"), F.trim(F.element_at(c, 4)).cast("int").alias("grade"))
    q = q.where("grade > 0") if drop_zero else q
    return q.groupBy("query_id", "doc_id").agg(F.max_by("grade", F.struct("file", "line")).alias("grade"))


def dataset(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a folder with corpus.tsv, queries.tsv, qrels.tsv; judgments of unknown documents, and queries without any, are dropped."""
    corpus, q, rel = corpus_tsv(spark, f"{folder}/corpus.tsv"), queries_tsv(spark, f"{folder}/queries.tsv"), qrels_tsv(spark, f"{folder}/qrels.tsv")
    rel = rel.join(corpus, "doc_id", "left_semi")
    return corpus, q.join(rel, "query_id", "left_semi"), rel.join(q, "query_id", "left_semi")


def eval_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of JSON lines {query, relevant_docs, relevance_grades?}; without grades, or with an empty map, each relevant document has 1; with grades, a relevant document that lacks one has 0."""
    rows = spark.read.schema(EVAL_QUERIES).json(path).withColumn("query_id", F.sha1("query"))
    graded = F.size("relevance_grades") > 0
    rel = rows.select("query_id", graded.alias("graded"), F.explode("relevant_docs").alias("doc_id"), "relevance_grades")
    return rows.select("query_id", "query"), rel.select("query_id", "doc_id", F.when(F.coalesce("graded", F.lit(False)), F.coalesce(F.element_at("relevance_grades", F.col("doc_id")), F.lit(0))).otherwise(1).alias("grade"))


def training_pairs(spark: SparkSession, path: str) -> DataFrame:
    """query, positive, negative (null in pairs)."""
    return spark.read.schema(PAIRS).json(path)


def metric_vectors(spark: SparkSession, path: str) -> DataFrame:
    """metric, query_id (the position), value of {metric: [numbers]}."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<double>>").alias("m"))
    return rows.select(F.explode("m").alias("metric", "v")).select("metric", F.posexplode("v").alias("query_id", "value"))


def scores_and_labels(spark: SparkSession, path: str) -> DataFrame:
    """score, label of {"scores": [...], "labels": [...]} or of rows [{"score", "label"}]."""
    rows = spark.read.text(path, wholetext=True)
    two = F.from_json("value", "struct<scores:array<double>,labels:array<double>>")
    many = F.from_json("value", "array<struct<score:double,label:double>>")
    zipped = F.transform(F.arrays_zip(two["scores"].alias("scores"), two["labels"].alias("labels")), lambda x: F.struct(x["scores"].alias("score"), x["labels"].alias("label")))
    return rows.select(F.explode(F.when(F.ltrim("value").startswith("["), many).otherwise(zipped)).alias("x")).select("x.*")


def numbers(spark: SparkSession, path: str) -> DataFrame:
    """x of [numbers] or {"values": [numbers]}."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<double>")).otherwise(F.from_json("value", "struct<values:array<double>>")["values"])).alias("x"))


def save_index(corpus: DataFrame, path: str, config: dict[str, Any], cluster: str | None = None) -> None:
    """A corpus with embeddings as Parquet, by cluster if there is one, and its settings beside."""
    w = corpus.write.mode("overwrite")
    (w.partitionBy(cluster) if cluster else w).parquet(f"{path}/corpus")
    corpus.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").write.mode("overwrite").json(f"{path}/config")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Any]]:
    return spark.read.parquet(f"{path}/corpus"), json.loads(spark.read.schema("config string").json(f"{path}/config").first()["config"])


def add_documents(path: str, docs: DataFrame) -> None:
    """Appends; nothing is rebuilt."""
    docs.write.mode("append").parquet(f"{path}/corpus")


def clear_index(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def save_report(report: DataFrame, path: str, title: str = "Report") -> None:
    """A report, whole, on the driver's disk: .json as rows, .md as a table."""
    rows = [json.loads(r) for r in report.toJSON().toLocalIterator()]
    if path.endswith(".md"):
        cols = report.columns
        body = "\n".join("| " + " | ".join(str(r.get(c, "")) for c in cols) + " |" for r in rows)
        Path(path).write_text(f"# {title}\n\n| {' | '.join(cols)} |\n|{'---|' * len(cols)}\n{body}\n", encoding="utf-8")
    else:
        Path(path).write_text(json.dumps(rows, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def load_report(path: str) -> list[dict[str, Any]]:
    return json.loads(Path(path).read_text(encoding="utf-8"))
