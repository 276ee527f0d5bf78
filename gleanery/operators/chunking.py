"""Chunks of text and Markdown sections, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T


def _windows(words: Column, max_words: int, overlap: int) -> Column:
    """Starts of the windows: none starts where one before has reached the end."""
    step = max_words - overlap
    return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), lambda s: (s == 0) | (s + overlap < F.size(words)))).otherwise(F.array().cast("array<int>"))


def chunk_text(docs: DataFrame, max_words: int = 180, overlap_words: int = 30, source: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """source, chunk_id, chunk_no, text, start_word, end_word, token_estimate: overlapping windows of words; one row in, its chunks out, no shuffle."""
    if max_words <= 0 or not 0 <= overlap_words < max_words:
        raise ValueError("max_words must be positive and overlap_words in [0, max_words)")
    d = docs.select(source, *keep, T.chunk_tokens(F.coalesce(F.col(text), F.lit(""))).alias("__w"))
    d = d.select(source, *keep, "__w", F.posexplode(_windows(F.col("__w"), max_words, overlap_words)).alias("chunk_no", "start_word"))
    end = F.least(F.col("start_word") + max_words, F.size("__w"))
    name = F.format_string("%s:%04d", F.col(source).cast("string"), F.col("chunk_no"))
    return d.select(source, *keep, name.alias("chunk_id"), "chunk_no", F.array_join(F.slice("__w", F.col("start_word") + 1, end - F.col("start_word")), " ").alias("text"), "start_word", end.alias("end_word"), T.token_estimate(end - F.col("start_word")).alias("token_estimate"))


def markdown_sections(docs: DataFrame, source: str = "doc_id", text: str = "text") -> DataFrame:
    """source, section_no (from 1), heading, level, body: headings start sections; lines are stripped. All within a row, each line copied once: sections are the slices between headings."""
    head = r"^(#{1,6})\s+(.+?)\s*$"
    lines = docs.select(source, F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n|\r").alias("l"))
    at = F.filter(F.transform("l", lambda x, i: F.when(x.rlike(head), i + 1)), lambda i: i.isNotNull())
    cuts = lines.select(source, "l", F.concat(F.array(F.lit(0)), at, F.array(F.size("l") + 1)).alias("cut"))

    def section(i: Column) -> Column:
        start, end = F.get("cut", i), F.get("cut", i + 1)
        title = F.get("l", start - 1)  # null before the first heading
        body = F.array_join(F.transform(F.slice("l", start + 1, end - start - 1), lambda x: F.trim(x)), "\n")
        return F.struct(
            F.trim(F.regexp_extract(title, head, 2)).alias("heading"),
            F.length(F.regexp_extract(title, head, 1)).alias("level"),
            F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"),
        )

    all_ = F.transform(F.sequence(F.lit(0), F.size("cut") - 2), section)
    kept = F.filter(all_, lambda s: (s["body"] != "") | s["heading"].isNotNull())
    found = cuts.select(source, F.posexplode(kept).alias("n", "s"))
    return found.select(source, "s.heading", "s.level", "s.body", (F.col("n") + 1).alias("section_no"))


def chunk_markdown(docs: DataFrame, max_words: int = 180, overlap_words: int = 30, source: str = "doc_id", text: str = "text", include_heading: bool = True) -> DataFrame:
    """Chunks of sections with heading and level. Ids carry the heading's slug and, as headings repeat, the section's number."""
    s = markdown_sections(docs, source, text)
    whole = F.when(F.col("heading").isNotNull() & F.lit(include_heading), F.trim(F.concat_ws("\n", "heading", F.when(F.col("body") != "", F.col("body"))))).otherwise(F.col("body"))
    name = F.concat_ws(":", F.col(source).cast("string"), F.col("section_no").cast("string"), T.slug(F.coalesce("heading", F.concat(F.lit("section-"), F.col("section_no").cast("string")))))
    return chunk_text(s.select(source, "heading", "level", "section_no", name.alias("section_id"), whole.alias("__t")), max_words, overlap_words, "section_id", "__t", keep=(source, "heading", "level", "section_no"))
