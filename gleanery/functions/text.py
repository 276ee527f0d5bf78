"""Text expressions: Column in, Column out, all on the JVM side except NFC normalisation.

There are several tokenizers on purpose; each belongs to the operators that name it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and templates that results depend on.
VARIANT_STOP_WORDS = "a an and are for how is of the to what with".split()
VARIANT_EXPANSIONS = {"ai": "artificial intelligence", "rag": "retrieval augmented generation", "llm": "large language model"}
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would shall "
    "should may might must can could not no nor so yet both either neither as if then than that this these those which who whom what "
    "where when why how i me my myself we our us you your he she it its they them their"
).split()
SYNONYMS = {
    "ml": ["machine learning"], "ai": ["artificial intelligence"], "nlp": ["natural language processing"], "dl": ["deep learning"], "nn": ["neural network"],
    "rag": ["retrieval augmented generation"], "llm": ["large language model"], "api": ["application programming interface"], "db": ["database"],
    "ocr": ["optical character recognition"], "cv": ["computer vision"], "ir": ["information retrieval"],
}
CLUSTER_STOP_WORDS = "a an the and or but in on at to for of with by is are was were be it that this as from not can will its into also more".split()
RAG_INSTRUCTIONS = "Answer using only the provided context. Cite sources with [S1]-style labels after each factual claim. If the context is insufficient, say what is missing instead of guessing."
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def words_array(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


# ---- tokenizers ----


def lexical_tokens(text: Column) -> Column:
    """BM25's: runs of a-z and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def profile_tokens(text: Column) -> Column:
    """Corpus profiling's: runs of letters, digits, underscore and apostrophe in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))


def explain_tokens(text: Column) -> Column:
    """The explainers': case kept."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9][A-Za-z0-9'_-]*"), F.lit(0))


def chunk_tokens(text: Column) -> Column:
    """The chunker's: runs of anything but white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def cluster_tokens(text: Column) -> Column:
    """Cluster labels': runs of three letters or more, without stop words, with multiplicity."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~w.isin(CLUSTER_STOP_WORDS))


# ---- normal forms ----


def folded(text: Column) -> Column:
    """Lower case with single spaces: the key of exact duplicates, and the normal form of a query for planning."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def blank(text: Column) -> Column:
    """Nothing but white space, found without a normal form."""
    return ~text.rlike(r"(?U)\S")


def duplicate_key(text: Column) -> Column:
    return F.sha1(folded(text))


def slug(value: Column) -> Column:
    s = F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def token_estimate(n_words: Column) -> Column:
    """Half-even, as Python rounds."""
    return F.greatest(F.lit(1), F.bround(n_words * F.lit(1.33)).cast("int"))


def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _plain(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode("ascii"))


def nfc(text: Column) -> Column:
    """Unicode NFC; Spark has no function for it."""
    return F.pandas_udf(_nfc, "string")(text)


def without_accents(text: Column) -> Column:
    return F.pandas_udf(_plain, "string")(text)


def normalised_query(text: Column, lowercase: bool = True, strip_accents: bool = False, max_length: int = 512, unicode: bool = True) -> Column:
    """NFC, accents off (optional), single spaces, lower case, cut to max_length at a space."""
    if unicode:
        text = nfc(text)
    if strip_accents:
        text = without_accents(text)
    text = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    if lowercase:
        text = F.lower(text)
    if max_length > 0:
        cut = F.substring(text, 1, max_length)
        # up to the last space, if there is one
        text = F.when(F.length(text) > max_length, F.regexp_replace(cut, r"^(.*) [^ ]*$", "$1")).otherwise(text)
    return text


def content_tokens(query: Column, stop_words: list[str] | None = None, min_tokens: int = 1, min_remaining: int = 1) -> Column:
    """A query's tokens without stop words; short queries stay, and at least min_remaining tokens."""
    stop = STOP_WORDS if stop_words is None else stop_words
    tokens = chunk_tokens(query)
    content = F.filter(tokens, lambda t: ~F.lower(t).isin(stop))
    return F.when(F.size(tokens) <= min_tokens, tokens).when(F.size(content) < min_remaining, F.slice(tokens, 1, min_remaining)).otherwise(content)


def filtered_query(query: Column, **how) -> Column:
    tokens = chunk_tokens(query)
    return F.when(F.size(tokens) <= how.get("min_tokens", 1), query).otherwise(F.array_join(content_tokens(query, **how), " "))


def expansions(tokens: Column, synonyms: dict[str, list[str]] | None = None, max_expansions: int = 3) -> Column:
    """Phrases for known tokens, in their order, each once."""
    table = SYNONYMS if synonyms is None else {k.lower(): v for k, v in synonyms.items()}
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), words_array(*v))])
    found = F.filter(F.transform(tokens, lambda t: F.element_at(known, F.lower(t))), lambda p: p.isNotNull())
    phrases = F.array_distinct(F.flatten(found))
    return F.slice(phrases, 1, max_expansions) if max_expansions > 0 else phrases


def expanded_query(query: Column, phrases: Column) -> Column:
    return F.when(F.size(phrases) > 0, F.concat_ws(" ", query, F.array_join(phrases, " "))).otherwise(query)


def query_variants(query: Column, max_variants: int = 4) -> Column:
    """The normal form; with expansions; without stop words; without the question word. The last two only if new."""
    norm = folded(F.coalesce(query, F.lit("")))
    tokens = F.split(norm, " ")
    known = F.create_map(*[F.lit(x) for kv in VARIANT_EXPANSIONS.items() for x in kv])
    extra = F.filter(F.transform(tokens, lambda t: F.element_at(known, t)), lambda p: p.isNotNull())
    first = F.when(F.size(extra) > 0, F.array(norm, F.concat_ws(" ", norm, F.array_join(extra, " ")))).otherwise(F.array(norm))
    keywords = F.array_join(F.filter(tokens, lambda t: ~t.isin(VARIANT_STOP_WORDS)), " ")
    bare = F.regexp_replace(norm, r"^(what|how|why|when|where)\s+", "")

    def plus(have: Column, new: Column) -> Column:
        return F.when((new != "") & ~F.array_contains(have, new), F.concat(have, F.array(new))).otherwise(have)

    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.slice(plus(plus(first, keywords), bare), 1, max_variants))


def retrieval_plan(query: Column, top_k: int = 5) -> Column:
    if top_k <= 0:
        raise ValueError("top_k must be greater than zero")
    variants = query_variants(query)
    return F.struct(F.trim(query).alias("original_query"), variants.alias("variants"), F.lit(top_k).alias("top_k"), (F.size(variants) > 1).alias("use_hybrid"))


# ---- citations and claims ----


def citation_labels(answer: Column) -> Column:
    """The distinct S1-style labels, sorted as strings."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[(S\d+)\]"), F.lit(1))))


def claims(answer: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(F.coalesce(answer, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def uncited_claims(answer: Column, min_words: int = 5) -> Column:
    return F.filter(claims(answer), lambda c: (F.size(chunk_tokens(c)) >= min_words) & ~c.rlike(r"\[S\d+\]"))


def citation_check(answer: Column, available: Column) -> Column:
    cited, missing = citation_labels(answer), uncited_claims(answer)
    unknown = F.array_except(cited, available)
    return F.struct(((F.size(unknown) == 0) & (F.size(missing) == 0)).alias("ok"), cited.alias("cited_labels"), unknown.alias("unknown_labels"), missing.alias("uncited_claims"))


def bibliography(sources: Column, titles: Column | None = None) -> Column:
    """One line a source: its label, the source, its title if any."""
    if titles is None:
        return F.array_join(F.transform(sources, lambda s, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), s)), "\n")
    both = F.arrays_zip(sources.alias("s"), titles.alias("t"))
    return F.array_join(F.transform(both, lambda x, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), x["s"], F.when(F.coalesce(x["t"], F.lit("")) != "", F.concat(F.lit(" — "), x["t"])).otherwise(""))), "\n")


# ---- prompts ----


def required(value: Column, name: str) -> Column:
    """Without control characters, trimmed; raises if nothing is left."""
    clean = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), CONTROL, ""))
    return F.when(clean == "", F.raise_error(F.lit(f"{name} is required"))).otherwise(clean)


def quoted(value: Column) -> Column:
    return F.array_join(F.transform(F.split(value, r"\r\n|\n|\r"), lambda x: F.concat(F.lit("    "), x)), "\n")


def rag_prompt(question: Column, context: Column, instructions: str = RAG_INSTRUCTIONS, answer_style: str = "concise") -> Column:
    import re

    style = re.sub(CONTROL, "", answer_style or "").strip()
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9 _-]{0,39}", style):
        raise ValueError("answer_style must be a short single-line label")
    return F.concat(F.lit("Instructions:\n"), required(F.lit(instructions), "instructions"), F.lit(f"\n\nAnswer style: {style}\n\nContext:\n"), quoted(required(context, "context")), F.lit("\n\nQuestion:\n"), quoted(required(question, "question")), F.lit("\n\nGrounded answer:"))


def refusal_prompt(question: Column, reason: Column) -> Column:
    return F.concat(
        F.lit("The retrieval context is not sufficient to answer safely.\nQuestion:\n"), quoted(required(question, "question")), F.lit("\nMissing context:\n"),
        quoted(required(reason, "missing_context_reason")), F.lit("\nRespond with a brief explanation and suggest the next retrieval step."),
    )


def context_window(passages: Column, max_chars: int = 4000, include_scores: bool = False) -> Column:
    """A citation-labelled block of rank-ordered passages (text, source, score, title) within a character budget: a fold over the array."""
    if max_chars <= 0:
        raise ValueError("max_chars must be greater than zero")

    def step(acc: Column, p: Column) -> Column:
        n = acc["n"] + 1
        title = F.coalesce(F.when(p["title"] != "", p["title"]), p["source"])
        score = F.when(p["score"].isNotNull(), F.concat(F.lit(" score="), F.format_string("%.3f", p["score"]))).otherwise("") if include_scores else F.lit("")
        block = F.concat(F.lit("[S"), n.cast("string"), F.lit("] "), title, score, F.lit("\n"), F.trim(p["text"]))
        sep = F.when(F.length(acc["out"]) > 0, F.lit("\n\n")).otherwise("")
        budget = F.lit(max_chars) - F.length(acc["out"]) - F.length(sep)
        long = F.length(block) > budget
        stop = acc["done"] | (budget <= 0) | (long & (budget < 20))
        cut = F.concat(F.regexp_replace(F.substring(block, F.lit(1), budget - 1), r"\s+$", ""), F.lit("…"))
        out = F.when(stop, acc["out"]).otherwise(F.concat(acc["out"], sep, F.when(long, cut).otherwise(block)))
        return F.struct(out.alias("out"), n.alias("n"), (stop | (F.length(out) >= max_chars)).alias("done"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(passages, start, step, lambda acc: acc["out"])


def prometheus_labels(labels: Column) -> Column:
    """{k="v",...} of a map, keys sorted, values escaped."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"')))
    return F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")


def run_id(name: Column, started: Column) -> Column:
    """A run's id: its name's slug, cut to 30 characters, and its start."""
    return F.concat_ws("_", F.substring(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), 1, 30), F.date_format(started, "yyyyMMdd_HHmmss"))
