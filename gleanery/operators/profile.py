"""Corpus health: lengths, vocabulary, duplicates, embedding statistics, query coverage, audit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import vector as V
from gleanery.operators.search import TILE, compared, grid_block, grid_blocks, matrix, ranked, saved, usable


def length_stats(docs: DataFrame, short: int = 20, long: int = 4000) -> DataFrame:
    """One row over all documents: means and interpolated percentiles of characters and words (empty ones count), and how many are empty, very short, very long (empty ones don't)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.length(t).alias("c"), F.size(T.profile_tokens(t)).alias("w"), T.blank(t).alias("empty"))
    p = lambda x, at: F.percentile(x, F.lit(at))
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.avg("c").alias("char_mean"), p("c", 0.5).alias("char_median"), p("c", 0.9).alias("char_p90"), p("c", 0.99).alias("char_p99"),
        F.avg("w").alias("word_mean"), p("w", 0.5).alias("word_median"), p("w", 0.9).alias("word_p90"), p("w", 0.99).alias("word_p99"),
        F.count_if("empty").alias("empty_count"), F.count_if(~F.col("empty") & (F.col("c") < short)).alias("very_short_count"), F.count_if(~F.col("empty") & (F.col("c") > long)).alias("very_long_count"),
    )


def length_extremes(docs: DataFrame, n: int = 5) -> DataFrame:
    """kind (longest, shortest), rank, doc_id, n_chars: two top-n, no full sort."""
    d = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"))
    pick = lambda kind, *order: d.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("kind", F.lit(kind))
    return pick("longest", F.desc("n_chars"), F.desc("doc_id")).unionByName(pick("shortest", "n_chars", "doc_id")).select("kind", "rank", "doc_id", "n_chars")


def term_counts(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(T.profile_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_stats(docs: DataFrame) -> DataFrame:
    """One row: total, unique, type-token ratio, share of terms that occur once."""
    r = term_counts(docs).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("unique_tokens"), F.count_if(F.col("n") == 1).alias("hapax"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return r.select("total_tokens", "unique_tokens", share("unique_tokens", "total_tokens").alias("type_token_ratio"), share("hapax", "unique_tokens").alias("hapax_ratio"))


def top_terms(docs: DataFrame, n: int = 20) -> DataFrame:
    return term_counts(docs).orderBy(F.desc("n"), "term").limit(n)


def exact_duplicate_groups(docs: DataFrame, cap: int | None = None) -> DataFrame:
    """doc_key, size, first_id and the ids of groups of equal normal form; blank documents don't count. Largest first, cut to cap."""
    t = F.coalesce("text", F.lit(""))
    d = docs.where(~T.blank(t)).select("doc_id", T.duplicate_key(t).alias("doc_key"))
    g = d.groupBy("doc_key").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first_id")).where("size > 1")
    if cap is not None:
        g = g.orderBy(F.desc("size"), "first_id").limit(cap)
    return g


def exact_duplicate_members(docs: DataFrame, cap: int = 25) -> DataFrame:
    """doc_key, doc_id of the largest groups."""
    key = docs.select("doc_id", T.duplicate_key(F.coalesce("text", F.lit(""))).alias("doc_key"))
    return key.join(exact_duplicate_groups(docs, cap).select("doc_key"), "doc_key", "left_semi")


def exact_duplicate_summary(docs: DataFrame) -> DataFrame:
    """One row over all groups, before any cap."""
    g = exact_duplicate_groups(docs).agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("n_duplicates"))
    return docs.agg(F.count(F.lit(1)).alias("n_documents")).crossJoin(g).withColumn("n_unique", F.col("n_documents") - F.col("n_duplicates")).withColumn("duplication_ratio", F.when(F.col("n_documents") > 0, F.col("n_duplicates") / F.col("n_documents")).otherwise(0.0))


# ---- near duplicates of embeddings ----


def near_edges(vectors: DataFrame, threshold: float = 0.92) -> DataFrame:
    """a, b, score: pairs a < b with at least that cosine. Exact, hence all pairs: blocks of vectors meet two by two, by matrix products of their tiles."""
    u = vectors.select("doc_id", V.unit(V.doubles(F.col("embedding"))).alias("v")).where("v is not null")
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same, ids, first, last, scores in pair_tiles(pa.Table.from_batches(batches)):
            x, y = np.nonzero(scores >= threshold - 1e-9)
            keep = np.round(scores[x, y], 9) >= threshold
            x, y = x[keep], y[keep]
            a, b = ids.take(pa.array(first[x])), ids.take(pa.array(last[y]))
            out = pa.table({"a": pc.if_else(pc.less(a, b), a, b), "b": pc.if_else(pc.less(a, b), b, a), "score": pa.array(scores[x, y])})
            # inside a block each pair is met twice, and each vector meets itself
            yield from out.filter(pc.less(a, b) if same else pc.not_equal(a, b)).combine_chunks().to_batches()

    return block_pairs(u)[0].applyInArrow(meet, f"a {kind}, b {kind}, score double")


def block_pairs(rows: DataFrame) -> tuple[GroupedData, int]:
    """doc_id and v dealt to the pairs i <= j of blocks; b is a row's own block. And how many blocks there are."""
    blocks, _ = grid_blocks(rows)
    own = rows.withColumn("b", grid_block("doc_id", blocks))
    sent = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "doc_id", "v")
    return sent.groupBy("i", "j"), blocks


def pair_tiles(group: pa.Table) -> Iterator[tuple[bool, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a pair of blocks, tile by tile: whether they are one block, ids, the places of both tiles' rows, all their inner products. Rows go by id, so another pass has the same products."""
    group = group.sort_by([("doc_id", "ascending")]).combine_chunks()
    ids, side = group.column("doc_id").combine_chunks(), group.column("b").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    first, last, m = np.flatnonzero(side == i), np.flatnonzero(side == j), matrix(group)
    for a in range(0, len(first), TILE):
        for b in range(0, len(last), TILE):
            x, y = first[a : a + TILE], last[b : b + TILE]
            yield i == j, ids, x, y, m[x] @ m[y].T


def components(edges: DataFrame) -> DataFrame:
    """id, component (the least id reached) of all ids in edges: least labels with pointer jumping until none changes, each round's result checkpointed where executors can't lose it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both)
    labels = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("id"), "c"))
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b"}), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        top = labels.select(F.col("id").alias("t"), F.col("c").alias("tc"))
        step = saved(step.join(top, F.col("c") == F.col("t")).select("id", "was", F.least("c", "tc").alias("c")))
        labels = step.select("id", "c")
        if not step.where("c < was").limit(1).count():
            return labels.withColumnRenamed("c", "component")


def near_duplicate_groups(vectors: DataFrame, threshold: float = 0.92) -> DataFrame:
    """component, size, mean_similarity (over all pairs within), medoid (greatest mean likeness to the rest, ties to the smaller id)."""
    labels = components(near_edges(vectors, threshold))
    u = vectors.select("doc_id", V.unit(V.doubles(F.col("embedding"))).alias("v")).join(labels, F.col("doc_id") == F.col("id"))
    # a member's mean likeness to the rest follows from the group's sum vector, so no pairs are made
    total = u.select("component", F.posexplode("v").alias("i", "x")).groupBy("component", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    total = total.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("sum"), F.max("n").alias("n"))
    per = u.join(total, "component").select("component", F.col("doc_id").alias("a"), ((V.dot(F.col("v"), F.col("sum")) - V.dot(F.col("v"), F.col("v"))) / (F.col("n") - 1)).alias("m"))
    return per.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.avg("m").alias("mean_similarity"), F.min_by("a", F.struct(-F.round("m", 9), "a")).alias("medoid"))


# ---- embedding statistics ----


def centroid(vectors: DataFrame) -> DataFrame:
    """dim, mean."""
    return vectors.select(F.posexplode(V.doubles(F.col("embedding"))).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"))


def sampled(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to n rows, those with the least hash of (id, seed): the same rows however the table is stored."""
    return vectors.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


#: Bins of a pass over all pairs, and how many values a pass may hand to the driver.
PAIR_BINS = 4096
PAIR_VALUES = 1 << 18


def pairwise_stats(vectors: DataFrame, sample: int | None = None) -> DataFrame:
    """One row: n, mean and median inner product of all pairs; of those of a hash sample of so many rows, if that is asked for. The pairs aren't kept: each pass counts their products in bins, and the next one looks into the bins with the middle values, until these are few."""
    v = (vectors if sample is None else sampled(vectors, sample)).select("doc_id", V.doubles(F.col("embedding")).alias("v"))
    # pairs of equal ids don't count
    same = F.col("n") * (F.col("n") - 1) / 2
    rows, repeats = v.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(same), F.lit(0.0))).first()
    known = v.where(usable() & F.col("doc_id").isNotNull())
    top = known.agg(F.max(V.dot(F.col("v"), F.col("v")))).first()[0]
    out = lambda mean, median: v.sparkSession.createDataFrame([(mean, median, rows * (rows - 1) // 2 - int(repeats))], "mean_dot double, median_dot double, n_pairs bigint")
    if top is None:
        return out(None, None)
    if not np.isfinite(top):  # not a number, or infinite: as such values are ordered
        pairs = compared(known.select(F.col("doc_id").alias("a"), F.col("v").alias("va")), known.select(F.col("doc_id").alias("b"), F.col("v").alias("vb"))).where("a < b").select(V.dot(F.col("va"), F.col("vb")).alias("s"))
        return out(*pairs.agg(F.avg("s"), F.percentile("s", F.lit(0.5))).first())
    whole = (-float(top), float(top) or 1.0)
    counts, total = _pair_pass(known, whole, [()])
    n = int(sum(counts[()].values()))
    if not n:
        return out(None, None)
    found: dict[int, float] = {}
    asked = {r: ((), r) for r in {(n - 1) // 2, n // 2}}  # the bins that the value lies in, and its place there
    while asked:
        values, more = {}, {}
        for r, (path, place) in asked.items():
            at, below = next((b, below) for b, below in _running(counts[path]) if place < below + counts[path][b])
            size, path, place = counts[path][at], (*path, at), place - below
            lo, hi = _bin(whole, path)
            if hi - lo < 1e-15 * whole[1]:
                found[r] = (lo + hi) / 2
            elif size <= PAIR_VALUES:
                if path not in values:
                    values[path] = _pair_values(known, whole, path)
                found[r] = float(values[path][place])
            else:
                more[r] = path, place
        asked = more
        if asked:
            counts, _ = _pair_pass(known, whole, sorted({path for path, _ in asked.values()}))
    return out(total / n, (found[(n - 1) // 2] + found[n // 2]) / 2)


def _running(counts: dict[int, int]) -> Iterator[tuple[int, int]]:
    """Bins in order, each with the count of those before it."""
    below = 0
    for b in sorted(counts):
        yield b, below
        below += counts[b]


def _bin(whole: tuple[float, float], path: tuple[int, ...]) -> tuple[float, float]:
    """The bounds of a bin within bins."""
    lo, hi = whole
    for b in path:
        lo, hi = lo + (hi - lo) / PAIR_BINS * b, lo + (hi - lo) / PAIR_BINS * (b + 1)
    return lo, hi


def _bins(s: np.ndarray, lo: float, hi: float) -> np.ndarray:
    return np.clip((s - lo) * (PAIR_BINS / (hi - lo)), 0, PAIR_BINS - 1).astype(np.int32)


def _within(s: np.ndarray, whole: tuple[float, float], path: tuple[int, ...]) -> np.ndarray:
    for n, b in enumerate(path):
        s = s[_bins(s, *_bin(whole, path[:n])) == b]
    return s


def _pair_products(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for same, ids, x, y, s in pair_tiles(pa.Table.from_batches(batches)):
        if same:  # each pair once, none of equal ids
            at = ids.to_numpy(zero_copy_only=False)
            yield s[at[x][:, None] < at[y][None, :]]
        else:
            yield s.ravel()


def _pair_pass(rows: DataFrame, whole: tuple[float, float], paths: list[tuple[int, ...]]) -> tuple[dict, float]:
    """How many products of pairs lie in each bin of each path, and the sum of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((len(paths), PAIR_BINS), np.int64), 0.0
        for s in _pair_products(batches):
            total += float(s.sum())
            for i, path in enumerate(paths):
                n[i] += np.bincount(_bins(_within(s, whole, path), *_bin(whole, path)), minlength=PAIR_BINS)
        i, b = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"p": pa.array([*i, -1], pa.int32()), "bin": pa.array([*b, -1], pa.int32()), "n": pa.array([*n[i, b], 0], pa.int64()), "s": pa.array([0.0] * len(i) + [total])})

    got = block_pairs(rows)[0].applyInArrow(count, "p int, bin int, n bigint, s double").groupBy("p", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    counts = {path: {r["bin"]: r["n"] for r in got if r["p"] == i} for i, path in enumerate(paths)}
    return counts, sum(r["s"] for r in got if r["p"] == -1)


def _pair_values(rows: DataFrame, whole: tuple[float, float], path: tuple[int, ...]) -> np.ndarray:
    """The products in one bin, in order."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _pair_products(batches):
            yield pa.RecordBatch.from_pydict({"s": pa.array(_within(s, whole, path))})

    return np.sort(block_pairs(rows)[0].applyInArrow(pick, "s double").toArrow().column("s").to_numpy())


def hubness(vectors: DataFrame, k: int = 10) -> DataFrame:
    """One row: population skewness of how often each vector is among others' k nearest; 0 for few vectors or no spread."""
    from gleanery.operators.search import dense_topk

    hits = dense_topk(vectors, vectors.select(F.col("doc_id").alias("query_id"), "embedding"), k, exclude_self=True).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    d = vectors.select("doc_id").join(hits, "doc_id", "left").select(F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    return d.agg(F.when((F.count(F.lit(1)) > k + 1) & (F.stddev_pop("n") > 1e-12), F.skewness("n")).otherwise(0.0).alias("hubness_skewness"), F.max("n").cast("bigint").alias("max_in_degree"))


def effective_rank(vectors: DataFrame) -> DataFrame:
    """One row: exp of the entropy of the normalised singular values. The d x d Gram matrix is summed by tasks; only it reaches the driver."""
    import numpy as np

    def gram(batches):
        import pandas as pd

        total = 0
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy())
                total = total + m.T @ m
        if not isinstance(total, int):
            yield pd.DataFrame([(i, list(map(float, row))) for i, row in enumerate(total)], columns=["i", "row"])

    rows = vectors.select(V.doubles(F.col("embedding")).alias("v")).mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = max((r["i"] for r in rows), default=-1) + 1
    g = np.zeros((d, d))
    for r in rows:
        g[r["i"], r["j"]] = r["x"]
    s = np.sqrt(np.clip(np.linalg.eigvalsh(g), 0, None)) if d else np.zeros(0)
    s = s[s > 1e-12]
    p = s / s.sum() if len(s) else s
    return vectors.sparkSession.createDataFrame([(float(np.exp(-(p * np.log(p)).sum())) if len(s) else 0.0,)], "effective_rank double")


# ---- difficulty, coverage, diversity ----


def query_difficulty(run: DataFrame, queries: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """query_id, clarity, score_drop, score_std, below_threshold_ratio; queries without hits have zeros, if the queries are given."""
    below = F.avg((F.col("score") < threshold).cast("double")) if threshold is not None else F.lit(None).cast("double")
    d = run.groupBy("query_id").agg(F.min_by("score", "rank").alias("top1"), F.max_by("score", "rank").alias("topk"), F.avg("score").alias("m"), F.stddev_pop("score").alias("score_std"), below.alias("below_threshold_ratio"))
    d = d.withColumn("clarity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("top1") - F.col("m")) / (F.abs("top1") + 1e-9)))).withColumn("score_drop", F.col("top1") - F.col("topk"))
    out = ["query_id", "clarity", "score_drop", "score_std", "below_threshold_ratio"]
    if queries is None:
        return d.select(*out, "top1")
    return queries.select("query_id").join(d, "query_id", "left").select("query_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in out[1:4]], "below_threshold_ratio", F.coalesce("top1", F.lit(0.0)).alias("top1"))


def score_distribution(run: DataFrame) -> DataFrame:
    std = F.stddev_pop("score")
    return run.groupBy("query_id").agg(F.min_by("score", "rank").alias("top1"), F.max_by("score", "rank").alias("topk"), F.avg("score").alias("mean"), std.alias("std"), F.when(std > 1e-12, F.skewness("score")).otherwise(0.0).alias("skewness"))


def result_diversity(run: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, intra_list_similarity, coverage, entropy (of the scores' softmax), n_results."""
    r = run.join(vectors.select("doc_id", V.unit(V.doubles(F.col("embedding"))).alias("v")), "doc_id")
    g = r.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "v"))).alias("x"))  # a list is a query's k results
    total = F.aggregate(F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: F.when(a["rank"] < b["rank"], V.dot(a["v"], b["v"])).otherwise(0.0)))), F.lit(0.0), lambda s, y: s + y)
    n = F.size("x")
    ils = F.when(n > 1, 2 * total / (n * (n - 1))).otherwise(F.lit(1.0))
    top = F.array_max(F.transform("x", lambda a: a["score"]))
    e = F.transform("x", lambda a: F.exp(a["score"] - top))
    z = F.aggregate(e, F.lit(0.0), lambda s, y: s + y)
    entropy = -F.aggregate(F.transform(e, lambda y: y / z * F.log(F.greatest(y / z, F.lit(1e-12)))), F.lit(0.0), lambda s, y: s + y)
    return g.select("query_id", ils.alias("intra_list_similarity"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ils)).alias("coverage"), entropy.alias("entropy"), n.cast("bigint").alias("n_results"))


def query_coverage(run: DataFrame, queries: DataFrame, coverage: float = 0.30, clarity: float = 0.10) -> DataFrame:
    """query_id, bucket (uncovered, ambiguous, confident), top1, top1_doc, clarity, score_drop; queries without hits are uncovered."""
    d = query_difficulty(run, queries)
    best = run.groupBy("query_id").agg(F.min_by("doc_id", "rank").alias("top1_doc"), F.count(F.lit(1)).alias("hits"))
    d = d.join(best, "query_id", "left")
    bucket = F.when(F.col("hits").isNull() | (F.col("top1") < coverage), "uncovered").when(F.col("clarity") < clarity, "ambiguous").otherwise("confident")
    return d.select("query_id", bucket.alias("bucket"), "top1", "top1_doc", "clarity", "score_drop")


def coverage_summary(verdicts: DataFrame) -> DataFrame:
    c = lambda b: F.count_if(F.col("bucket") == b)
    n = F.count(F.lit(1))
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    return verdicts.agg(n.alias("n_queries"), c("uncovered").alias("n_uncovered"), c("ambiguous").alias("n_ambiguous"), c("confident").alias("n_confident"), share(n - c("uncovered")).alias("coverage_rate"), share(c("confident")).alias("confidence_rate"))


def coverage_examples(verdicts: DataFrame, n: int = 10) -> DataFrame:
    """The worst of the uncovered (least top score) and the ambiguous (least clarity)."""
    worst = F.when(F.col("bucket") == "uncovered", F.col("top1")).otherwise(F.col("clarity"))
    return ranked(verdicts.where("bucket <> 'confident'").withColumn("score", -worst), n, by=("bucket",), tie="query_id").drop("score")


# ---- audit ----


def audit(docs: DataFrame, vectors: DataFrame | None = None, near_threshold: float = 0.92, verdicts: DataFrame | None = None) -> DataFrame:
    """One row: the figures of the sections, a verdict (ready, needs_attention) and notes."""
    row = length_stats(docs).crossJoin(vocabulary_stats(docs)).crossJoin(exact_duplicate_summary(docs).drop("n_documents"))
    near = F.lit(None).cast("double")
    if vectors is not None:
        g = near_duplicate_groups(vectors, near_threshold).agg(F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("near_duplicates"))
        row = row.crossJoin(g).crossJoin(vectors.agg(F.count(F.lit(1)).alias("n_vectors")))
        near = F.when(F.col("n_vectors") > 0, F.col("near_duplicates") / F.col("n_vectors")).otherwise(0.0)
    row = row.withColumn("near_ratio", near)
    row = row.crossJoin(coverage_summary(verdicts).select("coverage_rate")) if verdicts is not None else row.withColumn("coverage_rate", F.lit(None).cast("double"))
    c = F.col
    bad = (c("n") == 0) | (c("empty_count") > 0) | (c("duplication_ratio") > 0.20) | F.coalesce(c("near_ratio") > 0.30, F.lit(False)) | F.coalesce(c("coverage_rate") < 0.5, F.lit(False))
    pc = lambda x: F.format_string("%.1f%%", x * 100)
    notes = F.when(c("n") == 0, F.array(F.lit("No documents to audit."))).otherwise(F.filter(F.array(
        F.when(c("empty_count") > 0, F.concat(c("empty_count").cast("string"), F.lit(" documents have no text: fill them in or leave them out of the index."))),
        F.when(c("very_short_count") > 0, F.concat(c("very_short_count").cast("string"), F.lit(" documents are under 20 characters: join them to others."))),
        F.when(c("very_long_count") > 0, F.concat(c("very_long_count").cast("string"), F.lit(" documents are over 4000 characters: cut them into chunks."))),
        F.when(c("duplication_ratio") > 0.05, F.concat(pc(c("duplication_ratio")), F.lit(" of documents repeat another word for word: remove the copies."))),
        F.when(c("near_ratio") > 0.20, F.concat(pc(c("near_ratio")), F.lit(f" of vectors are within a cosine of {near_threshold:.2f} of another: thin them out, or diversify results."))),
        F.when(c("hapax_ratio") > 0.6, F.concat(pc(c("hapax_ratio")), F.lit(" of terms occur once: an encoder of that domain may do better."))),
        F.when(c("coverage_rate") < 0.6, F.concat(pc(c("coverage_rate")), F.lit(" of queries find an answer: add documents, or reword the queries."))),
    ), lambda x: x.isNotNull()))
    return row.withColumn("status", F.when(bad, "needs_attention").otherwise("ready")).withColumn("notes", notes)
