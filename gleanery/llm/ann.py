"""Approximate nearest neighbours by NN-descent and greedy graph search, both as rounds of Spark joins.

Vectors with equal components are one point (copies would otherwise fill each other's neighbour lists); points without a usable
direction (null, zero, or any null or non-finite component) take no part.

Building: every point keeps a list of its n_neighbours nearest points found so far. The first lists come from a few random
hyperplane partitions with leaves of bounded size. In each round every point is a meeting place: it joins its neighbours with
the points that have it as neighbour, and they are compared with each other (neighbours of neighbours); each takes home its best
new ones. Codes of a byte a component stand for the vectors meanwhile. A point's list of those that have it as neighbour is held
at n_reverse, nearest first, as in the published algorithm; what is left out still has the point in its own list. Rounds end when
few lists change.

Searching is greedy: a query, being a row of the table, starts at its own point. Each round expands the `expand` best points of
its beam that aren't expanded yet (a few at a time, since a round is a few Spark joins), looks their edges up, drops the points
that it has met before, joins the others with their codes, and keeps the best ef. A query leaves when its beam has nothing to
expand; search ends when all have left. No number of rounds is set. A point's edges are its own list and the `degree` nearest of
those that have it as neighbour, so no hub has more than n_neighbours + degree: what a round compares is bounded for each query.
What that leaves out are edges into hubs from afar, which hubs' own lists make up for; recall is measured in README. What is in the
beam in the end is scored by exact cosine in double precision. All members of the points found are candidates, so copies are not
lost.

Cases: null vectors and others without direction are left out as candidates and as queries. Vectors of different lengths are
compared within their length only. Ties go to the smaller id; repeated ids count once a row. With fewer candidates than asked for
all that are reached are returned. An empty table gives none. Columns other than those named are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import free_shuffles, small_batches, stash, unstash

LEAF = 256


def points(vectors: DataFrame, key: str, vector: str, members: int) -> tuple[DataFrame, DataFrame]:
    """(point: its least id, unit vector as packed doubles, code; member: point, id, of each point the `members` least ids)."""
    v = F.col(f"`{vector}`").cast("array<double>")
    ok = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v")).where("id is not null and v is not null")
    ok = ok.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    of = ok.groupBy("v").agg(F.min("id").alias("p"))
    order = Window.partitionBy("h", "v").orderBy("id")
    # the least ids of a point; Spark limits groups before the shuffle
    held = ok.withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= members)
    member = held.select("v", "id").join(of, "v").select("p", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, codes = [], []
            for x in batch.column(1):
                a = np.array(x.values.to_numpy(zero_copy_only=False), np.float64)
                data.append(a.tobytes())
                codes.append(coded(a).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(codes, pa.binary())], names=["p", "x", "code"])

    return of.select("p", "v").mapInArrow(pack, "p bigint, x binary, code binary"), member


def coded(a: np.ndarray) -> np.ndarray:
    """A unit vector in bytes; scaled so that the greatest component is 127, which the code's own norm undoes."""
    return np.rint(a / np.abs(a).max() * 127).astype(np.int8)


def _matrix(codes: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(sims: np.ndarray, own: np.ndarray, ids: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, other, likeness) of the `take` best others of each row."""
    take = min(take, sims.shape[1])
    top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
    s = np.take_along_axis(sims, top, 1).ravel()
    a, b = np.repeat(own, take), ids[top].ravel()
    ok = (s > -1.5) & (a != b)
    return a[ok], b[ok], s[ok]


EDGE = "p bigint, q bigint, s float"


def _edges(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b, s = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], names=["p", "q", "s"])


def _leaves(pts: DataFrame, n: int, trees: int, take: int, seed: int) -> DataFrame:
    """First edges: the best of each point among those in its leaf, in each of several partitions by random hyperplanes. A crowded leaf is cut by hash."""
    bits = max(0, math.ceil(math.log2(max(1, n / (LEAF * 0.6)))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, codes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for size in {len(c) for c in codes}:
                if size not in planes:
                    planes[size] = np.random.Generator(np.random.PCG64([seed, size])).standard_normal((trees * max(1, bits), size)).astype(np.float32)
                at = [i for i, c in enumerate(codes) if len(c) == size]
                side = (_matrix([codes[i] for i in at]) @ planes[size].T > 0).reshape(len(at), trees, -1)[:, :, : max(1, bits)]
                leaf = (side * (1 << np.arange(side.shape[2], dtype=np.int64))).sum(axis=2) if bits else np.zeros((len(at), trees), np.int64)
                for t in range(trees):
                    out += [(t, int(leaf[j, t]), size, int(ids[i]), codes[i]) for j, i in enumerate(at)]
            cols = list(zip(*out))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())], names=["tree", "leaf", "size", "p", "code"])

    placed = pts.select("p", "code").mapInArrow(place, "tree int, leaf bigint, size int, p bigint, code binary")
    crowd = placed.groupBy("tree", "leaf", "size").agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * LEAF)).alias("cuts"))
    placed = placed.join(crowd, ["tree", "leaf", "size"]).withColumn("cut", F.pmod(F.xxhash64("p", "tree"), F.col("cuts")))

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, m = group.column("p").to_numpy(), _matrix(group.column("code").to_pylist())
        sims = m @ m.T
        np.fill_diagonal(sims, -2)
        return pa.Table.from_batches([_edges([_best(sims, ids, ids, take)])])

    return placed.groupBy("tree", "leaf", "size", "cut").applyInArrow(meet, EDGE)


def _merged(edges: DataFrame, k: int) -> DataFrame:
    """p, list: the k nearest (q, s) of each point; each task first merges what it has."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            p, q, s = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((q, p))
            p, q, s = p[order], q[order], s[order]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            p, q, s = p[new], q[new], s[new]
            order = np.lexsort((q, -s, p))
            p, q, s = p[order], q[order], s[order]
            start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            rank = np.arange(len(p)) - np.repeat(start, np.diff(np.concatenate([start, [len(p)]])))
            ok = rank < k
            return pa.RecordBatch.from_arrays([pa.array(p[ok]), pa.array(q[ok]), pa.array(s[ok])], names=["p", "q", "s"])

        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
            if sum(len(x[0]) for x in held) > 2_000_000:
                yield flush()
                held = []
        if held:
            yield flush()

    own = edges.select("p", "q", "s").mapInArrow(merge, EDGE)
    w = Window.partitionBy("p").orderBy(F.desc("s"), "q")
    top = own.groupBy("p", "q").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.select("p", "q", "s")


def neighbour_graph(pts: DataFrame, n: int, n_neighbours: int = 40, n_reverse: int = 40, trees: int = 8, rounds: int | None = None, take: int = 8, stop: float = 0.01, seed: int = 5) -> DataFrame:
    """Edges p, q, s: each point's nearest, by NN-descent. Rounds go on until at most the share `stop` of all edges is new, unless their number is given: lists only ever get better, so that comes."""
    spark = pts.sparkSession
    codes = pts.select(F.col("p").alias("q"), "code")
    graph = stash(_merged(_leaves(pts, n, trees, take, seed), n_neighbours))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At each meeting place: all of its points are compared, and each takes home its best others that beat its worst neighbour."""
        found = []
        for batch in batches:
            for ids, data, worst, new in zip(*(batch.column(i) for i in range(4))):
                raw = data.values.to_pylist()
                ids, worst, new = ids.values.to_numpy(), worst.values.to_numpy(), new.values.to_numpy(zero_copy_only=False)
                ids, first = np.unique(ids, return_index=True)
                if len(ids) < 2:
                    continue
                worst, new = worst[first], new[first]
                m = _matrix([raw[i] for i in first])
                sims = m @ m.T
                # at least one of a pair is new here; and it must beat the worst of the list that it would enter
                sims[~(new[:, None] | new[None, :]) | (sims <= worst[:, None])] = -2
                np.fill_diagonal(sims, -2)
                found.append(_best(sims, ids, ids, take))
                if len(found) >= 512:
                    yield _edges(found)
                    found = []
        if found:
            yield _edges(found)

    fresh = graph.withColumn("new", F.lit(True))
    for _ in itertools.count() if rounds is None else range(rounds):
        worst = fresh.groupBy("p").agg(F.when(F.count(F.lit(1)) >= n_neighbours, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
        reverse = fresh.select(F.col("q").alias("at"), F.col("p").alias("q"), "s", "new").withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("s"), "q"))).where(F.col("r") <= n_reverse).drop("r")
        meeting = fresh.select(F.col("p").alias("at"), "q", "s", "new").unionByName(reverse)
        vectors = codes.join(worst.withColumnRenamed("p", "q"), "q", "left").select("q", "code", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
        lists = meeting.join(vectors, "q").groupBy("at", F.octet_length("code")).agg(F.collect_list("q").alias("ids"), F.collect_list("code").alias("codes"), F.collect_list("worst").alias("worst"), F.collect_list("new").alias("new"))
        better = lists.where(F.exists("new", lambda x: x)).select("ids", "codes", "worst", "new").mapInArrow(meet, EDGE)
        old = graph.select("p", "q", F.lit(False).alias("new"))
        merged = _merged(graph.unionByName(better), n_neighbours).join(old, ["p", "q"], "left").select("p", "q", "s", F.coalesce("new", F.lit(True)).alias("new"))
        after = stash(merged)
        changed, total = after.agg(F.count_if("new"), F.count(F.lit(1))).first()
        unstash(graph)
        graph, fresh = after.select("p", "q", "s"), after
        graph._stash_path = after._stash_path
        free_shuffles(spark)
        if changed <= stop * total:
            break
    return graph


def adjacency(graph: DataFrame, degree: int) -> DataFrame:
    """p, nbrs: each point's own list and the `degree` nearest of those that have it in theirs."""
    w = Window.partitionBy("p").orderBy(F.desc("s"), "q")
    reverse = graph.select(F.col("q").alias("p"), F.col("p").alias("q"), "s").withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree).select("p", "q")
    return graph.select("p", "q").unionByName(reverse).groupBy("p").agg(F.collect_set("q").alias("nbrs"))


#: A query's state: its point, its code, the beam (points, likenesses, whether expanded), every point met, and what to expand next.
BEAM = "c bigint, own binary, q array<bigint>, s array<float>, done array<boolean>, seen array<bigint>, next array<bigint>"


def search(queries: DataFrame, pts: DataFrame, graph: DataFrame, ef: int = 96, expand: int = 16, degree: int = 24) -> DataFrame:
    """Pairs c (a query's own point), q (point found), s (cosine): greedy search from the query's own point, all queries side by side. The beam is kept by the codes' likeness; what is in it at the end is scored exactly."""
    spark = pts.sparkSession
    edges = stash(adjacency(graph, degree))
    codes = pts.select(F.col("p").alias("q"), "code")
    point = F.array("c")
    asked = queries.select("c").distinct().join(pts.select(F.col("p").alias("c"), F.col("code").alias("own")), "c")
    beam = stash(asked.select("c", "own", *(F.array().cast(t).alias(n) for n, t in (("q", "array<bigint>"), ("s", "array<float>"), ("done", "array<boolean>"))), point.alias("seen"), point.alias("next")))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The beam with the points that were met: ids and codes, in columns 6 and 7."""
        for batch in batches:
            rows: list[list] = []
            for c, own, q, s, done, seen, ids, data in zip(*(x.to_pylist() for x in batch.columns)):
                ok = [i for i, code in enumerate(data) if len(code) == len(own)]
                if ok:
                    m = _matrix([own, *(data[i] for i in ok)])
                    q, s, done = q + [ids[i] for i in ok], s + (m[1:] @ m[0]).tolist(), done + [False] * len(ok)
                order = sorted(range(len(q)), key=lambda i: (-s[i], q[i]))[:ef]
                left = [i for i in order if not done[i]][:expand]
                for i in left:
                    done[i] = True
                rows.append([c, own, [q[i] for i in order], [s[i] for i in order], [done[i] for i in order], seen + ids, [q[i] for i in left]])
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=["c", "own", "q", "s", "done", "seen", "next"])

    ended = []
    while True:
        met = beam.select("c", F.explode("next").alias("p")).join(edges, "p").groupBy("c").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("met"))
        new = beam.join(met, "c").select("c", F.explode(F.array_except("met", "seen")).alias("q"))
        found = new.join(codes, "q").groupBy("c").agg(F.collect_list("q").alias("ids"), F.collect_list("code").alias("codes"))
        none = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)).alias(name)
        state = beam.join(found, "c", "left").select("c", "own", "q", "s", "done", "seen", none("ids", "array<bigint>"), none("codes", "array<binary>"))
        after = stash(state.mapInArrow(step, BEAM))
        unstash(beam)
        left = F.size("next") > 0
        ended.append(after.where(~left).select("c", "q"))
        free_shuffles(spark)
        if not after.where(left).limit(1).count():
            break
        beam = after.where(left)
        beam._stash_path = None  # those that ended are still to be read
    beam = functools.reduce(DataFrame.unionByName, ended).select("c", F.explode("q").alias("q"))
    vectors = pts.select("p", "x")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [cosine(np.frombuffer(x.as_buffer(), np.float64), np.frombuffer(y.as_buffer(), np.float64)) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["c", "q", "s"])

    pairs = beam.select("c", "q").join(vectors.withColumnRenamed("p", "q"), "q").join(vectors.select(F.col("p").alias("c"), F.col("x").alias("y")), "c")
    return pairs.select("c", "q", "x", "y").mapInArrow(score, "c bigint, q bigint, s double")


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """In double precision; scaled first, so that no component overflows."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / math.sqrt(float(x @ x) * float(y @ y)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", **build) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query row (queries: rows of vectors), without the query's own."""
    small_batches(vectors.sparkSession)
    pts, member = points(vectors, key, vector, k + 1)
    pts, member = stash(pts), stash(member)
    n = pts.count()
    graph = neighbour_graph(pts, n, **build)
    v = F.col(f"`{vector}`").cast("array<double>")
    # each query with its point, by its vector's packed form
    ids = _packed_queries(queries.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v")))
    own = stash(ids.join(pts.select("p", "x"), "x").select("id", F.col("p").alias("c")))
    found = search(own, pts, graph)
    found = found.unionByName(own.select("c", F.col("c").alias("q"), F.lit(1.0).alias("s")).distinct())
    w = Window.partitionBy("c").orderBy(F.desc("s"), "q")
    found = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    cands = own.join(found, "c").join(member.select(F.col("p").alias("q"), F.col("id").alias("other")), "q").where("id <> other")
    w = Window.partitionBy("id").orderBy(F.desc("s"), "other")
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias(key), F.col("s").alias("score"))


def _packed_queries(queries: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for x in batch.column(1):
                usable = x.is_valid and not x.values.null_count
                data.append(x.values.to_numpy(zero_copy_only=False).astype(np.float64).tobytes() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "x"])

    return queries.mapInArrow(pack, "id bigint, x binary").where("x is not null")
