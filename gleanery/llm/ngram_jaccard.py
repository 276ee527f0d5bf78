"""N-gram Jaccard self-join with a token-group matrix.

A document's set is that of its distinct shingles of five words (64-bit hashes). Two documents link when
100 * |intersection| >= 80 * |union|; the result is each document's component. No link between different sets is lost.

1. Equal sets are collapsed to their least id (two 64-bit sums identify a set), so copies cost one row each.
2. Tokens have one order: those not frequent first, then by hash. "Frequent" is what a sample of documents (one in 16, 8,192 at
   least) repeats; it only orders, so any sample gives the same components. In a set of n tokens a partner shares at least o = ceil(0.8 n), so two
   partners share one of their first n - o + 1 tokens. Those prefixes are the rows of the matrix.
3. Prefix tokens that are not frequent are exchanged in packed form, by hash. A token of two or three documents gives their
   pairs as candidates (each document a group of one). Other tokens of several documents, and the frequent ones, become entries
   (token, document). Of each of these tokens one document is the centre (the one with the fewest rare tokens) and a candidate
   for all others.
4. Candidates are bounded first by 256 counts of tokens by hash (the intersection is at most the sum of the minima), then
   verified with the full sets. Verified links partition similar documents into groups: their components.
5. The matrix of entries is then (token, group), with each group's union of tokens held as the greatest counts of its members.
   Documents are queries to groups other than their own, smaller groups to larger: a query's overlap with a group is bounded
   by the places of the token in both and by the counts; only groups that qualify are opened, and their members bounded and
   verified like other candidates. With these links the components are final.

Cases: null or empty text, and text without words, has an empty set, links with nothing and is its own component. Fewer than
five words make one shingle. Repeated rows and texts are one class. Rows that repeat an id with different texts each stand for
their own text; those with a null id for none. Texts are taken whole. An empty table gives none. Columns other than the key and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import free_shuffles, mix, shingle_runs, small_batches, stash, unstash
from gleanery.llm.components import components

#: A token's run with more documents than that goes into the matrix; others give their pairs at once.
LONG_RUN = 3
COUNTS = 256
SAMPLE_ONE_IN = 16
#: Tokens that the driver and the workers hold as frequent at most: 8 MB. They only order tokens.
MOST_FREQUENT = 1 << 19
#: Prefix tokens that a task holds at once, on average.
PART_TOKENS = 1 << 20
#: Rows of one group are dealt over so many tasks where they meet the group's size.
SALTS = 16
#: A count that has come so far may stand for more.
TOP = 255


def sets_of(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row."""
    held: list[np.ndarray] = []
    for a, b, h, row, more in shingle_runs(column, width):
        if more or held:  # pieces of one long row
            held.append(np.unique(h))
            if more:
                continue
            h, held = np.concatenate(held), []
            row = np.zeros(len(h), np.int64)
        cut = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            own = np.sort(h[cut[i] : cut[i + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def needed(n: np.ndarray | int, per_cent: int):
    """The least intersection that a set of n tokens has with any partner: ceil(t n)."""
    return -(-n * per_cent // 100)


def _frequent(docs: DataFrame, sample_docs: int, least: int) -> np.ndarray:
    """Tokens in at least `least` documents of a sample, and how many; bounded by the sample's tokens over `least`. The sample is drawn in the scan: texts are not moved.

    It has about sample_docs documents or one in SAMPLE_ONE_IN, whichever is more: runs of tokens that it misses stay short however many documents there are.
    """
    share = min(1.0, max(1 / SAMPLE_ONE_IN, sample_docs / max(1, docs.count())))
    sample = docs.where(F.shiftrightunsigned(F.xxhash64("k", "t"), 11) < F.lit(int(share * (1 << 53))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(sets_of(batch.column(1)))
            if own:
                tokens, times = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(times)], names=["t", "c"])

    found = stash(sample.select("k", "t").mapInArrow(count, "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= least))
    # the least count that MOST_FREQUENT tokens or fewer reach, from the number of tokens of each count: no task puts all in order
    left, cut = MOST_FREQUENT, 1 << 62
    for r in found.groupBy("c").agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.desc("c")).collect():
        left -= r["tokens"]
        if left < 0:
            break
        cut = r["c"]
    rows = found.where(F.col("c") >= F.lit(cut)).toPandas()
    unstash(found)
    out = np.stack([rows["t"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64).astype(np.uint64)]) if len(rows) else np.zeros((2, 0), np.uint64)
    return out[:, np.argsort(out[0])]


def _scan(docs: DataFrame, frequent: np.ndarray, per_cent: int) -> DataFrame:
    """k, n, f1, f2 (a set's identity), rare and common (the prefix in order, as packed hashes), counts (of tokens by hash, a byte each)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, times = sent.value
        for batch in batches:
            n, f1, f2, rare, common, counts = [], [], [], [], [], []
            for s in sets_of(batch.column(1)):
                n.append(len(s))
                counts.append(np.minimum(np.bincount((s >> np.uint64(17)).astype(np.int64) & (COUNTS - 1), minlength=COUNTS), TOP).astype(np.uint8).tobytes())
                f1.append(int(np.sum(mix(s), dtype=np.uint64).astype(np.int64)))
                f2.append(int(np.sum(mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)), dtype=np.uint64).astype(np.int64)))
                length = len(s) - needed(len(s), per_cent) + 1 if len(s) else 0
                at = np.searchsorted(hot, s)
                at[at == len(hot)] = 0
                is_hot = hot[at] == s if len(hot) else np.zeros(len(s), bool)
                first = s[~is_hot][:length]
                rare.append(first.tobytes())
                rest = length - len(first)
                if rest > 0:
                    own = np.flatnonzero(is_hot)
                    own = own[np.lexsort((s[own], times[at[own]]))][:rest]
                    common.append(s[own].tobytes())
                else:
                    common.append(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(rare, pa.binary()), pa.array(common, pa.binary()), pa.array(counts, pa.binary())], names=["k", "n", "f1", "f2", "rare", "common", "counts"])

    return docs.select("k", "t").mapInArrow(run, "k bigint, n int, f1 bigint, f2 bigint, rare binary, common binary, counts binary")


def _packed(classes: DataFrame, parts: int) -> DataFrame:
    """part, and the tokens of that part with their documents: one row for each part and batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                rows = batch.slice(a, 4096)
                ids, n = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(2)]
                size = np.array([len(x) for x in own])
                tokens = np.concatenate(own) if len(own) else np.zeros(0, np.uint64)
                if not len(tokens):
                    continue
                doc = np.repeat(np.arange(len(own), dtype=np.uint16), size)
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
                part = (tokens >> np.uint64(33)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                tokens, doc, place, part = tokens[order], doc[order], place[order].astype(np.int32), part[order]
                cut = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
                full = [p for p in range(parts) if cut[p] < cut[p + 1]]
                cells = []
                for p in full:
                    t, d, q = tokens[cut[p] : cut[p + 1]], doc[cut[p] : cut[p + 1]], place[cut[p] : cut[p + 1]]
                    used, d = np.unique(d, return_inverse=True)
                    cells.append((p, t.tobytes(), d.astype(np.uint16).tobytes(), q.tobytes(), ids[used].tobytes(), n[used].tobytes()))
                cols = list(zip(*cells))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["part", "t", "d", "q", "ids", "n"])

    return classes.select("k", "n", "rare").mapInArrow(run, "part int, t binary, d binary, q binary, ids binary, n binary")


def _runs(packed: DataFrame, parts: int, per_cent: int) -> DataFrame:
    """Candidates (a, b, token null) and entries of long runs (a, n, place, token) from the exchanged tokens. A task holds its parts' tokens; parts grow in number with the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ids, sizes, places = [], [], [], []
        for batch in batches:
            for t, d, q, i, n in zip(*(batch.column(c) for c in range(1, 6))):
                d = np.frombuffer(d.as_buffer(), np.uint16)
                tokens.append(np.frombuffer(t.as_buffer(), np.uint64))
                ids.append(np.frombuffer(i.as_buffer(), np.int64)[d])
                sizes.append(np.frombuffer(n.as_buffer(), np.int32)[d])
                places.append(np.frombuffer(q.as_buffer(), np.int32))
        names, kinds = ["a", "b", "t", "n", "q"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        if not tokens:
            return
        t, i, n, q = map(np.concatenate, (tokens, ids, sizes, places))
        del tokens, ids, sizes, places
        order = np.argsort(t, kind="stable")
        t = t[order]
        same = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
        length = np.diff(same)
        pairs: set[tuple[int, int]] = set()
        entries = []
        for a, m in zip(same[:-1][length > 1], length[length > 1]):
            own = order[a : a + m]
            if m > LONG_RUN:
                entries.append(np.stack([i[own], np.full(m, t[a].view(np.int64)), n[own], q[own]]))
                continue
            x, y = np.triu_indices(m, 1)
            x, y = own[x], own[y]
            # the shared token as the first one in common: what is left from there must suffice
            total = n[x].astype(np.int64) + n[y]
            ok = np.minimum(n[x] - q[x], n[y] - q[y]) * (100 + per_cent) >= per_cent * total
            for u, v in zip(i[x[ok]].tolist(), i[y[ok]].tolist()):
                if u != v:
                    pairs.add((u, v) if u < v else (v, u))
        if pairs:
            p = np.array(sorted(pairs), np.int64)
            for a in range(0, len(p), 100_000):
                c = p[a : a + 100_000]
                none = pa.nulls(len(c), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c[:, 0]), pa.array(c[:, 1]), pa.nulls(len(c), pa.int64()), none, none], names=names)
        whole = np.concatenate(entries, axis=1) if entries else np.zeros((4, 0), np.int64)
        for a in range(0, whole.shape[1], 100_000):
            e = whole[:, a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(e[0], kinds[0]), pa.nulls(e.shape[1], pa.int64()), pa.array(e[1], kinds[2]), pa.array(e[2].astype(np.int32)), pa.array(e[3].astype(np.int32))], names=names)

    return packed.repartition(parts, "part").mapInArrow(run, "a bigint, b bigint, t bigint, n int, q int")


def _entries(classes: DataFrame) -> DataFrame:
    """a, t, n, q of the frequent tokens in prefixes; the rare ones come before them in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)]
            size = np.array([len(x) for x in own], np.int64)
            if not size.sum():
                continue
            before = np.array([len(x.as_buffer()) // 8 for x in batch.column(2)])
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(before, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(np.concatenate(own)), pa.array(np.repeat(batch.column(1).to_numpy(), size)), pa.array(place.astype(np.int32))], names=["a", "t", "n", "q"])

    return classes.select("k", "n", "rare", "common").where(F.octet_length("common") > 0).mapInArrow(run, "a bigint, t bigint, n int, q int")


#: Bits of the filter by which the second scan keeps the wanted documents: 4 MB, whatever their number. A document too many does no harm.
FILTER_BITS = 1 << 25


def _bits(ids: np.ndarray) -> np.ndarray:
    return np.concatenate([mix(ids.view(np.uint64) + np.uint64(k << 60)) % np.uint64(FILTER_BITS) for k in (1, 2, 3)]).astype(np.int64)


def _mark(on: np.ndarray, ids: np.ndarray) -> None:
    """Sets the ids' bits, eight a byte: a worker never holds a byte for each."""
    bits = _bits(ids)
    np.bitwise_or.at(on, bits >> 3, (0x80 >> (bits & 7)).astype(np.uint8))


def _id_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids (k). Chunks of it are merged by tasks, so that its size is all the driver gets."""
    width = FILTER_BITS // 8 // 64

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros((64, width), np.uint8)
        for batch in batches:
            _mark(packed.reshape(-1), batch.column(0).to_numpy())
        full = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed[i].tobytes() for i in full], pa.binary())], names=["chunk", "bits"])

    def merge(group: pa.Table) -> pa.Table:
        bits = np.zeros(width, np.uint8)
        for x in group.column("bits"):
            bits |= np.frombuffer(x.as_buffer(), np.uint8)
        return pa.table({"chunk": group.column("chunk").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((64, width), np.uint8)
    for r in wanted.select("k").mapInArrow(own, "chunk int, bits binary").groupBy("chunk").applyInArrow(merge, "chunk int, bits binary").collect():
        out[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _keep(batch: pa.RecordBatch, on: np.ndarray) -> pa.RecordBatch:
    """The rows whose id the filter (eight bits a byte) has."""
    bits = _bits(batch.column(0).to_numpy())
    return batch.filter(pa.array((on[bits >> 3] & (0x80 >> (bits & 7)) != 0).reshape(3, -1).all(axis=0)))


def _wanted_counts(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows k, n, counts of at least the wanted documents (k); without a shuffle, so that a join moves only these. Written, so that the joins' stages run no second Python worker beside their own."""
    sent = counts.sparkSession.sparkContext.broadcast(_id_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = sent.value
        for batch in batches:
            yield _keep(batch, on)

    return stash(counts.select("k", "n", "counts").mapInArrow(run, "k bigint, n int, counts binary"))


def packed48(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: within two documents that is as good as all 64, and a quarter less to move."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked48(x: pa.Scalar) -> np.ndarray:
    own = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, 2:] = own
    return out.view(np.uint64).ravel()


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """k, tokens of at least the wanted documents (k); a scan without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(_id_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = sent.value
        for batch in batches:
            batch = _keep(batch, on)
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                own = list(sets_of(rows.column(1)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([packed48(s) for s in own], pa.binary())], names=["k", "tokens"])

    return docs.where("k is not null").select("k", "t").mapInArrow(run, "k bigint, tokens binary")


def _bounded(pairs: DataFrame, per_cent: int) -> DataFrame:
    """Of candidates (a, b, na, nb, ca, cb) those whose counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            ca, cb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COUNTS) for c in (4, 5))
            # a count that is at its top may stand for more
            most = np.minimum(ca, cb).sum(axis=1, dtype=np.int64)
            most[(np.minimum(ca, cb) == TOP).any(axis=1)] = np.iinfo(np.int64).max // 1000
            most = np.minimum(most, np.minimum(na, nb))
            ok = pa.array(most * (100 + per_cent) >= per_cent * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return pairs.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, counts: DataFrame, docs: DataFrame, per_cent: int) -> DataFrame:
    """The candidates (a, b) that link. counts: k, n, counts of all classes; full sets are made of the documents of candidates that these leave."""
    counts = _wanted_counts(counts, pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))))
    pairs = pairs.join(counts.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca")), "a")
    pairs = pairs.join(counts.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb")), "b")
    pairs = stash(_bounded(pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent), per_cent))
    unstash(counts)
    free_shuffles(docs.sparkSession)
    sets = stash(_full_sets(docs, pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k")))))
    pairs = pairs.join(sets.select(F.col("k").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("k").alias("b"), F.col("tokens").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = unpacked48(x), unpacked48(y)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= per_cent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    out = stash(pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint").distinct())
    unstash(sets)
    free_shuffles(docs.sparkSession)
    return out


def _opened(entries: DataFrame, groups: DataFrame, counts: DataFrame, per_cent: int) -> DataFrame:
    """Candidates of the matrix (token, group): documents and the members of the groups that qualify for them."""
    e = entries.join(groups, entries["a"] == groups["id"], "left").select("a", "t", "n", "q", F.coalesce("component", "a").alias("g"))
    several = e.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("t")
    e = stash(e.join(several, "t", "left_semi"))
    if not e.limit(1).count():
        return e.select("a", F.col("a").alias("b"))
    rest = F.col("n") - F.col("q")
    matrix = e.groupBy("t", "g").agg(F.max(rest).alias("most"), F.min("n").alias("least"))
    size = e.select("g", "a").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("a").alias("sole"))
    matrix = matrix.join(size.select("g", "size"), "g")
    # a group may hold a third of all rows: it is dealt over SALTS tasks
    salted = size.select("g", "size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    q = e.withColumn("salt", F.pmod(F.xxhash64("a", "t"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"]).select("a", "t", "n", "q", "g", "size")
    m = matrix.select("t", F.col("g").alias("og"), F.col("size").alias("osize"), "most", "least")
    ask = q.join(m, "t").where((F.struct("size", "g") < F.struct("osize", "og")) & (F.least(F.col("n") - F.col("q"), F.col("most")) * (100 + per_cent) >= per_cent * (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * per_cent / 100)))))
    held = stash(ask.where("osize > 1").select("a", "t", "n", "q", "og"))  # the tokens at which a group of several may open
    ask = stash(ask.select("a", "og").distinct())

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for g, n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                c = np.frombuffer(c.as_buffer(), np.uint8)
                held[g] = (min(n, held[g][0]), np.maximum(c, held[g][1])) if g in held else (n, c)
            if len(held) > 20_000:
                yield _unions(held)
                held = {}
        if held:
            yield _unions(held)

    members = stash(e.select("g", "a").distinct())
    counts = _wanted_counts(counts, members.select(F.col("a").alias("k")))
    counted = members.join(counts.select(F.col("k").alias("a"), "n", "counts"), "a").select("g", "n", "counts")
    partial = counted.mapInArrow(union, "g bigint, n int, counts binary")
    unions = partial.repartition("g").mapInArrow(union, "g bigint, n int, counts binary")
    # a group's rows are in one task, but may leave it in more than one row: any of them may qualify for those it stands for only
    asked = ask.join(counts.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca")), "a").join(unions.select(F.col("g").alias("og"), F.col("n").alias("nb"), F.col("counts").alias("cb")), "og").select("a", F.col("og").alias("b"), "na", F.greatest("nb", F.ceil(F.col("na") * per_cent / 100)).cast("int").alias("nb"), "ca", "cb")
    opened = _bounded_groups(asked, per_cent).distinct()
    opened = stash(opened.withColumnRenamed("b", "og"))
    unstash(counts)
    one = opened.join(size.where("size = 1").select(F.col("g").alias("og"), F.col("sole").alias("b")), "og").select("a", "b")
    # of a group of several, the members that share a token with the query and whose places allow a link
    y = e.select(F.col("a").alias("b"), "t", F.col("n").alias("on"), F.col("q").alias("oq"), F.col("g").alias("og"))
    x = held.join(opened, ["a", "og"], "left_semi")
    many = x.join(y, ["og", "t"]).where(F.least(F.col("n") - F.col("q"), F.col("on") - F.col("oq")) * (100 + per_cent) >= per_cent * (F.col("n") + F.col("on"))).select("a", "b")
    pairs = one.unionByName(many)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unions(held: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int32()), pa.array([c.tobytes() for _, c in held.values()], pa.binary())], names=["g", "n", "counts"])


def _bounded_groups(asked: DataFrame, per_cent: int) -> DataFrame:
    """Queries and groups whose union's counts allow a link with some member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            ca, cb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COUNTS) for c in (4, 5))
            low = np.minimum(ca, cb)
            most = low.sum(axis=1, dtype=np.int64)
            most[(low == TOP).any(axis=1)] = np.iinfo(np.int64).max // 1000
            ok = pa.array(np.minimum(most, na) * (100 + per_cent) >= per_cent * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return asked.mapInArrow(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", per_cent: int = 80, sample_docs: int = 8192, sample_least: int = 3) -> DataFrame:
    """key, n_shingles, component_id of each row. Links within a group that don't change it aren't all tested, so their number isn't given."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t"))
    frequent = _frequent(rows, sample_docs, sample_least)
    free_shuffles(spark)
    identity = ["n", "f1", "f2"]
    scanned = stash(_scan(rows, frequent, per_cent))
    least = stash(scanned.where("n > 0 and k is not null").groupBy(*identity).agg(F.min("k").alias("class")))
    own = least.withColumnRenamed("class", "k")
    classes = stash(scanned.join(own, ["k", *identity], "left_semi").select("k", "n", "rare", "common", "counts"))
    whole, scanned = scanned, stash(scanned.select("k", *identity))
    unstash(whole)
    free_shuffles(spark)
    tokens = classes.agg(F.sum(F.octet_length("rare"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // (8 * PART_TOKENS)), 1)
    found = stash(_runs(_packed(classes, parts), parts, per_cent))
    entries = stash(_entries(classes).unionByName(found.where("t is not null").select("a", "t", "n", "q")).distinct())
    prefixes, classes = classes, stash(classes.select("k", "n", "counts"))
    unstash(prefixes)
    free_shuffles(spark)
    central = entries.groupBy("t").agg(F.min_by("a", F.struct(F.col("q") / F.col("n"), "a")).alias("c"))
    stars = entries.join(central, "t").where("a <> c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b"))
    pairs = stash(found.where("b is not null").select("a", "b").unionByName(stars).distinct())
    links = _verified(pairs, classes, rows, per_cent)
    groups = components(links)
    more = stash(_opened(entries, groups, classes, per_cent).join(pairs, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        links = stash(links.unionByName(_verified(more, classes, rows, per_cent)).distinct())
        groups = components(links)
    known = least.join(groups, F.col("class") == F.col("id"), "left")
    out = scanned.select("k", *identity).join(known.select(*identity, F.coalesce("component", "class").alias("component_id")), identity, "left")
    for done in (classes, found, entries, pairs, more, links):
        unstash(done)
    return out.select(F.col("k").alias(key), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", "k").alias("component_id"))
