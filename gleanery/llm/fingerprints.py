"""Document fingerprints by one-permutation MinHash.

Each distinct shingle of five words is hashed once. The hash's leading bits choose one of n_bins bins, which keeps its least
hash. Empty bins are filled by optimal densification: each draws bins from a sequence of its own, the same for all documents,
until it meets a filled one. Of each bin the lowest n_bits are kept and packed, so 256 bins of 4 bits make 128 bytes. Two
fingerprints' likeness is the share of equal bins, corrected for the 2^-n_bits that agree by chance, and at least 0.

Cases: null and empty text, and text without words, have no shingle: their fingerprint is all zeros and its likeness is 1 to
another of that kind, else 0. Fewer than five words make one shingle. Texts are taken whole, however long. Equal texts have
equal fingerprints, so ties and repeated rows need no care. Columns other than the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import SLICE_BYTES, mix, shingle_runs, small_batches

#: Rows that the kernels take at once, besides SLICE_BYTES: bounds the bins in memory.
SLICE_ROWS = 1024
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Fingerprinter:
    def __init__(self, n_bins: int = 256, n_bits: int = 4, width: int = 5):
        if n_bins & (n_bins - 1) or 8 % n_bits:
            raise ValueError("n_bins must be a power of two, n_bits 1, 2, 4 or 8")
        self.n_bins, self.n_bits, self.width = n_bins, n_bits, width

    def bins(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x n_bins low bits, whether a row has any shingle)."""
        low, full = [], []
        shift = np.uint64(64 - self.n_bins.bit_length() + 1)
        least = None
        for a, b, h, row, more in shingle_runs(texts, self.width):
            if least is None:
                least = np.full((b - a) * self.n_bins, _NONE, np.uint64)
            np.minimum.at(least, row * self.n_bins + (h >> shift).astype(np.int64), h)
            if more:
                continue
            bins = least.reshape(b - a, self.n_bins)
            has = (bins != _NONE).any(axis=1)
            low.append((self._densified(bins, has) & np.uint64((1 << self.n_bits) - 1)).astype(np.uint8))
            full.append(has)
            least = None
        if not low:
            return np.zeros((0, self.n_bins), np.uint8), np.zeros(0, bool)
        return np.concatenate(low), np.concatenate(full)

    def _densified(self, least: np.ndarray, has: np.ndarray) -> np.ndarray:
        filled = least != _NONE
        row, at = np.nonzero(~filled & has[:, None])
        out, tries = least.copy(), 0
        out[~has] = 0
        while len(row):
            tries += 1
            drawn = (mix(at.astype(np.uint64) + np.uint64(tries << 32)) % np.uint64(self.n_bins)).astype(np.int64)
            hit = filled[row, drawn]
            out[row[hit], at[hit]] = least[row[hit], drawn[hit]]
            row, at = row[~hit], at[~hit]
        return out

    def hexes(self, low: np.ndarray) -> list[str]:
        per = 8 // self.n_bits
        packed = np.zeros((len(low), self.n_bins // per), np.uint8)
        for k in range(per):
            packed |= low[:, k::per] << np.uint8(self.n_bits * k)
        return [x.tobytes().hex() for x in packed]

    def likeness(self, a: np.ndarray, a_full: np.ndarray, b: np.ndarray, b_full: np.ndarray) -> np.ndarray:
        chance = 2.0**-self.n_bits
        out = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
        return np.where(a_full & b_full, out, np.where(a_full == b_full, 1.0, 0.0))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n_bins: int = 256, n_bits: int = 4) -> DataFrame:
    """key, fingerprint of each row: one pass, no shuffle."""
    small_batches(docs.sparkSession)
    maker = Fingerprinter(n_bins, n_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(a, SLICE_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(maker.hexes(maker.bins(part.column(1))[0]), pa.string())], names=[key, "fingerprint"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows part, tail, key, text in partitions by ranges of the key, each range sorted and followed by the row after it (tail true): what a lead() over all rows needs, without one task for all.

    The ranges come from approximate quantiles of the key, as many as there are shuffle partitions; the first key of each range
    is collected, so that much goes to the driver and is broadcast, whatever the number of rows. Rows of one key stand in the
    order of their texts. After the last row comes the first.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    # two steps of about the square root of the number of cuts each, instead of all cuts for each row
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if groups:
        outer = F.array(*[F.lit(g[-1]) for g in groups])
        inner = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups], F.array(F.lit(cuts[-1])))
        g = F.size(F.filter(outer, lambda x: x < F.col("k")))
        part = F.when(F.col("k").isNull(), F.lit(0)).otherwise(g * step + F.when(g < len(groups), F.size(F.filter(F.element_at(inner, g + 1), lambda x: x < F.col("k")))).otherwise(0))
    else:
        part = F.lit(0)
    rows = rows.withColumn("part", part.cast("int"))
    firsts = sorted((r["part"], r["first"]["k"]) for r in rows.groupBy("part").agg(F.min(F.struct("k")).alias("first")).collect())
    before = [(p, k, firsts[i - 1][0]) for i, (p, k) in enumerate(firsts)]
    small = spark.createDataFrame(before, f"fp int, fk {rows.schema['k'].dataType.simpleString()}, prior int")
    to = F.when(F.col("k").eqNullSafe(F.col("fk")), F.array(F.struct(F.col("part"), F.lit(False).alias("tail")), F.struct(F.col("prior").alias("part"), F.lit(True).alias("tail")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("tail"))))
    sent = rows.join(F.broadcast(small), F.col("part") == F.col("fp")).select(F.explode(to).alias("to"), "k", "t").select("to.part", "to.tail", "k", "t")
    return sent.repartition(n, "part").sortWithinPartitions("part", "tail", "k", "t")


def edit_report(docs: DataFrame, key: str = "doc_id", text: str = "text", n_bins: int = 256, n_bits: int = 4) -> DataFrame:
    """Each row's fingerprint, and that of its text with the last half replaced by the next row's beginning, with their likenesses."""
    small_batches(docs.sparkSession)
    maker = Fingerprinter(n_bins, n_bits)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def done(rows: list, keys: list) -> pa.RecordBatch:
        """rows: texts, and the one after the last."""
        edited = []
        for t, after in zip(rows, rows[1:]):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + after[:half])
        own, full = maker.bins(pa.array(rows, pa.large_string()))
        new, new_full = maker.bins(pa.array(edited, pa.large_string()))
        return pa.RecordBatch.from_arrays([
            pa.array(keys, KEY), pa.array([len(t) for t in rows[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(maker.hexes(own[:-1]), pa.string()), pa.array(maker.hexes(new), pa.string()),
            pa.array(maker.likeness(own[:-1], full[:-1], new, new_full), pa.float64()), pa.array(maker.likeness(own[:-1], full[:-1], own[1:], full[1:]), pa.float64()),
        ], names=names)

    KEY = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[str] = []
        keys: list = []
        size, now, ended = 0, None, False
        for batch in batches:
            for part, tail, k, t in zip(*(batch.column(i) for i in range(4))):
                part, tail, t = part.as_py(), tail.as_py(), t.as_py() or ""
                if part != now:
                    rows, keys, size, now, ended = [], [], 0, part, False
                if ended:
                    continue
                rows.append(t)
                size += 2 * len(t)
                if (tail or size > SLICE_BYTES or len(rows) > SLICE_ROWS) and len(rows) > 1:
                    yield done(rows, keys)
                    rows, keys, size = rows[-1:], [], 2 * len(t)
                ended = tail
                if not tail:
                    keys.append(k.as_py())

    return with_next(docs, key, text).mapInArrow(run, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
