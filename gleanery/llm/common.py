"""What the operators of this subpackage share: tables, checkpoints, hashing of words and shingles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the numpy kernels take at once; bounds a Python worker's memory (about 60 bytes a byte of text). A longer row is taken in pieces.
SLICE_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch, where the session leaves Spark's own limits as they are: rows of whole texts, and Spark's 10,000 of them are of any size.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 4096, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a task's JVM and Python worker hold of a table of texts at once. This sets the session's limits, if they are Spark's defaults."""
    for name, most in BATCH.items():
        if spark.sparkContext.getConf().get(name) is None and int(spark.conf.get(name).rstrip("b")) > most:
            spark.conf.set(name, most)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one in the warehouse, which all nodes share too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return sc.getCheckpointDir()


def stash(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared folder and read it again. Survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete a stash that nothing reads any more; no path, nothing to delete."""
    if df._stash_path is None:
        return
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished rounds of a loop; they go when the driver's JVM collects their handles."""
    spark._jvm.System.gc()


# ---- words and shingles, vectorised over the bytes of an Arrow batch ----

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240101))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C17)  # 3 modulo 4: 1 - R has one factor of two only
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []  # of _R and its inverse


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        with np.errstate(over="ignore"):
            _POWERS.extend(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(SLICE_BYTES - 1, r, np.uint64)]), dtype=np.uint64) for r in (_R, _R_INV))
    return _POWERS[0][:n], _POWERS[1][:n]


def _buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offs


def word_runs(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """(first row, end row, hashes of their words, row of each from the first, whether the words of that row go on in the next run), of runs of rows with at most `most` bytes of text, or of a piece of one longer row."""
    data, offs = _buffers(column)
    a, n = 0, len(column)
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + most, "right")) - 1
        if b > a:
            yield a, b, *word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]), False
            a = b
            continue
        at, end = int(offs[a]), int(offs[a + 1])
        while at < end:
            to = _cut(data, at, end, most)
            if to - at > most:  # one word
                words = np.array([_long_word(data[at:to])], np.uint64)
            else:
                words = word_hashes(data[at:to], np.array([0, to - at]))[0]
            yield a, a + 1, words, np.zeros(len(words), np.int64), to < end
            at = to
        a += 1


def _cut(data: np.ndarray, at: int, end: int, most: int) -> int:
    """Where the piece that begins at `at` ends: after its last space, or, if it has none, before the first one that follows."""
    if end - at <= most:
        return end
    spaces = np.flatnonzero(_SPACE[data[at : at + most]])
    if len(spaces):
        return at + int(spaces[-1]) + 1
    for to in range(at + most, end, most):
        spaces = np.flatnonzero(_SPACE[data[to : min(end, to + most)]])
        if len(spaces):
            return to + int(spaces[0])
    return end


def _long_word(data: np.ndarray) -> np.uint64:
    """The hash of one word of more bytes than a slice."""
    total = 0
    with np.errstate(over="ignore"):
        for a in range(0, len(data), SLICE_BYTES):
            part = data[a : a + SLICE_BYTES]
            total += int(np.sum(_BYTE[_LOWER[part]] * _powers(len(part))[0], dtype=np.uint64)) * pow(int(_R), a, 1 << 64)
        return mix(np.array([(total + len(data) * _LENGTH) % (1 << 64)], np.uint64))[0]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased, and the row of each; of at most SLICE_BYTES."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    body = ~_SPACE[data]
    start, end = body.copy(), body.copy()
    start[1:] &= ~body[:-1]
    end[:-1] &= ~body[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = body[inner]
    end[inner - 1] = body[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.cumsum(_BYTE[_LOWER[data]] * up, dtype=np.uint64)
        before = np.where(s > 0, total[s - 1], np.uint64(0))
        h = mix((total[e] - before) * down[s] + (e - s + 1).astype(np.uint64) * np.uint64(_LENGTH))
    return h, np.searchsorted(offs, s, "right") - 1


def shingle_runs(column: pa.Array | pa.ChunkedArray, width: int = 5, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool]]:
    """As word_runs, with the hashes of all runs of width words; of the whole sequence in a row of fewer. Pieces of a long row overlap by width - 1 words."""
    held: np.ndarray | None = None  # of a long row, the last words so far
    made = False
    for a, b, words, row, more in word_runs(column, most):
        if held is None and not more:
            yield a, b, *_shingles(words, row, b - a, width), False
            continue
        words = words if held is None else np.concatenate([held, words])
        if len(words) >= width:
            yield a, b, _windows(words, width), np.zeros(len(words) - width + 1, np.int64), more
            made = True
        elif not more:
            h, at = (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if made else _shingles(words, np.zeros(len(words), np.int64), 1, width)
            yield a, b, h, at, False
        held, made = (words[max(0, len(words) - width + 1) :], made) if more else (None, False)


def _windows(words: np.ndarray, width: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            h += words[k : len(words) - width + 1 + k] * _PLACE[k]
        return mix(h)


def _shingles(words: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of whole rows, in order of rows."""
    count = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    h, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= width:
        whole = row[: len(words) - width + 1] == row[width - 1 :]
        h, at = _windows(words, width)[whole], row[: len(words) - width + 1][whole]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        with np.errstate(over="ignore"):
            own = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                has = count[short] > k
                own[has] += words[first[short[has]] + k] * _PLACE[k]
            own = mix(own + count[short].astype(np.uint64) * _PLACE[63])
        h, at = np.concatenate([h, own]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at
