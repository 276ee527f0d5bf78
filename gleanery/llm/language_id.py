"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has features: its prefixes and suffixes of up to three letters, its letter trigrams, and itself (the lexicon). They are hashed to one table of weights for each language. Transitions between the languages of neighbouring words
are learned with them, so that forward-backward gives each word a distribution over languages that rests on its context: text
that switches language is labelled word by word. A text's language is the one with the greatest sum of its words' marginals;
its score is that sum over the number of words.

Training maximises the likelihood of label sequences by stochastic gradients. Labels of texts are known, not of words, so each
training sequence is put together from a few windows of sample texts, each window with the label of its text; that is where
transitions are learned from. The sample is bounded: at most sample_texts texts a language, those with the least hash of their
key, and of each at most sample_words words in windows spread over the whole text. Only this sample reaches the driver, and the
model (features x languages) is sent to the workers. All words of all texts are used in prediction. A run of more than RUN letters
is cut into words of RUN: scripts without spaces have positions too, and a switch of language inside a run can be seen.

The winning share says which language is likelier, not whether the text is in any: beside it, `known` is the share of a text's
letter trigrams that the learning texts have, 0 for another script, low for letters at random.

Cases: text that is null or has no letter (combining marks are none) is `und` with score and known 0. Texts of any length are labelled whole, in windows of words
that overlap, so memory stays bounded. Null labels are not learned from. Without any labelled
text, every text is `und`. Ties go to the language first in order. Repeated rows get equal results, and count once in learning. Columns other than those
named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import mix, small_batches

#: The longest word; longer runs of letters are several words.
RUN = 32
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]{0,%d}" % (RUN - 1))
UNKNOWN = "und"
#: Words memoised by a Python worker; at this number the memo starts anew. Bounds memory, not results.
MEMO_WORDS = 100_000
#: Words that forward-backward takes at once, over all texts of a block.
BLOCK_WORDS = 120_000
#: A text is run in windows of so many words, each with so many of context on either side that aren't counted; messages over
#: that distance have forgotten their start to far below a float's precision, unless words carry no evidence at all.
WINDOW, CONTEXT = 512, 32


_RNG = np.random.Generator(np.random.PCG64(20240102))
_LETTER = _RNG.integers(1, 1 << 63, RUN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KIND = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64)


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-case words' features: (the word itself, its prefixes and its suffixes of 1 to 3 letters, in a row each; trigrams with the word's ends, one word after another; letters of each word)."""
    size = np.array([len(w) for w in words])
    u = np.array(words, dtype=f"U{RUN}").view(np.uint32).reshape(len(words), RUN).astype(np.uint64)
    row, place = np.arange(len(words)), np.arange(RUN)
    with np.errstate(over="ignore"):
        heads = [(u * _LETTER).sum(axis=1, dtype=np.uint64) + _KIND[0]]
        front, back = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
        for k in range(3):
            front = front + u[:, k] * _LETTER[k]
            back = back + np.where(size > k, u[row, np.maximum(size - 1 - k, 0)], np.uint64(0)) * _LETTER[k]
            heads += [front + _KIND[1 + k], back + _KIND[4 + k]]
        c = np.zeros((len(words), RUN + 2), np.uint64)
        c[:, 0], c[:, 1:-1] = ord("^"), u
        c[row, size + 1] = ord("$")
        tri = (c[:, :-2] * _LETTER[0] + c[:, 1:-1] * _LETTER[1] + c[:, 2:] * _LETTER[2] + _KIND[7])[place < size[:, None]]
    return mix(np.column_stack(heads)), mix(tri), size


class Crf:
    """weights: features x languages; start: languages; trans: from x to; seen: hashed trigrams of the learning texts."""

    SEEN = 1 << 21

    def __init__(self, langs: list[str], size: int = 1 << 17):
        self.langs, self.size = langs, size
        n = len(langs)
        self.weights, self.start, self.trans = np.zeros((size, n), np.float32), np.zeros(n), np.zeros((n, n))
        self.seen = np.zeros(self.SEEN, bool)
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(self.langs) + 1))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": {}, "table": np.zeros((0, len(self.langs) + 1)), "seen": np.packbits(self.seen)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"seen": np.unpackbits(state["seen"]).astype(bool)})

    def emissions(self, words: list[str]) -> np.ndarray:
        """Each word's score for each language, and the share of its trigrams that are known."""
        if len(self.rows) > MEMO_WORDS:
            self._forget()
        rows = self.rows
        if new := list(set(words).difference(rows)):
            parts = [self.table]
            for a in range(0, len(new), 16384):
                heads, tri, size = hashed(new[a : a + 16384])
                start = np.cumsum(size) - size
                score = self.weights[heads & np.uint64(self.size - 1)].sum(axis=1, dtype=np.float64) + np.add.reduceat(self.weights[tri & np.uint64(self.size - 1)].astype(np.float64), start, axis=0)
                known = np.add.reduceat(self.seen[tri & np.uint64(self.SEEN - 1)].astype(np.float64), start) / size
                parts.append(np.column_stack([score, known]))
            self.table = np.concatenate(parts)
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
        return self.table[np.fromiter(map(rows.__getitem__, words), np.int64, len(words))]

    # -- training --

    def fit(self, sequences: list[tuple[list[str], list[int]]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-6, seed: int = 7) -> Crf:
        """Adagrad on the log likelihood, sequence by sequence; the best-known way to a sharp model in few passes."""
        rng = np.random.Generator(np.random.PCG64(seed))
        every = sorted({w for words, _ in sequences for w in words})
        heads, tri, size = hashed(every)
        cut = np.cumsum(size)
        memo = {w: (np.concatenate([heads[i], tri[cut[i] - size[i] : cut[i]]]) & np.uint64(self.size - 1)).astype(np.int64) for i, w in enumerate(every)}
        self.seen[tri & np.uint64(self.SEEN - 1)] = True
        n = len(self.langs)
        seen_w, seen_t, seen_s = np.full(self.weights.shape, 1e-2, np.float32), np.full((n, n), 1e-2), np.full(n, 1e-2)
        for _ in range(epochs):
            for i in rng.permutation(len(sequences)):
                words, labels = sequences[i]
                feats = [memo[w] for w in words]
                at = np.repeat(np.arange(len(words)), [len(f) for f in feats])
                flat = np.concatenate(feats)
                e = np.zeros((len(words), n))
                np.add.at(e, at, self.weights[flat])
                one, two = marginals(e, self.start, self.trans, pairs=True)
                y = np.zeros_like(one)
                y[np.arange(len(words)), labels] = 1
                g = (y - one) / len(words) ** 0.5
                gt = -two
                np.add.at(gt, (labels[:-1], labels[1:]), 1)
                gt /= len(words) ** 0.5
                grad = np.zeros_like(self.weights[: len(np.unique(flat))])
                places, back = np.unique(flat, return_inverse=True)
                np.add.at(grad, back, g[at].astype(np.float32))
                grad -= decay * self.weights[places]
                seen_w[places] += grad * grad
                self.weights[places] += rate * grad / np.sqrt(seen_w[places])
                seen_t += gt * gt
                self.trans += rate * gt / np.sqrt(seen_t)
                seen_s += g[0] * g[0]
                self.start += rate * g[0] / np.sqrt(seen_s)
        np.clip(self.trans, -12, 12, out=self.trans)
        return self

    # -- prediction --

    def label(self, text: str) -> list[tuple[str, np.ndarray]]:
        """Each word of a text, in lower case, with its distribution over the languages."""
        words = WORD.findall(text.lower())
        return list(zip(words, marginals(self.emissions(words)[:, :-1], self.start, self.trans))) if words else []

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The sums of each text's words' marginals and, last, of their known shares; None for a text without letters."""
        words: list[str] = []
        spans, owner = [], []
        out: list[np.ndarray | None] = [None] * len(texts)

        def flush() -> None:
            if not words:
                return
            e = self.emissions(words)
            own = np.array(spans)
            total = np.concatenate([[0.0], np.cumsum(e[:, -1])])
            known = total[own[:, 0] + own[:, 3]] - total[own[:, 0] + own[:, 2]]
            for k, s in zip(owner, np.column_stack([self.shares(e[:, :-1], own), known])):
                out[k] = s if out[k] is None else out[k] + s
            words.clear(), spans.clear(), owner.clear()

        for k, text in enumerate(texts):
            for piece in pieces((text or "").lower()):
                own = WORD.findall(piece)
                at = len(words)
                words += own
                for a in range(0, len(own), WINDOW):
                    b = min(a + WINDOW, len(own))
                    left, right = max(0, a - CONTEXT), min(len(own), b + CONTEXT)
                    spans.append((at + left, right - left, a - left, b - left))
                    owner.append(k)
                if len(words) > BLOCK_WORDS:
                    flush()
        flush()
        return out

    def shares(self, e: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """For each window (first row of e, length, first and end counted): the sum of its counted words' marginals. Windows run side by side, the longest first."""
        order = np.argsort(-spans[:, 1], kind="stable")
        first, length, lo, hi = spans[order].T
        flat = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-12
        move, begin = np.exp(self.trans - self.trans.max()), np.exp(self.start - self.start.max())
        steps = int(length[0])
        live = np.searchsorted(-length, -np.arange(steps), "left")  # windows longer than t
        base = np.concatenate([[0], np.cumsum(live)])
        ahead = np.empty((base[-1], e.shape[1]))
        a = begin * flat[first]
        a /= a.sum(axis=1, keepdims=True)
        ahead[: len(a)] = a
        for t in range(1, steps):
            m = live[t]
            a = (a[:m] @ move) * flat[first[:m] + t]
            a /= a.sum(axis=1, keepdims=True)
            ahead[base[t] : base[t + 1]] = a
        b, total = np.ones((len(order), e.shape[1])), np.zeros((len(order), e.shape[1]))
        for t in range(steps - 1, -1, -1):
            m = live[t]
            p = ahead[base[t] : base[t + 1]] * b[:m]
            p /= p.sum(axis=1, keepdims=True)
            total[:m] += p * ((lo[:m] <= t) & (t < hi[:m]))[:, None]
            x = (flat[first[:m] + t] * b[:m]) @ move.T
            b[:m] = x / x.sum(axis=1, keepdims=True)
        out = np.empty_like(total)
        out[order] = total
        return out


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Of a very long text, pieces that end before a space; where none comes in time, anywhere."""
    at = 0
    while len(text) - at > 2 * size:
        cut = text.find(" ", at + size, at + 2 * size)
        cut = cut if cut > 0 else at + 2 * size
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def marginals(e: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Forward-backward over one sequence of emissions; with pairs, also the sum of the pairwise marginals."""
    m, n = e.shape
    f = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-300
    move = np.exp(trans - trans.max())
    a, b = np.empty((m, n)), np.empty((m, n))
    x = np.exp(start - start.max()) * f[0]
    a[0] = x / x.sum()
    for t in range(1, m):
        x = (a[t - 1] @ move) * f[t]
        a[t] = x / x.sum()
    b[-1] = 1
    for t in range(m - 2, -1, -1):
        x = move @ (f[t + 1] * b[t + 1])
        b[t] = x / x.sum()
    p = a * b
    p /= p.sum(axis=1, keepdims=True)
    if not pairs:
        return p
    right = f[1:] * b[1:]
    z = np.einsum("ti,ij,tj->t", a[:-1], move, right)
    return p, move * np.einsum("ti,tj->ij", a[:-1] / z[:, None], right)


def windows(text: str, sample_words: int) -> list[str]:
    """Runs of up to 40 words, spread over the whole text, with about sample_words words in all."""
    words = WORD.findall(text.lower())
    step = max(40, len(words) * 40 // sample_words)
    return [" ".join(words[a : a + 40]) for a in range(0, len(words), step)]


def spliced(sample: list[tuple[str, str]], langs: list[str], seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Training sequences: one to three windows (language, words), each cut to 6 to 30 words."""
    rng = np.random.Generator(np.random.PCG64(seed))
    pool = [(langs.index(lang), text.split(" ")) for lang, text in sample]
    pool = [pool[j] for j in rng.permutation(len(pool))]
    out, i = [], 0
    while i < len(pool):
        take = [(k, ws[: int(rng.integers(6, 30))]) for k, ws in pool[i : i + int(rng.integers(1, 4))]]
        i += len(take)
        out.append(([w for _, ws in take for w in ws], [k for k, ws in take for _ in ws]))
    return out


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_texts: int = 150, sample_words: int = 400, epochs: int = 3) -> Crf | None:
    """The model of labelled rows; None if there are none. At most sample_texts texts of each language, and of each windows of about sample_words words, reach the driver."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("k", F.lit("")), "t"))
    # a few times sample_texts rows a language, by hash, before any are put in order: so many for each language, not for each task
    counts = rows.groupBy("l").agg((F.lit(8.0 * sample_texts) / F.count(F.lit(1))).alias("share"))
    drawn = rows.select("l", "h").join(counts, "l").where(F.shiftrightunsigned(F.xxhash64("h"), 11) < F.col("share") * F.lit(float(1 << 53))).select("l", "h").distinct()
    w = Window.partitionBy("l").orderBy("h")
    picked = drawn.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample_texts).select("l", "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(lang.as_py(), x, h.as_py(), i) for lang, t, h in zip(*(batch.column(c) for c in range(3))) for i, x in enumerate(windows(t.as_py(), sample_words))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in own], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["l", "t", "h", "i"])

    # picked has at most sample_texts rows a language; a row that repeats counts once
    sample = rows.join(F.broadcast(picked), ["l", "h"], "left_semi").select("l", "t", "h").mapInArrow(cut, "l string, t string, h bigint, i bigint").distinct().collect()
    if not sample:
        return None
    langs = sorted({r["l"] for r in sample})
    return Crf(langs).fit(spliced(sorted((r["l"], r["t"]) for r in sample), langs), epochs)


def predict(docs: DataFrame, model: Crf | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, lang_pred, score and known of each row. One pass, no shuffle."""
    small_batches(docs.sparkSession)
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = sent.value
        for batch in batches:
            lang, score, known = [], [], []
            column = batch.column(len(keep))
            for s in crf.texts([v.as_py() for v in column]) if crf else [None] * len(column):
                words = 0.0 if s is None else s[:-1].sum()
                best = 0 if s is None else int(np.argmax(s[:-1]))
                lang.append(UNKNOWN if s is None else crf.langs[best])
                score.append(0.0 if s is None else float(min(1.0, s[best] / words)))
                known.append(0.0 if s is None else float(min(1.0, s[-1] / words)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], names=[*keep, "lang_pred", "score", "known"])

    return chosen.mapInArrow(run, f"{schema}, lang_pred string, score double, known double")
