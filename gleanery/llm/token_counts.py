"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols stand in a doubly linked list; a heap holds its adjacent pairs by (rank of the merge, place). The lowest is
popped again and again, merged if it still stands, and its new neighbours pushed. The count is the initial symbols minus the
merges done, so no identifiers are ever made. Works in O(n log n) for a word of n symbols, however long.

Reads the tables (merge ranks, normalisation, split pattern, added tokens) of a tokenizer file of the `tokenizers` library.
Words are counted once in a bounded memo a Python worker, since words repeat far more than texts.

Cases: null or empty text has 0 tokens; texts of any length are counted whole, in windows of bounded memory cut where no word
can cross; repeated rows are counted each; an empty table gives an empty result; columns other than the key and the text are
not read, so their names can't clash.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import small_batches

#: Words memoised by a Python worker, in two generations. Bounds memory, not results.
MEMO_WORDS = 400_000
#: The words of a text. None holds white space, and each is found alone as it is in a text, so runs without white space are counted one by one.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_L, _N, _S = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
#: The same words of lower-case Latin-1 texts, by classes written out: `re` takes less than half the time of splitting by properties, and words without their punctuation are met again more often than runs.
LATIN_WORDS = re.compile(f"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_L}{_N}{_S}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [letter for _, letter in sorted([(b, chr(b)) for b in plain] + [(b, chr(256 + i)) for i, b in enumerate(other)])]


class Memo(dict):
    """Words' tokens, in two generations: at `most` words in the younger it becomes the older, and words met again move back. What neither has is asked of `count`."""

    def __init__(self, count: Callable[[str], int], most: int):
        self.count, self.most, self.old = count, most, {}

    def __missing__(self, run: str) -> int:
        n = self.old.get(run)
        if n is None:
            return self.count(run)
        self[run] = n
        return n

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class MergeCounter:
    """Counts the tokens of texts as the tokenizer file at path does, without special tokens of its own."""

    def __init__(self, path: str, memo_words: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        letters = byte_letters()
        self.symbol = [vocab[x] for x in letters]
        self.last = [vocab[x + self.suffix] for x in letters]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: this normaliser isn't known: {kinds}")
        first, second = spec["pre_tokenizer"]["pretokenizers"]
        if (first["type"], first["behavior"], first["invert"], second["type"]) != ("Split", "Removed", True, "ByteLevel") or first["pattern"]["Regex"] != WORDS:
            raise ValueError(f"{path}: this splitter isn't known")
        self.pattern = regex.compile(WORDS, regex.V0)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.memo = Memo(self._run, (memo_words or MEMO_WORDS) // 2)

    def word(self, word: str) -> int:
        """Tokens of one word: its symbols less the merges."""
        data = word.encode()
        n = len(data)
        if n <= 1:
            return n
        get = self.merge.get
        ids = [self.symbol[b] for b in data]
        ids[-1] = self.last[data[-1]]
        heap = []
        for i in range(n - 1):
            if m := get((ids[i], ids[i + 1])):
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pop, push, left = heapq.heappop, heapq.heappush, n
        while heap:
            _, i, a, b, new = pop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # a pair that an earlier merge has taken apart
            ids[i], ids[j] = new, -1
            left -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := get((new, ids[k])):
                    push(heap, (m[0], i, new, ids[k], m[1]))
            k = before[i]
            if k >= 0 and (m := get((ids[k], new))):
                push(heap, (m[0], k, ids[k], new, m[1]))
        return left

    def _run(self, run: str) -> int:
        """Tokens of a run without white space that the memo hasn't. Its words enter the memo, the run of several doesn't."""
        of = self.memo.__getitem__
        if not (run.isascii() and run.isalpha()):
            if run[-1] in ",." and run.isascii() and run[:-1].isalpha():
                return of(run[:-1]) + of(run[-1])
            words = self.pattern.findall(run)
            if words != [run]:
                return sum(map(of, words))
        n = self.word(run)
        if len(run) <= 64:
            self.memo[run] = n
        return n

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if text.isascii() else _lower(text)
        self.memo.age()
        if _latin(text):
            return sum(map(self.memo.__getitem__, LATIN_WORDS.findall(text)))
        # split() parts at four controls too, which are words to the pattern
        runs = self.pattern.findall(text) if any(x in text for x in "\x1c\x1d\x1e\x1f") else text.split()
        return sum(map(self.memo.__getitem__, runs))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, at = 0, 0
        if self.added is not None and "<|" in text:
            for m in self.added.finditer(text):
                total += self._windows(text[at : m.start()]) + 1
                at = m.end()
        return total + self._windows(text[at:] if at else text)

    def _windows(self, text: str, size: int = 1 << 20) -> int:
        """In windows that end before a space: the words and the normal form on either side are independent there."""
        total = 0
        while len(text) > size:
            cut = text.find(" ", size)
            if cut < 0:
                break
            total += self._plain(text[:cut])
            text = text[cut:]
        return total + self._plain(text)


def _lower(text: str) -> str:
    """Lower case letter by letter, without the context that str.lower() takes at a final sigma."""
    if "Σ" in text:
        text = text.replace("Σ", "σ")
    return text.lower()


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


@functools.lru_cache(maxsize=2)
def counter(path: str, memo_words: int | None = None) -> MergeCounter:
    """One a Python worker."""
    return MergeCounter(path, memo_words)


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of each row, in one pass without a shuffle. tokenizer: the file's path on every node."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(1):
                t = value.as_py()
                n_bytes.append(len(t.encode()) if t else 0)
                n_tokens.append(c.count(t))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def counted(docs: DataFrame, tokenizer: str, name: str = "n_tokens", text: str = "text", keep: tuple[str, ...] = ("doc_id",), memo_words: int | None = None) -> DataFrame:
    """The columns keep of each row and, as name, the number of tokens of its text. memo_words: how many a Python worker memoises, for MEMO_WORDS."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer, memo_words)
        for batch in batches:
            n = pa.array([c.count(v.as_py()) for v in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], names=[*keep, name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"{schema}, `{name}` bigint")
