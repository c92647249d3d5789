"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: bounded-lookahead streaming transducer. A merge list is read from a file of ranks; from it a
sufficient lookahead is computed, and a word of any length is encoded in windows of which only tokens
that end at least that far before the window's end are emitted, which keeps the encoder's memory constant. A text is
read in windows too, and a word is passed on once no later character can change it. Decoding is an
incremental state machine from bytes to text. What grows with a text is the text itself, as Spark hands over whole
values, and the window around a run of one kind of character (70,000 equal letters, say), which holds that run.

The vocabulary's place is a parameter, the same on all machines; nothing is trained. Null and empty texts have no ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.runtime import spread
from lexivault.sources.files import is_done, write_done

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed values of the public vocabulary: how a text is divided into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts of ASCII, Latin-1 letters and general punctuation only, for which the standard library's
# matcher needs less than half the time.
_PLAIN = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ\u2010-\u2027]")
_PLAIN_WORDS = re.compile(
    r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9À-ÖØ-öø-ÿ]+"
    r"|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"
)
_WORD_LOOKAHEAD = 3  # characters after a word that can still change where it ends
_TEXT_WINDOW = 1 << 16
_CACHE = 1 << 17
_BATCH_CHARS = 1 << 22  # characters whose ids are held before they are passed on


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Streaming encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORD_PATTERN) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.words = regex.compile(pattern)
        self.lookahead = self._sufficient_lookahead()
        self.window = max(4 * self.lookahead, 1024)
        self._known: dict[str, list[int]] = {}

    def _sufficient_lookahead(self) -> int:
        """Bytes after a token that can still decide whether it is formed.

        A merge is prevented only by an earlier one that takes its right part, which in turn may have been
        prevented by a still earlier one to its right. Such chains rise in rank from right to left and meet in a
        shared token, so the longest is found in one pass over the merges in order of rank.
        """
        reach: dict[bytes, int] = {}
        most = 1
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            if len(token) < 2:
                continue
            parts = self._merge(token, rank)
            if len(parts) != 2:
                continue
            u, v = parts
            far = max(len(token), len(u) + reach.get(v, 0))
            for shared in (u, token):
                reach[shared] = max(reach.get(shared, 0), far)
            most = max(most, far)
        return most + max(map(len, self.ranks))

    def _merge(self, word: bytes, below: int | None = None) -> list[bytes]:
        """The word's tokens by merges of rising rank, leftmost first, with a heap over a linked list."""
        n = len(word)
        ends = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ranks = self.ranks
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if (j := ends[i]) < n and (r := ranks.get(word[i : ends[j]])) is not None and (below is None or r < below):
                heapq.heappush(heap, (r, i, ends[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if j < 0 or j >= n or ends[j] != end:
                continue
            ends[i], ends[j] = end, -1
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(word[i : ends[i]])
            i = ends[i]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one word; a long one in windows, each emitting only what is stable."""
        ranks, out, start = self.ranks, [], 0
        if word in ranks:
            return [ranks[word]]
        while len(word) - start > self.window:
            at, stable = start, start + self.window - self.lookahead
            for token in self._merge(word[start : start + self.window]):
                if at + len(token) > stable:
                    break
                out.append(ranks[token])
                at += len(token)
            start = at
        out += [ranks[token] for token in self._merge(word[start:])]
        return out

    def _learn(self, word: str) -> list[int]:
        ids = self.encode_word(word.encode("utf-8", "replace"))
        if len(word) <= 64:
            if len(self._known) >= _CACHE:
                self._known.clear()
            self._known[word] = ids
        return ids

    def words_of(self, text: str) -> Iterator[list[str]]:
        """The text's words, window by window; a word is passed on once what follows can't change it.

        A word longer than a window (runs of one kind of character) widens the window until it ends.
        """
        at, size, n = 0, _TEXT_WINDOW, len(text)
        divide = self.words.findall
        if self.words.pattern == WORD_PATTERN and not _PLAIN.search(text):
            divide = _PLAIN_WORDS.findall
        while n - at > size:
            words = divide(text[at : at + size])
            stable = size - _WORD_LOOKAHEAD
            used = size
            while words and used > stable:
                used -= len(words.pop())
            if not words:
                size *= 2
                continue
            yield words
            at += used
            size = _TEXT_WINDOW
        yield divide(text[at:] if at else text)

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Lists of ids, which together encode the text."""
        if not text:
            return
        known, learn = self._known, self._learn
        for words in self.words_of(text):
            try:
                yield list(chain.from_iterable([known[w] for w in words]))
            except KeyError:
                yield list(chain.from_iterable([known.get(w) or learn(w) for w in words]))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.encode(text)))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of the ids, character by character as bytes complete one; what isn't UTF-8 becomes U+FFFD."""
        need, code, least = 0, 0, 0
        for i in ids:
            out = []
            for byte in self.tokens[i]:
                if need and 0x80 <= byte < 0xC0:
                    code, need = code << 6 | byte & 0x3F, need - 1
                    if not need:
                        out.append(chr(code) if least <= code < 0x110000 and not 0xD800 <= code < 0xE000 else "�")
                    continue
                if need:
                    out.append("�")
                    need = 0
                if byte < 0x80:
                    out.append(chr(byte))
                elif 0xC2 <= byte < 0xF5:
                    need = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                    code, least = byte & (0x3F >> need), (0x80, 0x800, 0x10000)[need - 1]
                else:
                    out.append("�")
            yield "".join(out)
        if need:
            yield "�"


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One a worker process: its table of known words serves all batches."""
    return Transducer(read_ranks(path))


def _require(path: str) -> None:
    """Fail before a job starts if the vocabulary isn't at its place, which must be the same on all machines."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no vocabulary at {path}")


def _encoded(column: pa.ChunkedArray | pa.Array, t: Transducer) -> Iterator[tuple[int, pa.ListArray]]:
    """(rows, their ids) in runs of at most about _BATCH_CHARS characters."""
    values: list[np.ndarray] = []
    sizes: list[int] = []
    chars = 0

    def flush() -> tuple[int, pa.ListArray]:
        offsets = np.zeros(len(sizes) + 1, np.int32)
        np.cumsum(sizes, out=offsets[1:])
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        return len(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))

    for text in column.to_pylist():
        n = 0
        for ids in t.encode(text):
            values.append(np.asarray(ids, np.int32))
            n += len(ids)
        sizes.append(n)
        chars += len(text or "")
        if chars >= _BATCH_CHARS:
            yield flush()
            values, sizes, chars = [], [], 0
    if sizes:
        yield flush()


def encode(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id_col, ids ARRAY<INT>): every row's text as ids, without special tokens; an empty list for null and empty texts.

    One pass without a shuffle; rows may repeat and the id may be null.
    """
    _require(path)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            at = 0
            for n, ids in _encoded(batch.column(1), t):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), ids], ["id", "ids"])
                at += n

    return spread(src).mapInArrow(run, f"id {dict(src.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens INT): the length of every row's text in tokens; 0 for null and empty texts."""
    _require(path)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            counts = pa.array([t.count(x) for x in batch.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["id", "n_tokens"])

    return spread(src).mapInArrow(run, f"id {dict(src.dtypes)['id']}, n_tokens int").withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str = VOCABULARY) -> DataFrame:
    """(id_col, text): the inverse of encode; null ids give a null text."""
    _require(path)
    src = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for batch in batches:
            texts = [None if x is None else "".join(t.decode(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def _fingerprint(path: str) -> str:
    _require(path)
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def write_ids(encoded: DataFrame, out: str, path: str = VOCABULARY) -> None:
    """Keep an encoded corpus as a columnar dataset, marked as complete and as made with this vocabulary."""
    encoded.write.mode("overwrite").option("compression", "zstd").parquet(out)
    write_done(encoded.sparkSession, out, vocabulary=_fingerprint(path))


def read_ids(spark: SparkSession, out: str, path: str = VOCABULARY) -> DataFrame:
    """A kept corpus; an error if it is incomplete or was made with another vocabulary."""
    if not is_done(spark, out, vocabulary=_fingerprint(path)):
        raise ValueError(f"{out} is incomplete or encoded with another vocabulary than {path}")
    return spark.read.parquet(out)
