"""Repetition inside a single document.

Method: repetition coverage with rolling hashes of word n-grams in numpy, many documents at a time. A
word is repeated if it lies in n consecutive words that also stand, in the same order, from some
earlier word of the same document on. Words are runs of letters, letter case ignored.

Every document is judged by itself, so nothing is shuffled. Null and blank texts have no words and a
share of 0. A document may be of any length: its arrays are as long as its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivault.runtime import spread

_WORD = regex.compile(r"\p{L}+")
_BLOCK = 1 << 20  # code points handled at once
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _MULT
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _later(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier in the array."""
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return again


class _Block:
    """Words of several documents: a hash of each word's folded form, its document and its length."""

    def __init__(self, texts: list[str | None]) -> None:
        seen: dict[str, int] = {}
        code: list[int] = []
        self.counts = np.zeros(len(texts), np.int64)
        sizes: list[int] = []
        for i, text in enumerate(texts):
            words = _WORD.findall(text) if text else []
            self.counts[i] = len(words)
            code += [seen.setdefault(w.lower(), len(seen)) for w in words]
            sizes += map(len, words)
        self.word = _mix(np.asarray(code, np.uint64) + np.uint64(1))
        self.chars = np.asarray(sizes, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    def repeated(self, n: int) -> np.ndarray:
        """True for each word inside an n-gram that stood earlier in its document."""
        total = len(self.word)
        if total < n:
            return np.zeros(total, bool)
        h = np.zeros(total - n + 1, np.uint64)
        for j in range(n):
            h = h * _MULT + self.word[j : total - n + 1 + j]
        whole = self.doc[n - 1 :] == self.doc[: total - n + 1]
        at = np.flatnonzero(whole)
        again = at[_later(_mix(h[at]) ^ _mix(self.doc[at].astype(np.uint64) + np.uint64(7)))]
        step = np.zeros(total + 1, np.int32)
        step[again] += 1
        np.add.at(step, again + n, -1)
        return np.cumsum(step[:-1]) > 0

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=len(self.counts))


def _line_chars(text: str | None) -> tuple[int, int]:
    """Characters in non-blank lines, and in those that stood earlier."""
    seen: set[str] = set()
    total = again = 0
    for line in (text or "").splitlines():
        if line := line.strip():
            total += len(line)
            if line in seen:
                again += len(line)
            seen.add(line)
    return total, again


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > _BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def repetition(df: DataFrame, id_col: str, text_col: str, lengths: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """One row per input row: (id_col, n_words, repeated_words_N and repeated_share_N for each n-gram length N, char_share, line_share).

    ``char_share`` is the share of letters that lie inside repeated n-grams of the least length;
    ``line_share`` that of characters in lines that stood earlier in the same text.
    """
    ids = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(ids.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for s, e in _blocks(texts):
                block = _Block(texts[s:e])
                n_words = np.maximum(block.counts, 1)
                out = {"id": batch["id"].iloc[s:e].to_numpy(), "n_words": block.counts}
                for n in lengths:
                    words = block.by_doc(block.repeated(n)).astype(np.int64)
                    out[f"repeated_words_{n}"], out[f"repeated_share_{n}"] = words, words / n_words
                chars = np.maximum(block.by_doc(block.chars), 1)
                out["char_share"] = block.by_doc(block.repeated(min(lengths)) * block.chars) / chars
                lines = np.asarray([_line_chars(t) for t in texts[s:e]]).reshape(-1, 2)
                out["line_share"] = lines[:, 1] / np.maximum(lines[:, 0], 1)
                yield pd.DataFrame(out)

    fields = "".join(f", repeated_words_{n} long, repeated_share_{n} double" for n in lengths)
    return spread(ids).mapInPandas(run, f"id {id_type}, n_words long{fields}, char_share double, line_share double").withColumnRenamed("id", id_col)


def repetitive(df: DataFrame, id_col: str, text_col: str, n: int = 5, least_share: tuple[int, int] = (1, 3)) -> DataFrame:
    """(id_col): ids of the texts of which at least the given part (a fraction) of the words are repeated; each id once.

    Texts without words are never among them. Only the found ids are shuffled.
    """
    ids = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    id_type = dict(ids.dtypes)["id"]
    num, den = least_share

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for s, e in _blocks(texts):
                block = _Block(texts[s:e])
                words = block.by_doc(block.repeated(n)).astype(np.int64)
                found = (words * den >= block.counts * num) & (words > 0)
                yield pd.DataFrame({"id": batch["id"].iloc[s:e].to_numpy()[found]})

    return spread(ids).mapInPandas(run, f"id {id_type}").distinct().withColumnRenamed("id", id_col)
