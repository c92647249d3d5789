"""Token grams of candidate texts that stand in the same key's source texts.

A gram is ``tau`` tokens in a row. Grams are compared by 64-bit rolling hashes of their tokens' hashes, computed in one
Arrow pass a text whatever tau is, so that the shuffle moves numbers, not text. Only sources of keys that have
candidates are broken up (a semi-join before the pass), and each side is made distinct before it is joined,
so a repeated gram or a hot key costs one row per different gram. Equality of hashes is taken as equality: among m
candidate and n source grams m * n / 2**64 false hits are to be expected. Null and short texts have no grams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivault.functions.tokens import WORDS, Tokenizer, token_count
from lexivault.runtime import spread

_BASE = 0x9E3779B97F4A7C15
_KNOWN = 500_000  # token hashes remembered in a task


class _Hasher:
    """Rolling hashes of the grams of a text."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.known: dict[str, int] = {}
        self.up = self.down = np.ones(1, np.uint64)

    def tokens(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > _KNOWN:
            known.clear()
        out = []
        for t in self.tokenizer.pieces(text) if text else ():
            if (h := known.get(t)) is None:
                h = known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.asarray(out, np.uint64)

    def grams(self, tokens: np.ndarray, tau: int) -> np.ndarray:
        n = len(tokens)
        if n < tau:
            return np.zeros(0, np.int64)
        if len(self.up) < n + 1:
            powers = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b, np.uint64))))
            self.up, self.down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * self.up[:n])))
        h = (total[tau:] - total[:-tau]) * self.down[: n - tau + 1]
        h ^= h >> np.uint64(31)
        return (h * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _grams(df: DataFrame, keep: list[str], tau: int, tokenizer: Tokenizer) -> DataFrame:
    """keep, pos (from 0), gram (mixed with the key): one row per position of df (keep, key, text)."""

    @F.pandas_udf("array<bigint>")
    def hashes(texts: pd.Series) -> pd.Series:
        make = _Hasher(tokenizer)
        return pd.Series([make.grams(make.tokens(t), tau) for t in texts])

    return df.select(*keep, "key", F.posexplode(hashes("text")).alias("pos", "h")).select(*keep, "pos", F.xxhash64("h", "key").alias("gram"))


def gram_hits(candidates: DataFrame, sources: DataFrame, tau: int = 30, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(id, pos): positions of candidate grams that stand in a source text of the same key.

    candidates: (id, key, text); sources: (key, text).
    """
    made = spread(candidates.where("key is not null and text is not null").select("id", "key", "text"))
    own = spread(sources.where("text is not null").select("key", "text")).join(made.select("key").distinct(), "key", "left_semi")
    known = _grams(own, [], tau, tokenizer).select("gram").distinct()
    return _grams(made, ["id"], tau, tokenizer).join(known, "gram", "left_semi").select("id", "pos")


def gram_flag(candidates: DataFrame, sources: DataFrame, tau: int = 30, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(id, verbatim): whether any gram of the candidate stands in its key's sources; false for short texts."""
    hit = gram_hits(candidates, sources, tau, tokenizer).select("id").distinct().withColumn("hit", F.lit(True))
    return candidates.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("verbatim"))


def gram_coverage(candidates: DataFrame, sources: DataFrame, tau: int = 30, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(id, covered, total, coverage): tokens inside at least one hit, of all tokens, and their ratio to 4 places.

    Covered tokens are the union of hit intervals: with hits in order, each adds at most tau tokens and no
    more than its distance to the next hit.
    """
    hits = gram_hits(candidates, sources, tau, tokenizer).groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    n = F.size("p")
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, F.least(F.lit(tau), F.try_element_at("p", i + 1) - F.element_at("p", i))).otherwise(tau))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    sized = candidates.select("id", token_count("text", tokenizer).alias("total"))
    out = sized.join(hits.select("id", covered.alias("covered")), "id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.select("id", "covered", "total", F.when(F.col("total") > 0, F.round(F.col("covered") / F.col("total"), 4)).otherwise(F.lit(0.0)).alias("coverage"))


def gram_coverages(candidates: DataFrame, sources: DataFrame, taus: Sequence[int], tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(tau, id, covered, total, coverage) for each of several gram lengths."""
    out = None
    for tau in taus:
        one = gram_coverage(candidates, sources, tau, tokenizer).select(F.lit(tau).alias("tau"), "id", "covered", "total", "coverage")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("name at least one gram length")
    return out


def gram_texts(candidates: DataFrame, sources: DataFrame, tau: int = 30, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(id, first_pos, span): the different hit grams as text, tokens joined by a space, each at its first position."""
    hits = gram_hits(candidates, sources, tau, tokenizer).groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("hits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, at in zip(batch["id"], batch["text"], batch["hits"]):
                tokens = tokenizer.pieces(text)
                first: dict[str, int] = {}
                for p in at:
                    first.setdefault(" ".join(tokens[p : p + tau]), int(p))
                rows += [(i, p, span) for span, p in first.items()]
            yield pd.DataFrame(rows, columns=["id", "first_pos", "span"])

    src = candidates.select("id", "text").join(hits, "id")
    return src.mapInPandas(run, f"id {dict(src.dtypes)['id']}, first_pos int, span string")


def repetition_cut(df: DataFrame, id_col: str, text_col: str, window: int = 20, tokenizer: Tokenizer = WORDS) -> DataFrame:
    """(id_col, n_words, kept): tokens to keep, up to the first gram that stood before; all where shorter than two windows.

    Each text is handled within its row, in time that grows with its tokens: no shuffle, whatever the number of rows.
    """
    src = spread(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = _Hasher(tokenizer)
        for batch in batches:
            sizes, kept = [], []
            for text in batch["text"]:
                tokens = make.tokens(text)
                n = len(tokens)
                cut = n
                if n >= 2 * window:
                    h = make.grams(tokens, window)
                    order = np.argsort(h, kind="stable")
                    again = order[1:][h[order[1:]] == h[order[:-1]]]
                    cut = int(again.min()) if len(again) else n
                sizes.append(n)
                kept.append(cut)
            yield pd.DataFrame({"id": batch["id"], "n_words": sizes, "kept": kept})

    return src.mapInPandas(run, f"id {dict(src.dtypes)['id']}, n_words int, kept int").withColumnRenamed("id", id_col)
