"""Tokenizers as the core's operators use them: where the tokens of a text are.

Any tokenizer will do that gives offsets; it is pickled with the task that runs it. ``WORDS`` is the default.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Tokenizer(Protocol):
    """What operators ask of a tokenizer: half-open offsets, in code points and in order; none for an empty text."""

    def offsets(self, text: str) -> Sequence[tuple[int, int]]: ...

    def pieces(self, text: str) -> Sequence[str]: ...


class Words:
    """Runs of characters that aren't ASCII white space."""

    pattern = re.compile(r"\S+", re.A)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text)]

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class Offsets:
    """A tokenizer from any function that gives offsets, such as those a public tokenizer's encoding has."""

    def __init__(self, find: Callable[[str], Sequence[tuple[int, int]]]) -> None:
        self.find = find

    def offsets(self, text: str) -> Sequence[tuple[int, int]]:
        return self.find(text)

    def pieces(self, text: str) -> list[str]:
        return [text[s:e] for s, e in self.find(text)]


WORDS = Words()


def token_spans(text: Column | str, tokenizer: Tokenizer = WORDS) -> Column:
    """array<struct<s:int,e:int>>: the tokens of a text, none for null, in one Arrow pass."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"s": s, "e": e} for s, e in tokenizer.offsets(t)] if t else [] for t in texts])

    return spans(text)


def token_count(text: Column | str, tokenizer: Tokenizer = WORDS) -> Column:
    """The number of tokens, 0 for null; words are counted in the JVM."""
    if isinstance(tokenizer, Words):
        return F.greatest(F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))), F.lit(0)), F.lit(0))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(tokenizer.offsets(t)) if t else 0 for t in texts])

    return count(text)
