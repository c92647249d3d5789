"""Checks and repairs of annotations: spans that really stand in a text, lists without named entries, tails, reference text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivault.functions.text import words


def verify_spans(spans: Column, text: Column) -> Column:
    """The spans that are non-empty and stand in the text exactly, in their order; none for nulls."""
    kept = F.filter(spans, lambda s: (s != "") & F.coalesce(text.contains(s), F.lit(False)))
    return F.coalesce(kept, F.array().cast("array<string>"))


def verify_removals(removals: Column, text: Column) -> Column:
    """The substrings that stand in the text, in any case."""
    return F.coalesce(F.filter(removals, lambda s: (s != "") & F.lower(text).contains(F.lower(s))), F.array().cast("array<string>"))


def scrub_list(packed: Column, removals: Column) -> Column:
    """A ;-list without the entries that contain any of the removals (case ignored); unchanged where there are none."""
    parts = F.transform(F.split(packed, ";"), lambda x: F.trim(x))
    kept = F.filter(parts, lambda x: (x != "") & ~F.exists(removals, lambda r: F.lower(x).contains(F.lower(r))))
    return F.when(F.size(removals) > 0, F.array_join(kept, "; ")).otherwise(packed)


def last_words(text: Column, n: int) -> Column:
    """The last n words, joined by single spaces."""
    w = words(text)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), n), " ")


def reference_text(rows: DataFrame, name: str, lists: dict[str, str], most: int = 10_000) -> DataFrame:
    """One row (text): for each name in order a line with it, and one for each of its lists (title -> column of arrays), values joined by '; '.

    Meant for dimension tables, whose text is one prompt: more than ``most`` rows are refused, never cut.
    """
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows of a reference table")
    parts = [F.concat(F.lit(f"\n  {title}: "), F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "; ")) for title, c in lists.items()]
    line = F.concat(F.lit("- "), F.col(name), *parts)
    return rows.where(F.col(name).isNotNull()).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
