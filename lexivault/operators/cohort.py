"""Cohort extraction: latest rows per key, fields by regular expression, dimension joins and key-level filters.

Everything is built-in: one shuffle by key serves the latest note and the latest notes that mention a field,
as ``max_by`` aggregates that combine on the map side, so a hot key moves one candidate row per task and
field. Dimensions join by lower-cased key; Spark broadcasts them only below its own size limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivault.functions.text import extract, strip


@dataclass(frozen=True)
class FieldRule:
    """A field taken from the latest note that mentions it: where it is mentioned, and what to extract."""

    name: str
    mention: str
    value: str


# How fields stand in the notes.
MENTIONED = (
    FieldRule("occupation", r"(?i)occupation\s*:", r"(?i)occupation\s*:\s*([\s\S]+?)\s*(?:;|marital status\s*:)"),
    FieldRule("marital_status", r"(?i)marital status\s*:", r"(?i)marital status\s*:\s*([\s\S]+?)\s*children\s*:"),
    FieldRule("children", r"(?i)children\s*:", r"(?i)children\s*:\s*([^\n]+)"),
)
NAME = r"^\s*([A-Za-z][A-Za-z\s,\.\-]+?)\s+\d{2}/\d{2}/\d{4}"
DATE_OF_BIRTH = r"\b(\d{2}/\d{2}/\d{4})\b"
NOTE_START = r"(?i)^([\s\S]+?)\n \n hpi:"
NOTE_HPI = r"(?i)\n \n hpi:\s*([\s\S]+?)(?:\n ros: \nconstitutional:|\n \n preventative screening tests:)"
MEDICATIONS = r"(?i)current\s+medications?\s*[:\-][^\n]*\n([\s\S]+?)(?:\n\s*\n|\z)"
REVIEW_LINE = r"(?i)^last\s+reviewed\s+on"


def eligible_notes(notes: DataFrame, section: str, since: str, max_chars: int) -> DataFrame:
    """Rows of a section (case and outer spaces ignored) since a day, with text that isn't blank and is below max_chars."""
    return notes.where(
        (F.lower(F.trim("Section_Name")) == section) & (F.col("Encounter_Date") >= F.lit(since).cast("timestamp_ntz")) & F.col("Note").isNotNull() & (F.trim("Note") != "") & (F.length("Note") < max_chars)
    )


def latest_texts(notes: DataFrame, key: Column, fields: tuple[FieldRule, ...] = MENTIONED) -> DataFrame:
    """(key, last_note, and each field): a key's latest note, and fields of its latest note that mentions them.

    The note is chosen before the field is extracted: if it fails the longer pattern, the field is null.
    Equal dates are ordered by row_idx.
    """
    at = F.struct("Encounter_Date", "row_idx")
    src = notes.select(key.alias("key"), "Note", at.alias("at")).where("key is not null")
    each = [F.max_by("Note", F.when(F.col("Note").rlike(f.mention), F.col("at"))).alias(f.name) for f in fields]
    out = src.groupBy("key").agg(F.max_by("Note", "at").alias("last_note"), *each)
    return out.select("key", "last_note", *[F.trim(extract(f.name, f.value)).alias(f.name) for f in fields])


def medication_list(note: str) -> Column:
    """The lines of a note's medication block, trimmed, without blank and review lines, joined by '; '."""
    lines = F.split(F.trim(extract(note, MEDICATIONS)), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) != "") & ~x.rlike(REVIEW_LINE))
    return F.array_join(F.transform(kept, lambda x: F.trim(x)), "; ")


def with_note_fields(latest: DataFrame) -> DataFrame:
    """Adds what is extracted from the latest note: name, date of birth, start, history and medications."""
    return latest.select(
        "*",
        F.trim(extract("last_note", NAME)).alias("extracted_name"),
        extract("last_note", DATE_OF_BIRTH).alias("extracted_dob"),
        extract("last_note", NOTE_START).alias("note_start"),
        F.trim(extract("last_note", NOTE_HPI)).alias("note_hpi"),
        medication_list("last_note").alias("medications"),
    )


def recode(c: Column, groups: dict[str, tuple[str, ...]], drop: tuple[str, ...]) -> Column:
    """Lower-cased and trimmed; members of a group become its name, values to drop and null are null."""
    v = F.lower(strip(c))
    out = v
    for name, members in groups.items():
        out = F.when(v.isin(*members), name).otherwise(out)
    return F.when(~v.isin(*drop), out)


def complete(df: DataFrame, columns: list[str], filled: tuple[str, ...] = ()) -> DataFrame:
    """Rows without a null in columns, and without an empty text in filled."""
    out = df.dropna(subset=columns)
    for c in filled:
        out = out.where(F.col(c) != "")
    return out


def single_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs once; all rows of a key with several are dropped. Null keys are dropped.

    The repeated keys are counted with a map-side combine and removed by an anti-join; both use the same
    partitioning, so the input is shuffled once by key.
    """
    several = df.groupBy(key).count().where("count > 1").select(key)
    return df.where(F.col(key).isNotNull()).join(several, key, "left_anti")
