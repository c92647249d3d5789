"""Prompts from what is known of a record: boundaries in its note, priors, probes and what is left of the note.

All are column expressions. A prompt that can't be derived has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivault.functions.text import blank_to_null, words

# Where the parts of a note begin, and which priors go with which probe.
ENCOUNTER = r"(?i)electronically|subjective"
ENCOUNTER_MARK = r"(?i)[ \t\n]*(?:electronically|subjective):?"
HPI_MARK = r"(?i)\n \n hpi:"
AFTER_HPI_MARK = r"(?i)\n ros: \nconstitutional:|\n \n preventative screening tests:"
STRUCTURED = ("public", "public_named", "public_named_meds")
UNSTRUCTURED = ("encounter_info", "encounter_info_cc", "encounter_info_cc_hpi")
CONTINUATION, NEW_NOTE = "note_continuation", "patient_note"
HORIZON = 400
DEFAULT_WORDS = 1000


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def encounter_boundary(start: str) -> list[Column]:
    """prefix, marker: what stands before the encounter's boundary, and the boundary with white space before and a colon after; null without one."""
    at = F.regexp_instr(start, F.lit(ENCOUNTER))
    return [F.when(at > 0, _rstrip(F.substring(F.col(start), F.lit(1), at - 1))).alias("prefix"), F.when(at > 0, F.regexp_substr(start, F.lit(ENCOUNTER_MARK))).alias("marker")]


def _after(note: Column, part: Column) -> Column:
    """What follows the first occurrence of part, or of part without trailing space, in note; null without either."""
    cut = _rstrip(part)
    behind = lambda p: F.when((p != "") & note.contains(p), F.substring(note, F.position(p, note) + F.length(p), F.length(note)))
    return F.coalesce(behind(part), behind(cut))


def marker_after(note: Column, part: Column, pattern: str) -> Column:
    """The first match of pattern behind part; null if part or match is missing."""
    return F.regexp_substr(_after(note, part), F.lit(pattern))


def known_fields(fields: dict[str, str]) -> Column:
    """'name: value' lines of the fields that are present."""
    return blank_to_null(F.concat_ws("\n", *[F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{n}: "), F.col(c).cast("string"))) for n, c in fields.items()]))


def remaining(note: Column, prefix: Column, marker: Column) -> Column:
    """Words of the note behind prefix and marker (looked for within HORIZON), at least 1; the default where the prefix isn't there."""
    rest = _after(note, prefix)
    near = F.substring(rest, 1, HORIZON)
    behind = F.when((marker != "") & near.contains(marker), F.substring(rest, F.position(marker, rest) + F.length(marker), F.length(rest))).otherwise(rest)
    return F.coalesce(F.greatest(F.size(words(behind)), F.lit(1)), F.lit(DEFAULT_WORDS))


def build_prompts(records: DataFrame) -> DataFrame:
    """key, prior_tier, probe_type, prompt, remaining_words for every valid combination.

    Structured priors take the probe of a new note, unstructured ones that of its continuation.
    """
    base = known_fields({"gender": "patient_gender", "marital status": "marital_status", "number of children": "children", "occupation": "occupation"})
    named = F.when(F.col("extracted_name") != "", F.concat(F.lit("name: "), F.col("extracted_name"), F.lit("\n"), F.col("base")))
    treated = F.when(F.col("medications") != "", F.concat(F.col("named"), F.lit("\nmedications: "), F.col("medications")))
    start_mark = marker_after(F.col("last_note"), F.col("note_start"), HPI_MARK)
    hpi_mark = marker_after(F.col("last_note"), F.col("note_hpi"), AFTER_HPI_MARK)
    r = records.withColumn("base", base).withColumn("named", named).withColumn("treated", treated).withColumn("start_mark", start_mark).withColumn("hpi_mark", hpi_mark)
    prefix, marker = encounter_boundary("note_start")
    r = r.select("*", prefix, marker)
    none = F.lit("")
    row = lambda tier, probe, prefix, end: F.struct(F.lit(tier).alias("prior_tier"), F.lit(probe).alias("probe_type"), prefix.alias("p"), end.alias("m"))
    options = [row(t, NEW_NOTE, F.col(c), F.lit("\npatient note:")) for t, c in zip(STRUCTURED, ("base", "named", "treated"))]
    options += [
        row(UNSTRUCTURED[0], CONTINUATION, blank_to_null(F.col("prefix")), F.col("marker")),
        row(UNSTRUCTURED[1], CONTINUATION, F.col("note_start"), F.col("start_mark")),
        row(UNSTRUCTURED[2], CONTINUATION, F.concat("note_start", "start_mark", "note_hpi"), F.col("hpi_mark")),
    ]
    each = r.select("key", "last_note", F.explode(F.array(*options)).alias("o")).where("o.p is not null and o.m is not null")
    left = F.when(F.col("o.probe_type") == CONTINUATION, remaining(F.col("last_note"), F.col("o.p"), F.coalesce("o.m", none))).otherwise(DEFAULT_WORDS)
    return each.select("key", "o.prior_tier", "o.probe_type", F.concat("o.p", "o.m").alias("prompt"), left.alias("remaining_words"))
