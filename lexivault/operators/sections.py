"""Sections of notes, boilerplate inside them, and tokens classed as templated or revealing.

What a note's template looks like is data (``NoteTemplate``); the operators only read it. Offsets of pattern
matches need Python, so each operator is one Arrow pass over rows that already hold what they need (a region
and the note it came from): nothing is shuffled, and rows are independent. Null and empty texts have no
headers, segments or tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The note template's headers, their place in the hierarchy, and boilerplate patterns.
HEADERS = (
    "visit date", "provider", "location", "subjective", "cc", "hpi", "ros", "constitutional", "e/n/t", "cardiovascular", "respiratory", "gastrointestinal", "genitourinary", "musculoskeletal", "integumentary",
    "allergic/immunologic", "psychiatric", "eyes", "lymphatic", "general", "nose", "neck", "skin", "neurologic", "past medical history / family history / social history", "past medical history",
    "current medical providers", "preventive health maintenance", "surgical history", "family history", "social history", "occupation", "marital status", "children", "hobbies/recreation", "exercise", "functional status",
    "tobacco/alcohol/supplements", "caffeine", "substance abuse history", "mental health history", "communicable diseases (eg stds)", "current problems", "immunizations", "allergies", "current medications", "objective", "vitals",
    "physical exam", "ht", "wt", "bmi", "bp", "p", "r", "sat", "lab/test results", "assessment", "plan", "medications", "patient recommendations", "charge capture", "primary diagnosis", "orders", "vaccine", "exams", "alcohol",
    "prescriptions", "gynecological history", "hospitalizations", "history", "hematologic/lymphatic", "endocrine",
)
PARENTS = {"ros": "ros", "physical exam": "pe", "objective": "pe"}
EXAM_LEAVES = ("general", "eyes", "nose", "neck", "lymphatic", "skin", "neurologic")
REVIEW_LEAVES = ("constitutional", "genitourinary", "integumentary", "allergic/immunologic")
SHARED_LEAVES = ("e/n/t", "cardiovascular", "respiratory", "gastrointestinal", "musculoskeletal", "psychiatric")
VITALS = ("vitals", "ht", "wt", "bmi", "bp", "p", "r", "sat")
BLANKET = ("past medical history / family history / social history",)
RULES = {
    "NEGATIVE_ROS": r"(?:^|(?<=\n))\s*(?:[a-z][a-z /\-]*?:\s*)?negative\s+for\s+[^.\n]*\.?",
    "LAST_REVIEWED": r"(?:^|(?<=\n))\s*last\s+reviewed[^\n]*",
    "DATE_TIME_LINE": r"(?:^|(?<=\n))\s*\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}[^\n]*",
    "BY_NAME_LINE": r"(?:^|(?<=\n))\s*(?:[ap]m\s+)?by\s+(?:(?:dr|mr|mrs|ms)\.?\s+[a-z][a-z\-']+|[a-z][a-z\-']+\s*,\s*[a-z][a-z\-' \.]{1,25}|[a-z][a-z\-']+\s+(?:md|do|np|pa|rn|m\.?d\.?|d\.?o\.?)\b)[^\n]{0,5}(?=\s*$|\s*\n)",
    "SEE_REFERENCE": r"\bsee\s+(?:hpi|history|ros|pe|p\.?e\.?|exam|physical(?:\s+exam(?:ination)?)?|note|notes|chart|assessment|plan|a\s*/\s*p|above|below|prior|previous|attached|attachment)\b[^.\n]*\.?",
}


def _alternatives(headers: tuple[str, ...]) -> str:
    """Longest first, inner spaces of any width."""
    return "|".join(r"\s+".join(map(re.escape, h.split())) for h in sorted(set(headers), key=len, reverse=True))


@dataclass(frozen=True)
class NoteTemplate:
    """Headers, hierarchy and boilerplate of a kind of notes."""

    headers: tuple[str, ...] = HEADERS
    parents: dict[str, str] = field(default_factory=lambda: dict(PARENTS))
    leaves: dict[str, str] = field(default_factory=lambda: {**dict.fromkeys(EXAM_LEAVES, "pe"), **dict.fromkeys(REVIEW_LEAVES, "ros")})
    shared: tuple[str, ...] = SHARED_LEAVES
    grouped: dict[str, str] = field(default_factory=lambda: dict.fromkeys(VITALS, "pe"))  # bare names that still tell the parent
    blanket: tuple[str, ...] = BLANKET
    rules: dict[str, str] = field(default_factory=lambda: dict(RULES))

    @cached_property
    def header(self) -> re.Pattern[str]:
        return re.compile(rf"(?<!\S)({_alternatives(self.headers)})\s*:", re.I)

    @cached_property
    def boilerplate(self) -> list[tuple[str, re.Pattern[str]]]:
        own = rf"(?:^|(?<=\n))\s*(?:{_alternatives(self.headers)})\s*:"
        return [(name, re.compile(p, re.I | re.S)) for name, p in [("HEADER_PREFIX", own), *self.rules.items()]]

    def parent_of(self, header: str) -> str | None:
        return self.parents.get(header) or self.leaves.get(header) or self.grouped.get(header)

    def headers_of(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, header in lower case) in order."""
        return [(*m.span(), m.group(1).strip().lower()) for m in self.header.finditer(text)]

    def sections_of(self, text: str) -> tuple[list[int], list[str]]:
        """Where each header of a note ends, and the section that begins there: one pass that carries the parent along."""
        ends, names = [], []
        parent: str | None = None
        for _, end, header in self.headers_of(text):
            above = self.leaves.get(header) or (parent if header in self.shared else None)
            ends.append(end)
            names.append(f"{above}/{header}" if above else header)
            parent = self.parent_of(header) or parent
        return ends, names

    def segments(self, region: str, note: str | None, pos: int) -> list[tuple[str | None, int, int, bool]]:
        """(section, start, end, is_leading) of the pieces of a region cut at the headers inside it.

        The section of a place is that of the last header of the note that ends at or before it.
        """
        if not region:
            return []
        ends, names = self.sections_of(note) if note else ([], [])
        at = lambda p: names[k - 1] if p > 0 and (k := bisect_right(ends, p)) else None
        inside = self.headers_of(region)
        cuts = [s for s, _, _ in inside]
        out = [(at(pos), 0, cuts[0] if cuts else len(region), True)] if not cuts or cuts[0] else []
        for (start, end, _), stop in zip(inside, [*cuts[1:], len(region)]):
            out.append((at(pos + end), start, stop, start == 0))
        return out

    def boilerplate_spans(self, text: str) -> list[tuple[int, int, str]]:
        return [(*m.span(), name) for name, p in self.boilerplate for m in p.finditer(text)]

    def classify(self, text: str) -> list[tuple[str, bool, str | None]]:
        """(piece, templated, rule) of each token.

        A token takes the first span it overlaps. Tokens without a letter or digit take after the token before
        them, at the start after the one behind; all are templated where none has any.
        """
        spans = sorted(self.boilerplate_spans(text), key=lambda x: x[:2])
        tokens: list[tuple[str, str | None, bool | None]] = []
        first = 0
        for m in _TOKEN.finditer(text):
            s, e = m.span()
            while first < len(spans) and spans[first][1] <= s:
                first += 1
            rule = next((r for a, b, r in spans[first:] if a < e and b > s), None) if first < len(spans) else None
            worth = any(map(str.isalnum, m.group()))
            tokens.append((m.group(), rule, rule is not None if worth or rule else None))
        if not any(any(map(str.isalnum, p)) for p, _, _ in tokens):
            return [(p, True, r) for p, r, _ in tokens]
        state = next(t for _, _, t in tokens if t is not None)
        out = []
        for piece, rule, templated in tokens:
            state = state if templated is None else templated
            out.append((piece, state, rule))
        return out


_TOKEN = re.compile(r"\w+|[^\w\s]|\s+")


def segment_regions(regions: DataFrame, template: NoteTemplate = NoteTemplate()) -> DataFrame:
    """(region, segment, section, seg_start, seg_end, is_leading): takes (region, text, note, pos), pos the region's place in its note."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for region, text, note, pos in zip(batch["region"], batch["text"], batch["note"], batch["pos"]):
                rows += [(region, i, *x) for i, x in enumerate(template.segments(text or "", note, 0 if pd.isna(pos) else int(pos)))]
            yield pd.DataFrame(rows, columns=["region", "segment", "section", "seg_start", "seg_end", "is_leading"])

    src = regions.select("region", "text", "note", "pos")
    return src.mapInPandas(run, f"region {dict(src.dtypes)['region']}, segment int, section string, seg_start int, seg_end int, is_leading boolean")


def classify_segments(segments: DataFrame, template: NoteTemplate = NoteTemplate()) -> DataFrame:
    """Takes (region, segment, section, text); adds n_tokens, n_templated, n_revealing, templated_text, revealing_text, rule_counts,
    rule_matched (the stretches each rule found) and blanket_section.

    In a blanket section all tokens are templated; the text that rules found comes first, then the rest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for region, segment, section, text in zip(batch["region"], batch["segment"], batch["section"], batch["text"]):
                text = text or ""
                tokens = template.classify(text)
                made, own = [p for p, t, _ in tokens if t], [p for p, t, _ in tokens if not t]
                counts = dict(Counter(r for _, t, r in tokens if r and t))
                blanket = section in template.blanket
                if blanket:
                    made, own = made + own, []
                matched: dict[str, list[str]] = {}
                for s, e, rule in sorted(template.boilerplate_spans(text)):
                    matched.setdefault(rule, []).append(text[s:e])
                rows.append((region, segment, section, len(tokens), len(made), len(own), "".join(made), "".join(own), counts, matched, blanket))
            yield pd.DataFrame(rows, columns=["region", "segment", "section", "n_tokens", "n_templated", "n_revealing", "templated_text", "revealing_text", "rule_counts", "rule_matched", "blanket_section"])

    src = segments.select("region", "segment", "section", "text")
    return src.mapInPandas(run, f"region {dict(src.dtypes)['region']}, segment int, section string, n_tokens int, n_templated int, n_revealing int, templated_text string, revealing_text string, rule_counts map<string,int>, rule_matched map<string,array<string>>, blanket_section boolean")


def collapse_section(c: Column) -> Column:
    """Null as (no_header), parts of the exam as pe, parts of the review as ros, also the two of them that often stand bare."""
    return F.when(c.isNull(), "(no_header)").when(c.startswith("pe/"), "pe").when(c.startswith("ros/") | c.isin("constitutional", "e/n/t"), "ros").otherwise(c)


def composition(classified: DataFrame, recurrence: DataFrame) -> DataFrame:
    """(section, revealing and templated tokens, each of regions of one key and of several): takes classified segments and (region, k_corpus).

    Regions that stand in no note of the corpus don't count.
    """
    one, several = F.col("k_corpus") == 1, F.col("k_corpus") > 1
    joined = classified.join(recurrence.where("k_corpus > 0").select("region", "k_corpus"), "region").withColumn("section", collapse_section(F.col("section")))
    return joined.groupBy("section").agg(
        F.sum(F.when(one, F.col("n_revealing")).otherwise(0)).alias("revealing_one"),
        F.sum(F.when(several, F.col("n_revealing")).otherwise(0)).alias("revealing_several"),
        F.sum(F.when(one, F.col("n_templated")).otherwise(0)).alias("templated_one"),
        F.sum(F.when(several, F.col("n_templated")).otherwise(0)).alias("templated_several"),
    )


def rule_summary(blanket: Column, rules: Column) -> Column:
    """BLANKET_SECTION, else the rules' names in order joined by a bar, else null."""
    names = F.array_join(F.array_sort(F.map_keys(rules)), "|")
    return F.when(blanket, "BLANKET_SECTION").when(F.size(rules) > 0, names)
