"""Queries of sections, boilerplate and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.functions.text import blank_to_null
from lexivault.operators import annotation, intervals, prompts, sections
from lexivault.plans import cohort, leakage, packed
from lexivault.sources.tables import table


MAX_BROADCAST = 1_000_000  # ids of notes


def _segments(cut: DataFrame, notes: DataFrame) -> DataFrame:
    """Segments of the parts of regions with their text; of parts without a note all in no section."""
    wanted = cut.where("row_idx is not null").select("row_idx").distinct()
    # Only the texts of these notes are shuffled.
    wanted = F.broadcast(wanted) if cut.count() <= MAX_BROADCAST else wanted
    texts = notes.select("row_idx", F.col("text").alias("note")).join(wanted, "row_idx", "left_semi")
    won = cut.join(texts, "row_idx", "left")
    seg = sections.segment_regions(won.select(F.col("piece").alias("region"), "text", "note", F.col("position").alias("pos")))
    return seg.join(cut.select(F.col("piece").alias("region"), F.col("text").alias("whole")), "region").select("region", "segment", "section", "seg_start", "seg_end", "is_leading", F.substring("whole", F.col("seg_start") + 1, F.col("seg_end") - F.col("seg_start")).alias("text"))


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.pieces(spark, sf).where("eval_split = 'train'")


def _classified(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Classified segments of the parts of train records, and those parts as (region, k_corpus, k_within)."""
    cut = _train(spark, sf)
    made = sections.classify_segments(_segments(cut, leakage.corpus(spark, sf)))
    return made, cut.select(F.col("piece").alias("region"), "k_corpus", "k_within")


def section_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(_train(spark, sf), leakage.corpus(spark, sf))


def section_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Every classified segment: its tokens, templated and revealing text, and the rules behind it."""
    made, _ = _classified(spark, sf)
    counts = F.array_join(F.array_sort(F.transform(F.map_entries("rule_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), "|")
    return made.select("region", "segment", "section", "n_tokens", "n_templated", "n_revealing", "templated_text", "revealing_text", "blanket_section", counts.alias("rule_counts"), sections.rule_summary(F.col("blanket_section"), F.col("rule_counts")).alias("rules"))


def section_composition(spark: SparkSession, sf: str) -> DataFrame:
    return sections.composition(*_classified(spark, sf))


def top_sections(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    """The n sections with most memorized tokens."""
    c = section_composition(spark, sf)
    return c.select("section", (F.col("revealing_one") + F.col("revealing_several") + F.col("templated_one") + F.col("templated_several")).alias("n_tokens")).orderBy(F.desc("n_tokens"), "section").limit(n)


def rule_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each boilerplate rule in memorized segments of train records."""
    made, _ = _classified(spark, sf)
    return made.select(F.explode("rule_counts").alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("n_tokens")).orderBy(F.desc("n_tokens"), "rule").limit(30)


def segment_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Which rules made segments templated, the blanket sections apart: segments and tokens of each combination."""
    made, _ = _classified(spark, sf)
    return made.groupBy(sections.rule_summary(F.col("blanket_section"), F.col("rule_counts")).alias("rules")).agg(F.count("*").alias("n_segments"), F.sum("n_tokens").alias("n_tokens"))


def _revealing(spark: SparkSession, sf: str) -> DataFrame:
    """k_within of the parts that stand in notes of one patient only and of which some segment has a revealing token."""
    made, k = _classified(spark, sf)
    return k.where("k_corpus = 1 and k_within > 0").join(made.where("n_revealing > 0").select("region").distinct(), "region", "left_semi")


def recurrence_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Of the revealing parts of one patient only: how many, and the share in several of its notes."""
    return _revealing(spark, sf).agg(F.count("*").alias("n_parts"), (F.count_if(F.col("k_within") > 1) / F.count("*")).alias("share_several_notes"))


def recurrence_histogram(spark: SparkSession, sf: str, most: int = 10) -> DataFrame:
    """How many revealing parts of one patient only stand in 1, 2, ... of its notes, the last bin for most and more; empty bins too."""
    k = _revealing(spark, sf).groupBy(F.least("k_within", F.lit(most)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(1, most + 1).select(F.col("id").cast("int").alias("bin")).join(k, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def segment_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """From the parts of train records to the segments that the composition counts."""
    made, k = _classified(spark, sf)
    parts = k.agg(F.count("*").alias("n_parts"), F.count_if(F.col("k_corpus") == 0).alias("n_parts_not_in_corpus"), F.count_if(F.col("k_corpus") == 1).alias("n_parts_one_patient"), F.count_if(F.col("k_corpus") > 1).alias("n_parts_several_patients"))
    used = made.join(k.where("k_corpus > 0"), "region", "left_semi")
    counted = used.where("n_tokens > 0").agg(F.count("*").alias("n_segments_used"), F.count_if("blanket_section").alias("n_blanket_segments"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.coalesce(F.sum("n_templated"), F.lit(0)).alias("n_templated"))
    return parts.crossJoin(made.agg(F.count("*").alias("n_segments"))).crossJoin(counted)


# Java's and RE2's patterns: what stands before a line's beginning is taken along where the note template looks behind.
_LINE = r"(?:^|\n)"


def _portable(pattern: str) -> str:
    """A rule of the template without look-around, for counting."""
    return "(?is)" + pattern.replace(r"(?:^|(?<=\n))", _LINE).replace(r"(?=\s*$|\s*\n)", r"(?:\s*$|\s*\n)")


def boilerplate_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of every boilerplate rule of the template in all notes, counted in the JVM."""
    n = table(spark, sf, "notes").where("Note is not null")
    names = list(sections.RULES)
    one = n.agg(*[F.coalesce(F.sum(F.regexp_count("Note", F.lit(_portable(p)))), F.lit(0)).alias(name) for name, p in sections.RULES.items()])
    return one.unpivot([], names, "rule", "n_matches")


def header_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that hold each of the template's headers."""
    n = table(spark, sf, "notes").where("Note is not null")
    found = n.select("row_idx", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("Note", F.lit(_HEADER), F.lit(1)), lambda h: F.lower(F.regexp_replace(h, r"\s+", " "))))).alias("header"))
    return found.groupBy("header").agg(F.count("*").alias("n_notes"))


_HEADER = r"(?i)(?:^|\s)(" + sections._alternatives(sections.HEADERS) + r")\s*:"


def nearest_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Notes without a section with that of the patient's note before, else of the first one after."""
    n = table(spark, sf, "notes").where("PatientUid is not null").select("row_idx", F.lower("PatientUid").alias("key"), F.col("Section_Name").alias("section"))
    filled = intervals.fill_nearest(n, ["key"], "row_idx", "section")
    return filled.join(n.where("section is null").select("row_idx"), "row_idx", "left_semi").select("row_idx", "section")


def verified_removals(spark: SparkSession, sf: str) -> DataFrame:
    """Of each record's medications those whose name stands in its text in any case."""
    r = table(spark, sf, "generations").dropDuplicates(["record_uid"])
    names = F.transform(F.split("medications_used", r";\s*"), lambda x: F.regexp_extract(x, r"^(\w+)", 1))
    kept = annotation.verify_removals(names, F.col("generation"))
    return r.select("record_uid", F.size(kept).alias("n_kept"), F.array_join(kept, "|").alias("names"))


def encounter_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    c = cohort.cohort_rows(spark, sf)
    return c.select("key", *prompts.encounter_boundary("note_start"))


def prompt_records(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt of every prior and probe that can be derived, with the size of what it leaves of the note."""
    c = cohort.cohort_rows(spark, sf).select("key", "patient_gender", "extracted_name", "marital_status", "children", "occupation", "medications", "note_start", "note_hpi", "last_note")
    p = prompts.build_prompts(c)
    return p.select("key", "prior_tier", "probe_type", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"), "remaining_words")


def verified_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of each record that stand in its text, and whether any does."""
    r = table(spark, sf, "generations").dropDuplicates(["record_uid"])
    kept = annotation.verify_spans(F.transform("memorized_spans", lambda x: x["text"]), F.col("generation"))
    return r.select("record_uid", F.size(kept).alias("n_verified"), (F.size(kept) > 0).alias("present"), F.array_join(kept, "|").alias("spans"))


def scrubbed_medications(spark: SparkSession, sf: str) -> DataFrame:
    """Medication lists without entries that name a substance of the record's own text."""
    r = table(spark, sf, "generations").dropDuplicates(["record_uid"])
    first = F.regexp_extract("medications_used", r"^(\w+)", 1)
    out = annotation.scrub_list(F.col("medications_used"), F.filter(F.array(blank_to_null(first)), lambda x: x.isNotNull()))
    return r.select("record_uid", out.alias("medications"))


def truncated_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Notes as a judge reads them: at most 20,000 characters, and the last 200 words of each."""
    n = table(spark, sf, "notes").where("Note is not null")
    return n.select("row_idx", F.length(F.substring("Note", 1, 20000)).alias("kept_chars"), (F.length("Note") > 20000).alias("judge_truncated"), F.md5(annotation.last_words(F.col("Note"), 200)).alias("tail_md5"))


def reference_table(spark: SparkSession, sf: str) -> DataFrame:
    """The diagnosis table as text: each diagnosis with the values of its packed cells in all its definitions."""
    d = table(spark, sf, "sensitive_diagnosis").select("dx_id", F.trim("Diagnosis").alias("name")).where("dx_id is not null and name <> ''").dropDuplicates(["dx_id"])
    values = packed.p3_found(spark, sf).join(d, "dx_id")
    each = lambda field, c: F.array_sort(F.collect_set(F.when(F.col("field_name") == field, F.lower("item")))).alias(c)
    lists = values.groupBy("name").agg(each("ICD10 code", "codes"), each("Medications", "medications"), each("Symptoms", "symptoms"))
    return annotation.reference_text(d.select("name").distinct().join(lists, "name", "left"), "name", {"codes": "codes", "medications": "medications", "symptoms": "symptoms"})


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _values(pairs: dict[str, str]) -> str:
    return ", ".join(f"('{_quoted(k)}', '{_quoted(v)}')" for k, v in pairs.items())


def _placed(source: str, keep: str, pattern: str, shift: str) -> str:
    """keep, i, s, e, g: matches of a pattern in t with their offsets, from what stands between them; shift is what the match takes along before it."""
    return f"""select {keep}, i, e - length(m) + {shift} as s, e, g from (
        select {keep}, i, m[i] as m, g[i] as g, sum(length(gaps[i]) + length(m[i])) over (partition by {keep} order by i) as e from (
            select {keep}, m, g, gaps, unnest(range(1, len(m) + 1)) as i from (select {keep}, regexp_extract_all(t, '{_quoted(pattern)}') as m, regexp_extract_all(t, '{_quoted(pattern)}', 1) as g, regexp_split_to_array(t, '{_quoted(pattern)}') as gaps from {source})))"""


_TEMPLATE = sections.NoteTemplate()
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_OWN = r"(?is)((?:^|\n)\s*(?:" + sections._alternatives(sections.HEADERS) + r")\s*:)"
_SPANS = " union all ".join(
    f"select *, {order} as ord, '{name}' as rule from ({_placed('segments', 'piece, segment', pattern, shift)})"
    for order, (name, pattern, shift) in enumerate(
        [("HEADER_PREFIX", _OWN, "(case when e > length(m) then 1 else 0 end)")]
        + [
            (name, "(?is)(" + _portable(q)[5:].replace(r"(?:\s*$|\s*\n)", "") + ")" + (r"(?:\s*$|\s*\n)" if name == "BY_NAME_LINE" else ""), "0" if name == "SEE_REFERENCE" else "(case when e > length(m) then 1 else 0 end)")
            for name, q in sections.RULES.items()
        ]
    )
)
_CLASSIFIED = (
    leakage._PIECES
    + f""", tr as (
    select * from pieces where eval_split = 'train'
), parent(header, p) as (values {_values({**_TEMPLATE.grouped, **_TEMPLATE.leaves, **_TEMPLATE.parents})}
), leaf(header, p) as (values {_values(_TEMPLATE.leaves)}
), shared(header, p) as (values {_values(dict.fromkeys(_TEMPLATE.shared, ''))}
), won as (
    select row_idx, text as t from c where row_idx in (select row_idx from tr)
), nh0 as ({_placed("won", "row_idx", _HEADER, "0")}
), nh as (
    select row_idx, e as ends, case when l.p is not null then l.p || '/' || h when s.p is not null and above is not null then above || '/' || h else h end as name from (
        select row_idx, e, lower(g) as h, last_value(parent.p ignore nulls) over (partition by row_idx order by i rows between unbounded preceding and 1 preceding) as above from nh0 left join parent on parent.header = lower(g)
    ) left join leaf l on l.header = h left join shared s on s.header = h
), tt as (
    select piece, text as t from tr
), rh as ({_placed("tt", "piece", _HEADER, "(case when regexp_matches(m, '^' || '" + r"\s" + "') then 1 else 0 end)")}
), cuts as (
    select piece, s, coalesce(lead(s) over (partition by piece order by s), length(text)) as stop, e as reach from rh join tr using (piece)
    union all select piece, 0, coalesce((select min(s) from rh where rh.piece = tr.piece), length(text)), 0 from tr where text <> '' and coalesce((select min(s) from rh where rh.piece = tr.piece), 1) > 0
), seg0 as (
    select piece, row_number() over (partition by piece order by s)::int - 1 as segment, s as seg_start, stop as seg_end, s = 0 as is_leading, row_idx, coalesce(position, 0) + reach as at0, substr(text, s::bigint + 1, (stop - s)::bigint) as t from cuts join tr using (piece)
), segments as (
    select piece, segment, case when at0 > 0 then name end as section, seg_start, seg_end, is_leading, t from seg0 asof left join nh on nh.row_idx = seg0.row_idx and seg0.at0 >= nh.ends
), spans as (
    {_SPANS}
), tokens as (
    select piece, segment, k, tok, te - length(tok) as ts, te from (
        select piece, segment, k, tok, sum(length(tok)) over (partition by piece, segment order by k) as te from (
            select piece, segment, w[k] as tok, k from (select piece, segment, w, unnest(range(1, len(w) + 1)) as k from (select piece, segment, regexp_extract_all(t, '(?s)[\\p{{L}}\\p{{N}}_]+|{_SPACE}|.') as w from segments))))
), hit as (
    select t.piece, t.segment, t.k, any_value(t.tok) as tok, arg_min(x.rule, (x.s, x.last, x.ord)) as rule
    from tokens t left join (select piece, segment, s, case when rule = 'BY_NAME_LINE' then s + length(g) - (case when g like chr(10) || '%' and s > 0 then 1 else 0 end) else e end as last, ord, rule from spans) x
        on x.piece = t.piece and x.segment = t.segment and x.s < t.te and x.last > t.ts
    group by t.piece, t.segment, t.k
), known as (
    select *, regexp_matches(tok, '[\\p{{L}}\\p{{N}}]') as worth, case when rule is not null then true when regexp_matches(tok, '[\\p{{L}}\\p{{N}}]') then false end as st from hit
), stated as (
    select *, not bool_or(worth) over (partition by piece, segment) or coalesce(last_value(st ignore nulls) over (partition by piece, segment order by k rows between unbounded preceding and current row), first_value(st ignore nulls) over (partition by piece, segment order by k rows between current row and unbounded following)) as templated from known
), classified as (
    select piece, segment, any_value(section) as section, any_value(section) in ({", ".join(f"'{b}'" for b in _TEMPLATE.blanket)}) as blanket, count(k) as n_tokens, count_if(templated) as n_made from segments left join stated using (piece, segment) group by piece, segment
), counted as (
    select *, case when blanket then n_tokens else n_made end as n_templated, case when blanket then 0 else n_tokens - n_made end as n_revealing,
        case when section is null then '(no_header)' when section like 'pe/%' then 'pe' when section like 'ros/%' or section in ('constitutional', 'e/n/t') then 'ros' else section end as collapsed from classified
), revealing as (
    select k_within from tr where k_corpus = 1 and k_within > 0 and piece in (select piece from counted where n_revealing > 0)
)"""
)
_COMPOSITION = "select collapsed as section, sum(case when k_corpus = 1 then n_revealing else 0 end)::bigint as revealing_one, sum(case when k_corpus > 1 then n_revealing else 0 end)::bigint as revealing_several, sum(case when k_corpus = 1 then n_templated else 0 end)::bigint as templated_one, sum(case when k_corpus > 1 then n_templated else 0 end)::bigint as templated_several from counted join tr using (piece) where k_corpus > 0 group by collapsed"

_COHORT = cohort._SQL["cohort_extract"].rsplit("select key, practiceid", 1)[0].strip() + " , co as (select * from final where key not in (select key from final group by key having count(*) > 1))"
_SQL = {
    "boilerplate_notes": " union all ".join(
        f"select '{name}' as rule, coalesce(sum(len(regexp_extract_all(Note, '{_portable(p).replace(chr(39), chr(39) * 2)}'))), 0)::bigint as n_matches from notes where Note is not null" for name, p in sections.RULES.items()
    ),
    "header_notes": f"""select header, count(*) as n_notes from (select distinct row_idx, lower(regexp_replace(unnest(regexp_extract_all(Note, '{_HEADER}', 1)), '\\s+', ' ', 'g')) as header from notes where Note is not null) group by header""",
    "nearest_sections": """select row_idx, coalesce(before, after) as section from (
        select row_idx, Section_Name as s, last_value(Section_Name ignore nulls) over (partition by lower(PatientUid) order by row_idx rows between unbounded preceding and current row) as before,
            first_value(Section_Name ignore nulls) over (partition by lower(PatientUid) order by row_idx rows between current row and unbounded following) as after from notes where PatientUid is not null) where s is null""",
    "verified_removals": """with g as (select *, row_number() over (partition by record_uid) as one from generations), k as (
        select record_uid, case when generation is null or medications_used is null then []::varchar[] else list_filter(list_transform(regexp_split_to_array(medications_used, ';\\s*'), lambda x: regexp_extract(x, '^(\\w+)', 1)), lambda s: s <> '' and contains(lower(generation), lower(s))) end as k from g where one = 1)
        select record_uid, len(k)::int as n_kept, array_to_string(k, '|') as names from k""",
    "encounter_prefixes": f"{_COHORT} select key, prefix, marker from (select key, regexp_replace(substr(note_start, 1, (length(regexp_extract(note_start, '(?is)^(.*?)(?:electronically|subjective)', 1)))::bigint), '\\s+$', '') as prefix, nullif(regexp_extract(note_start, '(?i)[ \\t\\n]*(?:electronically|subjective):?'), '') as marker from co) where marker is not null",
    "verified_spans": """with g as (select *, row_number() over (partition by record_uid) as one from generations), k as (select record_uid, list_filter([x.text for x in memorized_spans], lambda s: s is not null and s <> '' and contains(generation, s)) as k from g where one = 1)
        select record_uid, coalesce(len(k), 0)::int as n_verified, coalesce(len(k), 0) > 0 as present, coalesce(array_to_string(k, '|'), '') as spans from k""",
    "scrubbed_medications": """with g as (select *, row_number() over (partition by record_uid) as one from generations), f as (select record_uid, medications_used as m, nullif(regexp_extract(medications_used, '^(\\w+)', 1), '') as d from g where one = 1)
        select record_uid, case when m is null or d is null then m else array_to_string(list_filter([trim(x) for x in string_split(m, ';')], lambda x: x <> '' and not contains(lower(x), lower(d))), '; ') end as medications from f""",
    "truncated_texts": "select row_idx, least(length(Note), 20000)::int as kept_chars, length(Note) > 20000 as judge_truncated, md5(array_to_string(list_slice(w, greatest(len(w) - 199, 1), len(w)), ' ')) as tail_md5 from (select row_idx, Note, regexp_extract_all(Note, '\\S+') as w from notes where Note is not null)",
    "reference_table": f"""with d as (select dx_id, trim(any_value(Diagnosis), ' ') as name from sensitive_diagnosis where dx_id is not null group by dx_id), v as (select name, field_name, lower(item) as item from ({packed.P3_SQL}) join d using (dx_id) where name <> ''),
        l as (select name, {", ".join(f"coalesce(string_agg(distinct item, '; ' order by item) filter (field_name = '{f}'), '') as {c}" for f, c in (("ICD10 code", "codes"), ("Medications", "medications"), ("Symptoms", "symptoms")))} from v group by name)
        select string_agg('- ' || name || chr(10) || '  codes: ' || coalesce(codes, '') || chr(10) || '  medications: ' || coalesce(medications, '') || chr(10) || '  symptoms: ' || coalesce(symptoms, ''), chr(10) order by name) as text from (select distinct name from d where name <> '') left join l using (name)""",
}
_SQL |= {
    "section_segments": f"with recursive {_CLASSIFIED} select piece as region, segment, section, seg_start::int as seg_start, seg_end::int as seg_end, is_leading, t as text from segments",
    "section_composition": f"with recursive {_CLASSIFIED} {_COMPOSITION}",
    "top_sections": f"with recursive {_CLASSIFIED} select section, revealing_one + revealing_several + templated_one + templated_several as n_tokens from ({_COMPOSITION}) order by n_tokens desc, section limit 10",
    "rule_totals": f"with recursive {_CLASSIFIED} select rule, count(*) as n_tokens from stated where templated and rule is not null group by rule order by n_tokens desc, rule limit 30",
    "segment_rules": f"""with recursive {_CLASSIFIED}, named as (select piece, segment, string_agg(distinct rule, '|' order by rule) as rules from stated where templated and rule is not null group by 1, 2)
        select case when coalesce(blanket, false) then 'BLANKET_SECTION' else rules end as rules, count(*) as n_segments, sum(n_tokens)::bigint as n_tokens from counted left join named using (piece, segment) group by 1""",
    "segment_funnel": f"""with recursive {_CLASSIFIED} select count(*) as n_parts, count_if(k_corpus = 0) as n_parts_not_in_corpus, count_if(k_corpus = 1) as n_parts_one_patient, count_if(k_corpus > 1) as n_parts_several_patients, (select count(*) from counted) as n_segments,
        (select count(*) from counted join tr using (piece) where k_corpus > 0 and n_tokens > 0) as n_segments_used, (select count(*) from counted join tr using (piece) where k_corpus > 0 and n_tokens > 0 and blanket) as n_blanket_segments,
        (select coalesce(sum(n_tokens), 0)::bigint from counted join tr using (piece) where k_corpus > 0) as n_tokens, (select coalesce(sum(n_templated), 0)::bigint from counted join tr using (piece) where k_corpus > 0) as n_templated from tr""",
    "recurrence_summary": f"with recursive {_CLASSIFIED} select count(*) as n_parts, count_if(k_within > 1) / count(*) as share_several_notes from revealing",
    "recurrence_histogram": f"with recursive {_CLASSIFIED} select b::int as bin, coalesce(n, 0) as n from (select unnest(range(1, 11)) as b) left join (select least(k_within, 10) as b, count(*) as n from revealing group by 1) using (b)",
}


def _after(note: str, part: str) -> str:
    """What follows the first occurrence of a part, or of the part without trailing space."""
    one = lambda p: f"case when {p} <> '' and contains({note}, {p}) then substr({note}, instr({note}, {p}) + length({p})) end"
    return f"coalesce({one(part)}, {one(_rtrim(part))})"


def _rtrim(text: str) -> str:
    return f"regexp_replace({text}, '\\s+$', '')"


_LINES = ", ".join(f"case when {c} is not null and {c}::varchar <> '' then '{n}: ' || {c} end" for n, c in (("gender", "patient_gender"), ("marital status", "marital_status"), ("number of children", "children"), ("occupation", "occupation")))
_SQL["prompt_records"] = f"""{_COHORT}, a as (
    select *, nullif(concat_ws(chr(10), {_LINES}), '') as base, nullif(regexp_extract({_after("last_note", "note_start")}, '{prompts.HPI_MARK}'), '') as start_mark, nullif(regexp_extract({_after("last_note", "note_hpi")}, '{prompts.AFTER_HPI_MARK}'), '') as hpi_mark,
        case when regexp_matches(note_start, '{prompts.ENCOUNTER}') then nullif({_rtrim("regexp_extract(note_start, '(?is)^(.*?)(?:electronically|subjective)', 1)")}, '') end as prefix, nullif(regexp_extract(note_start, '{prompts.ENCOUNTER_MARK}'), '') as marker from co
), b as (
    select *, case when extracted_name <> '' then 'name: ' || extracted_name || chr(10) || base end as named from a
), o as (
    select key, last_note, 'public' as prior_tier, 'patient_note' as probe_type, base as p, chr(10) || 'patient note:' as m from b
    union all select key, last_note, 'public_named', 'patient_note', named, chr(10) || 'patient note:' from b
    union all select key, last_note, 'public_named_meds', 'patient_note', case when medications <> '' then named || chr(10) || 'medications: ' || medications end, chr(10) || 'patient note:' from b
    union all select key, last_note, 'encounter_info', 'note_continuation', prefix, marker from b
    union all select key, last_note, 'encounter_info_cc', 'note_continuation', note_start, start_mark from b
    union all select key, last_note, 'encounter_info_cc_hpi', 'note_continuation', note_start || start_mark || note_hpi, hpi_mark from b
), rest as (
    select *, {_after("last_note", "p")} as rest from o where p is not null and m is not null
)
select key, prior_tier, probe_type, md5(p || m) as prompt_md5, length(p || m)::int as prompt_chars,
    case when probe_type = 'patient_note' then {prompts.DEFAULT_WORDS} else coalesce(greatest(len(regexp_extract_all(case when m <> '' and contains(substr(rest, 1, {prompts.HORIZON}), m) then substr(rest, instr(rest, m) + length(m)) else rest end, '\\S+')), 1), {prompts.DEFAULT_WORDS}) end::int as remaining_words from rest"""
_SQL["section_tokens"] = f"""with recursive {_CLASSIFIED}, named as (
    select piece, segment, string_agg(rule || '=' || n, '|' order by rule || '=' || n) as rule_counts, string_agg(rule, '|' order by rule) as rules from (select piece, segment, rule, count(*) as n from stated where templated and rule is not null group by all) group by 1, 2
), texts as (
    select piece, segment, coalesce(string_agg(tok, '' order by k) filter (templated), '') as made, coalesce(string_agg(tok, '' order by k) filter (not templated), '') as own from stated group by 1, 2
)
select piece as region, segment, section, n_tokens::int as n_tokens, n_templated::int as n_templated, n_revealing::int as n_revealing, case when blanket then made || own else made end as templated_text, case when blanket then '' else own end as revealing_text,
    coalesce(blanket, false) as blanket_section, coalesce(rule_counts, '') as rule_counts, case when blanket then 'BLANKET_SECTION' else rules end as rules from counted left join texts using (piece, segment) left join named using (piece, segment)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
