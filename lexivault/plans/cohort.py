"""Queries that extract a cohort from notes and patient dimensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.functions.text import age_at, is_missing, parse_date
from lexivault.operators import attribution, cohort
from lexivault.sources.tables import table

SINCE, SECTION, MAX_CHARS = "2019-01-01", "doctor note", 32000
# Values of the race dimension that are one bucket, and those that are left out.
ASIAN = ("asian_indian", "vietnamese", "filipino", "korean", "pakistani", "bangladeshi", "japanese", "cambodian", "chinese")
NO_RACE = ("unknown", "multi", "other")


def note_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cohort.eligible_notes(table(spark, sf, "notes"), SECTION, SINCE, MAX_CHARS).select("row_idx", "record_uid")


def latest_note(spark: SparkSession, sf: str) -> DataFrame:
    n = cohort.eligible_notes(table(spark, sf, "notes"), SECTION, SINCE, MAX_CHARS)
    keyed = n.select(F.lower("PatientUid").alias("key"), "Encounter_Date", "row_idx", F.length("Note").alias("n_chars")).where("key is not null")
    return attribution.latest(keyed, ["key"], ["Encounter_Date", "row_idx"]).select("key", "row_idx", "n_chars")


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    n = cohort.eligible_notes(table(spark, sf, "notes"), SECTION, SINCE, MAX_CHARS)
    return cohort.with_note_fields(cohort.latest_texts(n, F.lower("PatientUid")))


def latest_matching_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("key", "occupation", "marital_status", "children")


def extracted_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select("key", "extracted_name", "extracted_dob", F.length("note_start").alias("note_start_chars"), F.length("note_hpi").alias("note_hpi_chars"), "medications")


def _race(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "race_ethnicity")
    return r.select(F.lower("patientuid").alias("key"), cohort.recode(F.col("raceeth"), {"other_asian": ASIAN}, NO_RACE).alias("raceeth")).where("raceeth is not null")


def race_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _race(spark, sf).groupBy("raceeth").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_patients"))


FIELDS = ["key", "practiceid", "raceeth", "patient_gender", "extracted_name", "extracted_dob", "marital_status", "occupation", "children", "note_start", "note_hpi", "medications", "last_note"]


def cohort_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The whole extraction: fields of the latest notes, patient and race dimensions, completeness, patients with one row."""
    p = table(spark, sf, "patients").where("practiceid is not null").select(F.lower("patientuid").alias("key"), "practiceid", F.col("gender").alias("patient_gender"))
    rows = _extracted(spark, sf).join(p, "key").join(_race(spark, sf), "key").select(*FIELDS)
    return cohort.single_rows(cohort.complete(rows, FIELDS, ("medications",)).distinct(), "key")


def cohort_extract(spark: SparkSession, sf: str) -> DataFrame:
    return cohort_rows(spark, sf).select(*FIELDS[:9], F.length("note_start").alias("note_start_chars"), F.length("note_hpi").alias("note_hpi_chars"), "medications", F.length("last_note").alias("last_note_chars")).orderBy("key")


def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the patient dimension with several rows, null-aware."""
    return table(spark, sf, "patients").groupBy(F.lower("patientuid").alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def patients_without_notes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "patients").select(F.lower("patientuid").alias("key")).distinct()
    return p.join(table(spark, sf, "notes").select(F.lower("PatientUid").alias("key")), "key", "left_anti")


def in_train_mark(spark: SparkSession, sf: str) -> DataFrame:
    """Each patient with whether any of its generations was of the train split."""
    g = table(spark, sf, "generations").where("eval_split = 'train'").select(F.lower("patient_id").alias("key")).distinct().withColumn("in_train", F.lit(True))
    p = table(spark, sf, "patients").select(F.lower("patientuid").alias("key")).distinct()
    return p.join(g, "key", "left").select("key", F.coalesce("in_train", F.lit(False)).alias("in_train"))


def first_row_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Of each record the row delivered first, and how many rows it had."""
    n = table(spark, sf, "notes").groupBy("record_uid").agg(F.min("row_idx").alias("row_idx"), F.count("*").alias("n_rows"), F.countDistinct("row_idx").alias("n_row_idx"))
    return n


def patient_ages(spark: SparkSession, sf: str) -> DataFrame:
    """Age at a reference day from the extracted date of birth; null where it doesn't parse or lies outside (0, 130)."""
    return _extracted(spark, sf).select("key", parse_date(F.col("extracted_dob")).cast("string").alias("dob"), F.round(age_at(F.col("extracted_dob")), 6).alias("age"))


def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Which fields of each patient hold something: those of its notes, gender, race and the number of its notes."""
    fields = ["extracted_name", "extracted_dob", "marital_status", "occupation", "children", "note_start", "note_hpi", "medications", "patient_gender", "raceeth", "num_notes"]
    key = lambda c: F.lower(c).alias("key")
    gender = table(spark, sf, "patients").groupBy(key("patientuid")).agg(F.min("gender").alias("patient_gender"))
    race = table(spark, sf, "race_ethnicity").groupBy(key("patientuid")).agg(F.min("raceeth").alias("raceeth"))
    count = table(spark, sf, "notes").where("PatientUid is not null").groupBy(key("PatientUid")).agg(F.count("*").alias("num_notes"))
    all_ = _extracted(spark, sf).join(gender, "key", "left").join(race, "key", "left").join(count, "key", "left")
    return all_.select("key", *[(~is_missing(F.col(f))).alias(f"qc_{f}_ok") for f in fields])


_FILTER = """lower(trim(Section_Name, ' ')) = 'doctor note' and Encounter_Date >= timestamp '2019-01-01' and Note is not null and trim(Note, ' ') <> '' and length(Note) < 32000"""
_LATEST = rf"""
f as (select lower(PatientUid) as key, Encounter_Date, row_idx, Note from notes where {_FILTER} and PatientUid is not null),
ln as (select key, Note as last_note from (select *, row_number() over (partition by key order by Encounter_Date desc, row_idx desc) as rn from f) where rn = 1),
oc as (select key, trim(nullif(regexp_extract(Note, '(?i)occupation\s*:\s*([\s\S]+?)\s*(?:;|marital status\s*:)', 1), ''), ' ') as occupation from (select *, row_number() over (partition by key order by Encounter_Date desc, row_idx desc) as rn from f where regexp_matches(Note, '(?i)occupation\s*:')) where rn = 1),
ma as (select key, trim(nullif(regexp_extract(Note, '(?i)marital status\s*:\s*([\s\S]+?)\s*children\s*:', 1), ''), ' ') as marital_status from (select *, row_number() over (partition by key order by Encounter_Date desc, row_idx desc) as rn from f where regexp_matches(Note, '(?i)marital status\s*:')) where rn = 1),
ch as (select key, trim(nullif(regexp_extract(Note, '(?i)children\s*:\s*([^\n]+)', 1), ''), ' ') as children from (select *, row_number() over (partition by key order by Encounter_Date desc, row_idx desc) as rn from f where regexp_matches(Note, '(?i)children\s*:')) where rn = 1),
x as (select key, last_note, occupation, marital_status, children,
    trim(nullif(regexp_extract(last_note, '^\s*([A-Za-z][A-Za-z\s,\.\-]+?)\s+\d{{2}}/\d{{2}}/\d{{4}}', 1), ''), ' ') as extracted_name,
    nullif(regexp_extract(last_note, '\b(\d{{2}}/\d{{2}}/\d{{4}})\b', 1), '') as extracted_dob,
    nullif(regexp_extract(last_note, '(?i)^([\s\S]+?)\n \n hpi:', 1), '') as note_start,
    trim(nullif(regexp_extract(last_note, '(?i)\n \n hpi:\s*([\s\S]+?)(?:\n ros: \nconstitutional:|\n \n preventative screening tests:)', 1), ''), ' ') as note_hpi,
    array_to_string([trim(l, ' ') for l in string_split(trim(nullif(regexp_extract(last_note, '(?i)current\s+medications?\s*[:\-][^\n]*\n([\s\S]+?)(?:\n\s*\n|\z)', 1), ''), ' '), chr(10)) if trim(l, ' ') <> '' and not regexp_matches(l, '(?i)^last\s+reviewed\s+on')], '; ') as medications
    from ln left join oc using (key) left join ma using (key) left join ch using (key))"""
_RACE = """race as (select key, case when v in ('asian_indian', 'vietnamese', 'filipino', 'korean', 'pakistani', 'bangladeshi', 'japanese', 'cambodian', 'chinese') then 'other_asian' else v end as raceeth from (
    select lower(patientuid) as key, lower(regexp_replace(raceeth, '^\\s+|\\s+$', '', 'g')) as v from race_ethnicity where raceeth is not null) where v not in ('unknown', 'multi', 'other'))"""
_SQL = {
    "note_filter": f"select row_idx, record_uid from notes where {_FILTER}",
    "latest_note": f"select key, row_idx, n_chars from (select lower(PatientUid) as key, row_idx, length(Note)::int as n_chars, row_number() over (partition by lower(PatientUid) order by Encounter_Date desc, row_idx desc) as rn from notes where {_FILTER} and PatientUid is not null) where rn = 1",
    "latest_matching_fields": f"with {_LATEST} select key, occupation, marital_status, children from x",
    "extracted_fields": f"with {_LATEST} select key, extracted_name, extracted_dob, length(note_start)::int as note_start_chars, length(note_hpi)::int as note_hpi_chars, medications from x",
    "race_buckets": f"with {_RACE} select raceeth, count(*) as n, count(distinct key) as n_patients from race group by raceeth",
    "cohort_extract": f"""with {_LATEST}, {_RACE}, final as (
        select distinct key, practiceid, raceeth, gender as patient_gender, extracted_name, extracted_dob, marital_status, occupation, children, note_start, note_hpi, medications, last_note
        from x join (select lower(patientuid) as key, practiceid, gender from patients where practiceid is not null) using (key) join race using (key)
        where extracted_name is not null and extracted_dob is not null and marital_status is not null and occupation is not null and children is not null and gender is not null and note_start is not null and note_hpi is not null and medications is not null and medications <> '')
    select key, practiceid, raceeth, patient_gender, extracted_name, extracted_dob, marital_status, occupation, children, length(note_start)::int as note_start_chars, length(note_hpi)::int as note_hpi_chars, medications, length(last_note)::int as last_note_chars
    from final where key not in (select key from final group by key having count(*) > 1)""",
    "repeated_keys": "select lower(patientuid) as key, count(*) as n from patients group by 1 having count(*) > 1",
    "patients_without_notes": "select distinct lower(patientuid) as key from patients where patientuid is not null and lower(patientuid) not in (select lower(PatientUid) from notes where PatientUid is not null)",
    "in_train_mark": "select distinct lower(patientuid) as key, coalesce(lower(patientuid) in (select lower(patient_id) from generations where eval_split = 'train' and patient_id is not null), false) as in_train from patients",
    "first_row_per_key": "select record_uid, min(row_idx) as row_idx, count(*) as n_rows, count(distinct row_idx) as n_row_idx from notes group by 1",
    "patient_ages": f"""with {_LATEST}, d as (select key, coalesce({", ".join(f"try_strptime(extracted_dob, '{x}')" for x in ('%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', '%m-%d-%Y', '%d-%b-%Y'))})::date as dob from x)
        select key, strftime(dob, '%Y-%m-%d') as dob, case when a > 0 and a < 130 then round(a, 6) end as age from (select *, (date '2024-01-01' - dob) / 365.25 as a from d)""",
    "quality_flags": f"with {_LATEST}, xx as (select * from x left join (select lower(patientuid) as key, min(gender) as patient_gender from patients group by 1) using (key) left join (select lower(patientuid) as key, min(raceeth) as raceeth from race_ethnicity group by 1) using (key) left join (select lower(PatientUid) as key, count(*)::varchar as num_notes from notes where PatientUid is not null group by 1) using (key)) select key, "
    + ", ".join(
        f"coalesce(lower(regexp_replace({f}, '^\\s+|\\s+$', '', 'g')) not in ('', 'nan', 'none', 'null', 'n/a', 'na'), false) as qc_{f}_ok" for f in ("extracted_name", "extracted_dob", "marital_status", "occupation", "children", "note_start", "note_hpi", "medications", "patient_gender", "raceeth", "num_notes")
    )
    + " from xx",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
