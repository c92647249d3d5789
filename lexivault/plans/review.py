"""Queries of review, adjudication and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.functions.text import alnum_count, is_missing, iso_timestamp, strip, to_boolean, to_int
from lexivault.operators import judge, metrics, review, selection
from lexivault.plans.metrics import _CELLS, _J, judged, label
from lexivault.plans.selection import _G, _generations
from lexivault.sources.tables import table


def review_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts as a blind sheet against the generations they name: how many match, are labelled and valid."""
    sheet = table(spark, sf, "verdicts").dropDuplicates(["verdict_id"]).select("verdict_id", F.col("generation_id").alias("item_id"), F.col("verdict").alias("human_label"))
    key = _generations(spark, sf).where("error_type is null").select(F.col("record_uid").alias("item_id"))
    return review.sheet_status(sheet, key, "item_id", label(F.col("human_label"))).groupBy("status").agg(F.count("*").alias("n"))


def _against_key(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts joined with the generation and diagnosis they judge: truth from the verdict, prediction from the generation's label."""
    sheet = judged(spark, sf).select("verdict_id", "generation_id", "diagnosis", F.col("mention").alias("truth"), F.coalesce(F.array_join(F.array_sort(F.filter(F.split("evidence", r"\|"), lambda x: x != "")), "+"), F.lit("")).alias("rules"))
    key = _generations(spark, sf).select(F.col("record_uid").alias("generation_id"), F.col("eval_dx_assignment").alias("diagnosis"), "eval_dx_label", "prior_tier")
    return sheet.join(key, ["generation_id", "diagnosis"]).withColumn("predicted", F.when(F.col("eval_dx_label") == "positive", True).when(F.col("eval_dx_label") == "negative", False))


def joined_kappa(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of annotators with the generations' labels, per diagnosis, over rows of the same generation and diagnosis."""
    return metrics.kappa(_against_key(spark, sf), ["diagnosis"], "truth", "predicted").select("diagnosis", "n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


def accuracy_by_section_and_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Right shares of predictions in each part (here the prior), and under each rule (here the evidence)."""
    j = _against_key(spark, sf)
    one = lambda c, name: review.accuracy(j.withColumn("value", F.col(c)), ["value"]).select(F.lit(name).alias("by"), "value", "n", "n_unscored", *[F.round(x, 9).alias(x) for x in ("ppv", "npv", "accuracy", "error_rate")])
    return one("prior_tier", "section").unionByName(one("rules", "rule"))


def corrected_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells as judged, and with gold labels from the queue 'fp' and positives that the queue 'fn' calls negative made negative and unmentioned."""
    j = judged(spark, sf)
    latest = lambda q: j.where((F.col("queue") == q) & F.col("mention").isNotNull()).groupBy("generation_id").agg(F.max_by("mention", F.struct("timestamp", "verdict_id")).alias("fixed"))
    out = review.corrected(j, latest("fp"), latest("fn").where("not fixed"), "generation_id")
    return metrics.confusion(out, ["mode", "eval_split", "diagnosis"])


def adjudication_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts without a usable label in the order in which they are worked through: queue, diagnosis, split, prior."""
    return judged(spark, sf).where("mention is null").select("queue", "diagnosis", "eval_split", "prior", "verdict_id").orderBy("queue", "diagnosis", "eval_split", "prior", "verdict_id")


def cohort_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Usable verdicts of each patient of the cohort; patients without any are left out."""
    p = table(spark, sf, "patients").select(F.lower("patientuid").alias("key")).where("key is not null").distinct()
    v = table(spark, sf, "verdicts").dropDuplicates(["verdict_id"]).where(label(F.col("verdict")).isNotNull()).select(F.lower("PatientUid").alias("key"), "verdict_id")
    return p.join(v, "key").groupBy("key").agg(F.count("*").alias("n_verdicts"))


def entries_with_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Each verdict with the model and prior of its generation, 'unknown' where there is none."""
    v = table(spark, sf, "verdicts").dropDuplicates(["verdict_id"]).select("verdict_id", F.col("generation_id").alias("record_uid"))
    return review.with_default(v, _generations(spark, sf).where("error_type is null"), "record_uid", ["ckpt_tag", "prompt"], {"ckpt_tag": "unknown", "prior_tier": "unknown"})


def first_and_last(spark: SparkSession, sf: str) -> DataFrame:
    """Of notes delivered several times the row that came first and the one that came last."""
    n = table(spark, sf, "notes").select("record_uid", "row_idx", "Section_Name")
    first = review.first_per_key(n, "record_uid", ["row_idx"]).select("record_uid", F.col("row_idx").alias("first_row"), F.col("Section_Name").alias("first_section"))
    last = review.first_per_key(n, "record_uid", ["row_idx"], last=True).select("record_uid", F.col("row_idx").alias("last_row"))
    return first.join(last, "record_uid")


def readiness(spark: SparkSession, sf: str) -> DataFrame:
    """Four conditions on a record, all surely met, met unless known not to be, and those of a negative: absent, with medications.

    Present is the label, the two places are the truncated and cut marks, the fourth is a filled medication list.
    """
    present = to_boolean(F.when(F.col("eval_dx_label") == "positive", "yes").when(F.col("eval_dx_label") == "negative", "no"))
    filled = ~is_missing(F.col("medications_used"))
    true, false = F.lit(True), F.lit(False)
    ready = present.eqNullSafe(true) & F.col("truncated").eqNullSafe(false) & F.col("repetition_removed").eqNullSafe(false) & filled
    loose = F.coalesce(present, false) & ~F.coalesce("truncated", false) & ~F.coalesce("repetition_removed", false) & filled
    return _generations(spark, sf).select("record_uid", ready.alias("ready"), loose.alias("loosely_ready"), (present.eqNullSafe(false) & filled).alias("negative_ready"))


def annotation_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Patients present, ready, sampled and in the cohort, and those skipped, per diagnosis."""
    g = _generations(spark, sf).where("eval_dx_assignment is not null and patient_id is not null").select("record_uid", F.col("eval_dx_assignment").alias("diagnosis"), F.lower("patient_id").alias("key"), "eval_dx_label", "truncated")
    present = g.where("eval_dx_label = 'positive'")
    ready = present.where("truncated is not null and not truncated")
    sampled = selection.sample_per_stratum(ready.select("diagnosis", "key").distinct().withColumn("dk", F.concat_ws("|", "diagnosis", "key")), ["diagnosis"], "dk", 30, 42)
    cohort = table(spark, sf, "patients").select(F.lower("patientuid").alias("key"))
    return review.progress(present, ready, sampled, cohort, "diagnosis", "key")


def diagnoses_by_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """Diagnoses of the truth maps by how often they are present, then by name, with their rank."""
    each = _generations(spark, sf).select(F.explode("ground_truth").alias("diagnosis", "present")).groupBy("diagnosis").agg(F.avg(F.col("present").cast("double")).alias("p"))
    listed = each.orderBy(F.desc("p"), "diagnosis").agg(F.collect_list(F.struct(F.round(-F.col("p"), 9).alias("np"), "diagnosis")).alias("x"))  # a row per diagnosis
    return listed.select(F.posexplode(F.array_sort("x")).alias("i", "d")).select((F.col("i") + 1).alias("place"), "d.diagnosis", F.round(-F.col("d.np"), 6).alias("prevalence"))


def fixed_order(spark: SparkSession, sf: str) -> DataFrame:
    """Priors in a given order, those it doesn't name after it by name."""
    order = ("structured", "encounter_info", "encounter_info_cc", "full_hpi")
    place = F.coalesce(*[F.when(F.col("prior_tier") == p, F.lit(i)) for i, p in enumerate(order)], F.lit(len(order)))
    n = _generations(spark, sf).where("prior_tier is not null").groupBy("prior_tier").agg(F.count("*").alias("n"))
    return n.select(place.alias("place"), "prior_tier", "n").orderBy("place", "prior_tier")


def first_rows(spark: SparkSession, sf: str, n: int = 10) -> DataFrame:
    """The first n notes in their order: a smoke run's input."""
    return table(spark, sf, "notes").select("row_idx", "record_uid").orderBy("row_idx").limit(n)


def alnum_counts(spark: SparkSession, sf: str) -> DataFrame:
    """ASCII letters and digits of each note."""
    return table(spark, sf, "notes").where("Note is not null").select("row_idx", alnum_count(F.col("Note")).alias("n_alnum"))


def whole_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of record names as whole numbers where they are such, null otherwise."""
    part = F.explode(F.split("record_uid", r"[^0-9a-zA-Z.]+"))
    return table(spark, sf, "generations").where("record_uid is not null").select(part.alias("part")).distinct().select("part", to_int(F.col("part")).alias("number"))


def patient_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The patient of each row of three tables that name it in different ways."""
    out = None
    for name in ("notes", "generations", "patients"):
        t = table(spark, sf, name)
        one = t.select(F.lit(name).alias("source"), F.lower(review.first_present(t, ["patient_id", "PatientUid", "patientuid"])).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("key").alias("n_patients"), F.count_if(F.col("key").isNull()).alias("n_without"))


def operating_points(spark: SparkSession, sf: str) -> DataFrame:
    """True and false positive rate of each cell, the area under the two lines through them, and whether it agrees with the rate's own."""
    r = metrics.rates(metrics.confusion(judged(spark, sf), ["eval_split", "diagnosis"]))
    return metrics.operating_point(r).select("eval_split", "diagnosis", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "auroc_point")], "consistent")


def verdict_times(spark: SparkSession, sf: str) -> DataFrame:
    """When each verdict was given, as text."""
    return table(spark, sf, "verdicts").dropDuplicates(["verdict_id"]).select("verdict_id", iso_timestamp(F.col("timestamp")).alias("at"))


def evidence_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """What a positive verdict rests on: the kinds of evidence it names, 'other' where it names none, nothing for other verdicts."""
    v = table(spark, sf, "verdicts").dropDuplicates(["verdict_id"])
    held = lambda kind: F.filter(F.split(F.coalesce("evidence", F.lit("")), r"\|"), lambda x: x == kind)
    kinds = judge.evidence_types(label(F.col("verdict")), {"diagnosis": held("diagnosis"), "symptom": held("symptoms"), "medication": held("medications")})
    return v.select("verdict_id", F.array_join(kinds, "+").alias("kinds"), F.size(kinds).alias("n_kinds"))


def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The key under which a derived dataset is kept: 16 digits of the sha256 of what it was made from."""
    g = _generations(spark, sf).where("ckpt_tag is not null").select("model_path", "ckpt_tag").distinct()
    return g.select("model_path", "ckpt_tag", selection.cache_key("model_path", "ckpt_tag", F.lit(4096), F.lit("true")).alias("cache_key"))


_VERDICTS = r"""vd as (
    select verdict_id, any_value(generation_id) as generation_id, any_value(diagnosis) as diagnosis, any_value(verdict) as verdict, any_value(lower(PatientUid)) as key, any_value(evidence) as evidence from verdicts group by verdict_id
), vl as (
    select *, regexp_replace(lower(regexp_replace(verdict, '^\s+|\s+$', '', 'g')), '\.$', '') as y from vd
), vb as (
    select *, case when y in ('p', 'pos', 'positive') then true when y in ('n', 'neg', 'negative') then false end as truth from vl
)"""
_KEYED = (
    _VERDICTS
    + f""", {_G}, k as (
    select vb.*, array_to_string(list_sort(list_filter(string_split(coalesce(vb.evidence, ''), '|'), lambda x: x <> '')), '+') as rules, g.prior_tier, case g.eval_dx_label when 'positive' then true when 'negative' then false end as predicted
    from vb join g on g.record_uid = vb.generation_id and g.eval_dx_assignment = vb.diagnosis
)"""
)
_ACC = "count_if(truth is not null and predicted is not null) as n, count_if(truth is null or predicted is null) as n_unscored, round(avg(case when predicted then (truth = predicted)::int end), 9) as ppv, round(avg(case when not predicted then (truth = predicted)::int end), 9) as npv, round(avg((truth = predicted)::int), 9) as accuracy, round(1 - avg((truth = predicted)::int), 9) as error_rate"
_READY = "medications_used is not null and lower(regexp_replace(medications_used, '^\\s+|\\s+$', '', 'g')) not in ('', 'nan', 'none', 'null', 'n/a', 'na')"
_SQL = {
    "review_statuses": f"""with {_VERDICTS}, {_G} select case when generation_id is null or generation_id not in (select record_uid from g where error_type is null and record_uid is not null) then 'unmatched' when coalesce(trim(verdict), '') = '' then 'unlabelled' when truth is null then 'invalid' else 'scored' end as status, count(*) as n from vb group by 1""",
    "joined_kappa": f"""with {_KEYED}, cells as (select diagnosis, truth as a, predicted as b, count(*) as n from k where truth is not null and predicted is not null group by all),
        tot as (select diagnosis, sum(n) as n, sum(case when a = b then n else 0 end) as same from cells group by 1), l as (select diagnosis, a as x, sum(n) as s from cells group by all), m as (select diagnosis, b as x, sum(n) as s from cells group by all),
        ch as (select l.diagnosis, sum(l.s * m.s) as c from l join m on l.x = m.x and l.diagnosis = m.diagnosis group by 1)
        select diagnosis, n::bigint as n, round(same / n, 9) as agreement, case when coalesce(c, 0) / (n * n) < 1 then round((same / n - coalesce(c, 0) / (n * n)) / (1 - coalesce(c, 0) / (n * n)), 9) end as kappa from tot left join ch using (diagnosis)""",
    "accuracy_by_section_and_rule": f"with {_KEYED} select 'section' as by, prior_tier as value, {_ACC} from k group by prior_tier union all select 'rule', rules, {_ACC} from k group by rules",
    "corrected_cells": f"""with {_J}, fp as (select generation_id, arg_max(mention, (timestamp, verdict_id)) as fixed from j where queue = 'fp' and mention is not null group by 1),
        fn as (select generation_id from (select generation_id, arg_max(mention, (timestamp, verdict_id)) as fixed from j where queue = 'fn' and mention is not null group by 1) where not fixed),
        a as (select j.* replace (coalesce(fixed, truth) as truth), coalesce(generation_id in (select generation_id from fn where generation_id is not null), false) and coalesce(fixed, truth, false) as flip from j left join fp using (generation_id)),
        b as (select 'original' as mode, eval_split, diagnosis, truth, mention from j union all select 'adjudication', eval_split, diagnosis, case when flip then false else truth end, case when flip then false else mention end from a)
        select mode, eval_split, diagnosis, {_CELLS} from b group by all""",
    "adjudication_queue": f"with {_J} select queue, diagnosis, eval_split, prior, verdict_id from j where mention is null order by all",
    "cohort_verdicts": f"with {_VERDICTS} select key, count(*) as n_verdicts from vb where truth is not null and key in (select lower(patientuid) from patients where patientuid is not null) group by key",
    "entries_with_defaults": f"""with {_VERDICTS}, {_G}, one as (select record_uid, ckpt_tag, prior_tier from g where error_type is null and record_uid is not null)
        select verdict_id, generation_id as record_uid, coalesce(nullif(ckpt_tag, ''), 'unknown') as ckpt_tag, coalesce(nullif(prior_tier, ''), 'unknown') as prior_tier from vd left join one on one.record_uid = vd.generation_id""",
    "first_and_last": "select record_uid, min(row_idx) as first_row, arg_min_null(Section_Name, row_idx) as first_section, max(row_idx) as last_row from notes where record_uid is not null group by record_uid",
    "readiness": f"""with {_G} select record_uid, coalesce(eval_dx_label = 'positive' and not truncated and not repetition_removed, false) and {_READY} as ready, coalesce(eval_dx_label = 'positive', false) and not coalesce(truncated, false) and not coalesce(repetition_removed, false) and {_READY} as loosely_ready,
        coalesce(eval_dx_label = 'negative', false) and {_READY} as negative_ready from g""",
    "annotation_progress": f"""with {_G}, p as (select distinct eval_dx_assignment as diagnosis, lower(patient_id) as key from g where eval_dx_assignment is not null and patient_id is not null and eval_dx_label = 'positive'),
        r as (select distinct eval_dx_assignment as diagnosis, lower(patient_id) as key from g where eval_dx_assignment is not null and patient_id is not null and eval_dx_label = 'positive' and not truncated),
        s as (select diagnosis, key from (select *, row_number() over (partition by diagnosis order by md5('42|' || diagnosis || '|' || key), diagnosis || '|' || key) as n from r) where n <= 30),
        c as (select distinct lower(patientuid) as key from patients where patientuid is not null)
        select diagnosis, count(*) as present, coalesce(any_value(nr), 0) as ready, coalesce(any_value(ns), 0) as sampled, coalesce(any_value(ni), 0) as in_cohort, coalesce(any_value(ns), 0) - coalesce(any_value(ni), 0) as skipped from p
        left join (select diagnosis, count(*) as nr from r group by 1) using (diagnosis) left join (select diagnosis, count(*) as ns, count_if(key in (select key from c)) as ni from s group by 1) using (diagnosis) group by diagnosis""",
    "diagnoses_by_prevalence": f"with {_G}, e as (select u.key as diagnosis, avg(u.value::int) as p from (select unnest(map_entries(ground_truth)) as u from g) group by 1) select row_number() over (order by round(p, 9) desc, diagnosis)::int as place, diagnosis, round(round(p, 9), 6) as prevalence from e",
    "fixed_order": f"with {_G} select case prior_tier when 'structured' then 0 when 'encounter_info' then 1 when 'encounter_info_cc' then 2 when 'full_hpi' then 3 else 4 end as place, prior_tier, count(*) as n from g where prior_tier is not null group by all",
    "first_rows": "select row_idx, record_uid from notes order by row_idx limit 10",
    "alnum_counts": "select row_idx, len(regexp_extract_all(Note, '[A-Za-z0-9]'))::int as n_alnum from notes where Note is not null",
    "whole_numbers": r"select distinct part, case when regexp_full_match(part, '[+-]?\d+') then try_cast(part as int) end as number from (select unnest(regexp_split_to_array(record_uid, '[^0-9a-zA-Z.]+')) as part from generations where record_uid is not null)",
    "patient_keys": " union all ".join(f"select '{t}' as source, count(*) as n, count(distinct lower(nullif({c}, ''))) as n_patients, count_if(nullif({c}, '') is null) as n_without from {t}" for t, c in (("notes", "PatientUid"), ("generations", "patient_id"), ("patients", "patientuid"))),
    "operating_points": f"""with {_J}, t as (select eval_split, diagnosis, {_CELLS} from j group by all), r as (select *, case when tp + fn > 0 then tp / (tp + fn) end as tpr, case when fp + tn > 0 then fp / (fp + tn) end as fpr, case when tp + fn > 0 and fp + tn > 0 then (tp * tn + 0.5 * (tp * fp + fn * tn)) / ((tp + fn)::double * (fp + tn)) end as auroc from t)
        select eval_split, diagnosis, round(tpr, 9) as tpr, round(fpr, 9) as fpr, round((tpr + 1 - fpr) / 2, 9) as auroc_point, abs((tpr + 1 - fpr) / 2 - auroc) <= 0.005 as consistent from r""",
    "verdict_times": "select verdict_id, any_value(case when microsecond(timestamp) % 1000000 = 0 then strftime(timestamp, '%Y-%m-%dT%H:%M:%S') else strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') end) as at from verdicts group by verdict_id",
    "evidence_kinds": f"""with {_VERDICTS}, e as (select verdict_id, truth, list_filter(['diagnosis', 'symptoms', 'medications'], lambda k: list_contains(string_split(coalesce(evidence, ''), '|'), k)) as k from vb), f as (
        select verdict_id, case when truth is null or not truth then []::varchar[] when len(k) = 0 then ['other'] else list_transform(k, lambda x: rtrim(x, 's')) end as k from e)
        select verdict_id, array_to_string(list_transform(k, lambda x: case x when 'diagnosi' then 'diagnosis' else x end), '+') as kinds, len(k)::int as n_kinds from f""",
    "cache_keys": f"with {_G} select distinct model_path, ckpt_tag, substr(sha256(concat_ws(':', model_path, ckpt_tag, '4096', 'true')), 1, 16) as cache_key from g where ckpt_tag is not null",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
