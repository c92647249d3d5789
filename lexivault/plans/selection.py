"""Queries of sampling, budgets, sets and predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.functions.text import first_filled, is_missing, strip, to_boolean
from lexivault.operators import selection
from lexivault.sources.tables import table


def _patients(spark: SparkSession, sf: str) -> DataFrame:
    """(key, n_tokens, n_notes) of each patient with notes."""
    n = table(spark, sf, "notes").where("PatientUid is not null and Note is not null")
    return n.groupBy(F.lower("PatientUid").alias("key")).agg(F.sum(F.size(F.regexp_extract_all("Note", F.lit(r"\S+"), F.lit(0)))).alias("n_tokens"), F.count("*").alias("n_notes"))


def _generations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "generations").dropDuplicates(["record_uid"])


def sample_by_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return selection.sample_per_stratum(_generations(spark, sf), ["eval_dx_assignment"], "record_uid", 10, 42).select("record_uid", "eval_dx_assignment")


def reservoir_sample(spark: SparkSession, sf: str) -> DataFrame:
    return selection.sample(_generations(spark, sf).where("_record_type is null"), "record_uid", 50, 42).select("record_uid")


def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Patients in random order until 60,000 words are reached."""
    return selection.fill_budget(_patients(spark, sf), "key", "n_tokens", 60_000, 42).select("key", "n_tokens", "tokens_before")


def budget_with_seed(spark: SparkSession, sf: str) -> DataFrame:
    """The budget after the patients of the train split, which are in already."""
    p = _patients(spark, sf)
    seed = _generations(spark, sf).where("eval_split = 'train'").select(F.lower("patient_id").alias("key")).distinct()
    already = p.join(seed, "key", "left_semi").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return selection.fill_budget(p.join(seed, "key", "left_anti"), "key", "n_tokens", already + 40_000, 43, already).select("key", "n_tokens")


def capped_arms(spark: SparkSession, sf: str) -> DataFrame:
    """At most 100 patients of the train split and 200 others, marked."""
    t = _generations(spark, sf).where("eval_split = 'train'").select(F.lower("patient_id").alias("key")).where("key is not null").distinct()
    p = _patients(spark, sf)
    one = selection.sample(p.join(t, "key", "left_semi"), "key", 100, 42).select("key", F.lit(1).alias("treated"))
    return one.unionByName(selection.sample(p.join(t, "key", "left_anti"), "key", 200, 42).select("key", F.lit(0).alias("treated")))


def first_per_section(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "notes").where("Section_Name is not null").select("row_idx", F.lower(strip("Section_Name")).alias("section"))
    return selection.first_per_class(n, "section", ["row_idx"], 20)


def four_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Patients by split and label, each in the first of four overlapping groups that holds it."""
    g = _generations(spark, sf).select(F.lower("patient_id").alias("key"), "eval_split", "eval_dx_label")
    part = lambda s, y: g.where((F.col("eval_split") == s) & (F.col("eval_dx_label") == y)).select("key").distinct()
    return selection.by_priority([("pos_train", part("train", "positive")), ("pos_nontrain", part("non_train", "positive")), ("neg_train", part("train", "negative")), ("neg_nontrain", part("non_train", "negative"))], "key")


def topped_up_group(spark: SparkSession, sf: str) -> DataFrame:
    """Patients of the first group, filled to 300 from all patients."""
    return selection.top_up(four_groups(spark, sf).where("`group` = 'pos_train'").select("key"), _patients(spark, sf), "key", 300, 42)


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of union, difference and intersection of the patients of notes and of generations."""
    a = table(spark, sf, "notes").select(F.lower("PatientUid").alias("key")).where("key is not null").distinct()
    b = _generations(spark, sf).select(F.lower("patient_id").alias("key")).where("key is not null").distinct()
    parts = [("union", a.union(b).distinct()), ("notes_only", a.subtract(b)), ("generations_only", b.subtract(a)), ("both", a.intersect(b))]
    out = None
    for name, df in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("set"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def incremental_rest(spark: SparkSession, sf: str) -> DataFrame:
    """Generations that no verdict names yet."""
    return selection.not_done(_generations(spark, sf).select("record_uid"), table(spark, sf, "verdicts").select(F.col("generation_id").alias("record_uid")), ["record_uid"])


def content_keys(spark: SparkSession, sf: str) -> DataFrame:
    return selection.content_key(_generations(spark, sf), ["eval_split"], "record_uid")


def eligible_records(spark: SparkSession, sf: str) -> DataFrame:
    g = _generations(spark, sf)
    return g.where("_record_type is null and error_type is null and generation <> ''").select("record_uid", F.coalesce(F.when(F.col("eval_split") != "", F.col("eval_split")), F.lit("unknown")).alias("eval_split"))


def first_non_empty(spark: SparkSession, sf: str) -> DataFrame:
    """The first filled of several fields, the order depending on the label."""
    pos = F.col("eval_dx_label") == "positive"
    return _generations(spark, sf).select("record_uid", F.when(pos, first_filled(F.col("medications_used"), F.col("generation"))).otherwise(first_filled(F.col("error"), F.col("medications_used"))).alias("value"), is_missing(F.col("medications_used")).alias("no_medications"))


def valid_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations of prior and probe that occur, and whether they are allowed."""
    kind = F.when(F.col("prior_tier").startswith("structured"), "structured").otherwise("unstructured")
    bad = ((kind == "structured") & (F.col("probe_type") == "note_continuation")) | ((kind == "unstructured") & (F.col("probe_type") == "patient_note"))
    return _generations(spark, sf).where("prior_tier is not null and probe_type is not null").groupBy("prior_tier", "probe_type").agg(F.count("*").alias("n"), (~F.max(bad)).alias("valid"))


def ready_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Patients that are surely positive and surely not truncated (null never matches), and the lenient reading (null counts as false)."""
    present = to_boolean(F.when(F.col("eval_dx_label") == "positive", "yes").when(F.col("eval_dx_label") == "negative", "no"))
    strict = present.eqNullSafe(F.lit(True)) & F.col("truncated").eqNullSafe(F.lit(False))
    lenient = F.coalesce(present, F.lit(False)) & ~F.coalesce("truncated", F.lit(False))
    return _generations(spark, sf).select("record_uid", strict.alias("strict"), lenient.alias("lenient"))


def boolean_values(spark: SparkSession, sf: str) -> DataFrame:
    """Truth values of the ground-truth map, unpivoted, per diagnosis."""
    g = _generations(spark, sf).select("record_uid", F.explode("ground_truth").alias("diagnosis", "present"))
    return g.groupBy("diagnosis").agg(F.count("*").alias("n"), F.count_if("present").alias("n_present"), F.count_if(F.col("present").isNull()).alias("n_null"))


def evidence_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence as a set in a fixed order, as an array, and whether it is exactly symptoms."""
    v = table(spark, sf, "verdicts").dropDuplicates(["verdict_id"])
    kinds = F.filter(F.split(F.coalesce("evidence", F.lit("")), r"\|"), lambda x: x != "")
    has = lambda k: F.array_contains("kinds", k)
    cls = F.concat_ws("+", F.when(has("diagnosis") | has("icd10"), "exp"), F.when(has("medications"), "med"), F.when(has("symptoms"), "sym"))
    return v.select("verdict_id", F.array_sort(kinds).alias("kinds")).select("verdict_id", F.coalesce(F.when(cls != "", cls), F.lit("none")).alias("evidence_class"), F.size("kinds").alias("n_kinds"), (F.col("kinds") == F.array(F.lit("symptoms"))).alias("symptoms_only"))


def routed_queues(spark: SparkSession, sf: str) -> DataFrame:
    """Review queues a verdict enters; one may enter several."""
    v = table(spark, sf, "verdicts").dropDuplicates(["verdict_id"])
    pos = F.lower(strip("verdict")).rlike("^p")
    ev = F.coalesce("evidence", F.lit(""))
    queues = F.filter(F.array(F.when(ev == "symptoms", "sym_only"), F.when(ev.contains("symptoms") & pos, "sym_pos"), F.when((ev != "") & F.lower(strip("verdict")).rlike("^n"), "neg_evid")), lambda x: x.isNotNull())
    return v.select("verdict_id", F.explode(queues).alias("review_queue"))


def collapsed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts in four classes, not_mentioned by default."""
    v = F.regexp_replace(F.lower(strip("verdict")), r"\.$", "")
    c = F.when(v.isin("p", "pos", "positive"), "positive").when(v.isin("n", "neg", "negative"), "negative").when(v.isin("u", "unsure"), "ambiguous").otherwise("not_mentioned")
    return table(spark, sf, "verdicts").dropDuplicates(["verdict_id"]).groupBy(c.alias("label")).agg(F.count("*").alias("n"))


def sections_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Section names in one spelling, null as a bucket of its own, most frequent first."""
    s = F.coalesce(F.lower(strip("Section_Name")), F.lit("(no_header)"))
    return table(spark, sf, "notes").groupBy(s.alias("section")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(30)


_G = "g as (select * from (select *, row_number() over (partition by record_uid) as one from generations) where one = 1)"
_P = "p as (select lower(PatientUid) as key, sum(len(regexp_extract_all(Note, '\\S+')))::bigint as n_tokens, count(*) as n_notes from notes where PatientUid is not null and Note is not null group by 1)"
_V = "v as (select *, regexp_replace(lower(regexp_replace(verdict, '^\\s+|\\s+$', '', 'g')), '\\.$', '') as y, coalesce(evidence, '') as ev from (select *, row_number() over (partition by verdict_id) as one from verdicts) where one = 1)"
_SEED = "seed as (select distinct lower(patient_id) as key from g where eval_split = 'train' and patient_id is not null)"


def _budget(seed: int) -> str:
    return f"select *, coalesce(sum(n_tokens) over (order by md5('{seed}|' || key) rows between unbounded preceding and 1 preceding), 0)::bigint as tokens_before from p"


_FOUR = """four as (select key, ['pos_train', 'pos_nontrain', 'neg_train', 'neg_nontrain'][min(i)] as "group" from (
    select lower(patient_id) as key, case when eval_split = 'train' and eval_dx_label = 'positive' then 1 when eval_split = 'non_train' and eval_dx_label = 'positive' then 2 when eval_split = 'train' and eval_dx_label = 'negative' then 3 when eval_split = 'non_train' and eval_dx_label = 'negative' then 4 end as i from g where patient_id is not null
    ) where i is not null group by key)"""
_SQL = {
    "sample_by_diagnosis": f"with {_G} select record_uid, eval_dx_assignment from (select *, row_number() over (partition by eval_dx_assignment order by md5('42|' || record_uid)) as r from g) where r <= 10",
    "reservoir_sample": f"with {_G} select record_uid from g where _record_type is null order by md5('42|' || record_uid) limit 50",
    "token_budget": f"with {_P} select key, n_tokens, tokens_before from ({_budget(42)}) where tokens_before < 60000",
    "budget_with_seed": f"with {_G}, p0 as (select * from (with {_P} select * from p)), {_SEED}, p as (select * from p0 where key not in (select key from seed)) select key, n_tokens from ({_budget(43)}) where tokens_before < 40000",
    "capped_arms": f"with {_G}, {_P}, {_SEED} select key, 1 as treated from (select key from p where key in (select key from seed) order by md5('42|' || key) limit 100) union all select key, 0 from (select key from p where key not in (select key from seed) order by md5('42|' || key) limit 200)",
    "first_per_section": "select row_idx, section, 'item_' || lpad((row_number() over (order by r, section))::varchar, 4, '0') as item_id from (select *, row_number() over (partition by section order by row_idx) as r from (select row_idx, lower(regexp_replace(Section_Name, '^\\s+|\\s+$', '', 'g')) as section from notes where Section_Name is not null)) where r <= 20",
    "four_groups": f'with {_G}, {_FOUR} select key, "group" from four',
    "topped_up_group": f"""with {_G}, {_P}, {_FOUR}, c as (select key from four where "group" = 'pos_train') select key from c union all (select key from p where key not in (select key from c) order by md5('42|' || key) limit (select greatest(0, 300 - count(*)) from c))""",
    "set_operations": f"""with {_G}, a as (select distinct lower(PatientUid) as key from notes where PatientUid is not null), b as (select distinct lower(patient_id) as key from g where patient_id is not null)
        select 'union' as "set", count(*) as n from (select key from a union select key from b) union all select 'notes_only', count(*) from (select key from a except select key from b) union all select 'generations_only', count(*) from (select key from b except select key from a) union all select 'both', count(*) from (select key from a intersect select key from b)""",
    "incremental_rest": f"with {_G} select record_uid from g where record_uid not in (select generation_id from verdicts where generation_id is not null)",
    "content_keys": f"with {_G}, h as (select distinct eval_split, sha1(record_uid) as h from g where record_uid is not null), s as (select eval_split, substr(h, 1, 3) as k, sha1(string_agg(h, chr(10) order by h)) as d from h group by 1, 2) select eval_split, substr(sha1(string_agg(k || d, chr(10) order by k || d)), 1, 16) as content_key from s group by eval_split",
    "eligible_records": f"with {_G} select record_uid, coalesce(nullif(eval_split, ''), 'unknown') as eval_split from g where _record_type is null and error_type is null and generation <> ''",
    "first_non_empty": f"with {_G} select record_uid, case when eval_dx_label = 'positive' then coalesce(nullif(medications_used, ''), nullif(generation, '')) else coalesce(nullif(error, ''), nullif(medications_used, '')) end as value, medications_used is null or lower(regexp_replace(medications_used, '^\\s+|\\s+$', '', 'g')) in ('', 'nan', 'none', 'null', 'n/a', 'na') as no_medications from g",
    "valid_combinations": f"""with {_G} select prior_tier, probe_type, count(*) as n, not max((prior_tier like 'structured%' and probe_type = 'note_continuation') or (prior_tier not like 'structured%' and probe_type = 'patient_note')) as valid from g where prior_tier is not null and probe_type is not null group by 1, 2""",
    "ready_strict": f"with {_G} select record_uid, coalesce(eval_dx_label = 'positive' and truncated = false, false) as strict, coalesce(eval_dx_label = 'positive', false) and not coalesce(truncated, false) as lenient from g",
    "boolean_values": f"with {_G} select e.key as diagnosis, count(*) as n, count_if(e.value) as n_present, count_if(e.value is null) as n_null from (select unnest(map_entries(ground_truth)) as e from g) group by 1",
    "evidence_classes": f"""with {_V}, k as (select verdict_id, list_sort(list_filter(string_split(ev, '|'), lambda x: x <> '')) as kinds from v)
        select verdict_id, coalesce(nullif(array_to_string(list_filter([case when list_contains(kinds, 'diagnosis') or list_contains(kinds, 'icd10') then 'exp' end, case when list_contains(kinds, 'medications') then 'med' end, case when list_contains(kinds, 'symptoms') then 'sym' end], lambda x: x is not null), '+'), ''), 'none') as evidence_class, len(kinds)::int as n_kinds, kinds = ['symptoms'] as symptoms_only from k""",
    "routed_queues": f"with {_V} select verdict_id, 'sym_only' as review_queue from v where ev = 'symptoms' union all select verdict_id, 'sym_pos' from v where contains(ev, 'symptoms') and y like 'p%' union all select verdict_id, 'neg_evid' from v where ev <> '' and y like 'n%'",
    "collapsed_labels": f"with {_V} select case when y in ('p', 'pos', 'positive') then 'positive' when y in ('n', 'neg', 'negative') then 'negative' when y in ('u', 'unsure') then 'ambiguous' else 'not_mentioned' end as label, count(*) as n from v group by 1",
    "sections_collapsed": "select coalesce(lower(regexp_replace(Section_Name, '^\\s+|\\s+$', '', 'g')), '(no_header)') as section, count(*) as n from notes group by 1 order by n desc, section limit 30",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
