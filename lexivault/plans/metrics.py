"""Queries of metrics on annotators' verdicts of generations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.functions.text import strip, title_case
from lexivault.operators import metrics, review
from lexivault.plans import cohort
from lexivault.sources.tables import table


def label(c: Column) -> Column:
    """True for a positive verdict, false for a negative one, in any spelling; null otherwise."""
    v = F.regexp_replace(F.lower(strip(c)), r"\.$", "")
    return F.when(v.isin("p", "pos", "positive"), True).when(v.isin("n", "neg", "negative"), False)


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Each verdict once: truth from gold_label, mention from the verdict, both true, false or null."""
    v = table(spark, sf, "verdicts").dropDuplicates(["verdict_id"])
    return v.select("verdict_id", "generation_id", "timestamp", F.lower(strip("annotator")).alias("annotator"), "queue", "diagnosis", "prior", "eval_split", "evidence", label(F.col("gold_label")).alias("truth"), label(F.col("verdict")).alias("mention"))


KEYS = ["eval_split", "prior", "diagnosis"]


def confusion_cells(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(judged(spark, sf), KEYS)


def cell_rates(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rates(confusion_cells(spark, sf)).select(*KEYS, "n_positive", "n_negative", *[F.round(c, 9).alias(c) for c in ("ppv", "mention_rate", "prevalence", "tpr", "fpr", "auroc", "auroc_lo", "auroc_hi")])


def pooled_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of each cell and of all diagnoses together, whose tallies are summed first."""
    all_ = metrics.pooled(confusion_cells(spark, sf), KEYS, "diagnosis")
    return metrics.rates(all_).select(*KEYS, "n_records", F.round("ppv", 9).alias("ppv"), F.round("auroc", 9).alias("auroc"))


def adjudicated_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells in two modes: as judged, and with the label of the last verdict of the queue 'fp' in place of the truth."""
    j = judged(spark, sf)
    fixed = j.where("queue = 'fp' and mention is not null").groupBy("generation_id").agg(F.max_by("mention", F.struct("timestamp", "verdict_id")).alias("fixed"))
    both = j.join(fixed, "generation_id", "left").withColumn("mode", F.explode(F.array(F.lit("original"), F.lit("adjudication"))))
    truth = F.when(F.col("mode") == "adjudication", F.coalesce("fixed", "truth")).otherwise(F.col("truth"))
    return metrics.confusion(both.withColumn("truth", truth), ["mode", "eval_split", "diagnosis"])


def exact_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The share of right positives of each cell with its exact interval."""
    cells = confusion_cells(spark, sf).select(*KEYS, "tp", (F.col("tp") + F.col("fp")).alias("n"))
    return metrics.with_exact_interval(cells, "tp", "n", "ppv").select(*KEYS, "tp", "n", F.round("ppv_lo", 6).alias("ppv_lo"), F.round("ppv_hi", 6).alias("ppv_hi"))


def split_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Train minus non-train of each rate, for priors and diagnoses that both splits have."""
    r = metrics.rates(metrics.confusion(judged(spark, sf), KEYS))
    side = lambda s, p: r.where(F.col("eval_split") == s).select("prior", "diagnosis", F.col("auroc").alias(f"{p}a"), F.col("ppv").alias(f"{p}p"))
    both = side("train", "t").join(side("non_train", "n"), ["prior", "diagnosis"])
    return both.select("prior", "diagnosis", F.round(F.col("ta") - F.col("na"), 9).alias("delta_auroc"), F.round(F.col("tp") - F.col("np"), 9).alias("delta_ppv"))


def mean_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return split_deltas(spark, sf).groupBy("prior").agg(F.round(F.avg("delta_auroc"), 6).alias("delta_auroc"), F.round(F.avg("delta_ppv"), 6).alias("delta_ppv"))


def rates_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """One row per prior, columns of each diagnosis: records of the train split, mentions and the share of right mentions."""
    v = judged(spark, sf).where("diagnosis is not null")
    train = F.col("eval_split") == "train"
    said = train & F.col("mention")
    right = F.count_if(said & F.col("truth")) / F.nullif(F.count_if(said & F.col("truth").isNotNull()), F.lit(0))
    out = metrics.metric_pivot(v, "prior", "diagnosis", {"n": F.count_if(train), "mentioned": F.count_if(said), "ppv": F.round(right, 9)})
    return out.na.fill(0, [c for c in out.columns if c.endswith(("_n", "_mentioned"))])


def rates_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of the pivot read back as (prior, diagnosis, n), without zeros."""
    p = rates_pivot(spark, sf)
    names = [c for c in p.columns if c.endswith("_n")]
    long = p.select("prior", *[F.col(f"`{c}`").alias(c[:-2]) for c in names])
    return long.unpivot("prior", [c[:-2] for c in names], "diagnosis", "n").where("n > 0")


def kappa_overall(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.kappa(judged(spark, sf), [], "truth", "mention").select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


def kappa_by_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.kappa(judged(spark, sf), ["diagnosis"], "truth", "mention").select("diagnosis", "n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


def completeness_gate(spark: SparkSession, sf: str, allow: bool = True) -> DataFrame:
    """Records and those without a usable verdict, per prior and split; unless ``allow``, an error where any is missing."""
    counts = judged(spark, sf).groupBy("prior", "eval_split").agg(F.count("*").alias("n"), F.count_if(F.col("mention").isNull()).alias("n_missing"))
    return review.require_complete(counts, "n_missing", allow)


def queue_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return judged(spark, sf).groupBy("queue").agg(F.count("*").alias("n"), F.count_if(F.col("mention").isNull()).alias("n_remaining"))


def review_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Right share among positive and negative verdicts, accuracy and error rate, per annotator; unknown ones apart."""
    j = judged(spark, sf)
    known = F.col("truth").isNotNull() & F.col("mention").isNotNull()
    right = F.col("truth") == F.col("mention")
    return j.groupBy("annotator").agg(
        F.count_if(known).alias("n"),
        F.count_if(~known).alias("n_unscored"),
        F.round(F.avg(F.when(known & F.col("mention"), right.cast("double"))), 9).alias("ppv"),
        F.round(F.avg(F.when(known & ~F.col("mention"), right.cast("double"))), 9).alias("npv"),
        F.round(F.avg(F.when(known, right.cast("double"))), 9).alias("accuracy"),
        F.round(1 - F.avg(F.when(known, right.cast("double"))), 9).alias("error_rate"),
    )


def _covariates(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "notes").where("PatientUid is not null").groupBy(F.lower("PatientUid").alias("key")).agg(F.count("*").alias("num_notes"), F.avg(F.length("Note")).alias("chars"))
    sex = F.lower(strip("gender"))
    p = table(spark, sf, "patients").where("patientuid is not null").groupBy(F.lower("patientuid").alias("key")).agg(F.max(F.when(sex.isin("m", "male"), 0).when(sex.isin("f", "female"), 1)).alias("sex"))
    train = table(spark, sf, "generations").where("eval_split = 'train'").select(F.lower("patient_id").alias("key")).distinct().withColumn("t", F.lit(True))
    return p.join(n, "key", "left").join(train, "key", "left").select("key", "sex", "num_notes", "chars", F.coalesce("t", F.lit(False)).alias("in_train"))


def group_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Of train and other patients: how many, age and notes with those missing, the share of women, and of all those in train."""
    ages = cohort.patient_ages(spark, sf).select("key", "age")
    v = _covariates(spark, sf).join(ages, "key", "left")
    out = metrics.group_stats(v, ["in_train"], ["age", "num_notes", "chars"]).join(v.groupBy("in_train").agg((100 * F.avg("sex")).alias("pct_female"), F.count_if(F.col("sex").isNull()).alias("sex_missing")), "in_train")
    all_ = v.agg(F.count("*").alias("all_n"))
    return out.crossJoin(all_).select("in_train", "n", F.round(100 * F.col("n") / F.col("all_n"), 1).alias("pct_of_all"), F.round("pct_female", 1).alias("pct_female"), "sex_missing", *[F.round(f"{m}_{s}", 3).alias(f"{m}_{s}") for m in ("age", "num_notes", "chars") for s in ("mean", "median", "std")], *[f"{m}_missing" for m in ("age", "num_notes", "chars")])


def balance(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised mean differences of train and other patients."""
    return metrics.mean_difference(_covariates(spark, sf), "in_train", ["sex", "num_notes", "chars"]).select("measure", F.round("smd", 3).alias("smd"))


def group_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "generations").dropDuplicates(["record_uid"])
    return g.groupBy("eval_split", "eval_dx_label").agg(F.count("*").alias("n")).withColumn("split_name", title_case(F.col("eval_split")))


def token_length_stats(spark: SparkSession, sf: str, most: int = 400) -> DataFrame:
    """Mean (whole), greatest and truncated lengths in words of notes cut at ``most`` words."""
    n = table(spark, sf, "notes").where("Note is not null").select(F.size(F.regexp_extract_all("Note", F.lit(r"\S+"), F.lit(0))).alias("n"))
    return n.agg(F.count("*").alias("n_notes"), F.floor(F.sum(F.least("n", F.lit(most))) / F.count("*")).alias("mean_length"), F.max("n").alias("longest"), F.count_if(F.col("n") > most).alias("n_truncated"))


_LABEL = "case when v in ('p', 'pos', 'positive') then true when v in ('n', 'neg', 'negative') then false end"
_J = rf"""j as (
    select verdict_id, any_value(generation_id) as generation_id, any_value(timestamp) as timestamp, any_value(annotator) as annotator, any_value(queue) as queue, any_value(diagnosis) as diagnosis, any_value(prior) as prior, any_value(eval_split) as eval_split,
        any_value({_LABEL.replace('v in', 'g in')}) as truth, any_value({_LABEL}) as mention
    from (select verdict_id, generation_id, timestamp, lower(regexp_replace(annotator, '^\s+|\s+$', '', 'g')) as annotator, queue, diagnosis, prior, eval_split,
        regexp_replace(lower(regexp_replace(gold_label, '^\s+|\s+$', '', 'g')), '\.$', '') as g, regexp_replace(lower(regexp_replace(verdict, '^\s+|\s+$', '', 'g')), '\.$', '') as v from verdicts)
    group by verdict_id
)"""
_CELLS = "count(*) as n_records, count_if(mention) as n_mentioned, count(mention) as n_mention_known, count_if(truth and mention) as tp, count_if(not truth and mention) as fp, count_if(truth and not mention) as fn, count_if(not truth and not mention) as tn"
_RATES = f"""
t as (select eval_split, prior, diagnosis, {_CELLS} from j group by all), r0 as (
    select *, (tp + fn)::double as pos, (fp + tn)::double as neg, case when tp + fn > 0 and fp + tn > 0 then (tp * tn + 0.5 * (tp * fp + fn * tn)) / ((tp + fn)::double * (fp + tn)) end as auroc from SOURCE
), r as (
    select *, case when tp + fp > 0 then tp / (tp + fp) end as ppv, case when n_mention_known > 0 then n_mentioned / n_mention_known end as mention_rate, case when pos + neg > 0 then pos / (pos + neg) end as prevalence, case when pos > 0 then tp / pos end as tpr, case when neg > 0 then fp / neg end as fpr,
        1.959963984540054 * sqrt(greatest(0, (auroc * (1 - auroc) + (pos - 1) * (auroc / (2 - auroc) - auroc * auroc) + (neg - 1) * (2 * auroc * auroc / (1 + auroc) - auroc * auroc)) / (pos * neg))) as er from r0
)"""
_RT = _RATES.replace("SOURCE", "t")
_COVARIATES = r"""v as (
    select key, sex, num_notes, chars, coalesce(key in (select lower(patient_id) from generations where eval_split = 'train' and patient_id is not null), false) as in_train
    from (select lower(patientuid) as key, max(case when s in ('m', 'male') then 0 when s in ('f', 'female') then 1 end) as sex from (select patientuid, lower(regexp_replace(gender, '^\s+|\s+$', '', 'g')) as s from patients where patientuid is not null) group by 1)
    left join (select lower(PatientUid) as key, count(*) as num_notes, avg(length(Note)) as chars from notes where PatientUid is not null group by 1) using (key)
)"""
_DX = ["ember_fever", "glass_bone_condition", "hollow_mood_disorder", "marrow_shade_disease", "nocturnal_dread_syndrome", "velar_tremor_disorder"]
_KAPPA = """cells as (select {k} truth as a, mention as b, count(*) as n from j where truth is not null and mention is not null group by all),
tot as (select {k} sum(n) as n, sum(case when a = b then n else 0 end) as same from cells {g}), l as (select {k} a as x, sum(n) as s from cells group by all), m as (select {k} b as x, sum(n) as s from cells group by all),
ch as (select {lk} sum(l.s * m.s) as c from l join m on l.x = m.x {on} {lg})
select {k} tot.n::bigint as n, round(same / tot.n, 9) as agreement, case when c / (tot.n * tot.n) < 1 then round((same / tot.n - c / (tot.n * tot.n)) / (1 - c / (tot.n * tot.n)), 9) end as kappa from tot {j}"""
_SQL = {
    "confusion_cells": f"with {_J} select eval_split, prior, diagnosis, {_CELLS} from j group by all",
    "cell_rates": f"with {_J}, {_RT} select eval_split, prior, diagnosis, (tp + fn)::bigint as n_positive, (fp + tn)::bigint as n_negative, round(ppv, 9) as ppv, round(mention_rate, 9) as mention_rate, round(prevalence, 9) as prevalence, round(tpr, 9) as tpr, round(fpr, 9) as fpr, round(auroc, 9) as auroc, case when auroc is not null then round(greatest(auroc - er, 0), 9) end as auroc_lo, case when auroc is not null then round(least(auroc + er, 1), 9) end as auroc_hi from r",
    "pooled_rates": f"with {_J}, {_RATES.replace('SOURCE', 'u')} select eval_split, prior, diagnosis, n_records::bigint as n_records, round(ppv, 9) as ppv, round(auroc, 9) as auroc from r".replace(
        "), r0 as", "), u as (select * from t union all select eval_split, prior, 'Average', sum(n_records), sum(n_mentioned), sum(n_mention_known), sum(tp), sum(fp), sum(fn), sum(tn) from t group by eval_split, prior), r0 as"
    ),
    "adjudicated_cells": f"""with {_J}, fx as (select generation_id, arg_max(mention, (timestamp, verdict_id)) as fixed from j where queue = 'fp' and mention is not null group by 1),
        b as (select mode, eval_split, diagnosis, mention, case when mode = 'adjudication' then coalesce(fixed, truth) else truth end as truth from j left join fx using (generation_id) cross join (select unnest(['original', 'adjudication']) as mode))
        select mode, eval_split, diagnosis, {_CELLS} from b group by all""",
    "split_deltas": f"with {_J}, {_RT} select prior, diagnosis, round(a.auroc - b.auroc, 9) as delta_auroc, round(a.ppv - b.ppv, 9) as delta_ppv from (select * from r where eval_split = 'train') a join (select * from r where eval_split = 'non_train') b using (prior, diagnosis)",
    "mean_deltas": f"with {_J}, {_RT} select prior, round(avg(round(a.auroc - b.auroc, 9)), 6) as delta_auroc, round(avg(round(a.ppv - b.ppv, 9)), 6) as delta_ppv from (select * from r where eval_split = 'train') a join (select * from r where eval_split = 'non_train') b using (prior, diagnosis) group by prior",
    "rates_pivot": f"with {_J}, tr as (select *, coalesce(eval_split = 'train', false) as t from j where diagnosis is not null) select prior, "
    + ", ".join(
        f"count_if(t and diagnosis = '{d}') as {d}_n, count_if(t and mention and diagnosis = '{d}') as {d}_mentioned, round(count_if(t and mention and truth and diagnosis = '{d}') / nullif(count_if(t and mention and truth is not null and diagnosis = '{d}'), 0), 9) as {d}_ppv"
        for d in _DX
    )
    + " from tr group by prior",
    "rates_unpivot": f"with {_J} select prior, diagnosis, count(*) as n from j where eval_split = 'train' and diagnosis is not null group by all",
    "kappa_overall": f"with {_J}, " + _KAPPA.format(k="", g="", lk="", on="", lg="", j="cross join ch"),
    "kappa_by_diagnosis": f"with {_J}, " + _KAPPA.format(k="diagnosis,", g="group by diagnosis", lk="l.diagnosis,", on="and l.diagnosis = m.diagnosis", lg="group by l.diagnosis", j="join ch using (diagnosis)"),
    "completeness_gate": f"with {_J} select prior, eval_split, count(*) as n, count_if(mention is null) as n_missing from j group by all",
    "queue_sizes": f"with {_J} select queue, count(*) as n, count_if(mention is null) as n_remaining from j group by all",
    "review_scores": f"""with {_J} select annotator, count_if(truth is not null and mention is not null) as n, count_if(truth is null or mention is null) as n_unscored, round(avg(case when truth is not null and mention then (truth = mention)::int end), 9) as ppv,
        round(avg(case when truth is not null and not mention then (truth = mention)::int end), 9) as npv, round(avg((truth = mention)::int), 9) as accuracy, round(1 - avg((truth = mention)::int), 9) as error_rate from j group by annotator""",
    "group_statistics": f"with {_COVARIATES}, ages as ({cohort._SQL['patient_ages']}), w as (select v.*, age from v left join ages using (key)) select in_train, count(*) as n, round(100 * count(*) / (select count(*) from w), 1) as pct_of_all, round(100 * avg(sex), 1) as pct_female, count_if(sex is null) as sex_missing, "
    + ", ".join(f"round(avg({m}), 3) as {m}_mean, round(quantile_cont({m}, 0.5), 3) as {m}_median, round(stddev_samp({m}), 3) as {m}_std, count_if({m} is null) as {m}_missing" for m in ("age", "num_notes", "chars"))
    + " from w group by in_train",
    "balance": f"with {_COVARIATES} "
    + " union all ".join(
        f"select '{m}' as measure, case when count({m}) filter (in_train) < 2 or count({m}) filter (not in_train) < 2 then null when s = 0 then 0.0 else round((avg({m}) filter (in_train) - avg({m}) filter (not in_train)) / s, 3) end as smd from v, (select sqrt((var_samp({m}) filter (in_train) + var_samp({m}) filter (not in_train)) / 2) as s from v) group by s"
        for m in ("sex", "num_notes", "chars")
    ),
    "group_counts": "select eval_split, eval_dx_label, count(*) as n, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace(eval_split, '_', ' '), ' ')], ' ') as split_name from (select record_uid, any_value(eval_split) as eval_split, any_value(eval_dx_label) as eval_dx_label from generations group by 1) group by eval_split, eval_dx_label",
    "token_length_stats": "select count(*) as n_notes, floor(sum(least(n, 400)) / count(*))::bigint as mean_length, max(n)::int as longest, count_if(n > 400) as n_truncated from (select len(regexp_extract_all(Note, '\\S+')) as n from notes where Note is not null)",
}
_TERM = "exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2))"
_SQL["exact_intervals"] = f"""with recursive {_J}, cells as (
    select eval_split, prior, diagnosis, count_if(truth and mention)::bigint as tp, (count_if(truth and mention) + count_if(not truth and mention))::bigint as n from j group by all
), b as (
    select distinct tp::bigint as k, n::bigint as n, 0.0::double as lo, 1.0::double as hi, 0 as i, side from cells cross join (select unnest(['lo', 'hi']) as side) where n > 0
    union all
    select k, n, case when low then lo else (lo + hi) / 2 end, case when low then (lo + hi) / 2 else hi end, i + 1, side from (
        select *, case side when 'lo' then list_sum(list_transform(range(k, n + 1), lambda j: {_TERM})) > 0.025 else list_sum(list_transform(range(0, k + 1), lambda j: {_TERM})) < 0.025 end as low from b where i < 50)
), e as (
    select k, n, max(case when side = 'lo' then (lo + hi) / 2 end) as lo, max(case when side = 'hi' then (lo + hi) / 2 end) as hi from b where i = 50 group by k, n
)
select eval_split, prior, diagnosis, tp, c.n, case when tp = 0 and c.n > 0 then 0.0 else round(lo, 6) end as ppv_lo, case when tp = c.n and c.n > 0 then 1.0 else round(hi, 6) end as ppv_hi from cells c left join e on e.k = tp and e.n = c.n"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
