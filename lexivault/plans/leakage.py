"""Queries on what generated text has in common with its patient's notes and with the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.functions.text import strip
from lexivault.functions.tokens import token_spans
from lexivault.operators import attribution, grams, intervals
from lexivault.runtime import spread, stage
from lexivault.sources.tables import table

TAU = 30


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible generations, each record once: no record type, no error, text not blank."""
    g = table(spark, sf, "generations")
    ok = F.col("_record_type").isNull() & F.col("error_type").isNull() & (strip("generation") != "")
    return g.where(ok).dropDuplicates(["record_uid"]).select(
        F.col("record_uid").alias("id"),
        F.lower("patient_id").alias("key"),
        F.col("generation").alias("text"),
        F.transform("memorized_spans", lambda x: x["text"]).alias("spans"),
        "prior_tier",
        "probe_type",
        "eval_dx_assignment",
        F.coalesce(F.when(F.col("eval_split") != "", F.col("eval_split")), F.lit("unknown")).alias("eval_split"),
    )


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that have a patient and text, with their stable row number."""
    n = table(spark, sf, "notes")
    return n.where(F.col("PatientUid").isNotNull() & F.col("Note").rlike(r"(?U)\S")).select("row_idx", F.lower("PatientUid").alias("key"), F.date_format("Encounter_Date", "yyyy-MM-dd").alias("note_date"), F.col("Note").alias("text"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Memorized regions: merged occurrences of a record's spans in its text; written once, as queries use them several times."""
    r = records(spark, sf)
    merged = intervals.merge_intervals(attribution.span_hits(r), ["id"])
    cut = merged.join(r.select("id", "key", "text", "eval_split", "prior_tier"), "id")
    named = cut.select(
        F.concat_ws(":", "id", "s", "e").alias("region"), "id", "key", F.col("s").cast("long").alias("gen_start"), F.col("e").cast("long").alias("gen_end"), F.substring("text", F.col("s") + 1, F.col("e") - F.col("s")).alias("text"), "eval_split", "prior_tier"
    )
    return stage(named, "regions")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return records(spark, sf).select("id", "key", "text"), corpus(spark, sf).select("key", "text")


def verbatim_flag_tau30(spark: SparkSession, sf: str) -> DataFrame:
    return grams.gram_flag(*_sides(spark, sf), TAU)


def verbatim_coverage_tau30(spark: SparkSession, sf: str) -> DataFrame:
    return grams.gram_coverage(*_sides(spark, sf), TAU)


def verbatim_coverage_taus(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage at several gram lengths."""
    return grams.gram_coverages(*_sides(spark, sf), (10, 20, 50)).select("tau", "id", "covered", "total", "coverage")


def memorized_spans_tau30(spark: SparkSession, sf: str) -> DataFrame:
    return grams.gram_texts(*_sides(spark, sf), TAU)


def verbatim_coverage_by_prior(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and standard error of coverage, share of records with any hit and its binomial error, per prior."""
    cov = verbatim_coverage_tau30(spark, sf).join(records(spark, sf).select("id", "prior_tier"), "id")
    p = F.avg((F.col("covered") > 0).cast("double"))
    return cov.groupBy("prior_tier").agg(
        F.count("*").alias("n"),
        F.avg("coverage").alias("mean_coverage"),
        F.when(F.count("*") > 1, F.stddev_samp("coverage") / F.sqrt(F.count("*"))).otherwise(0.0).alias("sem_coverage"),
        p.alias("hit_rate"),
        F.sqrt(p * (1 - p) / F.count("*")).alias("hit_sem"),
    )


def memorized_mask(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_intervals(attribution.span_hits(records(spark, sf)), ["id"])


def memorized_token_pct(spark: SparkSession, sf: str) -> DataFrame:
    """Share of words that overlap an occurrence of a span as it stands (not stripped), touching ones merged."""
    r = records(spark, sf)
    merged = intervals.merge_intervals(attribution.span_hits(r, stripped=False), ["id"], touching=True)
    tokens = spread(r.select("id", "text")).select("id", F.explode(token_spans("text")).alias("t")).select("id", F.col("t.s").alias("ts"), F.col("t.e").alias("te"))
    return intervals.count_overlapping(tokens, merged, ["id"]).select("id", "n_tokens", "n_overlapping", (F.col("n_overlapping") / F.col("n_tokens")).alias("mem_token_pct"))


def first_span_of_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """For each record how many of its words lie in an occurrence of a span, by the length class of the first such occurrence."""
    r = records(spark, sf)
    tokens = spread(r.select("id", "text")).select("id", F.explode(token_spans("text")).alias("t")).select("id", F.col("t.s").alias("ts"), F.col("t.e").alias("te"))
    size = F.col("e") - F.col("s")
    spans = attribution.span_hits(r).select("id", "s", "e", size.alias("ord"), F.when(size < 100, "short").when(size < 300, "middle").otherwise("long").alias("rule"))
    return intervals.first_overlap(tokens, spans, ["id"]).where("rule is not null").groupBy("id", "rule").agg(F.count("*").alias("n_words"))


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The memorized regions of every record cut into parts that notes of its patient explain, each with its note and recurrence."""
    r = regions(spark, sf)
    cut = attribution.pieces(r.select("region", "key", "gen_start", "text"), corpus(spark, sf))
    return cut.join(r.select("region", "id", "eval_split", "prior_tier"), "region")


def corpus_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Every place in the corpus where a region stands, whatever its length."""
    return attribution.corpus_occurrences(regions(spark, sf).select("region", "text"), corpus(spark, sf).select("row_idx", "text"))


def own_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Every place where a region stands in the notes of its own patient."""
    r, c = regions(spark, sf), corpus(spark, sf)
    found = attribution.corpus_occurrences(r.select("region", "text"), c.select("row_idx", "text"))
    return found.join(c.select("row_idx", "key"), "row_idx").join(r.select("region", "key"), ["region", "key"], "left_semi").select("region", "row_idx", "position")


def region_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every part of every region."""
    return pieces(spark, sf).select("region", "gen_start", "gen_end", "attributed", "split_origin")


def attribution_winner(spark: SparkSession, sf: str) -> DataFrame:
    """The note each explained part is attributed to: the latest of its patient that holds it."""
    return pieces(spark, sf).where("attributed").select("piece", "row_idx", "position")


def region_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Patients whose notes hold a part, and notes of its own patient that do."""
    return pieces(spark, sf).select("piece", "k_corpus", "k_within")


def patient_recurrence(spark: SparkSession, sf: str) -> DataFrame:
    """Of the parts of train records that stand in the corpus: how many, and the share in notes of several patients."""
    k = pieces(spark, sf).where("eval_split = 'train' and k_corpus > 0")
    return k.agg(F.count("*").alias("n_found"), (F.count_if(F.col("k_corpus") > 1) / F.count("*")).alias("share_several_patients"))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of train records that touch, as they stood before splitting: (id, run, gen_start, gen_end, n_parts, n_attributed, n_notes)."""
    cut = pieces(spark, sf).where("eval_split = 'train'")
    runs = intervals.contiguous_runs(cut, ["id"], "gen_start", "gen_end")
    return runs.groupBy("id", "run").agg(F.min("gen_start").alias("gen_start"), F.max("gen_end").alias("gen_end"), F.count("*").alias("n_parts"), F.count_if("attributed").alias("n_attributed"), F.countDistinct("row_idx").alias("n_notes"))


def contiguous_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of parts that touch, with the number of notes they come from."""
    return _runs(spark, sf)


def stitched_regions(spark: SparkSession, sf: str) -> DataFrame:
    """How many runs are stitched together from several notes: more than one part, some attributed, not all to one note."""
    stitched = (F.col("n_parts") > 1) & (F.col("n_attributed") > 0) & (F.col("n_notes") != 1)
    return _runs(spark, sf).agg(F.count("*").alias("n_runs"), F.count_if(stitched).alias("n_stitched"), (F.count_if(stitched) / F.count("*")).alias("share_stitched"))


def notes_per_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Train records with an attributed part, and from how many different notes they draw on average."""
    each = pieces(spark, sf).where("eval_split = 'train' and attributed").groupBy("id").agg(F.countDistinct("row_idx").alias("n"))
    return each.agg(F.count("*").alias("n_generations"), F.avg("n").alias("mean_notes"))


def chain_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """How much is left at each step from records to parts, for each split."""
    r = records(spark, sf)
    cut = pieces(spark, sf)
    origin = lambda o: F.count_if(F.col("split_origin") == o)
    parts = cut.groupBy("eval_split").agg(
        F.countDistinct("id").alias("n_with_regions"),
        F.countDistinct("region").alias("n_regions"),
        F.count("*").alias("n_parts"),
        F.count_if("attributed").alias("n_attributed"),
        F.count_if(~F.col("attributed")).alias("n_unattributed"),
        (origin("split_attributed") + origin("split_attributed_tiny")).alias("n_split_attributed"),
        (origin("split_residual") + origin("split_residual_tiny")).alias("n_split_residual"),
        F.count_if(F.col("k_corpus") == 0).alias("n_not_in_corpus"),
        F.sum(F.length("text")).alias("memorized_chars"),
    )
    names = [c for c in parts.columns if c != "eval_split"]
    return r.groupBy("eval_split").agg(F.count("*").alias("n_records")).join(parts, "eval_split", "left").select("eval_split", "n_records", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def repetition_cut_w20(spark: SparkSession, sf: str) -> DataFrame:
    return grams.repetition_cut(records(spark, sf).select("id", "text"), "id", "text", 20)


def patient_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Notes and words of each patient with a record, 0 where it has no notes."""
    c = corpus(spark, sf).groupBy("key").agg(F.count("*").alias("n_notes"), F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("n_tokens"))
    wanted = records(spark, sf).select("key").distinct()
    return wanted.join(c, "key", "left").select("key", F.coalesce("n_notes", F.lit(0)).alias("n_notes"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def oversize_patients_excluded(spark: SparkSession, sf: str, most: int = 1000) -> DataFrame:
    """Patients none of whose notes has more than ``most`` words, with their words."""
    sized = corpus(spark, sf).select("key", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("n"))
    return sized.groupBy("key").agg(F.max("n").alias("longest"), F.sum("n").alias("n_tokens")).where(F.col("longest") <= most)


_R = """
r as (
    select record_uid as id, any_value(lower(patient_id)) as key, any_value(generation) as text, any_value([x.text for x in memorized_spans]) as spans, any_value(prior_tier) as prior_tier
    from generations where _record_type is null and error_type is null and regexp_replace(generation, '^\\s+|\\s+$', '', 'g') <> '' group by record_uid
), c as (
    select row_idx, lower(PatientUid) as key, strftime(Encounter_Date, '%Y-%m-%d') as note_date, Note as text from notes
    where PatientUid is not null and regexp_replace(Note, '^\\s+|\\s+$', '', 'g') <> ''
)"""
def _gram_sql(tau: int) -> str:
    return (
        _R
        + f""", rw as (
    select id, key, regexp_extract_all(text, '\\S+') as w from r
), cw as (
    select key, regexp_extract_all(text, '\\S+') as w from c where key in (select key from r)
), known as (
    select distinct key, array_to_string(w[i:i+{tau - 1}], ' ') as gram from (select key, w, unnest(range(1, len(w) - {tau - 2})) as i from cw where len(w) >= {tau})
), made as (
    select id, key, i - 1 as pos, array_to_string(w[i:i+{tau - 1}], ' ') as gram from (select id, key, w, unnest(range(1, len(w) - {tau - 2})) as i from rw where len(w) >= {tau})
), hits as (
    select id, pos, gram from made semi join known using (key, gram)
)"""
    )


def _coverage_sql(tau: int) -> str:
    return (
        _gram_sql(tau)
        + f""", cov as (
    select id, count(distinct p) as covered from (select id, pos + unnest(range(0, {tau})) as p from hits) group by id
), coverage as (
    select id, coalesce(covered, 0)::int as covered, len(w)::int as total, case when len(w) > 0 then round(coalesce(covered, 0) / len(w), 4) else 0.0 end as coverage from rw left join cov using (id)
)"""
    )


_G, _COV = _gram_sql(30), _coverage_sql(30)


def _occ(stripped: bool) -> str:
    t = "regexp_replace(t, '^\\s+|\\s+$', '', 'g')" if stripped else "t"
    return f"""sp as (
    select distinct id, text, {t} as t from (select id, text, unnest(spans) as t from r) where t is not null
), occ as (
    select id, i - 1 as s, i - 1 + length(t) as e from (select id, text, t, unnest(range(1, length(text) - length(t) + 2)) as i from sp where t <> '' and contains(text, t)) where substr(text, i, length(t)) = t
)"""


def _merge(touching: bool) -> str:
    op = ">" if touching else ">="
    return f"""flagged as (
    select id, s, e, case when p is null or s {op} p then 1 else 0 end as f from (select *, max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) as p from occ)
), merged as (
    select id, min(s) as s, max(e) as e from (select *, sum(f) over (partition by id order by s, e rows unbounded preceding) as g from flagged) group by id, g
)"""


_REG = (
    _R
    + ", "
    + _occ(True)
    + ", "
    + _merge(False)
    + """, rs as (
    select record_uid as id, coalesce(nullif(eval_split, ''), 'unknown') as eval_split from generations
), regions as (
    select concat_ws(':', id, s::varchar, e::varchar) as region, id, key, s as gen_start, e as gen_end, substr(text, (s + 1)::bigint, (e - s)::bigint) as text from merged join r using (id)
)"""
)
_PIECES = (
    _REG
    + """, own as (
    select key, list(text) as ns from c where key in (select key from regions) group by key
), w as (
    select *, case when holds then 0 else coalesce(list_max(list_filter(range(1, length(t)), lambda k: len(list_filter(ns, lambda n: contains(n, substr(t, 1, k)))) > 0)), 0) end as hd,
        case when holds then 0 else coalesce(list_max(list_filter(range(1, length(t)), lambda k: len(list_filter(ns, lambda n: contains(n, right(t, k)))) > 0)), 0) end as tl
    from (select *, len(list_filter(ns, lambda n: contains(n, t))) > 0 as holds from (
        select region, id, key, gen_start as s0, text as whole, gen_start as g0, text as t, 0 as depth, false as tiny, coalesce(ns, []) as ns from regions left join own using (key) where text <> ''))
    union all
    select *, case when holds then 0 else coalesce(list_max(list_filter(range(1, length(t)), lambda k: len(list_filter(ns, lambda n: contains(n, substr(t, 1, k)))) > 0)), 0) end as hd,
        case when holds then 0 else coalesce(list_max(list_filter(range(1, length(t)), lambda k: len(list_filter(ns, lambda n: contains(n, right(t, k)))) > 0)), 0) end as tl
    from (select *, len(list_filter(ns, lambda n: contains(n, t))) > 0 as holds from (
        select region, id, key, s0, whole, g0 + h2 as g0, substr(t, h2 + 1, length(t) - h2 - t2) as t, depth + 1 as depth, length(t) - h2 - t2 < 30 as tiny, ns from (
            select *, case when hd >= 30 then hd else 0 end as h2, case when least(tl, length(t) - hd) >= 30 then least(tl, length(t) - hd) else 0 end as t2 from w
            where not holds and not tiny and depth < 4 and length(t) >= 30 and (hd > 0 or tl > 0)
        ) where length(t) - h2 - t2 > 0))
), v as (
    select *, case when hd >= 30 then hd else 0 end as h2, case when least(tl, length(t) - hd) >= 30 then least(tl, length(t) - hd) else 0 end as t2, not holds and (tiny or depth >= 4 or length(t) < 30 or (hd = 0 and tl = 0)) as ends from w
), cut as (
    select region, id, key, s0, whole, g0 as gen_start, g0 + length(t) as gen_end, case when tiny then 'split_attributed_tiny' when depth > 0 then 'split_attributed' else 'original' end as split_origin from v where holds
    union all select region, id, key, s0, whole, g0, g0 + length(t), case when tiny then 'split_residual_tiny' when depth > 0 then 'split_residual' else 'original' end from v where ends
    union all select region, id, key, s0, whole, g0, g0 + h2, 'split_attributed' from v where not holds and not ends and h2 > 0
    union all select region, id, key, s0, whole, g0 + length(t) - t2, g0 + length(t), 'split_attributed' from v where not holds and not ends and t2 > 0
), parts as (
    select *, region || '+' || (gen_start - s0) as piece, substr(whole, (gen_start - s0 + 1)::bigint, (gen_end - gen_start)::bigint) as text from cut
), held as (
    select t, row_idx, key, note_date, instr(c.text, t) - 1 as position from (select distinct text as t from parts) join c on contains(c.text, t)
), kc as (
    select t, count(distinct key) as k_corpus from held group by t
), kw as (
    select t, key, count(*) as k_within, arg_max({'row_idx': row_idx, 'position': position}, (coalesce(note_date, ''), row_idx)) as best from held group by t, key
), pieces as (
    select p.*, coalesce(k_corpus, 0) as k_corpus, coalesce(k_within, 0) as k_within, best.row_idx as row_idx, best.position as position, best is not null as attributed, e.eval_split
    from parts p left join kc on kc.t = p.text left join kw on kw.t = p.text and kw.key = p.key join (select id, any_value(eval_split) as eval_split from rs group by id) e using (id)
)"""
)
_RUNS = (
    _PIECES
    + """, runs as (
    select id, run, min(gen_start) as gen_start, max(gen_end) as gen_end, count(*) as n_parts, count_if(attributed) as n_attributed, count(distinct row_idx) as n_notes
    from (select *, sum(f) over (partition by id order by gen_start, gen_end rows unbounded preceding) as run from (
        select *, case when lag(gen_end) over (partition by id order by gen_start, gen_end) = gen_start then 0 else 1 end as f from pieces where eval_split = 'train')) group by id, run
)"""
)
_SQL = {
    "verbatim_flag_tau30": f"with {_G} select id, id in (select id from hits) as verbatim from r",
    "verbatim_coverage_tau30": f"with {_COV} select id, covered, total, coverage from coverage",
    "verbatim_coverage_taus": " union all ".join(f"(with {_coverage_sql(tau)} select {tau} as tau, id, covered, total, coverage from coverage)" for tau in (10, 20, 50)),
    "memorized_spans_tau30": f"with {_G} select id, gram as span, min(pos)::int as first_pos from hits group by id, gram",
    "verbatim_coverage_by_prior": f"""with {_COV} select prior_tier, count(*) as n, avg(coverage) as mean_coverage, case when count(*) > 1 then stddev_samp(coverage) / sqrt(count(*)) else 0.0 end as sem_coverage,
        avg((covered > 0)::int::double) as hit_rate, sqrt(avg((covered > 0)::int::double) * (1 - avg((covered > 0)::int::double)) / count(*)) as hit_sem from coverage join r using (id) group by prior_tier""",
    "memorized_mask": f"with {_R}, {_occ(True)}, {_merge(False)} select id, s::int as s, e::int as e from merged",
    "memorized_token_pct": f"""with {_R}, {_occ(False)}, {_merge(True)}, tok as (
        select id, te - n as ts, te from (select id, n, sum(gap + n) over (partition by id order by i) as te from (
            select id, i, length(w[i]) as n, length(gaps[i]) as gap from (select id, w, gaps, unnest(range(1, len(w) + 1)) as i from (select id, regexp_extract_all(text, '\\S+') as w, regexp_split_to_array(text, '\\S+') as gaps from r))))
    ), hit as (select distinct t.id, ts from tok t join merged m on t.id = m.id and m.s < t.te and t.ts < m.e)
    select id, n_tokens, coalesce(n, 0) as n_overlapping, coalesce(n, 0) / n_tokens as mem_token_pct from (select id, count(*) as n_tokens from tok group by id) left join (select id, count(*) as n from hit group by id) using (id)""",
    "first_span_of_tokens": f"""with {_R}, {_occ(True)}, tok as (
        select id, te - n as ts, te from (select id, n, sum(gap + n) over (partition by id order by i) as te from (
            select id, i, length(w[i]) as n, length(gaps[i]) as gap from (select id, w, gaps, unnest(range(1, len(w) + 1)) as i from (select id, regexp_extract_all(text, '\\S+') as w, regexp_split_to_array(text, '\\S+') as gaps from r))))
    ), one as (select t.id, t.ts, arg_min(o.e - o.s, (o.s, o.e)) as size from tok t join occ o on o.id = t.id and o.s < t.te and t.ts < o.e group by t.id, t.ts)
    select id, case when size < 100 then 'short' when size < 300 then 'middle' else 'long' end as rule, count(*) as n_words from one group by all""",
    "corpus_occurrences": f"""with {_REG} select region, row_idx, (i - 1)::int as position from (
        select region, n.row_idx, g.text as t, n.text, unnest(range(1, length(n.text) - length(g.text) + 2)) as i from regions g join c n on contains(n.text, g.text) where g.text <> '') where substr(text, i, length(t)) = t""",
    "own_occurrences": f"""with {_REG} select region, row_idx, (i - 1)::int as position from (
        select region, n.row_idx, g.text as t, n.text, unnest(range(1, length(n.text) - length(g.text) + 2)) as i from regions g join c n on g.key = n.key and contains(n.text, g.text) where g.text <> '') where substr(text, i, length(t)) = t""",
    "region_split": f"with recursive {_PIECES} select region, gen_start, gen_end, attributed, split_origin from pieces",
    "attribution_winner": f"with recursive {_PIECES} select piece, row_idx, position::int as position from pieces where attributed",
    "region_recurrence": f"with recursive {_PIECES} select piece, k_corpus, k_within from pieces",
    "patient_recurrence": f"with recursive {_PIECES} select count(*) as n_found, count_if(k_corpus > 1) / count(*) as share_several_patients from pieces where eval_split = 'train' and k_corpus > 0",
    "contiguous_regions": f"with recursive {_RUNS} select id, run::bigint as run, gen_start, gen_end, n_parts, n_attributed, n_notes from runs",
    "stitched_regions": f"""with recursive {_RUNS} select count(*) as n_runs, count_if(n_parts > 1 and n_attributed > 0 and n_notes <> 1) as n_stitched, count_if(n_parts > 1 and n_attributed > 0 and n_notes <> 1) / count(*) as share_stitched from runs""",
    "notes_per_generation": f"with recursive {_PIECES} select count(*) as n_generations, avg(n) as mean_notes from (select id, count(distinct row_idx) as n from pieces where eval_split = 'train' and attributed group by id)",
    "chain_funnel": f"""with recursive {_PIECES}, n as (select eval_split, count(distinct r.id) as n_records from r join rs using (id) group by 1), p as (
        select eval_split, count(distinct id) as n_with_regions, count(distinct region) as n_regions, count(*) as n_parts, count_if(attributed) as n_attributed, count_if(not attributed) as n_unattributed,
            count_if(split_origin like 'split_attributed%') as n_split_attributed, count_if(split_origin like 'split_residual%') as n_split_residual, count_if(k_corpus = 0) as n_not_in_corpus, sum(length(text))::bigint as memorized_chars from pieces group by 1)
        select eval_split, n_records, """
    + ", ".join(f"coalesce({c}, 0) as {c}" for c in ("n_with_regions", "n_regions", "n_parts", "n_attributed", "n_unattributed", "n_split_attributed", "n_split_residual", "n_not_in_corpus", "memorized_chars"))
    + " from n left join p using (eval_split)",
    "repetition_cut_w20": f"""with {_R}, w as (select id, regexp_extract_all(text, '\\S+') as w from r), g as (
        select id, i, array_to_string(w[i:i+19], ' ') as gram from (select id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 40)
    ), cut as (select id, min(i) - 1 as kept from (select id, i, row_number() over (partition by id, gram order by i) as k from g) where k > 1 group by id)
    select id, len(w)::int as n_words, coalesce(kept, len(w))::int as kept from w left join cut using (id)""",
    "patient_corpus_stats": f"with {_R} select key, coalesce(n_notes, 0) as n_notes, coalesce(n_tokens, 0)::bigint as n_tokens from (select distinct key from r) left join (select key, count(*) as n_notes, sum(len(regexp_extract_all(text, '\\S+'))) as n_tokens from c group by key) using (key)",
    "oversize_patients_excluded": f"with {_R} select key, max(n)::int as longest, sum(n)::bigint as n_tokens from (select key, len(regexp_extract_all(text, '\\S+')) as n from c) group by key having max(n) <= 1000",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _SQL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
