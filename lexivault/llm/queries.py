"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.llm import consensus, packing, pii, repetition, shared_spans, tokenizer, truncation
from lexivault.runtime import stage
from lexivault.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of records with a common stretch of at least 200 characters."""
    return shared_spans.sharing_pairs(shared_spans.record_texts(table(spark, sf, "notes"), table(spark, sf, "generations")))


def p1_extent(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each record stands in other records too."""
    return shared_spans.shared_extent(shared_spans.record_texts(table(spark, sf, "notes"), table(spark, sf, "generations")))


def _once(rows: DataFrame) -> DataFrame:
    """Equal rows of a record_uid once; rows without one are each a record of their own."""
    own = F.when(F.col("record_uid").isNull(), F.monotonically_increasing_id())
    return rows.withColumn("_own", own).dropDuplicates().drop("_own")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Generations of which at least a third of the words are repeated."""
    return repetition.repetitive(table(spark, sf, "generations"), "record_uid", "generation")


def p2_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of repeated content of each generation; rows that repeat a record_uid and content count once, those without a record_uid each."""
    return _once(repetition.repetition(table(spark, sf, "generations"), "record_uid", "generation"))


def _pii_texts(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "notes").select(F.col("record_uid").alias("record"), F.col("Note").alias("text"))
    return own.unionByName(table(spark, sf, "generations").select(F.col("record_uid").alias("record"), F.col("generation").alias("text")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each person's name, phone number, e-mail address, identity number and street address of each record."""
    texts = _pii_texts(spark, sf)
    return pii.find(texts, pii.train(texts, table(spark, sf, "name_gazetteer"))).withColumnRenamed("record", "record_uid")


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every record's text with typed placeholders; rows that repeat a record_uid and text count once, those without a record_uid each."""
    texts = _pii_texts(spark, sf)
    return pii.redact(texts, "record", "text", pii.train(texts, table(spark, sf, "name_gazetteer"))).withColumnRenamed("record", "record_uid").transform(_once)


def _usable(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.usable_votes(table(spark, sf, "verdicts"), "generation_id", "annotator", consensus.verdict_label(F.col("verdict")), ["timestamp"], "verdict_id")


def _votes(spark: SparkSession, sf: str) -> tuple[DataFrame, consensus.Model]:
    votes = consensus.staged_votes(_usable(spark, sf))
    return votes, consensus.fit(stage(consensus.patterns(votes), "patterns"), ["positive", "negative"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The label of each generation judged by at least three annotators."""
    votes, model = _votes(spark, sf)
    return consensus.consensus(votes, model, 3).select(F.col("item").alias("generation_id"), "label")


def p5_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label and confidence of every generation with a usable verdict."""
    votes, model = _votes(spark, sf)
    return consensus.consensus(votes, model).select(F.col("item").alias("generation_id"), "label", "confidence")


def p5_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of the annotators of every generation with a usable verdict."""
    return consensus.agreement(_usable(spark, sf)).withColumnRenamed("item", "generation_id")


def p5_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of all annotators, also corrected for chance."""
    return consensus.alpha(_usable(spark, sf)).select("n_items", "n_labels", F.round("agreement", 9).alias("agreement"), F.round("alpha", 9).alias("alpha"))


def p5_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Reliability and type of each annotator."""
    votes, model = _votes(spark, sf)
    return consensus.reliability(votes, model)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as token ids."""
    return tokenizer.encode(table(spark, sf, "documents"), "doc_id", "text")


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Where every piece of every document lies in sequences of at most 8,192 tokens."""
    sizes = stage(tokenizer.token_counts(table(spark, sf, "documents"), "doc_id", "text"), "sizes")
    return packing.pack(sizes, "doc_id", "n_tokens")


def p7_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """The number of sequences against its lower bound."""
    return packing.certificate(stage(p7_packing(spark, sf), "packing"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text was cut."""
    scored = truncation.score(table(spark, sf, "documents"), "doc_id", "text", "source")
    return scored.where("is_cut").select("doc_id")


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts."""
    return truncation.cut_rates(truncation.score(table(spark, sf, "documents"), "doc_id", "text", "source"))


_P1 = """
texts as (
    select distinct record, text from (
        select record_uid as record, Note as text from notes union all select record_uid, generation from generations
        union all select record_uid, unnest(list_transform(memorized_spans, lambda x: x.text)) from generations
    ) where record is not null and text is not null
), t as (
    select row_number() over () as tid, record, text from texts where length(text) >= 200
), g as (
    select tid, record, i - 1 as s, hash(substr(text, i, 200)) as h from (select tid, record, text, unnest(range(1, length(text) - 198)) as i from t)
), hits as (
    select * from g where h in (select h from g group by h having min(record) <> max(record))
)"""
P1_SQL = f"with {_P1} select distinct a.record as record_a, b.record as record_b from (select distinct record, h from hits) a join (select distinct record, h from hits) b on a.h = b.h and a.record < b.record"
P1_EXTENT_SQL = f"""with {_P1}, islands as (
    select tid, record, min(s) as s, max(s) + 200 as e from (
        select *, sum(f) over (partition by tid order by s rows unbounded preceding) as island from (
            select tid, record, s, case when s > lag(s) over (partition by tid order by s) + 200 then 1 when lag(s) over (partition by tid order by s) is null then 1 else 0 end as f from hits)) group by tid, record, island
), found as (
    select record, sum(e - s) as shared_chars, count(*) as n_spans, max(e - s) as longest from islands group by record
), sizes as (
    select record, sum(length(text)) as n_chars from texts group by record
)
select record, n_chars::bigint as n_chars, coalesce(shared_chars, 0)::bigint as shared_chars, coalesce(n_spans, 0)::bigint as n_spans, coalesce(longest, 0)::int as longest,
    case when n_chars > 0 then coalesce(shared_chars, 0) / n_chars else 0.0 end as share from sizes left join found using (record)
"""

_P2 = """words as (
    select record_uid, regexp_extract_all(lower(generation), '\\p{L}+') as w
    from (select record_uid, any_value(generation) as generation from generations where record_uid is not null and generation is not null group by record_uid)
), placed as (
    select record_uid, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from words
)"""


def _covered(n: int) -> str:
    """Words inside an n-gram that stood earlier."""
    return f"""grams{n} as (
    select record_uid, pos, string_agg(word, ' ') over (partition by record_uid order by pos rows between current row and {n - 1} following) as gram,
        count(*) over (partition by record_uid order by pos rows between current row and {n - 1} following) as n
    from placed
), covered{n} as (
    select distinct record_uid, pos + unnest(range(0, {n})) as pos from (select *, row_number() over (partition by record_uid, gram order by pos) as k from grams{n} where n = {n}) where k > 1
), rep{n} as (
    select record_uid, count(*) as rep, sum(length(word)) as chars from covered{n} join placed using (record_uid, pos) group by record_uid
)"""


P2_SQL = f"with {_P2}, {_covered(5)} select record_uid from rep5 join (select record_uid, len(w) as total from words) using (record_uid) where rep * 3 >= total"
P2_SHARES_SQL = f"""with {_P2}, {_covered(3)}, {_covered(5)}, {_covered(10)}, lines as (
    select record_uid, generation, unnest(l) as line, unnest(range(1, len(l) + 1)) as i from (
        select record_uid, generation, regexp_split_to_array(generation, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') as l from (select record_uid, any_value(generation) as generation from generations where record_uid is not null and generation is not null group by record_uid))
), again as (
    select record_uid, sum(n) as total, sum(case when k > 1 then n else 0 end) as again from (
        select record_uid, length(line) as n, row_number() over (partition by record_uid, line order by i) as k from (select record_uid, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as line from lines) where line <> '') group by record_uid
)
select r.record_uid, coalesce(len(w), 0)::bigint as n_words, """ + ", ".join(
    f"coalesce(rep{n}.rep, 0)::bigint as repeated_words_{n}, coalesce(rep{n}.rep, 0) / greatest(coalesce(len(w), 0), 1) as repeated_share_{n}" for n in (3, 5, 10)
) + """, coalesce(rep3.chars, 0) / greatest(coalesce(length(array_to_string(w, '')), 0), 1) as char_share, coalesce(again.again / again.total, 0.0) as line_share
from (select distinct record_uid from generations where record_uid is not null) r left join words using (record_uid) left join rep3 using (record_uid) left join rep5 using (record_uid) left join rep10 using (record_uid) left join again using (record_uid)
"""

_P5 = """v as (
    select verdict_id, any_value(generation_id) as item, any_value(lower(regexp_replace(annotator, '^\\s+|\\s+$', '', 'g'))) as who, any_value(regexp_replace(lower(regexp_replace(verdict, '^\\s+|\\s+$', '', 'g')), '[\\s.!]+$', '')) as y, any_value(timestamp) as ts from verdicts group by verdict_id
), usable as (
    select item, who, y, row_number() over (partition by item, who order by ts desc nulls last, verdict_id desc) as k from (
        select item, who, case when y in ('p', 'pos', 'positive') then 'positive' when y in ('n', 'neg', 'negative') then 'negative' end as y, ts, verdict_id from v) where item is not null and who <> '' and y is not null
), votes as (
    select item, y, count(*) as n from usable where k = 1 group by item, y
), items as (
    select item, sum(n)::bigint as n, sum(n * (n - 1)) as same, count(*) as kinds from votes group by item
)"""
P5_AGREEMENT_SQL = f"with {_P5} select item as generation_id, case when n > 1 then same / (n * (n - 1)) else 1.0 end as agreement, n as n_annotators from items"
P5_ALPHA_SQL = f"""with {_P5}, several as (
    select item, y, v.n as c, i.n as n from votes v join items i using (item) where i.n > 1
), totals as (
    select y, sum(c) as s from several group by y
), o as (
    select sum(c * (c - 1) / (n - 1)) / sum(c) as agreed, sum(c) as total from several
)
select (select count(distinct item) from several) as n_items, total::bigint as n_labels, round(agreed, 9) as agreement, round(1 - (1 - agreed) / (1 - e), 9) as alpha from o, (select sum(s * (s - 1)) / (sum(s) * (sum(s) - 1)) as e from totals)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_extent": p1_extent,
        "p2_found": p2_found,
        "p2_shares": p2_shares,
        "p4_found": p4_found,
        "p4_redacted": p4_redacted,
        "p5_found": p5_found,
        "p5_labels": p5_labels,
        "p5_agreement": p5_agreement,
        "p5_alpha": p5_alpha,
        "p5_reliability": p5_reliability,
        "p6_ids": p6_ids,
        "p7_packing": p7_packing,
        "p7_certificate": p7_certificate,
        "p8_found": p8_found,
        "p8_rates": p8_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p1_extent": P1_EXTENT_SQL, "p2_found": P2_SQL, "p2_shares": P2_SHARES_SQL, "p5_agreement": P5_AGREEMENT_SQL, "p5_alpha": P5_ALPHA_SQL}
