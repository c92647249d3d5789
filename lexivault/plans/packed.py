"""Queries on packed cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexivault.operators.packed_values import split_values
from lexivault.sources.tables import table

FIELDS = ("Medications", "Symptoms", "ICD10 code")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each value of the packed cells of sensitive_diagnosis with its position."""
    return split_values(table(spark, sf, "sensitive_diagnosis"), "dx_id", FIELDS)


P3_SQL = r"""
with defs as (
    select dx_id, any_value("Medications") as m, any_value("Symptoms") as s, any_value("ICD10 code") as i from sensitive_diagnosis group by dx_id
), cells as (
    select dx_id, 'Medications' as field_name, m as cell from defs union all select dx_id, 'Symptoms', s from defs union all select dx_id, 'ICD10 code', i from defs
), tokens as (
    select dx_id, field_name, unnest(t) as token, unnest(range(1, len(t) + 1)) as k from (
        select dx_id, field_name, regexp_extract_all(cell, '(?s)"(?:[^"]|"")*"|“[^”]*”|\([^()]*\)|\[[^\[\]]*\]|\s+/\s+|[;,|•\t\n]|[^;,|•\t\n"“(\[/\s]+|.') as t
        from cells where cell is not null and lower(regexp_replace(cell, '^\s+|\s+$', '', 'g')) not in ('', 'nan', 'n/a', '-')
    )
), marked as (
    select *, regexp_full_match(token, '\s+/\s+|[;,|•\t\n]') as is_delimiter from tokens
), grouped as (
    select *, sum(is_delimiter::int) over (partition by dx_id, field_name order by k) as g from marked
), parts as (
    select dx_id, field_name, g, regexp_replace(string_agg(token, '' order by k) filter (not is_delimiter), '^\s+|\s+$', '', 'g') as part from grouped group by dx_id, field_name, g
), items as (
    select dx_id, field_name, g, case
        when len(part) > 1 and regexp_full_match(part, '(?s)"(?:[^"]|"")*"') then trim(replace(part[2:-2], '""', '"'))
        when len(part) > 1 and regexp_full_match(part, '(?s)“[^”]*”') then trim(part[2:-2]) else part end as item
    from parts
)
select dx_id, field_name, row_number() over (partition by dx_id, field_name order by g)::int as pos, item from items where item <> ''
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL}
