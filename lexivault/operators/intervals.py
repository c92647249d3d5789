"""Intervals of a record: merging, runs, overlap and filling.

Intervals are half-open (s, e) and belong to a record's key. Everything is a window over the key,
ordered, so a record's intervals are sorted once; records are independent. Null bounds are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: Sequence[str], s: str = "s", e: str = "e", touching: bool = False) -> DataFrame:
    """(keys, s, e): unions of overlapping intervals; with ``touching`` also of those that only meet."""
    order = Window.partitionBy(*keys).orderBy(s, e)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(e).over(before)
    opens = reach.isNull() | ((F.col(s) > reach) if touching else (F.col(s) >= reach))
    return (
        df.where(F.col(s).isNotNull() & F.col(e).isNotNull())
        .withColumn("_new", opens.cast("int"))
        .withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_island")
        .agg(F.min(s).alias(s), F.max(e).alias(e))
        .drop("_island")
    )


def contiguous_runs(df: DataFrame, keys: Sequence[str], s: str = "s", e: str = "e") -> DataFrame:
    """All columns and ``run``: numbered from 1, a new one where an interval doesn't start at the end of the one before."""
    order = Window.partitionBy(*keys).orderBy(s, e)
    opens = (F.lag(e).over(order).isNull() | (F.lag(e).over(order) != F.col(s))).cast("int")
    return df.withColumn("_new", opens).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def fill_nearest(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``value`` with nulls replaced by the last value before, else by the first after."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(before, after))


def count_overlapping(tokens: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_tokens, n_overlapping): tokens (keys, ts, te) that overlap some span (keys, s, e).

    One sorted pass over both together: a token overlaps iff, of the spans that begin before its end, the
    furthest end lies beyond its start. At the same place tokens come first, as a span that begins there doesn't count.
    """
    both = tokens.select(*keys, F.col("te").alias("_at"), F.lit(0).alias("_span"), F.col("ts").alias("_ts"), F.lit(None).cast("long").alias("_end")).unionByName(
        spans.where("s is not null and e is not null and s < e").select(*keys, F.col("s").alias("_at"), F.lit(1).alias("_span"), F.lit(None).cast("int").alias("_ts"), F.col("e").cast("long").alias("_end"))
    )
    before = Window.partitionBy(*keys).orderBy("_at", "_span").rowsBetween(Window.unboundedPreceding, -1)
    reached = both.withColumn("_reach", F.max("_end").over(before)).where("_span = 0")
    return reached.groupBy(*keys).agg(F.count("*").alias("n_tokens"), F.count_if(F.coalesce(F.col("_reach") > F.col("_ts"), F.lit(False))).alias("n_overlapping"))


def first_overlap(tokens: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tokens (keys, ts, te, ...) with ``rule`` of the first span (keys, s, e, ord, rule) they overlap, by (s, e, ord)."""
    held = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e", "ord", "rule"))).alias("_spans"))
    hit = F.filter("_spans", lambda x: (x["s"] < F.col("te")) & (F.col("ts") < x["e"]))
    return tokens.join(held, list(keys), "left").withColumn("rule", F.when(F.size(hit) > 0, F.element_at(hit, 1)["rule"])).drop("_spans")
