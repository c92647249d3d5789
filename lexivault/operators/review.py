"""Manual review and adjudication: sheets joined with their keys, queues in order, corrections of labels, progress.

All are joins and aggregates on record keys; the reviewed side is made one row per key first, so that a
repeated row of one side doesn't multiply the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivault.functions.text import first_filled


def sheet_status(sheet: DataFrame, key: DataFrame, on: str, label: Column) -> DataFrame:
    """The rows of a sheet with ``label`` and ``status``: unmatched (no such key), unlabelled (empty), invalid (label null), else scored.

    ``label`` is computed from the sheet's column human_label; keys are made distinct.
    """
    known = key.select(on).where(F.col(on).isNotNull()).distinct().withColumn("_known", F.lit(True))
    joined = sheet.join(known, on, "left").withColumn("label", label)
    empty = F.coalesce(F.trim("human_label"), F.lit("")) == ""
    status = F.when(F.col("_known").isNull(), "unmatched").when(empty, "unlabelled").when(F.col("label").isNull(), "invalid").otherwise("scored")
    return joined.withColumn("status", status).drop("_known")


def accuracy(df: DataFrame, keys: Sequence[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(keys, n, n_unscored, ppv, npv, accuracy, error_rate) of predictions against human labels, booleans or null; null without a case."""
    t, p = F.col(truth), F.col(predicted)
    known = t.isNotNull() & p.isNotNull()
    share = lambda cond: F.avg(F.when(known & cond, (t == p).cast("double")))
    return df.groupBy(*keys).agg(F.count_if(known).alias("n"), F.count_if(~known).alias("n_unscored"), share(p).alias("ppv"), share(~p).alias("npv"), share(F.lit(True)).alias("accuracy"), (1 - share(F.lit(True))).alias("error_rate"))


def corrected(df: DataFrame, gold: DataFrame | None, reviewed: DataFrame | None, key: str) -> DataFrame:
    """df (key, truth, mention, ...) once in mode 'original' and, if a correction is given, once in mode 'adjudication'.

    There the truth is that of ``gold`` (key, fixed) where it has one; of records that ``reviewed`` (key) names
    a positive truth becomes negative and the mention is cleared.
    """
    original = df.withColumn("mode", F.lit("original"))
    if gold is None and reviewed is None:
        return original
    out = df.withColumn("mode", F.lit("adjudication"))
    if gold is not None:
        out = out.join(gold.dropDuplicates([key]).select(key, F.col("fixed").alias("_fixed")), key, "left").withColumn("truth", F.coalesce("_fixed", "truth")).drop("_fixed")
    if reviewed is not None:
        out = out.join(reviewed.select(key).distinct().withColumn("_flip", F.lit(True)), key, "left")
        flip = F.coalesce("_flip", F.lit(False)) & F.coalesce("truth", F.lit(False))
        out = out.withColumn("mention", F.when(flip, False).otherwise(F.col("mention"))).withColumn("truth", F.when(flip, False).otherwise(F.col("truth"))).drop("_flip")
    return original.unionByName(out.select(*original.columns))


def modes(gold: DataFrame | None, reviewed: DataFrame | None) -> list[str]:
    """The modes that ``corrected`` gives."""
    return ["original"] if gold is None and reviewed is None else ["original", "adjudication"]


def first_per_key(df: DataFrame, key: str, order: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key, the first by ``order`` (or the last), as an aggregate that combines before the shuffle. Null keys are dropped."""
    rest = [c for c in df.columns if c != key]
    at = F.struct(*order)
    row = (F.max_by if last else F.min_by)(F.struct(*rest), at).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, "_r.*").select(*df.columns)


def with_default(entries: DataFrame, items: DataFrame, key: str, order: Sequence[str], defaults: dict[str, str]) -> DataFrame:
    """entries with columns of the first matching item; where there is none, or its value is empty, the default."""
    one = first_per_key(items, key, order).select(key, *[F.col(c).alias(f"_{c}") for c in defaults])
    return entries.join(one, key, "left").select(*entries.columns, *[F.coalesce(first_filled(F.col(f"_{c}")), F.lit(v)).alias(c) for c, v in defaults.items()])


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first non-empty value of those columns of a list that the frame has; null if it has none."""
    have = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return first_filled(*have) if have else F.lit(None).cast("string")


def require_complete(counts: DataFrame, missing: str, allow: bool = False) -> DataFrame:
    """The counts, if no row has any missing; else an error that names some of those rows."""
    if not allow:
        bad = counts.where(F.col(missing) > 0).limit(5).collect()
        if bad:
            raise ValueError("incomplete: " + "; ".join(str(r.asDict()) for r in bad))
    return counts


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """An error if the two share a key; null keys don't count."""
    shared = a.select(key).where(F.col(key).isNotNull()).join(b.select(key), key, "left_semi").limit(3).collect()
    if shared:
        raise ValueError(f"shared {key}: {[r[0] for r in shared]}")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame, if no combination of keys repeats; else an error."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if bad:
        raise ValueError(f"repeated {list(keys)}: {[tuple(r)[:-1] for r in bad]}")
    return df


def progress(present: DataFrame, ready: DataFrame, sampled: DataFrame, cohort: DataFrame, by: str, key: str) -> DataFrame:
    """(by, present, ready, sampled, in_cohort, skipped) counts of different keys; each frame has (by, key), the cohort (key).

    Skipped are those sampled that the cohort doesn't hold.
    """
    tag = lambda df, name: df.select(by, key).distinct().select(by, key, F.lit(name).alias("_set"))
    all_ = tag(present, "present").unionByName(tag(ready, "ready")).unionByName(tag(sampled, "sampled"))
    held = cohort.select(key).distinct().withColumn("_in", F.lit(True))
    rows = all_.join(held, key, "left")
    taken = F.col("_set") == "sampled"
    return rows.groupBy(by).agg(*[F.count_if(F.col("_set") == n).alias(n) for n in ("present", "ready", "sampled")], F.count_if(taken & F.col("_in")).alias("in_cohort"), F.count_if(taken & F.col("_in").isNull()).alias("skipped"))
