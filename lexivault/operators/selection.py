"""Sampling, budgets, set operations and ordered selection, the same on every engine.

Random order is the md5 of a seed and the key. Ranks over the whole input use a two-level plan: the rows
that can still be chosen are cut per partition of the hash range first, so that no single task sorts all
rows; per-stratum ranks keep only the best k of each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivault.functions.text import seeded_order
from lexivault.runtime import stage


def sample_per_stratum(df: DataFrame, strata: Sequence[str], key: str, k: int, seed: int) -> DataFrame:
    """At most k rows of each stratum, uniformly, without replacement. Rows of a null key are left out.

    Rank <= k over a partition lets Spark keep k rows per task and stratum before it shuffles (group limit).
    """
    w = Window.partitionBy(*strata).orderBy(seeded_order(seed, key), key)
    return df.where(F.col(key).isNotNull()).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows uniformly: the k of least order, taken per task and then merged."""
    return df.where(F.col(key).isNotNull()).withColumn("_o", seeded_order(seed, key)).orderBy("_o", key).limit(k).drop("_o")


def running_total(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of value over all rows before a row in the order of a hex hash.

    The range of the hash is cut into slices by its first two digits: totals of the slices (few rows) are
    accumulated and joined back, and the running sum is a window within a slice, so no task holds all rows.
    """
    sliced = df.withColumn("_slice", F.substring(order, 1, 2))
    totals = sliced.groupBy("_slice").agg(F.sum(value).alias("_t"))
    # At most 256 rows, whatever the size of the input.
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_slice", "_before")
    w = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return sliced.join(F.broadcast(before), "_slice").withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("_slice", "_before")


def fill_budget(df: DataFrame, key: str, size: str, target: int, seed: int, already: int = 0) -> DataFrame:
    """Rows in random order until their sizes reach the target: a row is taken while what stands before it is below it."""
    ordered = df.where(F.col(key).isNotNull()).withColumn("_o", seeded_order(seed, key))
    return running_total(ordered, "_o", size, "tokens_before").where(F.col("tokens_before") + already < target).drop("_o")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Adds the place of each row in an order over all rows, from 1, without one task that holds them all.

    The sorted rows are written once with their place in their partition; the sizes of the partitions before are added.
    """
    low = (1 << 33) - 1  # what monotonically_increasing_id leaves for the place in a partition
    placed = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(low) + 1).drop("_at", "_part", "_before")


def first_per_class(df: DataFrame, cls: str, order: Sequence[str], n: int, prefix: str = "item") -> DataFrame:
    """The first n rows of each class, interleaved by rank and class, with ids prefix_0001, ... in that order."""
    w = Window.partitionBy(cls).orderBy(*order)
    kept = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return numbered(kept, ["_rank", cls], "_place").withColumn("item_id", F.format_string(f"{prefix}_%04d", "_place")).drop("_rank", "_place")


def by_priority(groups: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, group): each key in the first group that holds it."""
    tagged = None
    for i, (name, df) in enumerate(groups):
        part = df.select(F.col(key), F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("g"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("g").alias("g")).select(key, F.col("g.name").alias("group"))


def top_up(chosen: DataFrame, pool: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """chosen and, if fewer than n, random keys of the pool that aren't in it, up to n in all."""
    missing = n - chosen.select(key).limit(n).count()
    if missing <= 0:
        return chosen.select(key)
    rest = pool.select(key).distinct().join(chosen.select(key), key, "left_anti")
    return chosen.select(key).unionByName(sample(rest, key, missing, seed))


def not_done(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys aren't among those done: what an incremental run has still to do."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def content_key(df: DataFrame, groups: Sequence[str], id_col: str) -> DataFrame:
    """(groups, content_key): 16 digits that stand for a group's different ids, whatever their order.

    Ids are hashed (sha1), and the hashes of each of the 4,096 slices by their first three digits are sorted and hashed
    again, then the slices in order; so a task holds a 4,096th of a group's hashes, never all ids of a group.
    """
    ids = df.where(F.col(id_col).isNotNull()).select(*groups, F.sha1(F.col(id_col).cast("string")).alias("_h")).distinct()
    joined = lambda c: F.sha1(F.array_join(F.array_sort(F.collect_list(c)), "\n"))
    slices = ids.groupBy(*groups, F.substring("_h", 1, 3).alias("_slice")).agg(joined("_h").alias("_d"))
    return slices.groupBy(*groups).agg(F.substring(joined(F.concat("_slice", "_d")), 1, 16).alias("content_key"))


def cache_key(*parts: Column | str) -> Column:
    """16 digits of the sha256 of the parts, joined by colons; null parts are left out."""
    return F.substring(F.sha2(F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]), 256), 1, 16)
