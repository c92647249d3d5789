"""Filling fixed-capacity containers with items of varying length.

Method: bound-certified repacking. Items are dealt to groups at random, each group is packed by best-fit
decreasing, and dual-feasible functions give a lower bound that certifies its number of bins. A group
that needs as many bins as its bound is optimal and is never touched again. Groups with a gap exchange the
items of their bins that aren't full and are packed again, until no gap is left, fewer than two groups
have one, or a round lowers the number of bins no further.

An item above the capacity is split into full containers and a rest; no other item is ever split.
Items of size 0 or null size take no room: they are listed without a container. Items are dealt by a hash of
their row, not of their id, so a repeated or null id is no hot group; groups are sized by the sum of item
sizes and by the number of items, so a task holds a bounded part of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivault.runtime import stage

CAPACITY = 8192
GROUP_BINS = 2048
GROUP_ITEMS = 200_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, free room of each bin). Ties keep the items' order."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    free: list[int] = []
    levels: list[int] = []  # rooms that some bin has, in order
    at_level: dict[int, list[int]] = {}
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        k = bisect_left(levels, size)
        if k < len(levels):
            room = levels[k]
            stack = at_level[room]
            b = stack.pop()
            if not stack:
                del at_level[room], levels[k]
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i] = b
        room -= size
        free[b] = room
        if room:
            if room not in at_level:
                at_level[room] = []
                insort(levels, room)
            at_level[room].append(b)
    return bins, np.asarray(free, np.int64)


def _steps(capacity: int) -> tuple[range, list[int]]:
    """Parameters of the dual-feasible functions: k of the rounding ones, thresholds of the cutting ones."""
    return range(1, 21), sorted({capacity * j // 40 for j in range(1, 21)})


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the largest total over dual-feasible functions of the sizes."""
    if not len(sizes):
        return 0
    ks, cuts = _steps(capacity)
    x = sizes.astype(np.int64)
    best = -(-int(x.sum()) // capacity)
    for k in ks:
        up = (k + 1) * x
        total = int(np.where(up % capacity == 0, k * x, up // capacity * capacity).sum())
        best = max(best, -(-total // (k * capacity)))
    for cut in cuts:
        total = int(np.where(x > capacity - cut, capacity, np.where(x >= cut, x, 0)).sum())
        best = max(best, -(-total // capacity))
    return best


def corpus_lower_bound(items: DataFrame, size_col: str, capacity: int) -> DataFrame:
    """One row (n_items, volume, lower_bound): the same bound over all items, as one aggregation."""
    ks, cuts = _steps(capacity)
    x = F.col("x")
    sums = [F.sum("x").alias("v")]
    for k in ks:
        up = x * (k + 1)
        rounded = F.when(up % capacity == 0, x * k).otherwise(F.floor(up / capacity).cast("long") * capacity)
        sums.append(F.sum(rounded).alias(f"k{k}"))
    for cut in cuts:
        sums.append(F.sum(F.when(x > capacity - cut, capacity).when(x >= cut, x).otherwise(0)).alias(f"e{cut}"))
    total = items.select(F.col(size_col).cast("long").alias("x")).where("x > 0").agg(F.count("*").alias("n_items"), *sums)
    each = [F.ceil(F.col("v") / capacity)] + [F.ceil(F.col(f"k{k}") / (k * capacity)) for k in ks] + [F.ceil(F.col(f"e{c}") / capacity) for c in cuts]
    return total.select("n_items", F.coalesce("v", F.lit(0)).alias("volume"), F.coalesce(F.greatest(*each), F.lit(0)).alias("lower_bound"))


def _pack_groups(items: DataFrame, capacity: int, rnd: int) -> DataFrame:
    """Best-fit decreasing within each group; adds bin, free and the group's gap (bins above its bound)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], kind="stable", ignore_index=True)
        sizes = pdf["size"].to_numpy()
        bins, free = best_fit_decreasing(sizes, capacity)
        names = np.array([f"{rnd}-{pdf['group'].iloc[0]}-{b}" for b in range(len(free))], dtype=object)
        return pdf[["row", "id", "piece", "size"]].assign(bin=names[bins], free=free[bins], group=pdf["group"], gap=len(free) - lower_bound(sizes, capacity))

    kind = dict(items.dtypes)["id"]
    return items.groupBy("group").applyInPandas(run, f"row long, id {kind}, piece int, size int, bin string, free long, group int, gap int")


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, group_bins: int = GROUP_BINS, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(id_col, piece INT, size INT, bin STRING, round INT): where every piece of every item lies.

    Pieces count from 0. Rows that repeat an id, and all rows of a null id, are items of their own. A round
    packs each group; groups at their bound are done, and so are full bins of the others. The items in the
    other bins of groups with a gap are dealt to new groups and packed in the next round, which stands only
    if it needs fewer bins than they had; else the bins stay as they were and no further round runs.
    """
    kind = dict(items.select(F.col(id_col).alias("id")).dtypes)["id"]
    src = items.select(F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    empty = src.where("n = 0").select("id", F.lit(0).alias("piece"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("int").alias("round"))
    rows = stage(src.where("n > 0").withColumn("row", F.monotonically_increasing_id()), "items")
    full = rows.where(F.col("n") >= capacity).select(
        "id",
        F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / capacity).cast("int"))).alias("p"),
        "row",
    ).select("id", (F.col("p") - 1).cast("int").alias("piece"), F.lit(capacity).cast("int").alias("size"), F.concat(F.lit("full-"), F.col("row").cast("string"), F.lit("-"), F.col("p").cast("string")).alias("bin"), F.lit(0).alias("round"))
    pool = rows.where(F.col("n") % capacity > 0).select("row", "id", F.floor(F.col("n") / capacity).cast("int").alias("piece"), (F.col("n") % capacity).cast("int").alias("size"))
    done: list[DataFrame] = []
    before: tuple[DataFrame, int] | None = None  # the pool as it was packed, and in how many bins
    rnd = 0
    while True:
        total, count = pool.agg(F.sum("size"), F.count("*")).first()
        if not total:
            break
        rnd += 1
        groups = max(1, round(total / (capacity * group_bins)), -(-count // group_items))
        dealt = pool.withColumn("group", F.pmod(F.xxhash64("row", F.lit(rnd)), F.lit(groups)).cast("int"))
        packed = stage(_pack_groups(dealt, capacity, rnd), f"packed-{rnd}")
        if before and packed.agg(F.countDistinct("bin")).first()[0] >= before[1]:
            done.append(before[0])
            break
        named = packed.select("id", "piece", "size", "bin", F.lit(rnd).alias("round"))
        open_ = (F.col("gap") > 0) & (F.col("free") > 0)
        n_open, n_groups = packed.where(open_).agg(F.countDistinct("bin"), F.countDistinct("group")).first()
        if n_groups < 2:  # one group has nobody to exchange with
            done.append(named)
            break
        done.append(named.where(~open_))
        before = named.where(open_), n_open
        pool = packed.where(open_).select("row", "id", "piece", "size")
    schema = f"id {kind}, piece int, size int, bin string, round int"
    parts = [full, *done, empty]
    return reduce(DataFrame.unionByName, [p.select("id", "piece", "size", "bin", "round") for p in parts]).to(_schema(items.sparkSession, schema)).withColumnRenamed("id", id_col)


def _schema(spark, ddl: str):
    return spark.createDataFrame([], ddl).schema


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: n_items, volume, lower_bound, bins, gap, fill (volume over room of all bins)."""
    bins = packed.where("bin is not null").agg(F.countDistinct("bin").alias("bins"))
    bound = corpus_lower_bound(packed, "size", capacity)
    return bound.crossJoin(bins).select(
        "n_items", "volume", "lower_bound", "bins", (F.col("bins") - F.col("lower_bound")).alias("gap"), F.when(F.col("bins") > 0, F.col("volume") / (F.col("bins") * capacity)).alias("fill")
    )
