"""Disclosure metrics: confusion tallies, rates with intervals, agreement, balance of groups.

Tallies are plain counts, so partial sums of any split of the rows add up; rates are always computed from
tallies, never averaged. Zero denominators give null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def confusion(df: DataFrame, keys: Sequence[str], truth: str = "truth", mention: str = "mention") -> DataFrame:
    """(keys, n_records, n_mentioned, n_mention_known, tp, fp, fn, tn); truth and mention are booleans or null.

    Only rows whose truth and mention are known are among the four cells.
    """
    t, m = F.col(truth), F.col(mention)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_records"),
        F.count_if(m).alias("n_mentioned"),
        F.count_if(m.isNotNull()).alias("n_mention_known"),
        F.count_if(t & m).alias("tp"),
        F.count_if(~t & m).alias("fp"),
        F.count_if(t & ~m).alias("fn"),
        F.count_if(~t & ~m).alias("tn"),
    )


def pooled(tallies: DataFrame, keys: Sequence[str], over: str, name: str = "Average") -> DataFrame:
    """The tallies and, for each of the other keys, their sums over one key under the given name."""
    rest = [k for k in keys if k != over]
    counts = [c for c in tallies.columns if c not in keys]
    total = tallies.groupBy(*rest).agg(*[F.sum(c).alias(c) for c in counts]).withColumn(over, F.lit(name))
    return tallies.unionByName(total.select(*tallies.columns))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def rates(tallies: DataFrame) -> DataFrame:
    """Adds positives and negatives, ppv, mention_rate, prevalence, tpr, fpr and auroc of a binary score with its interval."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    pos, neg = tp + fn, fp + tn
    auroc = F.when((pos > 0) & (neg > 0), (tp * tn + 0.5 * (tp * fp + fn * tn)) / (pos * neg))
    q1, q2 = F.col("auroc") / (2 - F.col("auroc")), 2 * F.col("auroc") ** 2 / (1 + F.col("auroc"))
    a2 = F.col("auroc") ** 2
    variance = (F.col("auroc") * (1 - F.col("auroc")) + (pos - 1) * (q1 - a2) + (neg - 1) * (q2 - a2)) / (pos * neg)
    error = F.lit(Z95) * F.sqrt(F.greatest(variance, F.lit(0.0)))
    return (
        tallies.withColumn("n_positive", F.col("tp") + F.col("fn"))
        .withColumn("n_negative", F.col("fp") + F.col("tn"))
        .withColumn("ppv", _ratio(tp, tp + fp))
        .withColumn("mention_rate", _ratio(F.col("n_mentioned").cast("double"), F.col("n_mention_known")))
        .withColumn("prevalence", _ratio(pos, pos + neg))
        .withColumn("tpr", _ratio(tp, pos))
        .withColumn("fpr", _ratio(fp, neg))
        .withColumn("auroc", auroc)
        .withColumn("auroc_lo", F.greatest(F.col("auroc") - error, F.lit(0.0)))
        .withColumn("auroc_hi", F.least(F.col("auroc") + error, F.lit(1.0)))
        # greatest and least skip nulls: without an area there is no interval.
        .withColumn("auroc_lo", F.when(F.col("auroc").isNotNull(), F.col("auroc_lo")))
        .withColumn("auroc_hi", F.when(F.col("auroc").isNotNull(), F.col("auroc_hi")))
    )


def operating_point(rated: DataFrame, tolerance: float = 5e-3) -> DataFrame:
    """Adds auroc_point, the area under the lines through (fpr, tpr), and whether it agrees with auroc within the tolerance."""
    point = (F.col("tpr") + 1 - F.col("fpr")) / 2
    return rated.withColumn("auroc_point", point).withColumn("consistent", F.abs(F.col("auroc_point") - F.col("auroc")) <= tolerance)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * out


def beta_quantile(p: float, a: float, b: float) -> float:
    """Bisection on the incomplete beta function."""
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _incomplete_beta(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def exact_interval(k: int, n: int, alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Clopper-Pearson interval of k of n; null without cases, 0 and 1 at the ends."""
    if not n:
        return None, None
    return (0.0 if k == 0 else beta_quantile(alpha / 2, k, n - k + 1)), (1.0 if k == n else beta_quantile(1 - alpha / 2, k + 1, n - k))


def with_exact_interval(df: DataFrame, k: str, n: str, name: str, alpha: float = 0.05) -> DataFrame:
    """Adds name_lo and name_hi. Meant for tallies; equal (k, n) of a batch are computed once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name}_lo double, {name}_hi double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[int, int], tuple[float | None, float | None]] = {}
        for batch in batches:
            pairs = [(int(a), int(b)) for a, b in zip(batch[k].fillna(0), batch[n].fillna(0))]
            for p in set(pairs) - known.keys():
                known[p] = exact_interval(*p, alpha)
            yield batch.assign(**{f"{name}_lo": [known[p][0] for p in pairs], f"{name}_hi": [known[p][1] for p in pairs]})

    return df.mapInPandas(run, schema)


def kappa(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, n, agreement, kappa) of two labels; rows with a null label are left out, kappa is null where chance agreement is 1."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    total = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_n")).otherwise(0)).alias("_same"))
    left = cells.groupBy(*keys, F.col("_a").alias("_l")).agg(F.sum("_n").alias("_x"))
    right = cells.groupBy(*keys, F.col("_b").alias("_l")).agg(F.sum("_n").alias("_y"))
    chance = left.join(right, [*keys, "_l"]).groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_y")).alias("_chance"))
    both = total.join(chance, list(keys), "left") if keys else total.crossJoin(chance)
    po, pe = F.col("_same") / F.col("n"), F.coalesce("_chance", F.lit(0)) / (F.col("n") * F.col("n"))
    return both.select(*keys, "n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def group_stats(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(keys, n, and mean, median, std and missing of each measure)."""
    aggs = [F.count("*").alias("n")]
    for m in measures:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.percentile(m, F.lit(0.5)).alias(f"{m}_median"), F.stddev_samp(m).alias(f"{m}_std"), F.count_if(F.col(m).isNull()).alias(f"{m}_missing")]
    return df.groupBy(*keys).agg(*aggs)


def metric_pivot(df: DataFrame, rows: str, columns: str, metrics: dict[str, Column], most: int = 1000) -> DataFrame:
    """One row per value of ``rows``, one column value_metric per value of ``columns`` and metric; values in order, null as 'null'.

    The values are read from the data; more than ``most`` are refused, as they become columns.
    """
    named = df.withColumn("_c", F.coalesce(F.col(columns).cast("string"), F.lit("null")))
    values = sorted(r[0] for r in named.select("_c").distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError(f"more than {most} values of {columns}")
    return named.groupBy(rows).pivot("_c", values).agg(*[m.alias(name) for name, m in metrics.items()])


def mean_difference(df: DataFrame, arm: str, measures: Sequence[str]) -> DataFrame:
    """(measure, smd): standardised difference of means of two arms (a boolean); null with fewer than two values in an arm, 0 without spread."""
    aggs = []
    for m in measures:
        for side, cond in (("t", F.col(arm)), ("c", ~F.col(arm))):
            v = F.when(cond, F.col(m).cast("double"))
            aggs += [F.count(v).alias(f"{m}_{side}n"), F.avg(v).alias(f"{m}_{side}m"), F.stddev_samp(v).alias(f"{m}_{side}s")]
    row = df.agg(*aggs)
    each = []
    for m in measures:
        c = lambda x, m=m: F.col(f"{m}_{x}")
        spread = F.sqrt((c("ts") ** 2 + c("cs") ** 2) / 2)
        smd = F.when((c("tn") < 2) | (c("cn") < 2), F.lit(None).cast("double")).when(spread == 0, 0.0).otherwise((c("tm") - c("cm")) / spread)
        each.append(F.struct(F.lit(m).alias("measure"), smd.alias("smd")))
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")
