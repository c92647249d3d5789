"""Matched groups: propensity by logistic regression, nearest neighbours one to one without replacement.

Each stratum has its own model. Its arms are capped before matching (a parameter of the design, as a matched cohort
needs n pairs, not all), so a stratum is a bounded group, and all strata are fitted and matched in one pass. Matching is greedy in a
seeded order of the smaller arm, nearest first on the logit, ties by id; rows with a null covariate take no part.
A stratum with an arm below ``least``, or whose model can't be fitted, has no pairs. What pairs don't fill is
topped up at random from the whole pools, which for such a stratum means a random sample.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivault.functions.text import seeded_order
from lexivault.operators.review import require_unique
from lexivault.operators.selection import sample_per_stratum
from lexivault.runtime import stage


def propensity(df: DataFrame, covariates: Sequence[str], treated: str = "treated") -> DataFrame:
    """Adds ``logit`` of being treated, by a logistic regression on the covariates (of rows without nulls)."""
    full = df.dropna(subset=[*covariates, treated]).withColumn("label", F.col(treated).cast("double"))
    vectors = VectorAssembler(inputCols=list(covariates), outputCol="features").transform(full)
    model = LogisticRegression(maxIter=50, standardization=True).fit(vectors)
    return model.transform(vectors).withColumn("logit", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction", "label")


def greedy_pairs(small: Sequence[tuple[str, float]], large: Sequence[tuple[str, float]]) -> list[tuple[str, str]]:
    """Pairs (of small, of large) in the order of small: the nearest free logit, the lower id of two equally near."""
    free = sorted((x, i) for i, x in large)
    out = []
    for name, x in small:
        if not free:
            break
        at = bisect_left(free, (x, ""))
        best = min((abs(free[k][0] - x), free[k][1], k) for k in (at - 1, at) if 0 <= k < len(free))
        # All of the same logit as the nearest: the lowest id comes first in order.
        k = bisect_left(free, (free[best[2]][0], ""))
        out.append((name, free.pop(k)[1]))
    return out


def logits(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray | None:
    """The fitted log odds of y, by Newton's method on standardised columns; None where they can't be fitted."""
    if not len(y) or y.min() == y.max():
        return None
    scale = x.std(axis=0)
    z = np.column_stack((np.ones(len(y)), (x - x.mean(axis=0)) / np.where(scale > 0, scale, 1)))
    w = np.zeros(z.shape[1])
    penalty = np.diag([0.0] + [ridge] * x.shape[1]) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty
        try:
            step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        except np.linalg.LinAlgError:
            return None
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return z @ w if np.isfinite(w).all() else None


def match(df: DataFrame, strata: Sequence[str], id_col: str, n: int, covariates: Sequence[str], treated: str = "treated", seed: int = 42, least: int = 5, cap_treated: int | None = None, cap_control: int | None = None) -> DataFrame:
    """(strata, treated_id, control_id): at most n pairs of each stratum; ``treated`` is a boolean column.

    Arms are capped at random at max(1000, 20 n) and max(2000, 40 n) rows.
    """
    caps = (cap_treated or max(1000, 20 * n), cap_control or max(2000, 40 * n))
    arms = [sample_per_stratum(df.where(F.col(treated) == side), list(strata), id_col, cap, seed) for side, cap in zip((True, False), caps)]
    values = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]
    rows = arms[0].unionByName(arms[1]).select(*strata, F.col(id_col).cast("string").alias("id"), F.col(treated).alias("treated"), seeded_order(seed, id_col).alias("o"), *values)
    schema = ", ".join(f"{s} {t}" for s, t in rows.select(*strata).dtypes) + ", treated_id string, control_id string"
    names = [f"x{i}" for i in range(len(covariates))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["treated"].value_counts()
        full = pdf.dropna(subset=names).sort_values("o")
        pairs: list[tuple[str, str]] = []
        y = full["treated"].to_numpy(bool)
        odds = logits(full[names].to_numpy(float), y.astype(float)) if min(sizes.get(True, 0), sizes.get(False, 0)) >= least else None
        if odds is not None:
            ids = full["id"].to_numpy()
            sides = [list(zip(ids[y == t], odds[y == t].tolist())) for t in (True, False)]
            flip = len(sides[0]) > len(sides[1])
            pairs = greedy_pairs(sides[1], sides[0]) if flip else greedy_pairs(sides[0], sides[1])
            pairs = [(b, a) for a, b in pairs] if flip else pairs
        out = pd.DataFrame(pairs[:n], columns=["treated_id", "control_id"])
        for i, s in enumerate(strata):
            out.insert(i, s, pdf[s].iloc[0])
        return out

    return rows.groupBy(*strata).applyInPandas(run, schema)


def _filled(chosen: DataFrame, pool: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: int) -> DataFrame:
    """(keys, id_col, how) at most n a key: those chosen (keys, id_col, how), then random ones of the pool; only n of a key leave each task."""
    own = [*keys, id_col]
    rest = pool.select(*own).distinct().join(chosen.select(*own), own, "left_anti").withColumn("how", F.lit("filled"))
    both = chosen.select(*own, "how").withColumn("_last", F.lit(0)).unionByName(rest.withColumn("_last", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("_last", seeded_order(seed, id_col), id_col)
    return both.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).select(*own, "how")


def matched_arms(df: DataFrame, strata: Sequence[str], id_col: str, n: int, covariates: Sequence[str], treated: str = "treated", seed: int = 42, **more: int) -> DataFrame:
    """(strata, treated, id_col, how): n of each arm of each stratum, or all there are: 'matched' ones first, then 'filled' at random."""
    pairs = stage(match(df, strata, id_col, n, covariates, treated, seed, **more), "pairs")
    both = pairs.select(*strata, F.explode(F.array(F.struct(F.lit(True).alias(treated), F.col("treated_id").alias(id_col)), F.struct(F.lit(False).alias(treated), F.col("control_id").alias(id_col)))).alias("x")).select(*strata, "x.*", F.lit("matched").alias("how"))
    pool = df.where(F.col(treated).isNotNull() & F.col(id_col).isNotNull()).select(*strata, treated, F.col(id_col).cast("string").alias(id_col))
    return _filled(both, pool, [*strata, treated], id_col, n, seed)


GROUPS = ("pos_train", "pos_nontrain", "neg_train", "neg_nontrain")


def four_groups(pools: DataFrame, stratum: str, id_col: str, n: int, covariates: Sequence[str], seed: int = 42, **more: int) -> DataFrame:
    """(stratum, group, id_col, how): n of each of four groups of each stratum, no id in two groups of one.

    pools: (stratum, group, id_col, covariates), group one of GROUPS; an id may be in several pools. Strata with fewer than
    n in a positive pool are left out. Positive train ones are matched with positive others, and each of the two
    then with the negatives of its side. An id in several groups stays in the first of GROUPS; groups are
    then filled from their pools in that order with ids that no group has. Raises an error if an id is left in two.
    """
    own = [stratum, id_col]
    pools = pools.where(F.col(id_col).isNotNull()).withColumn(id_col, F.col(id_col).cast("string")).dropDuplicates([stratum, "group", id_col])
    sizes = pools.groupBy(stratum).agg(*[F.count_if(F.col("group") == g).alias(g) for g in GROUPS])
    pools = stage(pools.join(sizes.where((F.col(GROUPS[0]) >= n) & (F.col(GROUPS[1]) >= n)).select(stratum), stratum, "left_semi"), "pools")
    side = lambda group, flag: pools.where(F.col("group") == group).withColumn("treated", F.lit(flag))
    positive = stage(matched_arms(side("pos_train", True).unionByName(side("pos_nontrain", False)), [stratum], id_col, n, covariates, "treated", seed, **more), "positive")
    arms = [positive.where("treated").select(*own, "how"), positive.where("not treated").select(*own, "how")]
    for pos, neg, chosen in (("pos_train", "neg_train", arms[0]), ("pos_nontrain", "neg_nontrain", arms[1])):
        both = side(pos, True).join(chosen.select(*own), own, "left_semi").unionByName(side(neg, False))
        arms.append(matched_arms(both, [stratum], id_col, n, covariates, "treated", seed, **more).where("not treated").select(*own, "how"))
    tagged = [arm.withColumn("_i", F.lit(i)) for i, arm in enumerate(arms)]
    chosen = stage(reduce(DataFrame.unionByName, tagged).groupBy(*own).agg(F.min_by("how", "_i").alias("how"), F.min("_i").alias("_i")), "chosen")
    done = None
    for i, group in enumerate(GROUPS):
        others = chosen.where(F.col("_i") != i).select(*own)
        taken = others if done is None else others.unionByName(done.select(*own))
        free = pools.where(F.col("group") == group).join(taken, own, "left_anti")
        filled = stage(_filled(chosen.where(F.col("_i") == i), free, [stratum], id_col, n, seed).select(stratum, F.lit(group).alias("group"), id_col, "how"), group)
        done = filled if done is None else done.unionByName(filled)
    return require_unique(done, own)
