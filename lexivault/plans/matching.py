"""Queries of matched groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexivault.operators import matching, metrics
from lexivault.plans import metrics as metric_queries
from lexivault.runtime import stage
from lexivault.sources.tables import table


COVARIATES = ["sex", "num_notes", "chars"]


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    return stage(metric_queries._covariates(spark, sf).select("key", *COVARIATES, F.col("in_train").alias("treated"), F.lit("all").alias("stratum")), "arms")


def matched_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Patients of the train split with their nearest other patients."""
    return matching.match(_arms(spark, sf), ["stratum"], "key", 100, COVARIATES)


def matched_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of means before and after matching."""
    arms = _arms(spark, sf)
    pairs = stage(matching.match(arms, ["stratum"], "key", 100, COVARIATES), "pairs")
    kept = pairs.select(F.explode(F.array("treated_id", "control_id")).alias("key"))
    before, after = metrics.mean_difference(arms, "treated", COVARIATES), metrics.mean_difference(arms.join(kept, "key", "left_semi"), "treated", COVARIATES)
    return before.withColumnRenamed("smd", "before").join(after.withColumnRenamed("smd", "after"), "measure")


def propensity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted log odds of each patient of being of the train split, over all patients with complete covariates."""
    return matching.propensity(_arms(spark, sf), COVARIATES).select("key", "treated", F.round("logit", 4).alias("logit"))


def _pools(spark: SparkSession, sf: str) -> DataFrame:
    """Patients with a truth value of each diagnosis, in the pool of that value and of the split of their generations."""
    g = table(spark, sf, "generations").where("patient_id is not null and ground_truth is not null and eval_split is not null").select(F.lower("patient_id").alias("key"), "eval_split", F.explode("ground_truth").alias("diagnosis", "present")).where("present is not null").distinct()
    group = F.concat(F.when(F.col("present"), "pos").otherwise("neg"), F.when(F.col("eval_split") == "train", "_train").otherwise("_nontrain"))
    return g.select("diagnosis", group.alias("group"), "key").join(metric_queries._covariates(spark, sf).select("key", *COVARIATES), "key")


def cohort_pools(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the four pools of each diagnosis."""
    return _pools(spark, sf).groupBy("diagnosis").agg(*[F.count_if(F.col("group") == g).alias(g) for g in matching.GROUPS])


def matched_cohort(spark: SparkSession, sf: str, n: int = 8) -> DataFrame:
    """n patients of each of the four groups of each diagnosis."""
    return matching.four_groups(_pools(spark, sf), "diagnosis", "key", n, COVARIATES)


def matched_summary(spark: SparkSession, sf: str, n: int = 8) -> DataFrame:
    """What the pools of each diagnosis held and what the design took: nothing where a positive pool is too small."""
    made = matched_cohort(spark, sf, n).groupBy("diagnosis").agg(*[F.count_if(F.col("group") == g).alias(f"final_{g}") for g in matching.GROUPS], F.count("*").alias("total_records"))
    out = cohort_pools(spark, sf).join(made, "diagnosis", "left")
    return out.select("diagnosis", F.col("pos_train").alias("pos_train_avail"), F.col("pos_nontrain").alias("pos_nontrain_avail"), *[F.coalesce(c, F.lit(0)).alias(c) for c in (*[f"final_{g}" for g in matching.GROUPS], "total_records")])


_POOLS = metric_queries._COVARIATES + """, p as (
    select distinct e.key as diagnosis, case when e.value then 'pos' else 'neg' end || case when eval_split = 'train' then '_train' else '_nontrain' end as grp, key
    from (select lower(patient_id) as key, eval_split, unnest(map_entries(ground_truth)) as e from generations where patient_id is not null and ground_truth is not null and eval_split is not null) where e.value is not null
)"""
_SQL = {"cohort_pools": f"with {_POOLS} select diagnosis, " + ", ".join(f"count_if(grp = '{g}') as {g}" for g in matching.GROUPS) + " from p join v using (key) group by diagnosis"}
_ROWS_ONLY = ("matched_pairs", "matched_balance", "propensity_scores", "matched_cohort", "matched_summary")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in (*_SQL, *_ROWS_ONLY)}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
