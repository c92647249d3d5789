"""Session, scratch tables and partition helpers shared by all operators.

Nothing here depends on the data: the scratch folder is the one the cluster names in
``spark.checkpoint.dir`` (shared by all executors), and only where that is unset, as in
tests, a local one is chosen.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lexivault", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a local one where unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lexivault-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _jvm_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _application_dir(spark: SparkSession) -> str:
    """The application's own folder below the scratch folder; the driver's JVM removes it when it ends."""
    path = f"{scratch_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    fs, where = _jvm_path(spark, path)
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables staged inside the block at its end; consume (write, collect) results inside it.

    Without such a block staged tables stay until the application ends, as lazy results still read them.
    """
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            fs, where = _jvm_path(spark, path)
            fs.delete(where, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the scratch folder and return a reader of it.

    Cuts the lineage and survives the loss of executors: the files are complete, compressed and
    shared. Unlike ``checkpoint()`` the plan behind ``df`` runs exactly once. Removed at the end of the
    enclosing ``scratch`` block, else of the application.
    """
    spark = df.sparkSession
    path = f"{_application_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Plan nodes that keep the partitions of what they read.
_NARROW = frozenset(("Project", "Filter", "Union", "Generate", "SubqueryAlias", "View", "SerializeFromObject", "DeserializeToObject", "Expand"))


def _scans_only(plan) -> bool:
    """Whether a logical plan only reads, filters and projects, so that its partitions are those of its input files."""
    children = plan.children()
    return not children.size() or plan.nodeName() in _NARROW and all(_scans_only(children.apply(i)) for i in range(children.size()))


def spread(df: DataFrame) -> DataFrame:
    """Give a Python-heavy step at least one partition per core; a no-op on inputs of many splits.

    A table of one small file is read by one task. Repartitioning costs a shuffle of the rows, so it is
    done only where a scan has fewer splits than the session has cores. The plan is looked at, never run:
    what was shuffled already has the partitions adaptive execution chose and stays as it is.
    """
    if not _scans_only(df._jdf.queryExecution().optimizedPlan()):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def hash_sample(df: DataFrame, text_col: str, n: int, usable: Column | None = None, total: int | None = None) -> DataFrame:
    """About n rows of different texts, at most n, chosen by the texts' hashes and so the same on every run.

    Only rows below a hash threshold leave the scan, and repeated texts are collapsed before the shuffle,
    so what reaches the driver is bounded by n, not by rows or tasks. The threshold is set from the number
    of all rows, which needs no column; ``usable`` says which of them may be taken (fewer than n come out
    where less than half of the rows are usable). A caller that knows that number gives ``total``.
    """
    total = df.count() if total is None else total
    kept = F.col(text_col).isNotNull() if usable is None else F.col(text_col).isNotNull() & usable
    hashed = df.where(kept).withColumn("_hash", F.xxhash64(text_col))
    if total > 2 * n:
        hashed = hashed.where(F.col("_hash") < F.lit(int(-(1 << 63) + (1 << 64) * (2 * n / total))))
    return hashed.dropDuplicates(["_hash"]).orderBy("_hash").limit(n).drop("_hash")
