"""Readers and writers of line-JSON and CSV, resumable and atomic writing.

Schemas are always given, so no file is read to infer one. Spark splits files itself; no line is lost at a
split's edge.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_lines(spark: SparkSession, path: str, schema: T.StructType, malformed: str = "fail") -> DataFrame:
    """Line-JSON with blank lines left out. Malformed lines: 'fail' stops, 'drop' leaves them out, 'keep' has them as rows of nulls with the line in _corrupt."""
    if malformed == "keep":
        kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        return spark.read.schema(kept).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return spark.read.schema(schema).json(path, mode={"fail": "FAILFAST", "drop": "DROPMALFORMED"}[malformed])


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, value): every physical line, blank and malformed ones counted, numbered from 0 in the order of files and lines.

    Done once, at ingest only, as lines pass through Python; later steps carry row_idx as a column. zipWithIndex counts lines per split first,
    then numbers them, in two passes without a shuffle.
    """
    lines = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0]["value"]))
    return spark.createDataFrame(lines, "row_idx long, value string")


def parse_lines(numbered: DataFrame, schema: T.StructType) -> DataFrame:
    """Numbered lines as columns; lines that don't parse keep their number, are rows of nulls and stand as they are in _corrupt.

    A blank line has nulls throughout, so all lines can be written back at their places.
    """
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return numbered.select("row_idx", F.when(F.trim("value") != "", parsed).alias("r")).select("row_idx", "r.*")


def peek(line: str, key: str) -> Column:
    """One field of a JSON line without parsing the rest, to filter lines before they are parsed."""
    return F.get_json_object(line, f"$.{key}")


def read_table(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """CSV with a header; quotes are doubled inside quoted values. Large files are split between tasks unless
    ``multiline`` says that quoted values may span lines: then each file is read by one task."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=multiline, escape='"')


def write_table(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """CSV with a header and the columns in the given order."""
    df.select(*columns).write.mode(mode).csv(path, header=True, escape='"')


def named_columns(df: DataFrame, suffix: str) -> Column:
    """A map of the columns that end with suffix, named without it."""
    names = [c for c in df.columns if c.endswith(suffix)]
    parts = [x for c in names for x in (F.lit(c[: -len(suffix)]), F.col(f"`{c}`"))]
    return F.create_map(*parts) if parts else F.create_map().cast("map<string,boolean>")


def partition_filter(df: DataFrame, **values: list[str] | None) -> DataFrame:
    """Rows of the wanted partition values; on a partitioned folder only those files are listed and read."""
    for column, wanted in values.items():
        if wanted:
            df = df.where(F.col(column).isin(*wanted))
    return df


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _file_system(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_done(spark: SparkSession, path: str, **facts: object) -> None:
    """Mark a dataset as complete: a small file beside it that says what it was made from."""
    _put(spark, f"{path.rstrip('/')}.done", json.dumps(facts, sort_keys=True))


def is_done(spark: SparkSession, path: str, **facts: object) -> bool:
    """Whether a dataset is marked as complete and was made from just these facts."""
    fs, where = _file_system(spark, f"{path.rstrip('/')}.done")
    if not fs.exists(where):
        return False
    return json.loads("\n".join(r[0] for r in spark.read.text(where.toString()).collect()) or "{}") == json.loads(json.dumps(facts))


def write_summary(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one JSON file, a list of objects; more than ``most`` rows are refused, never cut."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a summary of more than {most} rows; write a dataset instead")
    _put(df.sparkSession, path, "[" + ",\n".join(r[0] for r in rows) + "]\n")


def create_table(df: DataFrame, name: str) -> None:
    """A catalog table made anew from a query, in place of one of that name."""
    if not re.fullmatch(r"\w+(\.\w+)*", name):
        raise ValueError("a table's name is letters, digits and _, with dots between its parts")
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def write_snapshot(df: DataFrame, root: str, name: str) -> str:
    """A complete new version of a dataset under root, made current by one rename of a small pointer file; readers see the old or the new one."""
    if not re.fullmatch(r"[\w-]+", name):
        raise ValueError("a name is letters, digits, - and _")
    version = f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(root).getFileSystem(conf)
    fresh, current = path(f"{root}/.{version}.tmp"), path(f"{root}/{name}.current")
    out = fs.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), conf)
    over = context.getClass().getClassLoader().loadClass("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
    options = df.sparkSession.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = next(o for o in over if o.toString() == "OVERWRITE")
    context.rename(fs.makeQualified(fresh), fs.makeQualified(current), options)
    return version


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current version."""
    version = spark.read.text(f"{root}/{name}.current").first()[0]
    return spark.read.parquet(f"{root}/{version}")


def append_audit(df: DataFrame, path: str, by: str, mode: str = "append") -> None:
    """An audit dataset partitioned by a column, appended to or replaced for the values at hand."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
