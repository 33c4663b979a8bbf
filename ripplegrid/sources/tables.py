"""Scans and sinks: declared schemas, verified files, resumable and guarded writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegrid.schema import TABLES
from ripplegrid.sources.shared import path_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its declared schema; only the columns that are used are read."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def days(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table partitioned by day: filters on ``day`` skip whole folders."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def discovered(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """The files below a folder, with the stem of each as ``name``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), "length")


def hashed(spark: SparkSession, path: str) -> DataFrame:
    """name, sha256 of every file below a folder; the name is the path from there."""
    where, system = path_of(spark, path)
    root = system.makeQualified(where).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.substr("path", F.lit(len(root) + 2)).alias("name"), F.sha2("content", 256).alias("sha256"))


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The manifest (name, sha256) with ``intact``: whether the file of that name below the folder has that hash; false if there is none."""
    seen = hashed(spark, path).withColumnRenamed("sha256", "found")
    return manifest.join(seen, "name", "left").select("name", "sha256", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("intact"))


def measured(rows: DataFrame, sensors: DataFrame, first: str, last: str, every: str, values: list[str]) -> DataFrame:
    """ts, sensor and the values at every step from first to last for all sensors (sensor); a step without a row, or with a value that is null or NaN, is an error when it is read.

    rows has ts (a step's beginning) and sensor, at most one row each."""
    steps = sensors.select("sensor", F.explode(F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval {every})")).alias("ts"))
    inside = rows.where(F.col("ts").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))).select("ts", "sensor", *values)
    missing = lambda c: F.raise_error(F.concat(F.lit(f"no {c} at "), F.col("ts").cast("string"), F.lit(" of "), F.col("sensor").cast("string")))
    return steps.join(inside, ["ts", "sensor"], "left").select("ts", "sensor", *[F.when(F.col(c).isNull() | F.isnan(c), missing(c)).otherwise(F.col(c)).alias(c) for c in values])


def write_new(df: DataFrame, path: str) -> None:
    """Writes Parquet; fails if something is there."""
    df.write.mode("errorifexists").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Writes a small report as JSON lines; a NaN or an infinity in it is an error."""
    numbers = [c for c, kind in df.dtypes if kind in ("double", "float")]
    guard = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns]
    df.select(*guard).coalesce(1).write.mode("errorifexists").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Writes a small evaluation table as one CSV with a header."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """What write_table() has written, with its declared schema; a line that does not fit it, or another header, is an error."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def resume(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is planned and not done yet."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")
