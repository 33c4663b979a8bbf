"""JSON manifests: scans with a declared schema, merging by priority, and publication in one step."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplegrid.sources.shared import exists, path_of

#: What a manifest of planned episodes holds.
EPISODES = "state string, seed bigint, episodes array<struct<id: bigint, variant: string, partition: string, leaks: map<string, double>>>, _corrupt string"


def manifests(spark: SparkSession, path: str, schema: str = EPISODES) -> DataFrame:
    """The JSON documents below a path, one a file, with ``file``; a document that does not fit the schema is an error when it is read."""
    found = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    broken = F.raise_error(F.concat(F.lit("not a manifest: "), F.col("_metadata.file_path")))
    sound = F.when(F.col("_corrupt").isNull(), F.col("_metadata.file_path")).otherwise(broken)
    return found.select(sound.alias("file"), *[c for c in found.columns if c != "_corrupt"]).where("file IS NOT NULL")


def episodes(found: DataFrame) -> DataFrame:
    """file, state, seed and a row for each episode of the manifests."""
    return found.select("file", "state", "seed", F.explode("episodes").alias("e")).select("file", "state", "seed", "e.*")


def by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of the parts with ``source`` (the part's number); of equal keys the row of the first part stays."""
    numbered = [p.withColumn("source", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("source"))).where("__n = 1").drop("__n")


def read(spark: SparkSession, path: str) -> dict | None:
    """A small manifest as it is; None if there is none."""
    if not exists(spark, path):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Replaces a manifest in one step: it is written aside and renamed, so a reader sees the old one or the new one, never a part.

    NaN and infinities are errors. If anything fails before the rename, the old manifest stays and nothing is left behind."""
    where, system = path_of(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}.tmp")
    try:
        _write(system, aside, json.dumps(manifest, indent=1, allow_nan=False, default=str))
        _swap(spark, system.makeQualified(aside), system.makeQualified(where))
    except BaseException:
        system.delete(aside, False)
        raise


def _write(system, path, text: str) -> None:
    out = system.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _swap(spark: SparkSession, aside, where) -> None:
    fs = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, where, options)
