"""Score maps found in folders: one scan over files of different schemas, keyed by map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields that a file of scores may hold, the suffix of the map each makes, and whether negative values count as none.
FIELDS = {"logits": ("logits", False), "balance": ("balance", True), "presence": ("presence", False), "expected": ("expected", True)}
_KEYS = {"hour": "timestamp_ntz", "entity": "bigint"}


def _schema(fields: dict[str, tuple[str, bool]]) -> str:
    return ", ".join([*[f"{k} {t}" for k, t in _KEYS.items()], *[f"{f} double" for f in fields]])


def below(spark: SparkSession, path: str, prefix: str = "", pattern: str = "*.parquet", fields: dict[str, tuple[str, bool]] = FIELDS) -> DataFrame:
    """map, hour, entity, score of all files below a path whose names match, keyed by ``prefix + folder / field``.

    The folder is that of the file. All files are one scan with a declared schema: a field that a file lacks is null there and makes no map."""
    found = spark.read.schema(_schema(fields)).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(path)
    folder = F.substring_index(F.substring_index(F.col("_metadata.file_path"), "/", -2), "/", 1)
    value: list[Column] = [F.struct(F.concat(F.lit(prefix), folder, F.lit(f"/{name}")).alias("map"), (F.when(F.col(f) < 0, 0.0).otherwise(F.col(f)) if positive else F.col(f)).alias("score")) for f, (name, positive) in fields.items()]
    out = found.select("hour", "entity", F.explode(F.array(*value)).alias("x")).where("x.score IS NOT NULL")
    return out.select("x.map", "hour", "entity", "x.score")


def together(spark: SparkSession, places: list[tuple[str, str]], pattern: str = "*.parquet") -> DataFrame:
    """The maps of several (prefix, path); a path may hold * and stands for the first folder in order that it matches, for none if there is none."""
    out = None
    for prefix, path in places:
        if "*" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            matched = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
            names = sorted(str(x.getPath().toString()) for x in matched or [])
            if not names:
                continue
            path = names[0]
        one = below(spark, path, prefix, pattern)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise FileNotFoundError(f"no map below {[p for _, p in places]}")
    return out


def described(maps: DataFrame, manifest: DataFrame) -> DataFrame:
    """The maps with what a manifest (map, ...) says of them; maps that it does not name are left out."""
    return maps.join(manifest, "map")
