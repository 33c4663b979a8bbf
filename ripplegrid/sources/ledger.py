"""A table by day that can be brought up to date: a ledger of hashes says which days are whole and made of the present input.

The table is partitioned by day. Its ledger (a manifest that is replaced in one step) has a row a day: the hash of the rows
that the day was made from and the hash of the rows that were written. Before a day is skipped both are computed again:
a day whose input has changed is rewritten and no other; a day whose rows are not what the ledger says is an error, or is
rewritten if that is asked for. Days are written in batches, each entered in the ledger after it has been written and read
back, so what a killed run has done is kept, and files that it left without an entry are overwritten.

Hashes of days are counts, sums and exclusive ors of row hashes, so they need one aggregation with partial sums and no order. The driver
holds a row a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegrid.sources import manifest
from ripplegrid.sources.shared import exists


def digests(df: DataFrame, day: str) -> DataFrame:
    """day, rows, hash: the same for the same rows in any order; nulls count, and so does where they stand."""
    others = sorted(c for c in df.columns if c != day)
    row = F.xxhash64(*[x for c in others for x in (F.col(c), F.col(c).isNull())]) if others else F.lit(0).cast("bigint")
    by = df.withColumn("__h", row).groupBy(day).agg(F.count("*").alias("rows"), F.bit_xor("__h").alias("x"), F.sum(F.col("__h").cast("decimal(38,0)")).alias("s"))
    return by.select(day, "rows", F.sha2(F.concat_ws("|", "rows", "x", F.col("s").cast("string")), 256).alias("hash"))


def _by_day(rows: DataFrame, day: str) -> dict[str, tuple[int, str]]:
    return {str(r[day]): (r["rows"], r["hash"]) for r in digests(rows, day).collect()}  # a row a day


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at path with the columns of ``like``; filters on the day skip whole folders."""
    return spark.read.schema(like.schema).parquet(f"{path}/data").select(*like.columns)


def update(source: DataFrame, path: str, day: str, settings: str, made: Callable[[DataFrame], DataFrame] = lambda df: df, batch: int = 64, rewrite_damaged: bool = False) -> list[str]:
    """Brings the table at path to what ``made`` makes of the source, day by day, and returns the days that were written.

    made must keep ``day`` and make a day of that day's rows alone. A table without a ledger, a ledger of other settings, a ledger with days that the source
    has no longer, and (unless rewrite_damaged) rows that differ from the ledger's hash are errors; nothing is touched then."""
    spark, out = source.sparkSession, made(source)
    ledger = manifest.read(spark, f"{path}/ledger.json")
    if ledger is None:
        if exists(spark, f"{path}/data"):
            raise FileExistsError(f"a table without a ledger: {path}")
        ledger = {"settings": settings, "state": "running", "days": []}
    if ledger["settings"] != settings:
        raise ValueError(f"made with other settings: {ledger['settings']}")
    entries = {e["day"]: e for e in ledger["days"]}
    wanted = _by_day(source, day)
    if gone := sorted(set(entries) - set(wanted)):
        raise ValueError(f"days that are no longer there: {gone[:5]}")
    whole = _by_day(stored(spark, path, out).where(F.col(day).cast("string").isin(list(entries))), day) if entries else {}
    damaged = sorted(d for d, e in entries.items() if whole.get(d, (0, ""))[1] != (e["output"] or ""))
    if damaged and not rewrite_damaged:
        raise ValueError(f"days that are not what the ledger says: {damaged[:5]}")
    stale = sorted(d for d, (_, hash_) in wanted.items() if d in damaged or entries.get(d, {}).get("input") != hash_)
    for start in range(0, len(stale), batch):
        some = stale[start : start + batch]
        rows = made(source.where(F.col(day).cast("string").isin(some)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(f"{path}/data")
        back = _by_day(stored(spark, path, out).where(F.col(day).cast("string").isin(some)), day)
        entries |= {d: {"day": d, "input": wanted[d][1], "output": back.get(d, (0, ""))[1], "rows": back.get(d, (0, ""))[0]} for d in some}
        manifest.publish(spark, f"{path}/ledger.json", ledger | {"days": [entries[d] for d in sorted(entries)]})
    manifest.publish(spark, f"{path}/ledger.json", {"settings": settings, "state": "complete", "days": [entries[d] for d in sorted(entries)]})
    return stale


def entries(spark: SparkSession, path: str) -> DataFrame:
    """day, input, output, rows of the ledger."""
    schema = "settings string, state string, days array<struct<day: string, input: string, output: string, rows: bigint>>"
    return spark.read.schema(schema).option("multiLine", True).json(f"{path}/ledger.json").select("state", F.explode("days").alias("d")).select("d.*", "state")
