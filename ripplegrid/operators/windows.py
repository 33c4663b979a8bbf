"""Windows along time that never cross an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def causal(df: DataFrame, episode: list[str], order: list[str], value: str, width: int = 12) -> DataFrame:
    """df with step (from 0) and ``window``, the last ``width`` values up to each step; only full windows are kept."""
    w = Window.partitionBy(*episode).orderBy(*order)
    out = df.withColumn("step", F.row_number().over(w) - 1).withColumn("window", F.collect_list(value).over(w.rowsBetween(1 - width, 0)))
    return out.where(F.col("step") >= width - 1)


def difference(df: DataFrame, episode: list[str], order: list[str], value: str, valid: str) -> DataFrame:
    """df with ``change`` and ``change_valid``: both steps must be valid, the first step of an episode is not."""
    w = Window.partitionBy(*episode).orderBy(*order)
    ok = F.coalesce(F.col(valid) & F.lag(valid).over(w), F.lit(False))
    return df.withColumn("change_valid", ok).withColumn("change", F.when(F.col("change_valid"), F.col(value) - F.lag(value).over(w)).otherwise(0.0))


def rolling_mean(df: DataFrame, episode: list[str], order: list[str], value: str, width: int = 6) -> DataFrame:
    """df with ``rolling``: the mean of the last ``width`` values, null before there are as many."""
    w = Window.partitionBy(*episode).orderBy(*order).rowsBetween(1 - width, 0)
    return df.withColumn("rolling", F.when(F.count(value).over(w) == width, F.avg(value).over(w)))


def resample(df: DataFrame, ts: str, keys: list[str], value: str, every: str = "1 hour") -> DataFrame:
    """keys, slot, mean, last (by time and the other columns given in df as ``seq``), n of tumbling windows that hold rows."""
    slot = F.window(F.col(ts), every)
    return df.groupBy(*keys, slot.alias("w")).agg(F.avg(value).alias("mean"), F.max_by(value, F.struct(ts, "seq")).alias("last"), F.count("*").alias("n")).select(*keys, F.col("w.start").cast("timestamp_ntz").alias("slot"), "mean", "last", "n")


def spread_sample(df: DataFrame, episode: list[str], order: list[str], k: int) -> DataFrame:
    """At most k rows of each episode at evenly spaced places, the first and last among them; k = 1 gives the first."""
    w = Window.partitionBy(*episode)
    out = df.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    if k == 1:
        return out.where("place = 0").drop("__n")
    slots = F.when(F.col("__n") <= k, F.lit(True)).otherwise(F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / (k - 1)) == F.col("place")))
    return out.where(slots).drop("__n")


def pieces(intervals: DataFrame, episode: str, start: int = 0, end: int = 72) -> DataFrame:
    """episode, begin, finish of the consecutive pieces between all distinct bounds of its intervals (begin, finish), start and end."""
    bound = intervals.select(episode, F.explode(F.array(F.lit(start), F.lit(end), F.greatest(F.col("begin"), F.lit(start)), F.least(F.col("finish"), F.lit(end)))).alias("t")).distinct()
    w = Window.partitionBy(episode).orderBy("t")
    return bound.withColumn("finish", F.lead("t").over(w)).where("finish IS NOT NULL").select(episode, F.col("t").alias("begin"), "finish")


def active_in(pieces_: DataFrame, intervals: DataFrame, episode: str) -> DataFrame:
    """episode, begin, finish, n_active: how many intervals cover the beginning of each piece (half-open)."""
    i = intervals.select(episode, F.col("begin").alias("b"), F.col("finish").alias("f"))
    joined = pieces_.join(i, episode).groupBy(episode, "begin", "finish").agg(F.count_if((F.col("b") <= F.col("begin")) & (F.col("begin") < F.col("f"))).alias("n_active"))
    return joined


def concatenated(runs: DataFrame, episode: str, end: int) -> DataFrame:
    """runs (episode, begin, finish, local, ...) with ``step``: the pieces of an episode put one behind the other as a single run.

    A piece has the steps 0 to finish - begin, and its last is the first of the next piece: it goes, but for the piece that ends at ``end``. A piece
    starts behind all that is kept of the pieces before it."""
    kept = F.col("finish") - F.col("begin") + (F.col("finish") == end).cast("int")
    pieces_ = runs.select(episode, "begin", "finish").distinct().withColumn("__kept", kept)
    before = Window.partitionBy(episode).orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces_.select(episode, "begin", "__kept", F.coalesce(F.sum("__kept").over(before), F.lit(0)).alias("__offset"))
    return runs.join(offsets, [episode, "begin"]).where(F.col("local") < F.col("__kept")).withColumn("step", (F.col("__offset") + F.col("local")).cast("bigint")).drop("__kept", "__offset")


def rotated(df: DataFrame, partition: list[str], order: list[Column], n: int = 3) -> DataFrame:
    """df with category 0 to n - 1 in turn."""
    return df.withColumn("category", F.pmod(F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1, F.lit(n)))


def by_day(rows: DataFrame, entity: str, fields: list[str], first: str, last: str, per_day: int, width: int = 12) -> DataFrame:
    """day, entity, step and each field as a window of ``width`` steps up to it, for the days from first to last of rows (day, entity, step from 0, fields).

    A day's windows reach into the day before by width - 1 steps: only those are sent over, and only the days that are asked for
    and the one before are read. Windows are cut by day and entity, so days are independent of one another; steps without a full window have none."""
    if width - 1 > per_day:
        raise ValueError("a window must not reach beyond the day before")
    days = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    earlier = F.col("day").between(F.date_sub(F.lit(first).cast("date"), 1), F.date_sub(F.lit(last).cast("date"), 1))
    columns = ["day", entity, "step", *fields]
    own = rows.where(days).select(*columns)
    halo = rows.where(earlier & (F.col("step") > per_day - width)).select(F.date_add("day", 1).alias("day"), entity, (F.col("step") - per_day).alias("step"), *fields)
    w = Window.partitionBy("day", entity).orderBy("step").rowsBetween(1 - width, 0)
    out = own.unionByName(halo).select("day", entity, "step", *[F.collect_list(f).over(w).alias(f) for f in fields], F.min("step").over(w).alias("__from"))
    return out.where((F.col("step") >= 0) & (F.col("__from") == F.col("step") - (width - 1))).drop("__from")
