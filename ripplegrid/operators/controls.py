"""Control maps and masked labels: what a map is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(scores: DataFrame, away: Column) -> DataFrame:
    """scores whose entities inside the mask count as inactive; hours without another active entity are not judged later."""
    return scores.withColumn("active", F.col("active") & ~away)


def frozen(scores: DataFrame, hours: int) -> DataFrame:
    """control, hour, entity, score, active: every hour gets the entity's mean score of the first ``hours`` hours."""
    first = scores.agg(F.min("hour").alias("begin"))  # one row
    early = scores.join(F.broadcast(first), F.col("hour") < F.col("begin") + F.make_dt_interval(F.lit(0), F.lit(hours)))
    mean = early.groupBy("entity").agg(F.round(F.avg("score"), 6).alias("frozen"))
    return scores.join(mean, "entity").select(F.lit("frozen").alias("control"), "hour", "entity", F.col("frozen").alias("score"), "active")


def seeded(scores: DataFrame, seed: int) -> DataFrame:
    """control, hour, entity, score, active: every hour gets the same scores, scattered by a seed over 1009 values."""
    return scores.select(F.lit("seeded").alias("control"), "hour", "entity", ((F.col("entity") + seed) * 7919 % 1009).cast("double").alias("score"), "active")
