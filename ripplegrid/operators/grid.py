"""Hour x entity grids: gap filling, labels, finite rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegrid.functions.scalar import finite


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hourly(events: DataFrame, score: Column | None = None, label: Column | None = None) -> DataFrame:
    """hour, entity, score (sum of value), active of the hours and entities that have events."""
    value = F.round(F.sum("value"), 6) if score is None else score
    flag = F.col("event_type") == "error" if label is None else label
    return events.groupBy(hour_of(F.col("ts")).alias("hour"), F.col("user_id").alias("entity")).agg(value.alias("score"), F.max(flag).alias("active"))


def fill(observed: DataFrame, fills: dict[str, object]) -> DataFrame:
    """Every hour between the first and last, for every entity; missing cells get the fill values, present ones stay.

    The grid is dealt by entity: each entity's row explodes into its hours, with no join of hours and entities. Spark takes the grid to be as
    small as its entities and would broadcast it, so it is joined by merging, here and in later joins (the hint goes through filters, windows and groups)."""
    first, last = observed.agg(F.min("hour"), F.max("hour")).first()
    entities = observed.select("entity").distinct()
    hours = F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval 1 hour)") if first is not None else F.array().cast("array<timestamp_ntz>")
    grid = entities.select("entity", F.explode(hours).alias("hour"))
    joined = grid.hint("merge").join(observed, ["hour", "entity"], "left")
    return joined.select("hour", "entity", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in fills.items()]).hint("merge")


def score_map(events: DataFrame) -> DataFrame:
    """hour, entity, score, active on the full grid; no events count as score 0 and not active."""
    return fill(hourly(events), {"score": 0.0, "active": False})


def scatter(grid: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Observations onto a grid: the value, 0 where none is, and whether one is present."""
    seen = observed.select(*keys, F.col(value).alias("__v"), F.lit(True).alias("__p"))
    return grid.join(seen, keys, "left").select(*grid.columns, F.coalesce("__v", F.lit(0.0)).alias(value), F.coalesce("__p", F.lit(False)).alias("present"))


def finite_hours(scores: DataFrame, score: str = "score") -> DataFrame:
    """The rows of the hours all of whose scores are finite numbers."""
    whole = scores.groupBy("hour").agg(F.bool_and(finite(F.col(score))).alias("whole")).where("whole")
    return scores.join(whole.select("hour"), "hour", "left_semi")


def ring(entities: DataFrame, reach: float = 300.0, unit: float = 100.0) -> DataFrame:
    """p, q, d for entities within reach on a ring in the order of their numbers: each entity names its own neighbours."""
    n = F.lit(entities.agg(F.count("*")).first()[0]).cast("bigint")
    steps = int(reach // unit)
    near = entities.select(F.col("entity").alias("p"), F.explode(F.sequence(F.lit(-steps), F.lit(steps))).alias("s"))
    near = near.select("p", F.pmod(F.col("p") + F.col("s"), n).alias("q")).distinct()
    gap = F.abs(F.col("p") - F.col("q"))
    near = near.withColumn("d", (F.lit(unit) * F.least(gap, n - gap)).cast("double"))
    return near.join(entities.select(F.col("entity").alias("q")), "q", "left_semi").select("p", "q", "d")
