"""Masked normalisation learned from training rows only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegrid.functions.scalar import standardized

#: Spreads below this count as 1; scales are never below it.
TINY = 1e-6


def mask_of(field: str, flags: dict[str, list[str]]) -> Column:
    """All flags that a field depends on hold; a field without flags is always valid."""
    return reduce(lambda a, b: a & b, [F.col(f) for f in flags.get(field, [])], F.lit(True))


def fit(train: DataFrame, fields: list[str], masks: dict[str, Column], booleans: tuple[str, ...] = ()) -> DataFrame:
    """field, centre, spread, n: mean and population deviation of the valid values; 0 and 1 for booleans.

    One pass: each field is two conditional aggregates. An empty field has null centre and spread."""
    made = []
    for f in fields:
        x = F.when(masks.get(f, F.lit(True)), F.col(f).cast("double"))
        if f in booleans:
            made += [F.lit(0.0).alias(f"{f}__c"), F.lit(1.0).alias(f"{f}__s"), F.count(x).alias(f"{f}__n")]
        else:
            made += [F.avg(x).alias(f"{f}__c"), F.stddev_pop(x).alias(f"{f}__s"), F.count(x).alias(f"{f}__n")]
    one = train.agg(*made)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}__c").alias("centre"), F.when(F.col(f"{f}__s") < TINY, 1.0).otherwise(F.col(f"{f}__s")).alias("spread"), F.col(f"{f}__n").alias("n")) for f in fields])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def apply(df: DataFrame, stats: DataFrame, fields: list[str], masks: dict[str, Column], dropped: tuple[str, ...] = ()) -> DataFrame:
    """df with each field as (x - centre) / spread where valid, else 0; dropped fields are 0 throughout.

    The statistics are one row a field, read once and put into the plan as numbers."""
    known = {r["field"]: r for r in stats.collect()}
    missing = [f for f in fields if f not in dropped and (f not in known or known[f]["centre"] is None)]
    if missing:
        raise ValueError(f"no statistics for {missing}")
    made = {f: F.lit(0.0) if f in dropped else standardized(F.col(f).cast("double"), F.lit(known[f]["centre"]), F.lit(known[f]["spread"]), masks.get(f, F.lit(True))) for f in fields}
    return df.withColumns(made)


def scale(train: DataFrame, column: str) -> DataFrame:
    """One row: scale, the root of the mean square, not centred."""
    return train.agg(F.greatest(F.sqrt(F.avg(F.col(column) * F.col(column))), F.lit(TINY)).alias("scale"))


def merged_moments(train: DataFrame, episode: str, column: str, mask: Column) -> DataFrame:
    """One row: centre, spread, n from sums, squares and counts by episode that are then added up; a tiny spread counts as 1."""
    x = F.when(mask, F.col(column).cast("double"))
    parts = train.groupBy(episode).agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.count(x).alias("m"))
    total = parts.agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("m").alias("n"))
    centre = F.try_divide("s1", "n")
    spread = F.sqrt(F.greatest(F.try_divide("s2", "n") - centre * centre, F.lit(0.0)))
    return total.select(centre.alias("centre"), F.when(spread < TINY, 1.0).otherwise(spread).alias("spread"), "n")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: how many rows break each rule (a rule that is null is broken)."""
    one = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(name) for name, r in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def pairwise_violations(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """rule, violations of pairs (p, q, d): symmetry (the pair the other way round is there with the same distance), diagonal (every entity is with itself, at 0),
    distance (not negative, a number), unknown (both are entities)."""
    back = pairs.select(F.col("q").alias("p"), F.col("p").alias("q"), F.col("d").alias("other"))
    alone = pairs.join(back, ["p", "q"], "left").where(~F.coalesce(F.abs(F.col("d") - F.col("other")) <= 1e-9 * (1 + F.abs("d")), F.lit(False)))
    own = entities.select(F.col("entity").alias("p")).join(pairs.where("p = q AND d = 0").select("p"), "p", "left_anti")
    odd = pairs.where(~F.coalesce((F.col("d") >= 0) & ~F.isnan("d"), F.lit(False)))
    ends = pairs.select(F.explode(F.array("p", "q")).alias("entity")).join(entities.select("entity"), "entity", "left_anti")
    out = None
    for rule, rows in (("symmetry", alone), ("diagonal", own), ("distance", odd), ("unknown", ends)):
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
