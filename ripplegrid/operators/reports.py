"""Summaries of zones and footprints, and the shaping of nested reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegrid.operators import spatial


def zone_summary(scores: DataFrame, selected: DataFrame, covered: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row over the hours of scores: hours, hours_active, the mean recall of the hours with active entities, the mean, least and most
    selected length, the mean, least and most share of all length that is covered, and the mean likeness of the selections of consecutive hours and how
    many pairs of such hours there are. An hour that selects nothing counts with length 0 and nothing covered."""
    hours = scores.groupBy("hour").agg(F.max("active").alias("any"))
    chosen = selected.join(lengths, "entity").groupBy("hour").agg(F.sum("length").alias("x"))
    total = lengths.agg(F.sum("length").alias("total"))  # one row
    near = covered.join(lengths, "entity").groupBy("hour").agg(F.sum("length").alias("y"))
    share = F.coalesce("y", F.lit(0.0)) / F.col("total")
    each = hours.join(chosen, "hour", "left").join(near, "hour", "left").crossJoin(F.broadcast(total)).select("hour", "any", F.coalesce("x", F.lit(0.0)).alias("x"), share.alias("y"))
    found = spatial.recall(scores, covered).select("hour", "recall")
    alike = spatial.stability(selected, lengths, hours)
    one = each.join(found, "hour", "left").join(alike, "hour", "left")
    return one.agg(
        F.count("*").alias("hours"), F.count_if("any").alias("hours_active"), F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.avg("x"), 6).alias("mean_length"), F.min("x").alias("least_length"), F.max("x").alias("most_length"),
        F.round(F.avg("y"), 6).alias("covered"), F.round(F.min("y"), 6).alias("least_covered"), F.round(F.max("y"), 6).alias("most_covered"),
        F.round(F.avg("jaccard"), 6).alias("jaccard"), F.count("jaccard").alias("pairs"),
    )


def _met(scores: DataFrame, covered: DataFrame) -> DataFrame:
    found = covered.select("hour", "entity").distinct().withColumn("met", F.lit(1))
    return scores.where("active").join(found, ["hour", "entity"], "left").withColumn("met", F.coalesce("met", F.lit(0)))


def entity_recall(scores: DataFrame, covered: DataFrame) -> DataFrame:
    """entity, n, recall: in what share of its active hours an entity is covered."""
    return _met(scores, covered).groupBy("entity").agg(F.count("*").alias("n"), F.round(F.avg("met"), 9).alias("recall"))


def event_recall(scores: DataFrame, covered: DataFrame) -> DataFrame:
    """One row: entities, and the mean over them of the share of their active hours in which they are covered."""
    by = _met(scores, covered).groupBy("entity").agg(F.avg("met").alias("r"))
    return by.agg(F.count("*").alias("entities"), F.round(F.avg("r"), 9).alias("recall"))


def flattened(report: DataFrame, column: str, levels: list[str], value: str = "value") -> DataFrame:
    """A column of nested maps as a row for each innermost value: a column of keys for each level, then the value."""
    kept = [c for c in report.columns if c != column]
    out = report.withColumnRenamed(column, "__map")
    for level in levels:
        out = out.select(*kept, F.explode("__map").alias(level, "__map"))
        kept.append(level)
    return out.withColumnRenamed("__map", value)


def preferred(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of each key the first by a composite order (false before true)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def criterion(tables: dict[str, DataFrame], rows: list[tuple[str, str, str]], columns: dict[str, str], digits: int) -> DataFrame:
    """label and the columns (new name: name in the tables), rounded, of the rows (label, table, map) that a criterion names; a map that a table lacks is an error."""
    out = None
    for label, name, map_ in rows:
        one = tables[name].where(F.col("map") == map_).select(F.lit(label).alias("label"), *[F.round(c, digits).alias(n) for n, c in columns.items()])
        if not one.limit(1).count():
            raise KeyError(f"no {map_} in {name}")
        out = one if out is None else out.unionByName(one)
    return out
