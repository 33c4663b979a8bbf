"""Tie-aware ranking metrics over (hour, entity, score, active)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegrid.functions.scalar import miss_probability


def with_cutoff(scores: DataFrame, k: int) -> DataFrame:
    """scores with cutoff (the k-th largest score of the hour, the smallest if fewer), above and ties (how many
    scores of the hour lie above it and at it) and draws (places left for the ties)."""
    hour = Window.partitionBy("hour")
    out = scores.withColumn("__n", F.row_number().over(hour.orderBy(F.desc("score"))))
    out = out.withColumn("cutoff", F.min(F.when(F.col("__n") <= k, F.col("score"))).over(hour))
    out = out.withColumn("above", F.sum((F.col("score") > F.col("cutoff")).cast("int")).over(hour)).withColumn("ties", F.sum((F.col("score") == F.col("cutoff")).cast("int")).over(hour))
    return out.withColumn("draws", F.least(F.lit(k) - F.col("above"), F.col("ties"))).drop("__n")


def hits(scores: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """hour, entity, hit for active rows: the chance that one of the k best, ties drawn evenly, is near the entity."""
    ranked = with_cutoff(scores, k)
    best = ranked.where(F.col("score") >= F.col("cutoff")).select("hour", F.col("entity").alias("q"), (F.col("score") > F.col("cutoff")).alias("sure"))
    active = ranked.where("active").select("hour", "entity", "ties", "draws")
    around = active.join(near.select(F.col("p").alias("entity"), "q"), "entity").join(best, ["hour", "q"], "left")
    found = around.groupBy("hour", "entity").agg(F.first("ties").alias("ties"), F.first("draws").alias("draws"), F.max(F.coalesce("sure", F.lit(False))).alias("sure"), F.sum((F.col("sure") == F.lit(False)).cast("int")).alias("b"))
    return chances(found)


def chances(found: DataFrame) -> DataFrame:
    """hour, entity, hit of rows with ties and draws of the hour, sure (a place above the cutoff is near) and b (how many places at the cutoff are)."""
    miss = miss_probability(F.col("ties"), F.coalesce("b", F.lit(0)), F.col("draws"))
    return found.select("hour", "entity", F.when(F.col("sure"), 1.0).otherwise(1 - miss).alias("hit"))


def localisation(scores: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """hour, n_active, hit: the mean chance over the active entities of each hour that has any."""
    return by_hour(hits(scores, near, k))


def by_hour(found: DataFrame) -> DataFrame:
    return found.groupBy("hour").agg(F.count("*").alias("n_active"), F.round(F.avg("hit"), 9).alias("hit"))


def random_reference(near: DataFrame, n: int, k: int) -> DataFrame:
    """entity, m, hit: the chance that k entities drawn at random include one of the m near ones."""
    return near.groupBy(F.col("p").alias("entity")).agg(F.count("*").alias("m")).select("entity", "m", F.round(1 - miss_probability(F.lit(n), F.col("m"), F.lit(k)), 9).alias("hit"))


def average_rank(scores: DataFrame) -> DataFrame:
    """hour, n_active, mean_rank of the active entities; equal scores share the mean of their places."""
    order = Window.partitionBy("hour").orderBy(F.desc("score"))
    place = F.rank().over(order) + (F.count("*").over(Window.partitionBy("hour", "score")) - 1) / 2
    return scores.withColumn("place", place).where("active").groupBy("hour").agg(F.count("*").alias("n_active"), F.round(F.avg("place"), 6).alias("mean_rank"))


def fractional_recall(scores: DataFrame, k: int) -> DataFrame:
    """hour, recall: the share of the hour's active entities among its k best, ties counted in parts."""
    x = with_cutoff(scores, k).where("active")
    sure = F.sum((F.col("score") > F.col("cutoff")).cast("int"))
    maybe = F.sum((F.col("score") == F.col("cutoff")).cast("int"))
    return x.groupBy("hour").agg(F.round((sure + maybe * F.first("draws") / F.first("ties")) / F.count("*"), 9).alias("recall"))


def average_precision(pairs: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: ap, positives, n over all rows; null ap if nothing is positive. Ties are one step of the curve."""
    return _curve(pairs, [], score, label)


def average_precision_by(pairs: DataFrame, keys: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """keys, ap, positives, n: the same for each key."""
    return _curve(pairs, keys, score, label)


def _curve(pairs: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Rows are summed by distinct score before they are ordered, in parts of the score's range so that no task holds all."""
    by = pairs.where(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n"))
    quantiles = by.approxQuantile("s", [i / 32 for i in range(1, 32)], 0.01)
    part = F.size(F.filter(F.lit(sorted(set(quantiles)) or [0.0]), lambda q: q > F.col("s")))  # 0: the highest scores
    by = by.withColumn("part", part)
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by.groupBy(*keys, "part").agg(F.sum("p").alias("pp"), F.sum("n").alias("nn"))  # 32 rows a key at most
    parts = parts.select(*keys, "part", F.coalesce(F.sum("pp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("nn").over(before), F.lit(0)).alias("n0"))
    order = Window.partitionBy(*keys, "part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    curve = by.join(parts, [*keys, "part"]).select(*keys, "p", "n", ((F.sum("p").over(order) + F.col("p0")) / (F.sum("n").over(order) + F.col("n0"))).alias("precision"))
    total = F.sum("p")
    return curve.groupBy(*keys).agg(F.round(F.try_divide(F.sum(F.col("p") * F.col("precision")), total), 9).alias("ap"), F.coalesce(total, F.lit(0)).alias("positives"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def confusion(scores: DataFrame, threshold: float) -> DataFrame:
    """One row: tp, fp, fn, precision, recall of the alarms score >= threshold; null where a denominator is 0."""
    alarm = F.col("score") >= threshold
    out = scores.agg(F.count_if(alarm & F.col("active")).alias("tp"), F.count_if(alarm & ~F.col("active")).alias("fp"), F.count_if(~alarm & F.col("active")).alias("fn"))
    return out.select("tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 9).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 9).alias("recall"))


def false_alarms(scores: DataFrame, threshold: float) -> DataFrame:
    """One row over the hours without an active entity: hours, share with any alarm, mean number of alarms; null if none."""
    hours = scores.groupBy("hour").agg(F.max("active").alias("a"), F.count_if(F.col("score") >= threshold).alias("alarms")).where(~F.col("a"))
    return hours.agg(F.count("*").alias("hours"), F.round(F.avg((F.col("alarms") > 0).cast("int")), 9).alias("share"), F.round(F.avg("alarms"), 9).alias("mean_alarms"))


def ordered(scores: DataFrame) -> DataFrame:
    """scores with place: 1 for the highest of the hour, equal scores in the order of the entities."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("hour").orderBy(F.desc("score"), "entity")))


def first_place_near(scores: DataFrame, near: DataFrame) -> DataFrame:
    """hour, entity, place for active rows: the best place of an entity near it."""
    placed = ordered(scores)
    around = placed.where("active").select("hour", "entity").join(near.select(F.col("p").alias("entity"), "q"), "entity")
    return around.join(placed.select("hour", F.col("entity").alias("q"), "place"), ["hour", "q"]).groupBy("hour", "entity").agg(F.min("place").alias("place"))


def top_frequency(scores: DataFrame, k: int) -> DataFrame:
    """entity, share: in what share of the hours the entity is among the k best."""
    hours = scores.select("hour").distinct().count()
    return ordered(scores).where(F.col("place") <= k).groupBy("entity").agg(F.round(F.count("*") / F.lit(float(max(hours, 1))), 9).alias("share"))
