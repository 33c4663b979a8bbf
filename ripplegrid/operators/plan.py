"""Plans and manifests: contracts, overlaps, shards, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(plan: DataFrame, width: int) -> DataFrame:
    """a, b of plan (id, partition, begin, finish): intervals of different partitions that share time (half-open), a < b.

    An interval-overlap join by slots of ``width``; a pair is reported in the slot where the later one begins."""
    slots = F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("finish") - 1) / width))
    spread = plan.where("begin < finish").withColumn("slot", F.explode(slots))
    left, right = (spread.select("slot", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "partition", "begin", "finish")]) for s in ("a", "b"))
    meets = (F.col("id_a") < F.col("id_b")) & (F.col("partition_a") != F.col("partition_b")) & (F.col("begin_a") < F.col("finish_b")) & (F.col("begin_b") < F.col("finish_a"))
    once = F.col("slot") == F.floor(F.greatest("begin_a", "begin_b") / width)
    return left.join(right, "slot").where(meets & once).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def overlaps(plan: DataFrame) -> DataFrame:
    """slot, pairs: how many pairs of intervals of different partitions (id, partition, begin, finish, whole numbers, half-open)
    start to share time in each slot. Counts by slot and partition do; no pair is made."""
    alike = plan.where("begin < finish").groupBy("partition", "begin", "finish").agg(F.count("*").alias("n"))
    spread = alike.withColumn("slot", F.explode(F.sequence("begin", F.col("finish") - 1)))
    by = spread.groupBy("slot", "partition").agg(F.sum("n").alias("now"), F.sum(F.when(F.col("slot") > F.col("begin"), F.col("n")).otherwise(0)).alias("old"))
    same = by.groupBy("slot").agg(*[F.sum(x).alias(y) for x, y in (("now", "s"), ("old", "o"))], *[F.sum(F.col(x) * F.col(x)).alias(y) for x, y in (("now", "ss"), ("old", "oo"))])
    pairs = ((F.col("s") * F.col("s") - F.col("ss")) - (F.col("o") * F.col("o") - F.col("oo"))) / 2  # together now, less together before
    return same.select("slot", pairs.cast("bigint").alias("pairs")).where("pairs > 0")


def drawn(seed: str, *parts: Column | str) -> Column:
    """A number from 0 below 2**32 that depends on the seed and the parts alone: the same in any engine (the first 8 hex digits of an md5)."""
    text = F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def assigned(episodes: DataFrame, shares: dict[str, int], slots: int, width: int, length: int, seed: str) -> DataFrame:
    """id, variant, partition, slot, begin, finish: a period for every episode (id, variant, partition) such that periods of different partitions never overlap.

    Time is cut into ``slots`` of ``width`` and every slot is drawn for one partition in proportion to the shares. An episode starts with a
    slot of its partition: those of a variant take its slots one after the other from a drawn one on, so they differ while there are enough.
    An episode is no longer than a slot, so it stays within it. A partition that drew no slot is an error."""
    if length > width:
        raise ValueError("an episode must fit into a slot")
    spark, total, owner, least = episodes.sparkSession, sum(shares.values()), F.lit(None).cast("string"), 0
    draw = F.pmod(drawn(seed, F.lit("slot"), "slot"), F.lit(total))
    for name, share in reversed(list(shares.items())):
        least = sum(list(shares.values())[: list(shares).index(name)])
        owner = F.when((draw >= least) & (draw < least + share), F.lit(name)).otherwise(owner)
    table = spark.range(slots).select(F.col("id").alias("slot")).withColumn("partition", owner)
    own = Window.partitionBy("partition")
    table = table.select("partition", "slot", (F.row_number().over(own.orderBy("slot")) - 1).alias("n"), F.count("*").over(own).alias("of"))  # as many rows as slots
    counts = table.select("partition", "of").distinct()
    turn = F.row_number().over(Window.partitionBy("partition", "variant").orderBy(drawn(seed, F.lit("episode"), "id"), "id")) - 1
    placed = episodes.select("id", "variant", "partition", turn.alias("turn")).join(F.broadcast(counts), "partition", "left")
    sure = F.when(F.col("of").isNull(), F.raise_error(F.concat(F.lit("no slot for "), F.col("partition")))).otherwise(F.pmod(drawn(seed, F.lit("variant"), "variant") + F.col("turn"), F.col("of")))
    found = placed.withColumn("n", sure).drop("of").join(table.select("partition", "n", "slot"), ["partition", "n"])
    return found.select("id", "variant", "partition", "slot", (F.col("slot") * width).alias("begin"), (F.col("slot") * width + length).alias("finish"))


def contract(plan: DataFrame, variant: str, partition: str) -> DataFrame:
    """variant, partitions of the variants that lie in more than one partition."""
    return plan.groupBy(variant).agg(F.count_distinct(partition).alias("partitions")).where("partitions > 1")


def repeated(plan: DataFrame, key: str) -> DataFrame:
    """key, n of the ids that are not unique."""
    return plan.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def shard(plan: DataFrame, partition: list[str], order: list[str], shards: int, mine: int) -> DataFrame:
    """Every ``shards``-th row of each partition from the ``mine``-th on."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return plan.withColumn("__n", n - 1).where(F.pmod("__n", F.lit(shards)) == mine).drop("__n")


def first_of(plan: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each partition, with ``place``."""
    return plan.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("place") <= n)


def sampled(rows: DataFrame, key: str, partition: list[str], seed: str, n: int) -> DataFrame:
    """n rows of each partition without replacement, in the order of md5(seed|key): the same in any engine."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(draw, key))).where(F.col("place") <= n)


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both manifests; rows of the second whose keys the first has are left out."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def overlaid(defaults: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the overrides where there are some, else the defaults."""
    new = overrides.select(key, F.col(value).alias("__new"))
    return defaults.join(new, key, "left").select(key, F.coalesce("__new", value).alias(value))


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: only_a, only_b: how many distinct keys each side alone has."""
    both = a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"))
