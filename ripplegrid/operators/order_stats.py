"""Exact order statistics: range parts of the values, prefix counts, and one part for each rank that is asked for.

Equal values of a key become one row with their number, so a value that fills a third of the table is one row, and these are dealt to parts by
ranges of key and value, and written. Numbers by key and part, added up in the order of the parts, tell in which part a rank lies and how far into
it; only those parts are sorted. No task holds more than a part, no key is gathered whole, and nothing is approximate or left to chance, so
a task that is repeated makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegrid.sources.shared import removed, written


def _same(keys: list[str]) -> Column:
    """Equality of the keys with those that _other() has renamed, nulls equal."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return out


def _other(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"__{c}") for c in df.columns])


def ranged(df: DataFrame, keys: list[str], value: str, parts: int | None = None) -> DataFrame:
    """keys, x, n, part: the distinct values that are not null and how often they are there, in parts whose numbers rise with key and value."""
    rows = df.select(*keys, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull()).groupBy(*keys, "x").agg(F.count("*").alias("n"))
    dealt = rows.repartitionByRange(parts, *keys, "x") if parts else rows.repartitionByRange(*keys, "x")
    return written(dealt.withColumn("part", F.spark_partition_id()), "order-parts")


def at_ranks(parts: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """ranks (keys, rank from 0, ...) with x, the value of that rank among the key's values in ``ranged`` form; ranks beyond the last are left out."""
    counts = parts.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys or [F.lit(0)]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = _other(counts.select(*keys, "part", "n", before.alias("before")))  # a row a key and part
    inside = (F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__n"))
    wanted = ranks.join(spans, _same(keys) & inside).select(*ranks.columns, F.col("__part").alias("part"), (F.col("rank") - F.col("__before")).alias("place"))
    asked = parts.join(_other(wanted.select(*keys, "part")).distinct(), _same([*keys, "part"]), "left_semi")
    upto = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = _other(asked.withColumn("upto", upto))
    here = (F.col("place") >= F.col("__upto") - F.col("__n")) & (F.col("place") < F.col("__upto"))
    return wanted.join(placed, _same([*keys, "part"]) & here).select(*ranks.columns, F.col("__x").alias("x"))


def quantiles(df: DataFrame, keys: list[str], value: str, at: tuple[float, ...], parts: int | None = None) -> DataFrame:
    """keys, q, x: the exact quantiles of each key's values, linear between neighbours; a key without a value has no row."""
    return _quantiles(ranged(df, keys, value, parts), keys, at)


def _quantiles(ordered: DataFrame, keys: list[str], at: tuple[float, ...]) -> DataFrame:
    totals = ordered.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")
    asked = totals.select(*keys, "n", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("q")).withColumn("place", F.col("q") * (F.col("n") - 1))
    low, high = F.floor("place"), F.ceil("place")
    ranks = asked.select(*keys, "q", F.explode(F.array(F.struct(low.alias("rank"), (1 - (F.col("place") - low)).alias("share")), F.struct(F.when(high > low, high).alias("rank"), (F.col("place") - low).alias("share")))).alias("r")).select(*keys, "q", "r.rank", "r.share").where("rank IS NOT NULL")
    found = at_ranks(ordered, keys, ranks)
    return found.groupBy(*keys, "q").agg(F.sum(F.col("x") * F.col("share")).alias("x"))


def one_quantile(df: DataFrame, value: str, p: float) -> float | None:
    """A quantile of a whole table as a number; None without a value."""
    ordered = ranged(df, [], value)
    row = _quantiles(ordered, [], (p,)).first()
    removed(ordered)
    return row.x if row else None
