"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix has ``share`` times the words of all documents. Sources get targets by weight, none above ``cap`` times
its size; what is above is shared again by weight. The mix's blocks of ``block_words`` words are then given to sources by highest
quotients target / (2 seats + 1). A source of less than 256 such blocks is apportioned, among its like, in blocks of one word, which
changes nothing for other sources. A source's documents lie in shards (by a hash of id and text); by the same quotients its
seats are given to its shards, so quotas are integers that sum to the seats. Inside a shard the documents stand in seeded order
and are cut into blocks; the quota takes whole rounds of the shard and, of what is left, the blocks that a seeded permutation
puts first.

One row per source and per shard reaches the driver (``max_sources`` and ``max_shards`` at most, so shards grow beyond ``shard_words``
where there would be more). A shard is a window group of sizes and texts that Spark sorts and spills, never an array.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplegrid.llm.common import scratch, written

WORD = r"[^\x20\x09-\x0D]+"
#: Primes below 2**31: steps of the permutations, coprime to any number of blocks.
_STEPS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)


def targets(sizes: Sequence[float], weights: Sequence[float], share: float, cap: float) -> np.ndarray:
    """Shares of ``share`` times all sizes by weight, none above ``cap`` times its size, the excess shared again by weight."""
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    out, full = np.zeros(len(size)), np.zeros(len(size), bool)
    while not full.all():
        left = share * size.sum() - (cap * size[full]).sum()
        out = np.where(full, cap * size, left * weight / weight[~full].sum())
        over = ~full & (out > cap * size)
        if not over.any():
            break
        full |= over
        out = np.where(full, cap * size, out)
    return out


def sainte_lague(votes: Sequence[float], seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 seats + 1), ties to the first; exact for any number of seats."""
    votes = np.asarray(votes, float)
    out = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0 or votes.sum() <= 0:
        return out
    # a divisor that gives away too few by len(votes) at most; the rest goes quotient by quotient
    out = np.maximum(0, np.floor(votes * ((seats - len(votes)) / votes.sum()) + 0.5)).astype(np.int64) if seats > len(votes) else out
    while out.sum() > seats:
        i = int(np.argmin(np.where(out > 0, votes / (2 * out - 1.0), np.inf)))
        out[i] -= 1
    queue = [(-v / (2 * int(s) + 1), i) for i, (v, s) in enumerate(zip(votes, out, strict=True)) if v > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        heapq.heappush(queue, (-votes[i] / (2 * int(out[i]) + 1), i))
    return out


def _plan(docs: DataFrame, weights: Sequence[float], share: float, cap: float, block_words: int, shard_words: int, max_shards: int, seed: str, max_sources: int) -> DataFrame:
    """its_source, its_shard, shards, source_size, target, total, block, words: what each shard of each source gives."""
    spark = docs.sparkSession
    with scratch(spark):
        sized = written(docs.groupBy("__source", "__deal").agg(F.sum("__size").alias("size")), "mixing-sizes")
        rows = sized.groupBy("__source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
        if len(rows) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        rows.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
        sizes = [r["size"] for r in rows]
        every = max(sum(sizes), 1)
        shards = [max(1, min(math.ceil(n / shard_words), math.ceil(max_shards * n / every))) for n in sizes]
        dealt = spark.createDataFrame([(r["__source"], n) for r, n in zip(rows, shards, strict=True)], "its_source string, shards int")
        own = sized.join(F.broadcast(dealt), F.col("__source").eqNullSafe(F.col("its_source")))  # max_sources rows at most
        parts = own.groupBy("__source", F.pmod("__deal", F.col("shards")).cast("int").alias("shard")).agg(F.sum("size").alias("size")).collect()  # max_sources + max_shards rows at most
    of: dict[str | None, dict[int, int]] = {}
    for r in parts:
        of.setdefault(r["__source"], {})[r["shard"]] = r["size"]
    target = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], share, cap)
    block = [block_words if n >= 256 * block_words else 1 for n in sizes]
    seats = np.zeros(len(rows), np.int64)
    for b in set(block):
        mine = np.flatnonzero(np.array(block) == b)
        seats[mine] = sainte_lague(target[mine], round(float(target[mine].sum()) / b))
    plan = []
    for i, r in enumerate(rows):
        found = of.get(r["__source"], {})
        order = sorted(found)
        totals = [found[s] for s in order]
        quota = sainte_lague(totals, int(seats[i])) if sizes[i] else np.zeros(len(order), np.int64)
        plan += [(r["__source"], s, shards[i], sizes[i], float(target[i]), n, block[i], int(min(int(q) * block[i], cap * n))) for s, n, q in zip(order, totals, quota, strict=True)]
    return spark.createDataFrame(plan, "its_source string, its_shard int, shards int, source_size bigint, target double, total bigint, block int, words bigint")


def _decided(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = 32, shard_words: int = 100_000, max_shards: int = 4096, seed: str = "mix", max_sources: int = 100_000) -> DataFrame:
    """docs with __size, __source, source_size, target, __taken, __rounds and __extra of every row."""
    row = F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    own = docs.withColumns({
        "__source": F.col("source").cast("string"), "__size": F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint"), "__row": row, "__deal": F.pmod(F.shiftright(row, 8), F.lit(1 << 16)).cast("int"),
    })
    plan = _plan(own, weights, share, cap, block_words, shard_words, max_shards, seed, max_sources)
    of = plan.select("its_source", "shards", "source_size", "target").distinct()
    own = own.join(F.broadcast(of), F.col("__source").eqNullSafe(F.col("its_source"))).drop("its_source")  # max_sources rows at most
    own = own.withColumn("__shard", F.pmod("__deal", F.col("shards")).cast("int"))
    of_shard = plan.select("its_source", "its_shard", "total", "block", "words")
    own = own.join(F.broadcast(of_shard), F.col("__source").eqNullSafe(F.col("its_source")) & (F.col("__shard") == F.col("its_shard"))).drop("its_source", "its_shard")  # max_sources + max_shards rows at most
    order = Window.partitionBy("__source", "__shard").orderBy("__row", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("__to", F.sum("__size").over(order))
    b, total = F.col("block").cast("bigint"), F.greatest("total", F.lit(1))
    blocks = F.greatest(F.ceil(F.col("total") / b), F.lit(1))
    own = own.withColumn("__rounds", F.floor(F.col("words") / total).cast("bigint"))
    own = own.withColumn("__picks", F.least(F.floor((F.col("words") - F.col("__rounds") * F.col("total")) / b + 0.5).cast("bigint"), blocks))
    own = own.withColumn("__blocks", blocks).withColumn("__from", F.col("__to") - F.col("__size"))
    dealt = F.xxhash64("__source", "__shard", F.lit(seed))
    own = own.withColumn("__first", F.pmod(dealt, F.col("__blocks"))).withColumn("__step", F.element_at(F.lit(list(_STEPS)).cast("array<bigint>"), (F.pmod(F.shiftright(dealt, 7), F.lit(len(_STEPS))) + 1).cast("int")))
    mine = F.sequence(F.floor(F.col("__from") / b), F.floor((F.col("__to") - 1) / b))
    chosen = F.filter(mine, lambda j: F.pmod(j * F.col("__step") + F.col("__first"), F.col("__blocks")) < F.col("__picks"))
    ranges = F.transform(chosen, lambda j: F.struct((F.greatest(j * b, F.col("__from")) - F.col("__from")).alias("start"), (F.least((j + 1) * b, F.col("__to")) - F.col("__from")).alias("end")))
    own = own.withColumn("__extra", F.coalesce(F.when((F.col("__size") > 0) & (F.col("__picks") > 0), ranges), F.array().cast("array<struct<start:bigint,end:bigint>>")))
    return own.withColumn("__taken", F.col("__rounds") * F.col("__size") + F.aggregate("__extra", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"]))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, rounds, extra of every row of docs.

    docs has doc_id, text and source, other columns are not looked at. Weights go to the sources by code point, null
    last, repeating. A row gives its text ``rounds`` times in full and the word ranges ``extra`` (array of [start, end))
    once more; taken counts the words. Null and empty texts have size 0 and give nothing. Rows with one doc_id, or none, count
    one by one. Settings: weights (5, 2, 1), share (1.5), cap (2), block_words (32), shard_words, max_shards, seed, max_sources.
    """
    found = _decided(docs.select("doc_id", "text", "source"), **settings)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), "source_size", "target", F.col("__taken").alias("taken"), F.col("__rounds").alias("rounds"), F.col("__extra").alias("extra"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix, with the columns of docs: each text as often as the mix takes it in full, and once more the
    words that it takes besides, joined by one space (n_chars, where there is such a column, follows the text).

    Rows of docs without a word leave. Rows that share a doc_id, or have none, are decided one by one."""
    carried = [f"__own_{c}" for c in docs.columns]
    found = docs.select("doc_id", "text", "source", *[F.col(c).alias(x) for c, x in zip(docs.columns, carried, strict=True)])
    found = _decided(found, **settings).where("__taken > 0").select("text", "__rounds", "__extra", *carried)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    found = found.withColumn("__words", F.when(F.size("__extra") > 0, words))
    part = F.array_join(F.flatten(F.transform("__extra", lambda x: F.slice(F.col("__words"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), " ")
    none = F.array().cast("array<string>")
    texts = F.concat(F.when(F.col("__rounds") > 0, F.array_repeat("text", F.col("__rounds").cast("int"))).otherwise(none), F.when(F.size("__extra") > 0, F.array(part)).otherwise(none))
    out = found.withColumn("__text", F.explode(texts))
    made = {"text": F.col("__text")} | ({"n_chars": F.length("__text").cast("bigint")} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, F.col(x)).alias(c) for c, x in zip(docs.columns, carried, strict=True)])
