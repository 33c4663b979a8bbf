"""Spatial kernels, budgets and footprints over (hour, entity, score), near (p, q, d) and lengths (entity, length)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplegrid.functions.scalar import decay
from ripplegrid.operators.rank import by_hour, chances, ordered, with_cutoff


def kernel(near: DataFrame, lengths: DataFrame, reach: float = 300.0) -> DataFrame:
    """p, q, weight: exp(-d / reach) times q's length, rows summing to 1."""
    raw = near.join(lengths.select(F.col("entity").alias("q"), "length"), "q").select("p", "q", decay(F.col("d"), reach, F.col("length")).alias("w"))
    return raw.select("p", "q", (F.col("w") / F.sum("w").over(Window.partitionBy("p"))).alias("weight"))


def smooth(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """hour, entity, score: the kernel's weighted mean of the scores around each entity."""
    x = scores.select("hour", F.col("entity").alias("q"), "score").join(weights, "q")
    return x.groupBy("hour", F.col("p").alias("entity")).agg(F.round(F.sum(F.col("weight") * F.col("score")), 6).alias("score"))


def _marked(budgets: list[float], names: list[str]):
    """Rows in order of hour and place, with a flag for each budget that buys them; only what is left of the budgets is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = list(budgets)
        for batch in batches:
            place, length = batch["place"].to_numpy(), batch["length"].to_numpy()
            starts = np.flatnonzero(place == 1).tolist()
            flags = np.zeros((len(budgets), len(place)), dtype=bool)
            for number, budget in enumerate(budgets):
                for begin, end in zip([0, *starts], [*starts, len(place)], strict=True):
                    if begin < end:
                        got, left[number] = _fold(length[begin:end], budget if place[begin] == 1 else left[number])
                        flags[number, got + begin] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, flags)], names=[*batch.schema.names, *names])

    return run


def _fold(length: np.ndarray, left: float) -> tuple[np.ndarray, float]:
    """Which items fit one after the other, and what is left. Runs that fit are taken at once; what does not fit once never will."""
    taken, rest = [], np.arange(len(length))
    while len(rest := rest[length[rest] <= left]):
        after = np.subtract.accumulate(np.concatenate(([left], length[rest])))
        short = length[rest] > after[:-1]
        n = int(short.argmax()) if short.any() else len(rest)
        taken.append(rest[:n])
        left, rest = float(after[n]), rest[n:]
    return (np.concatenate(taken) if taken else rest), left


def marked_budgets(placed: DataFrame, total: float, shares: tuple[float, ...]) -> DataFrame:
    """placed (hour, place, length, ...) as ``ordered`` gives it with budget0, budget1, ...: whether a budget of that share of the total buys the row; what
    no longer fits is skipped.

    Order matters, so an hour's rows go through one fold a budget: they come sorted out of a window and stream through it; nothing is
    gathered but what is left of the budgets."""
    names = [f"budget{i}" for i in range(len(shares))]
    schema = T.StructType([*placed.schema.fields, *[T.StructField(n, T.BooleanType()) for n in names]])
    return placed.mapInArrow(_marked([float(s * total) for s in shares], names), schema)


def within_budgets(scores: DataFrame, lengths: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """hour, entity, place, budget (its number) of what budgets of such shares of the total length buy, by falling score."""
    total = lengths.agg(F.sum("length")).first()[0] or 0.0
    items = ordered(scores.select("hour", "entity", "score").join(lengths.select("entity", F.col("length").cast("double").alias("length")), "entity")).select("hour", "entity", "place", "length")
    flags = F.filter(F.array(*[F.when(F.col(f"budget{i}"), F.lit(i)) for i in range(len(shares))]), lambda x: x.isNotNull())
    return marked_budgets(items, total, shares).select("hour", "entity", "place", F.explode(flags).alias("budget"))


def within_budget(scores: DataFrame, lengths: DataFrame, share: float) -> DataFrame:
    """hour, entity, place of what one budget buys."""
    return within_budgets(scores, lengths, (share,)).drop("budget")


def near_pairs(points: DataFrame, reach: float) -> DataFrame:
    """p, q, d of all points (entity, x, y) within reach of each other on the plane, each with itself; points without a place have none.

    The plane is a grid of cells of the reach. A point stays in its cell and is sent to the nine around it, so near points
    meet by equality of cells and the work follows the points around each point. Cells are dealt to a fixed number of tasks: pairs grow with the
    square of the points, so the points' size says nothing of the work, and neither side may be broadcast to the few tasks that read the other."""
    side = reach * (1 + 1e-9)  # rounding never parts near points by two cells
    cells = [F.floor(F.col(c) / side).alias(f"c{c}") for c in ("x", "y")]
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").select("entity", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    home = placed.select(F.col("entity").alias("q"), F.col("x").alias("xq"), F.col("y").alias("yq"), *cells)
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    sent = placed.select(F.col("entity").alias("p"), "x", "y", *cells, F.explode(around).alias("o")).select("p", "x", "y", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    apart = F.sqrt((F.col("x") - F.col("xq")) * (F.col("x") - F.col("xq")) + (F.col("y") - F.col("yq")) * (F.col("y") - F.col("yq")))
    tasks = 8 * points.sparkSession.sparkContext.defaultParallelism
    sent, home = (df.repartition(tasks, "cx", "cy") for df in (sent, home))
    return sent.hint("merge").join(home, ["cx", "cy"]).select("p", "q", apart.alias("d")).where(F.col("d") <= reach)


def localisation_within(scores: DataFrame, points: DataFrame, reach: float, k: int) -> DataFrame:
    """What ``rank.localisation`` says where near means within reach on the plane (points: entity, x, y); active entities without a place are left out.

    The hour's best are sent to the cells around them and meet the hour's active entities there, so the work follows these; the pairs of all
    near entities, which grow with their square, are not made."""
    side = reach * (1 + 1e-9)
    cell = lambda c: F.floor(F.col(c) / side)
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").select("entity", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ranked = with_cutoff(scores, k)
    active = ranked.where("active").select("hour", "entity", "ties", "draws").join(placed, "entity").withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    best = ranked.where(F.col("score") >= F.col("cutoff")).select("hour", "entity", (F.col("score") > F.col("cutoff")).alias("above")).join(placed.select("entity", F.col("x").alias("xq"), F.col("y").alias("yq")), "entity")
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    sent = best.select("hour", "above", "xq", "yq", F.explode(step).alias("i")).select("*", F.explode(step).alias("j"))
    sent = sent.select("hour", "above", "xq", "yq", (cell("xq") + F.col("i")).alias("cx"), (cell("yq") + F.col("j")).alias("cy"))
    apart = F.sqrt((F.col("x") - F.col("xq")) * (F.col("x") - F.col("xq")) + (F.col("y") - F.col("yq")) * (F.col("y") - F.col("yq")))
    met = active.join(sent, ["hour", "cx", "cy"], "left").withColumn("above", F.when(apart <= reach, F.col("above")))
    found = met.groupBy("hour", "entity").agg(F.first("ties").alias("ties"), F.first("draws").alias("draws"), F.max(F.coalesce("above", F.lit(False))).alias("sure"), F.count_if(~F.col("above")).alias("b"))
    return by_hour(chances(found))


def covered(selected: DataFrame, near: DataFrame) -> DataFrame:
    """hour, entity of all entities near a selected one."""
    return selected.select("hour", F.col("entity").alias("p")).join(near.select("p", "q"), "p").select("hour", F.col("q").alias("entity")).distinct()


def recall(scores: DataFrame, found: DataFrame) -> DataFrame:
    """hour, n_active, recall: the share of the active entities among the found (hour, entity)."""
    x = scores.where("active").select("hour", "entity").join(found.select("hour", "entity", F.lit(1).alias("f")), ["hour", "entity"], "left")
    return x.groupBy("hour").agg(F.count("*").alias("n_active"), F.round(F.avg(F.coalesce("f", F.lit(0))), 9).alias("recall"))


def footprint(scores: DataFrame, near: DataFrame, lengths: DataFrame, share: float, keep_last: bool = False, most: int | None = None) -> DataFrame:
    """hour, entity, weight: entities by falling score until what lies near them reaches ``share`` of the total length.

    The last entity counts with the part of its new length that is still needed, or whole (keep_last). An entity's new
    length is that of all entities for which it is the first near one; ``most`` caps the places looked at."""
    placed = ordered(scores)
    total = lengths.agg(F.sum("length")).first()[0] or 0.0
    target = F.lit(float(share * total))
    first = placed.select("hour", F.col("entity").alias("p"), "place").join(near.select("p", "q"), "p").groupBy("hour", "q").agg(F.min("place").alias("place"))
    new = first.join(lengths.select(F.col("entity").alias("q"), "length"), "q").groupBy("hour", "place").agg(F.sum("length").cast("double").alias("new"))
    grown = placed.join(new, ["hour", "place"], "left").select("hour", "entity", "place", F.coalesce("new", F.lit(0.0)).alias("new"))
    so_far = F.sum("new").over(Window.partitionBy("hour").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    grown = grown.withColumn("sum", so_far).withColumn("before", F.col("sum") - F.col("new"))
    part = F.when(F.col("sum") <= target, 1.0).otherwise(1.0 if keep_last else F.greatest(F.lit(0.0), F.try_divide(target - F.col("before"), F.col("new"))))
    kept = grown.where(F.col("before") < target)
    if most is not None:
        kept = kept.where(F.col("place") <= most)
    return kept.select("hour", "entity", F.round(part, 9).alias("weight"))


def stability(selected: DataFrame, lengths: DataFrame, hours: DataFrame) -> DataFrame:
    """hour, jaccard: length-weighted likeness of an hour's selection to that of exactly one hour before; 1 if both are empty."""
    own = selected.join(lengths, "entity").select("hour", "entity", "length")
    both = own.select("hour", "entity", "length", F.lit(1).alias("now"), F.lit(0).alias("then")).unionByName(own.select((F.col("hour") + F.expr("interval 1 hour")).alias("hour"), "entity", "length", F.lit(0).alias("now"), F.lit(1).alias("then")))
    each = both.groupBy("hour", "entity").agg(F.first("length").alias("length"), F.max("now").alias("now"), F.max("then").alias("then"))
    sums = each.groupBy("hour").agg(F.sum(F.col("length") * F.col("now") * F.col("then")).alias("i"), F.sum("length").alias("u"))
    follow = hours.select("hour").join(hours.select((F.col("hour") + F.expr("interval 1 hour")).alias("hour")), "hour")
    return follow.join(sums, "hour", "left").select("hour", F.coalesce(F.round(F.try_divide("i", "u"), 9), F.lit(1.0)).alias("jaccard"))
