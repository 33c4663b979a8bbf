"""The comparison of score maps: every metric of every map and mode, and of the controls they are held against.

Maps are rows (map, mode, hour, entity, score, active). What is ranked as one is an *instant*: an hour of a map and mode; the map frozen
after its first hours (one instant a map and mode); a drawn order (one instant a draw); an hour of a random map. An instant is
one number: its series (which map and mode, or which control) above its hour. All instants are dealt and sorted once; places, ranks,
ties and what the budgets buy come out of that pass as one table, which all metrics read.

A metric is a mean over instants of means over their active entities (or over entities of means over their hours, or over the
active entities outside a zone). All three are sums over active rows of a value times a weight, so the weights are made once and every metric
ends in sums by series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegrid.functions.scalar import miss_probability
from ripplegrid.operators import plan, rank, spatial
from ripplegrid.sources.shared import written

BUDGETS = (0.01, 0.05, 0.10)
SHARES = (0.10, 0.20, 0.30)
TOPS = (1, 5, 10)
#: Places that a footprint looks at.
MOST = 400
_BITS = 32


def _series() -> Column:
    return F.shiftright("hour", _BITS)


def _hour_number(hour: Column) -> Column:
    return F.floor(F.unix_timestamp(hour.cast("timestamp")) / 3600)


def instants(maps: DataFrame, names: DataFrame, many: int, draws: int, seed: str, frozen_hours: int = 24) -> DataFrame:
    """hour (the instant's number), entity, score, active of all that is ranked: the maps' own hours, the frozen maps, the draws and the random hours, in this order of series."""
    number = lambda series, hour=0: (F.shiftleft(series.cast("bigint"), _BITS) + hour).alias("hour")
    known = maps.join(F.broadcast(names), ["map", "mode"])  # a row a map and mode
    own = known.select(number(F.col("series"), _hour_number(F.col("hour"))), "entity", "score", "active")
    hours = known.select("series", "hour").distinct().withColumn("n", F.row_number().over(Window.partitionBy("series").orderBy("hour"))).where(F.col("n") <= frozen_hours)
    early = known.join(F.broadcast(hours.drop("n")), ["series", "hour"])  # so many rows a series
    frozen = early.groupBy("series", "entity").agg(F.round(F.avg("score"), 6).alias("score")).select(number(F.col("series") + many), "entity", "score")
    drawn = maps.select("entity").distinct().select("entity", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("d"))
    drawn = drawn.select(number(F.col("d") + 2 * many), "entity", plan.drawn(seed, F.lit("draw"), "d", "entity").cast("double").alias("score"))
    hourly = maps.select("hour", "entity").distinct().select(number(F.lit(2 * many + draws), _hour_number(F.col("hour"))), "entity", plan.drawn(seed, F.lit("hour"), F.date_format("hour", "yyyyMMddHH"), "entity").cast("double").alias("score"))
    return reduce(lambda a, b: a.unionByName(b.withColumn("active", F.lit(False))), [frozen, drawn, hourly], own)


def ranked(all_: DataFrame, lengths: DataFrame, total: float) -> DataFrame:
    """The instants' rows with place (ties by entity), rank and same (how many share the score), length, and budget0 to budget2."""
    placed = rank.ordered(all_.join(lengths.select("entity", F.col("length").cast("double").alias("length")), "entity"))
    order = Window.partitionBy("hour").orderBy(F.desc("score"))  # the order of the places serves it
    placed = placed.withColumn("rank", F.rank().over(order)).withColumn("same", F.count("*").over(order.rangeBetween(0, 0)))
    return spatial.marked_budgets(placed.select("hour", "entity", "score", "active", "place", "rank", "same", "length"), total, BUDGETS)


def _weights(active: DataFrame, outside: DataFrame) -> DataFrame:
    """Active rows (hour, entity) with what each counts in a mean over hours (w), over entities (wp) and over hours outside the zone (wo); outside names the entities that lie there."""
    rows = active.join(outside.select("entity", F.lit(1).alias("out")), "entity", "left").select(_series().alias("series"), "hour", "entity", F.coalesce("out", F.lit(0)).alias("out"))
    each = rows.withColumn("n", F.count("*").over(Window.partitionBy("hour"))).withColumn("no", F.sum("out").over(Window.partitionBy("hour")))
    hours = rows.groupBy("series", "hour").agg(F.max("out").alias("o")).groupBy("series").agg(F.count("*").alias("hours"), F.sum("o").alias("hours_out"))
    own = rows.groupBy("series", "entity").agg(F.count("*").alias("np"))
    x = each.join(hours, "series").join(own, ["series", "entity"]).join(own.groupBy("series").agg(F.count("*").alias("entities")), "series")
    part = lambda n, of: F.lit(1.0) / F.col(n) / F.col(of)
    return x.select("series", "hour", "entity", part("n", "hours").alias("w"), part("np", "entities").alias("wp"), F.when(F.col("out") == 1, part("no", "hours_out")).otherwise(0.0).alias("wo"))


_W = ("w", "wp", "wo")


def _means(rows: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """series, metric and the three means out of active rows with weights and a column for each metric."""
    sums = rows.groupBy("series").agg(*[F.sum(F.col(w) * value).alias(f"{w}|{name}") for name, value in metrics.items() for w in _W])
    out = F.array(*[F.struct(F.lit(name).alias("metric"), *[F.col(f"`{w}|{name}`").alias(w) for w in _W]) for name in metrics])
    return sums.select("series", F.explode(out).alias("m")).select("series", "m.*")


def _tops(own: DataFrame, weights: DataFrame, near: DataFrame) -> DataFrame:
    """top<k>: the chance that one of the k best of the hour, ties drawn evenly, is near."""
    best = own.where(F.col("rank") <= max(TOPS))
    cuts = []
    for k in TOPS:
        among = F.col("place") <= k
        cuts += [F.min(F.when(among, F.col("score"))).alias(f"cut{k}"), F.max(F.when(among, F.col("rank") - 1)).alias(f"above{k}"), F.max_by("same", F.when(among, F.col("place"))).alias(f"ties{k}")]
    cut = best.groupBy("hour").agg(*cuts)
    around = weights.join(near.select(F.col("p").alias("entity"), "q"), "entity").join(best.select("hour", F.col("entity").alias("q"), "score"), ["hour", "q"], "left").join(cut, "hour")
    found = around.groupBy("series", "hour", "entity").agg(*[F.first(c).alias(c) for c in (*_W, *[f"{c}{k}" for k in TOPS for c in ("above", "ties")])], *[x for k in TOPS for x in (F.max(F.coalesce(F.col("score") > F.col(f"cut{k}"), F.lit(False))).alias(f"sure{k}"), F.count_if(F.col("score") == F.col(f"cut{k}")).alias(f"b{k}"))])
    hit = {f"top{k}": F.when(F.col(f"sure{k}"), 1.0).otherwise(1 - miss_probability(F.col(f"ties{k}"), F.col(f"b{k}"), F.least(k - F.col(f"above{k}"), F.col(f"ties{k}")))) for k in TOPS}
    return _means(found, hit)


def _random_tops(weights: DataFrame, near: DataFrame, n: int) -> DataFrame:
    around = near.groupBy(F.col("p").alias("entity")).agg(F.count("*").alias("m"))
    chance = around.select("entity", *[(1 - miss_probability(F.lit(n), F.col("m"), F.lit(min(k, n)))).alias(f"c{k}") for k in TOPS])
    return _means(weights.join(chance, "entity"), {f"random_top{k}": F.col(f"c{k}") for k in TOPS})


def _zones(rows: DataFrame, weights: DataFrame, near: DataFrame, many: int, draws: int) -> DataFrame:
    """zone<i>, frozen_zone<i>, random_zone<i>: the share of the active entities near what budget i buys."""
    flags, z = [f"budget{i}" for i in range(len(BUDGETS))], range(len(BUDGETS))
    bought = rows.where(F.greatest(*flags) & (_series() < 2 * many + draws)).select("hour", _series().alias("s"), "entity", *[F.col(f).cast("int").alias(f"z{i}") for i, f in enumerate(flags)])
    most = [F.max(f"z{i}").alias(f"z{i}") for i in z]
    own = bought.where(F.col("s") < many).drop("s").withColumnRenamed("entity", "q")
    met = weights.join(near.select(F.col("p").alias("entity"), "q"), "entity").join(own, ["hour", "q"]).groupBy("series", "hour", "entity").agg(*most, *[F.first(w).alias(w) for w in _W])
    still = bought.where(F.col("s") >= many).select("s", F.col("entity").alias("p"), *[f"z{i}" for i in z]).join(near.select("p", F.col("q").alias("entity")), "p").groupBy("s", "entity").agg(*most)
    frozen = still.where(F.col("s") < 2 * many).withColumn("series", F.col("s") - many)
    drawn = still.where(F.col("s") >= 2 * many).groupBy("entity").agg(*[(F.sum(f"z{i}") / draws).alias(f"z{i}") for i in z])
    parts = [("", met), ("frozen_", weights.join(frozen, ["series", "entity"])), ("random_", weights.join(drawn, "entity"))]
    return reduce(DataFrame.unionByName, [_means(df, {f"{prefix}zone{i}": F.col(f"z{i}") for i in z}) for prefix, df in parts])


def _footprints(rows: DataFrame, weights: DataFrame, near: DataFrame, lengths: DataFrame, total: float, many: int, draws: int) -> DataFrame:
    """footprint<i>, frozen_footprint<i>, random_footprint<i>: the share of the active entities in what lies near the best entities whose surroundings make up share i of all length."""
    e, drawn = range(len(SHARES)), (_series() >= 2 * many) & (_series() < 2 * many + draws)
    placed = rows.where((F.col("place") <= MOST) & ~drawn).select("hour", F.col("entity").alias("p"), "place")
    first = placed.join(near.select("p", "q"), "p").groupBy("hour", "q").agg(F.min("place").alias("place"))
    grown = first.join(lengths.select(F.col("entity").alias("q"), F.col("length").cast("double").alias("length")), "q").groupBy("hour", "place").agg(F.sum("length").alias("new"))
    so_far = grown.withColumn("sum", F.sum("new").over(Window.partitionBy("hour").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    cuts = so_far.groupBy("hour").agg(*[F.coalesce(F.min(F.when(F.col("sum") >= f * total, F.col("place"))), F.lit(MOST)).alias(f"cut{i}") for i, f in enumerate(SHARES)])
    inside = first.join(cuts, "hour").where(F.col("place") <= F.greatest(*[f"cut{i}" for i in e])).select("hour", _series().alias("s"), F.col("q").alias("entity"), *[(F.col("place") <= F.col(f"cut{i}")).cast("int").alias(f"e{i}") for i in e])
    own = weights.join(inside.where(F.col("s") < many).drop("s"), ["hour", "entity"])
    frozen = weights.join(inside.where((F.col("s") >= many) & (F.col("s") < 2 * many)).select((F.col("s") - many).alias("series"), "entity", *[f"e{i}" for i in e]), ["series", "entity"])
    hour = lambda c: F.col(c) - F.shiftleft(F.shiftright(c, _BITS), _BITS)
    random = weights.withColumn("h", hour("hour")).join(inside.where(F.col("s") >= 2 * many).select(hour("hour").alias("h"), "entity", *[f"e{i}" for i in e]), ["h", "entity"])
    return reduce(DataFrame.unionByName, [_means(df, {f"{prefix}footprint{i}": F.col(f"e{i}") for i in e}) for prefix, df in (("", own), ("frozen_", frozen), ("random_", random))])


def comparison(maps: DataFrame, near: DataFrame, lengths: DataFrame, outside: DataFrame, draws: int = 16, seed: str = "9") -> DataFrame:
    """map, mode and 36 metrics of every map and mode of ``maps``; null average precision and mean rank where no hour has an active entity.

    outside has the entities outside the zone. Hours with a score that is not a finite number must have been left out before."""
    spark, maps = maps.sparkSession, written(maps.select("map", "mode", "hour", "entity", "score", "active"), "compare-maps")
    names = sorted(tuple(r) for r in maps.select("map", "mode").distinct().collect())  # a row a map and mode
    many, known = len(names), spark.createDataFrame([(m, mode, i) for i, (m, mode) in enumerate(names)], "map string, mode string, series bigint")
    sums = lengths.agg(F.sum(F.col("length").cast("double")).alias("total"), F.count("*").alias("n")).first()
    total, near = sums.total or 0.0, written(near.select("p", "q"), "compare-near").hint("merge")
    rows = written(ranked(instants(maps, known, many, draws, seed), lengths, total), "compare-ranked").hint("merge")
    own = rows.where(_series() < many)
    weights = written(_weights(own.where("active").select("hour", "entity"), outside), "compare-weights").hint("merge")  # packed files say little of its size in memory
    long = reduce(DataFrame.unionByName, [_tops(own, weights, near), _random_tops(weights, near, sums.n), _zones(rows, weights, near, many, draws), _footprints(rows, weights, near, lengths, total, many, draws)])
    named = own.withColumn("series", _series())
    hours = named.groupBy("series", "hour").agg(F.max("active").alias("any")).groupBy("series").agg(F.count("*").alias("hours"), F.count_if("any").alias("hours_active"))
    ap = rank.average_precision_by(named, ["series"], "score", "active").select("series", "ap")
    ranks = named.where("active").groupBy("series").agg((F.sum(F.col("rank") + (F.col("same") - 1) / 2) / F.count("*")).alias("mean_rank"))
    value = lambda metric, w="w": F.round(F.coalesce(F.max(F.when(F.col("metric") == metric, F.col(w))), F.lit(0.0)), 6)
    percent = lambda x: round(100 * x)
    cols = {f"{r}top{k}": value(f"{r}top{k}") for k in TOPS for r in ("", "random_")}
    cols |= {f"{r}zone_{percent(b)}": value(f"{r}zone{i}") for i, b in enumerate(BUDGETS) for r in ("", "frozen_", "random_")}
    cols |= {f"{r}footprint_{percent(s)}": value(f"{r}footprint{i}") for i, s in enumerate(SHARES) for r in ("", "frozen_", "random_")}
    for suffix, w in (("per_entity", "wp"), ("outside", "wo")):
        cols |= {f"{name}_{suffix}": value(metric, w) for name, metric in (("top5", "top5"), ("random_top5", "random_top5"), ("footprint_20", "footprint1"), ("random_footprint_20", "random_footprint1"))}
    wide = long.groupBy("series").agg(*[v.alias(c) for c, v in cols.items()])
    out = reduce(lambda a, b: a.join(b, "series", "left"), [ap, ranks, wide], hours).join(F.broadcast(known), "series")
    return out.select("map", "mode", "hours", "hours_active", "ap", F.round("mean_rank", 4).alias("mean_rank"), *cols)
