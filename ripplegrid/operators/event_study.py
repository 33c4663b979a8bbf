"""Event studies: backgrounds, anchors with controls, gains, and their difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegrid.operators import spatial
from ripplegrid.operators.rank import ordered


def background(scores: DataFrame, before: Column) -> DataFrame:
    """scores with background: the mean of the same entity and hour of day over the rows where ``before`` holds, and residual.

    An hour of day without such a row has a null background."""
    mean = scores.withColumn("hod", F.hour("hour")).groupBy("entity", "hod").agg(F.avg(F.when(before, F.col("score"))).alias("background"))
    out = scores.withColumn("hod", F.hour("hour")).join(mean, ["entity", "hod"])
    return out.select("hour", "entity", "score", "background", (F.col("score") - F.col("background")).alias("residual"))


def around(scores: DataFrame, anchors: DataFrame, hours: int) -> DataFrame:
    """case, entity, offset, score: the scores up to ``hours`` hours before and after each anchor (case, entity, anchor).

    Every anchor names the hours it needs, so the join is by equality."""
    wanted = anchors.select("case", "entity", "anchor", F.explode(F.sequence(F.lit(-hours), F.lit(hours - 1))).alias("offset"))
    wanted = wanted.withColumn("hour", F.col("anchor") + F.make_dt_interval(F.lit(0), F.col("offset")))
    return wanted.join(scores, ["hour", "entity"]).select("case", "entity", "offset", "score")


def controls(anchors: DataFrame, days: tuple[int, ...] = (7, 14)) -> DataFrame:
    """anchors with case 'event', and the same hour so many days before as case 'control_<days>'."""
    both = [anchors.select(F.lit("event").alias("case"), "entity", "anchor")]
    both += [anchors.select(F.lit(f"control_{d}").alias("case"), "entity", (F.col("anchor") - F.make_dt_interval(F.lit(d))).alias("anchor")) for d in days]
    out = both[0]
    for x in both[1:]:
        out = out.unionByName(x)
    return out


def gains(windows: DataFrame) -> DataFrame:
    """case, entity, before, after, gain, rise: means of both sides, and the gain in population deviations of the side before (null if it is constant)."""
    pre, post = F.col("offset") < 0, F.col("offset") >= 0
    each = windows.groupBy("case", "entity").agg(F.avg(F.when(pre, F.col("score"))).alias("b"), F.avg(F.when(post, F.col("score"))).alias("a"), F.stddev_pop(F.when(pre, F.col("score"))).alias("s"))
    return each.select("case", "entity", F.round("b", 6).alias("before"), F.round("a", 6).alias("after"), F.round(F.col("a") - F.col("b"), 6).alias("gain"), F.round(F.when(F.col("s") > 1e-12, (F.col("a") - F.col("b")) / F.col("s")), 6).alias("rise"))


def difference_in_differences(gained: DataFrame) -> DataFrame:
    """entity, event_gain, control_gain, difference: the event's gain less the mean gain of its controls."""
    event = F.col("case") == "event"
    out = gained.groupBy("entity").agg(F.avg(F.when(event, F.col("gain"))).alias("e"), F.avg(F.when(~event, F.col("gain"))).alias("c"))
    return out.select("entity", F.round("e", 6).alias("event_gain"), F.round("c", 8).alias("control_gain"), F.round(F.col("e") - F.col("c"), 8).alias("difference"))


def concurrent(anchors: DataFrame, events: DataFrame, hours: int, slot_hours: int = 24) -> DataFrame:
    """entity, anchor, n: events of other entities within [anchor - hours, anchor + hours + 1).

    A range join by slots: every anchor names the slots that its range touches, so both sides meet by equality."""
    slot = lambda t: F.floor(F.unix_timestamp(t.cast("timestamp")) / (3600 * slot_hours))
    lo, hi = F.col("anchor") - F.make_dt_interval(F.lit(0), F.lit(hours)), F.col("anchor") + F.make_dt_interval(F.lit(0), F.lit(hours + 1))
    wide = anchors.select("entity", "anchor", lo.alias("lo"), hi.alias("hi")).withColumn("slot", F.explode(F.sequence(slot(F.col("lo")), slot(F.col("hi")))))
    other = events.select(F.col("entity").alias("other"), "ts", slot(F.col("ts")).alias("slot"))
    found = wide.join(other, "slot").where((F.col("other") != F.col("entity")) & (F.col("ts") >= F.col("lo")) & (F.col("ts") < F.col("hi"))).groupBy("entity", "anchor").agg(F.count("*").alias("n"))
    return anchors.select("entity", "anchor").join(found, ["entity", "anchor"], "left").select("entity", "anchor", F.coalesce("n", F.lit(0)).alias("n"))


def surroundings(scores: DataFrame, cases: DataFrame, horizon: int) -> DataFrame:
    """case, before, hour, entity, score: the maps of the ``horizon`` hours before and after each case's anchor (case, anchor), without its own hour."""
    offsets = F.concat(F.sequence(F.lit(-horizon), F.lit(-1)), F.sequence(F.lit(1), F.lit(horizon)))
    wanted = cases.select("case", "anchor", F.explode(offsets).alias("offset"))
    wanted = wanted.select("case", (F.col("anchor") + F.make_dt_interval(F.lit(0), F.col("offset"))).alias("hour"), (F.col("offset") < 0).alias("before"))
    return wanted.join(scores.select("hour", "entity", "score"), "hour").select("case", "before", "hour", "entity", "score")


def case_background(rows: DataFrame) -> DataFrame:
    """rows with background: the case's mean of the same entity and hour of day before the anchor. An hour of day without a row before is an error."""
    mean = rows.groupBy("case", "entity", F.hour("hour").alias("hod")).agg(F.avg(F.when(F.col("before"), F.col("score"))).alias("background"))
    joined = rows.withColumn("hod", F.hour("hour")).join(mean, ["case", "entity", "hod"])
    sure = F.when(F.col("background").isNull(), F.raise_error(F.lit("an hour of day has no row before the anchor"))).otherwise(F.col("background"))
    return joined.select("case", "before", "hour", "entity", "score", sure.alias("background"))


def modes(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """mode, case, before, hour, entity, score: the smoothed maps as they are (absolute), those of the changes against the background
    (change), and the background of the smoothed maps (background)."""
    key = F.struct("case", "before", "hour").alias("hour")
    back = lambda df: df.select(F.col("hour.case").alias("case"), F.col("hour.before").alias("before"), F.col("hour.hour").alias("hour"), "entity", "score")
    known = case_background(rows)
    absolute = back(spatial.smooth(rows.select(key, "entity", "score"), weights))
    change = back(spatial.smooth(known.select(key, "entity", (F.col("score") - F.col("background")).alias("score")), weights))
    still = case_background(absolute).select("case", "before", "hour", "entity", F.col("background").alias("score"))
    return reduce(DataFrame.unionByName, [df.withColumn("mode", F.lit(m)) for m, df in (("absolute", absolute), ("change", change), ("background", still))])


def local_rise(maps: DataFrame, cases: DataFrame) -> DataFrame:
    """case, before, after, rise, deviation, rise_deviations at each case's own entity: the smoothed score before and after; how far it lies
    above its background after; the population deviation of that before; and their ratio (null if it is constant)."""
    own = maps.join(cases.select("case", "entity"), ["case", "entity"])
    pair = own.groupBy("case", "before", "hour").agg(*[F.max(F.when(F.col("mode") == m, F.col("score"))).alias(m) for m in ("absolute", "background")])
    gap, pre = F.col("absolute") - F.col("background"), F.col("before")
    each = pair.groupBy("case").agg(F.avg(F.when(pre, F.col("absolute"))).alias("b"), F.avg(F.when(~pre, F.col("absolute"))).alias("a"), F.avg(F.when(~pre, gap)).alias("r"), F.stddev_pop(F.when(pre, gap)).alias("s"))
    ratio = F.when(F.col("s") > 1e-12, F.col("r") / F.col("s"))
    return each.select("case", F.round("b", 6).alias("before"), F.round("a", 6).alias("after"), F.round("r", 6).alias("rise"), F.round("s", 6).alias("deviation"), F.round(ratio, 4).alias("rise_deviations"))


def footprint_gains(maps: DataFrame, cases: DataFrame, near: DataFrame, lengths: DataFrame, shares: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """case, mode, share, before, after, gain: how much of the hours before and after the case's own entity lies in the footprint of a share of all length.

    Entities by falling score make up the footprint; the entity that would pass the share counts in the part that is still needed, and so does what
    only it brings in."""
    total = float(lengths.agg(F.sum("length")).first()[0] or 0.0)
    placed = ordered(maps.select(F.struct("mode", "case", "before", "hour").alias("hour"), "entity", "score")).select("hour", F.col("entity").alias("p"), "place")
    first = placed.join(near.select("p", "q"), "p").groupBy("hour", "q").agg(F.min("place").alias("place"))
    grown = first.join(lengths.select(F.col("entity").alias("q"), F.col("length").cast("double").alias("length")), "q").groupBy("hour", "place").agg(F.sum("length").alias("new"))
    grown = grown.withColumn("sum", F.sum("new").over(Window.partitionBy("hour").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    own = first.select("hour", F.col("hour.case").alias("case"), F.col("q").alias("entity"), F.col("place").alias("own")).join(cases.select("case", "entity"), ["case", "entity"]).select("hour", "own")
    cut = F.min(F.when(F.col("sum") >= F.col("target"), F.struct("place", ((F.col("target") - (F.col("sum") - F.col("new"))) / F.col("new")).alias("part"))))
    targets = F.array(*[F.struct(F.lit(f).alias("share"), F.lit(f * total).alias("target")) for f in shares])
    cuts = grown.select("*", F.explode(targets).alias("t")).select("hour", "place", "new", "sum", "t.*").groupBy("hour", "share").agg(cut.alias("cut"))
    inside = F.when(F.col("own") < F.col("cut.place"), 1.0).when(F.col("own") == F.col("cut.place"), F.col("cut.part")).otherwise(0.0)
    each = cuts.join(own, "hour").select(F.col("hour.case").alias("case"), F.col("hour.mode").alias("mode"), F.col("hour.before").alias("pre"), "share", inside.alias("x"))
    both = each.groupBy("case", "mode", "share").agg(F.avg(F.when(F.col("pre"), F.col("x"))).alias("b"), F.avg(F.when(~F.col("pre"), F.col("x"))).alias("a"))
    return both.select("case", "mode", "share", F.round("b", 9).alias("before"), F.round("a", 9).alias("after"), F.round(F.col("a") - F.col("b"), 9).alias("gain"))


def synthesis(gained: DataFrame, cases: DataFrame) -> DataFrame:
    """mode, share, event_before, event_after, event_gain, control_before, control_after, control_gain, difference: means over the cases of either kind (case, control)."""
    x = gained.join(cases.select("case", "control"), "case")
    made = [F.avg(F.when(F.col("control") == c, F.col(f))).alias(f"{name}_{f}") for c, name in ((False, "event"), (True, "control")) for f in ("before", "after", "gain")]
    out = x.groupBy("mode", "share").agg(*made)
    return out.select("mode", "share", *[F.round(f"{name}_{f}", 6).alias(f"{name}_{f}") for name in ("event", "control") for f in ("before", "after", "gain")], F.round(F.col("event_gain") - F.col("control_gain"), 6).alias("difference"))
