"""Network operators over links (link, a, b, ...) and nodes (node, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplegrid.sources.shared import removed, written


def cut(links: DataFrame) -> DataFrame:
    """link, segment, a, b: every link as two halves that meet in a midpoint named after it."""
    middle = F.concat(F.lit("m"), F.col("link").cast("string"))
    halves = F.array(F.struct(F.lit(1).alias("segment"), F.col("a").cast("string").alias("a"), middle.alias("b")), F.struct(F.lit(2).alias("segment"), middle.alias("a"), F.col("b").cast("string").alias("b")))
    return links.select("link", F.explode(halves).alias("h")).select("link", "h.segment", "h.a", "h.b")


def doubled(links: DataFrame) -> DataFrame:
    """link, src, dst: every link in both directions."""
    return links.select("link", F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("x")).select("link", "x.src", "x.dst")


def line_graph(links: DataFrame) -> DataFrame:
    """l1, l2, node, sign: pairs of different links that share a node, in both directions; sign is 1 if l1 ends there, else -1."""
    ends = links.select("link", F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(-1).alias("sign")), F.struct(F.col("b").alias("node"), F.lit(1).alias("sign")))).alias("x")).select("link", "x.node", "x.sign")
    other = ends.select(F.col("link").alias("l2"), "node").distinct()
    return ends.select(F.col("link").alias("l1"), "node", "sign").join(other, "node").where("l1 <> l2").select("l1", "l2", "node", "sign")


def line_features(links: DataFrame, nodes: DataFrame, fields: list[str]) -> DataFrame:
    """links with the fields of their first node as start_* and of their second as end_*."""
    start = nodes.select(F.col("node").alias("a"), *[F.col(f).alias(f"start_{f}") for f in fields])
    end = nodes.select(F.col("node").alias("b"), *[F.col(f).alias(f"end_{f}") for f in fields])
    return links.join(start, "a").join(end, "b")


def balance(links: DataFrame, q1: str = "q1", q2: str = "q2") -> DataFrame:
    """node, balance: what links bring (q2 of those that end there) less what they take (q1 of those that begin there)."""
    flows = links.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col(q2).alias("q")), F.struct(F.col("a").alias("node"), (-F.col(q1)).alias("q")))).alias("x")).select("x.*")
    return flows.groupBy("node").agg(F.round(F.sum("q"), 4).alias("balance"))


def losses(links: DataFrame, q1: str = "q1", q2: str = "q2") -> DataFrame:
    """link, loss: q1 - q2 at the midpoint."""
    return links.select("link", F.round(F.col(q1) - F.col(q2), 4).alias("loss"))


def all_of_kind(links: DataFrame, kind: str, value: str) -> DataFrame:
    """node, degree of the nodes all of whose links are of that kind."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node"), (F.col(kind) == value).alias("ok"))
    return ends.groupBy("node").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("degree")).where("ok").select("node", "degree")


def neighbour_mean(nodes: DataFrame, links: DataFrame, value: str) -> DataFrame:
    """node, mean: the mean value of the sources of a node's arcs, 0 without any."""
    arcs = doubled(links)
    got = arcs.join(nodes.select(F.col("node").alias("src"), value), "src").groupBy(F.col("dst").alias("node")).agg(F.avg(value).alias("m"))
    return nodes.select("node").join(got, "node", "left").select("node", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean"))


def union_edges(first: DataFrame, second: DataFrame) -> DataFrame:
    """src, dst, origin of both edge lists without repeats; of equal edges the first list's is kept."""
    both = first.select("src", "dst", F.lit(0).alias("origin")).unionByName(second.select("src", "dst", F.lit(1).alias("origin")))
    return both.groupBy("src", "dst").agg(F.min("origin").alias("origin"))


def distances(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """source, node, distance: shortest paths over arcs (src, dst, length >= 0) by rounds of relaxation until nothing changes.

    Each round extends only what the round before has shortened, and its table is written to cut the lineage."""
    best = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance"), F.lit(True).alias("new"))
    earlier = None
    while True:
        longer = best.where("new").join(arcs, best["node"] == arcs["src"]).groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("length")).alias("found"))
        both = best.drop("new").join(longer, ["source", "node"], "full")
        shorter = F.col("distance").isNull() | (F.col("found") < F.col("distance"))
        best = both.select("source", "node", F.least("distance", "found").alias("distance"), F.coalesce(shorter, F.lit(False)).alias("new"))
        best = written(best, "path-round")
        if earlier is not None:
            removed(earlier)
        earlier = best
        if not best.where("new").limit(1).count():
            return best.drop("new")


def paths_within(links: DataFrame, reach: float) -> DataFrame:
    """p, q, d: links (link, a, b, length >= 0) whose middles are at most ``reach`` apart along the network, each with itself (0).

    A path is half of the first link, the links between and half of the last. From every link a frontier spreads over the nodes: a
    round extends only what the round before has shortened and drops what is beyond reach, so the work follows the near
    pairs and not the square of the network. Each round is written."""
    ends = links.select("link", F.explode(F.array("a", "b")).alias("node"), (F.col("length") / 2).alias("half"))
    arcs = links.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "length"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "length"))).alias("x")).select("x.*")
    known = written(ends.where(F.col("half") <= reach).groupBy(F.col("link").alias("p"), "node").agg(F.min("half").alias("d")), "path-known")
    frontier = known
    while True:
        step = frontier.join(arcs, frontier["node"] == arcs["src"]).select("p", F.col("dst").alias("node"), (F.col("d") + F.col("length")).alias("d")).where(F.col("d") <= reach)
        found = step.groupBy("p", "node").agg(F.min("d").alias("d"))
        old = known.select("p", "node", F.col("d").alias("old"))
        better = written(found.join(old, ["p", "node"], "left").where("old IS NULL OR d < old").select("p", "node", "d"), "path-frontier")
        if not better.limit(1).count():
            removed(better)
            break
        both = written(known.join(better.select("p", "node"), ["p", "node"], "left_anti").unionByName(better), "path-known")
        removed(known)
        if frontier is not known:
            removed(frontier)
        known, frontier = both, better
    reached = known.join(ends, "node").where("p <> link").select("p", F.col("link").alias("q"), (F.col("d") + F.col("half")).alias("d")).where(F.col("d") <= reach)
    return reached.groupBy("p", "q").agg(F.min("d").alias("d")).unionByName(links.select(F.col("link").alias("p"), F.col("link").alias("q"), F.lit(0.0).alias("d")))


def standard_static(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """nodes with the fields z-scored by population deviation (1 if it is tiny)."""
    stats = nodes.agg(*[x for f in fields for x in (F.avg(f).alias(f"{f}__c"), F.stddev_pop(f).alias(f"{f}__s"))]).first()
    return nodes.withColumns({f: (F.col(f) - F.lit(stats[f"{f}__c"])) / F.lit(stats[f"{f}__s"] if stats[f"{f}__s"] and stats[f"{f}__s"] >= 1e-6 else 1.0) for f in fields})


def positive_losses(links: DataFrame, q1: str = "q1", q2: str = "q2") -> DataFrame:
    """link, loss: what is lost at the midpoint; a gain counts as none."""
    return links.select("link", F.round(F.greatest(F.col(q1) - F.col(q2), F.lit(0.0)), 4).alias("loss"))


def typed(links: DataFrame, kind: str, kinds: list[str]) -> DataFrame:
    """links with a 0/1 column is_<kind> for each of the kinds."""
    return links.withColumns({f"is_{k}": (F.col(kind) == k).cast("int") for k in kinds})


def geometry(links: DataFrame, places: DataFrame) -> DataFrame:
    """link, length, x, y: the distance between a link's ends and the point half-way; places has node, x, y."""
    ends = [places.select(F.col("node").alias(e), F.col("x").alias(f"x_{e}"), F.col("y").alias(f"y_{e}")) for e in ("a", "b")]
    both = links.join(ends[0], "a").join(ends[1], "b")
    return both.select("link", F.round(F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")), 6).alias("length"), ((F.col("x_a") + F.col("x_b")) / 2).alias("x"), ((F.col("y_a") + F.col("y_b")) / 2).alias("y"))


def boundary(links: DataFrame, edge: DataFrame) -> DataFrame:
    """link, segment: of the links with one end among the nodes of ``edge``, which half (1: the start's) touches it."""
    marked = links
    for end in ("a", "b"):
        marked = marked.join(edge.select(F.col("node").alias(end), F.lit(True).alias(f"on_{end}")), end, "left").withColumn(f"on_{end}", F.coalesce(f"on_{end}", F.lit(False)))
    return marked.where(F.col("on_a") != F.col("on_b")).select("link", F.when(F.col("on_a"), 1).otherwise(2).alias("segment"))
