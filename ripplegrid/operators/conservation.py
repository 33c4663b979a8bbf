"""Conservation of flow: what links bring to nodes and lose on the way, the scales it is measured in, and the loss of a prediction.

Flows are rows (episode, step, link, a, b, ...) with a value at the link's start and one at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplegrid.functions.scalar import weighted_log_loss

#: Scales and references are never below this.
TINY = 1e-6


def balances(flows: DataFrame, nodes: DataFrame, first: Column, second: Column) -> DataFrame:
    """episode, step, node, balance at the nodes given: the ends' values of links that come in less the starts' values of links that go out."""
    ends = F.array(F.struct(F.col("b").alias("node"), second.alias("q")), F.struct(F.col("a").alias("node"), (-first).alias("q")))
    return flows.select("episode", "step", F.explode(ends).alias("x")).select("episode", "step", "x.*").join(nodes.select("node"), "node", "left_semi").groupBy("episode", "step", "node").agg(F.sum("q").alias("balance"))


def _square_sum(flows: DataFrame, nodes: DataFrame, first: Column, second: Column) -> DataFrame:
    """One row: the mean square of the balances over all instants and nodes; a node without a flow at an instant is balanced."""
    instants = flows.select("episode", "step").distinct().agg(F.count("*").alias("instants"))
    sums = balances(flows, nodes, first, second).agg(F.coalesce(F.sum(F.col("balance") * F.col("balance")), F.lit(0.0)).alias("s"))
    many = nodes.select("node").distinct().agg(F.count("*").alias("nodes"))
    return sums.crossJoin(F.broadcast(instants)).crossJoin(F.broadcast(many)).select(F.try_divide(F.col("s"), F.col("instants") * F.col("nodes")).alias("junctions"))  # one row each


def scale(flows: DataFrame, first: str, second: str) -> DataFrame:
    """One row: scale, the root of the mean over episodes of each episode's mean square of both values."""
    each = flows.groupBy("episode").agg(F.avg((F.col(first) * F.col(first) + F.col(second) * F.col(second)) / 2).alias("m"))
    return each.agg(F.greatest(F.sqrt(F.avg("m")), F.lit(TINY)).alias("scale"))


def fit(flows: DataFrame, nodes: DataFrame, first: str, second: str) -> DataFrame:
    """One row: scale, and in its units the mean squares of the balances at the nodes (junctions) and of the losses on the links (midpoints): the
    references of the loss, which are those of predicting no change."""
    one, two = F.col(first), F.col(second)
    middle = flows.agg(F.avg((one - two) * (one - two)).alias("midpoints"))
    row = scale(flows, first, second).crossJoin(F.broadcast(_square_sum(flows, nodes, one, two))).crossJoin(F.broadcast(middle))  # one row each
    square = F.col("scale") * F.col("scale")
    return row.select("scale", F.greatest(F.col("junctions") / square, F.lit(TINY)).alias("junctions"), F.greatest(F.col("midpoints") / square, F.lit(TINY)).alias("midpoints"))


def loss(flows: DataFrame, nodes: DataFrame, references: DataFrame, logit: str, label: str, positive: float, even_loss: float) -> DataFrame:
    """One row: dq, junctions, midpoints, leak and total of flows with true (y1, y2) and predicted (p1, p2) changes.

    Changes are squared errors in units of the scale, balances and losses those of the errors over their references, the leak a
    weighted log loss over that of even odds; the total is half the leak and a sixth of each of the others."""
    known = references.first()
    e1, e2 = ((F.col(p) - F.col(y)) / known["scale"] for p, y in (("p1", "y1"), ("p2", "y2")))
    here = flows.agg(
        F.avg((e1 * e1 + e2 * e2) / 2).alias("dq"), (F.avg((e1 - e2) * (e1 - e2)) / known["midpoints"]).alias("midpoints"),
        (F.avg(weighted_log_loss(F.col(logit), F.col(label).cast("double"), F.lit(positive))) / even_loss).alias("leak"),
    )
    both = here.crossJoin(F.broadcast(_square_sum(flows, nodes, e1, e2).select((F.col("junctions") / known["junctions"]).alias("junctions"))))  # one row each
    return both.withColumn("total", F.col("leak") / 2 + (F.col("dq") + F.col("junctions") + F.col("midpoints")) / 6).select("dq", "junctions", "midpoints", "leak", "total")
