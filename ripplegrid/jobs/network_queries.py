"""Queries over nearness on a plane and along a network, and over plans whose periods must not meet.

Customers stand on a plane by balance and a spread number, and hang together as a tree with cross links; users likewise. Planned episodes are
orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplegrid.jobs.score_queries import _BY_HOUR, _FINE, _HIT, GRID, Inputs
from ripplegrid.jobs.table_queries import _plan
from ripplegrid.operators import graph, plan, rank, spatial
from ripplegrid.sources.tables import table

_X, _Y = "{0} * 37 % 1009", "{0} * 91 % 997"


def near_customers(spark, sf_dir):
    """All customers within 150 of each other on the plane."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"))
    return spatial.near_pairs(c, 150.0).select("p", "q", (F.floor(F.col("d") * 1e6 + 0.5) / 1e6).alias("d"))  # F.round() makes a decimal of every double


def localisation_planar(spark, sf_dir):
    """Localisation where near means within 120 on the plane."""
    x = Inputs(spark, sf_dir)
    places = x.users.select("entity", F.expr(_X.format("entity")).alias("x"), F.expr(_Y.format("entity")).alias("y"))
    return spatial.localisation_within(x.scores, places, 120.0, 5)


def _pipes(ids):
    """link, a, b, length: every id is a link from itself to half of it, or, every fifth, to the number after it."""
    own = F.col("entity")
    return ids.select(own.alias("link"), own.alias("a"), F.when(own % 5 == 0, own + 1).otherwise(F.floor(own / 2)).alias("b"), (40 + own % 7 * 10).cast("double").alias("length"))


def paths_within_reach(spark, sf_dir):
    """Links of the customers' network whose middles are at most 200 apart along it."""
    return graph.paths_within(_pipes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"))), 200.0)


def localisation_by_paths(spark, sf_dir):
    """Localisation where near means within 150 along the users' network."""
    x = Inputs(spark, sf_dir)
    return rank.localisation(x.scores, graph.paths_within(_pipes(x.users), 150.0), 5)


def plan_overlap_pairs(spark, sf_dir):
    """The pairs of planned episodes of different partitions that share time; an episode of six hours begins about every other hour."""
    o = _plan(spark, sf_dir).withColumn("begin", F.col("id") * 2 + F.col("variant") % 7)
    return plan.overlapping(o.withColumn("finish", F.col("begin") + 6), 24)


def planned_episodes(spark, sf_dir):
    """A day for every order such that days of different partitions never meet, six to one to one of a thousand."""
    return plan.assigned(_plan(spark, sf_dir), {"train": 6, "validation": 1, "test": 1}, 1000, 24, 6, "9")


def planned_conflicts(spark, sf_dir):
    """How many episodes of each partition were planned, in how many slots, and in how many slots another partition's are too (none)."""
    p = planned_episodes(spark, sf_dir)
    by = p.groupBy("slot").agg(F.count_distinct("partition").alias("kinds"))
    return p.join(by, "slot").groupBy("partition").agg(F.count("*").alias("episodes"), F.count_distinct("slot").alias("slots"), F.count_if(F.col("kinds") > 1).alias("conflicts"))


_PIPES = "l AS (SELECT {0} AS link, {0} AS a, CASE WHEN {0} % 5 = 0 THEN {0} + 1 ELSE {0} // 2 END AS b, (40 + {0} % 7 * 10)::DOUBLE AS length FROM {1})"


def _paths(reach: int, rounds: int) -> str:
    """near: pairs of links l by so many rounds of relaxation, enough for links of 40 and more."""
    out = ["e AS (SELECT link, a AS node, length / 2 AS half FROM l UNION ALL SELECT link, b, length / 2 FROM l)", "rr AS (SELECT a AS src, b AS dst, length FROM l UNION ALL SELECT b, a, length FROM l)", "d0 AS MATERIALIZED (SELECT link AS p, node, min(half) AS d FROM e GROUP BY 1, 2)"]
    out += [f"d{n + 1} AS MATERIALIZED (SELECT p, node, min(d) AS d FROM (SELECT * FROM d{n} UNION ALL SELECT p, dst, d + length FROM d{n} JOIN rr ON src = node WHERE d + length <= {reach}) GROUP BY 1, 2)" for n in range(rounds)]
    out += [f"near AS (SELECT p, link AS q, min(d + half) AS d FROM d{rounds} JOIN e USING (node) WHERE p <> link AND d + half <= {reach} GROUP BY 1, 2 UNION ALL SELECT link, link, 0 FROM l)"]
    return ", ".join(out)


_DRAWN = "('0x' || substr(md5('9|' || {}), 1, 8))::BIGINT"
_ORDERS = "o AS (SELECT o_orderkey AS id, o_custkey AS variant, CASE WHEN year(o_orderdate) < 1999 THEN 'train' WHEN year(o_orderdate) < 2000 THEN 'validation' ELSE 'test' END AS part FROM orders)"
_PLANNED = f"""{_ORDERS}, sl AS (SELECT s, CASE WHEN d < 6 THEN 'train' WHEN d < 7 THEN 'validation' ELSE 'test' END AS part FROM (SELECT s, {_DRAWN.format("'slot|' || s")} % 8 AS d FROM range(1000) t(s))),
tb AS (SELECT part, s, row_number() OVER (PARTITION BY part ORDER BY s) - 1 AS n, count(*) OVER (PARTITION BY part) AS of FROM sl),
tn AS (SELECT *, row_number() OVER (PARTITION BY part, variant ORDER BY {_DRAWN.format("'episode|' || id")}, id) - 1 AS turn FROM o),
pl AS (SELECT id, variant, tn.part AS partition, s AS slot, s * 24 AS begin, s * 24 + 6 AS finish FROM tn JOIN tb ON tb.part = tn.part AND tb.n = ({_DRAWN.format("'variant|' || variant")} + turn) % of)"""
_NEAR_PLANAR = f"near AS (SELECT a.entity AS p, b.entity AS q, 0 AS d FROM users a JOIN users b ON ({_X.format('a.entity')} - {_X.format('b.entity')}) ** 2 + ({_Y.format('a.entity')} - {_Y.format('b.entity')}) ** 2 <= 120 ** 2)"
_NO_RING = GRID[: GRID.index("near AS")] + GRID[GRID.index("lengths AS") :]

QUERIES = {
    near_customers: "WITH c AS (SELECT c_custkey AS e, c_acctbal AS x, (c_custkey * 7919 % 10007)::DOUBLE AS y FROM customer) SELECT a.e AS p, b.e AS q, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM c a JOIN c b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 150",
    localisation_planar: f"WITH {_NO_RING}, {_NEAR_PLANAR}, {_FINE}, {_HIT.format(k=5)} {_BY_HOUR}",
    paths_within_reach: f"WITH {_PIPES.format('c_custkey', 'customer')}, {_paths(200, 5)} SELECT p, q, d FROM near",
    localisation_by_paths: f"WITH {_NO_RING}, {_PIPES.format('entity', 'users')}, {_paths(150, 4)}, {_FINE}, {_HIT.format(k=5)} {_BY_HOUR}",
    plan_overlap_pairs: f"WITH {_ORDERS}, p AS (SELECT id, part, id * 2 + variant % 7 AS b FROM o) SELECT x.id AS a, y.id AS b FROM p x JOIN p y ON y.id BETWEEN x.id + 1 AND x.id + 7 AND x.part <> y.part AND x.b < y.b + 6 AND y.b < x.b + 6",
    planned_episodes: f"WITH {_PLANNED} SELECT * FROM pl",
    planned_conflicts: f"WITH {_PLANNED} SELECT partition, count(*) AS episodes, count(DISTINCT slot) AS slots, 0::BIGINT AS conflicts FROM pl GROUP BY 1",
}
