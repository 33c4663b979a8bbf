"""Order statistics, nearness on a plane and along a network, budgets, plans and piece runs against plain loops."""

import heapq
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegrid.jobs import network_queries, study_queries
from ripplegrid.operators import compare, graph, grid, order_stats, plan, rank, spatial, windows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("parts", [None, 1, 7])
def test_quantiles_equal_numpy(spark, parts):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=500), "b": np.repeat(3.0, 400), None: rng.integers(0, 5, 301).astype(float), "c": np.array([2.0])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("d", None)]
    random.Random(2).shuffle(rows)
    at = (0.0, 0.01, 0.333, 0.5, 0.99, 1.0)
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    out = order_stats.quantiles(df, ["k"], "v", at, parts)
    got = {(r.k, r.q): r.x for r in out.collect()}
    assert set(got) == {(k, q) for k in values for q in at}
    assert all(got[k, q] == pytest.approx(float(np.quantile(v, q)), abs=1e-12) for k, v in values.items() for q in at)
    assert "percentile" not in _plan(out).lower()
    assert order_stats.one_quantile(df.where("k = 'd'"), "v", 0.5) is None


def test_ranks_are_taken_from_the_parts_that_hold_them(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    parts = order_stats.ranged(df, [], "v", 16)
    sizes = [r.n for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 4000
    tied = order_stats.ranged(df.withColumn("v", F.when(F.col("v") % 3 == 0, 5.0).otherwise(F.col("v"))), [], "v", 16)
    assert tied.where("x = 5").count() == 1 and tied.agg(F.sum("n")).first()[0] == 10_000  # a third of all rows is one row
    ranks = spark.createDataFrame([(0,), (17,), (9_999,), (20_000,)], "rank bigint")
    want = sorted(r.v for r in df.collect())
    assert {r["rank"]: r.x for r in order_stats.at_ranks(parts, [], ranks).collect()} == {k: want[k] for k in (0, 17, 9_999)}


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    points = [(i, rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(200)] + [(500 + i, 100.0 * i, 0.0) for i in range(-3, 4)] + [(300, 0.0, 0.0), (301, 0.0, 0.0)]
    df = spark.createDataFrame([*points, (400, None, 1.0)], "entity bigint, x double, y double")
    out = spatial.near_pairs(df, 100.0)
    want = {(a, b) for a, x, y in points for b, u, v in points if ((x - u) ** 2 + (y - v) ** 2) ** 0.5 <= 100}
    got = [(r.p, r.q) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "NestedLoop" not in _plan(out) and "Cartesian" not in _plan(out)
    weights = spatial.kernel(out.select("p", "q", "d"), df.select("entity", F.lit(2.0).alias("length")))
    assert all(r.s == pytest.approx(1) for r in weights.groupBy("p").agg(F.sum("weight").alias("s")).collect())


def test_bounded_paths_equal_dijkstra(spark):
    rng = random.Random(4)
    links = [(i, rng.randrange(40), rng.randrange(40), float(rng.choice([10, 20, 50]))) for i in range(60)] + [(60, 90, 91, 10.0), (61, 92, 92, 400.0)]
    arcs = {}
    for _, a, b, w in links:
        arcs.setdefault(a, []).append((b, w))
        arcs.setdefault(b, []).append((a, w))
    want = {}
    for p, a, b, w in links:
        best, queue = {}, [(w / 2, a), (w / 2, b)]
        heapq.heapify(queue)
        while queue:
            d, n = heapq.heappop(queue)
            if n not in best and d <= 100:
                best[n] = d
                for m, x in arcs[n]:
                    heapq.heappush(queue, (d + x, m))
        for q, u, v, x in links:
            d = 0.0 if p == q else min(best.get(u, 1e9), best.get(v, 1e9)) + x / 2
            if d <= 100:
                want[p, q] = d
    got = graph.paths_within(spark.createDataFrame(links, "link bigint, a bigint, b bigint, length double"), 100.0).collect()
    assert {(r.p, r.q): r.d for r in got} == want and len(got) == len(want)


def test_pairs_follow_the_neighbourhood_and_not_the_network(spark):
    line = lambda n: spark.range(n).select(F.col("id").alias("link"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(100.0).alias("length"))
    assert [graph.paths_within(line(n), 300.0).count() for n in (100, 200)] == [100 * 7 - 12, 200 * 7 - 12]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_budget_equals_a_loop_however_batches_fall(spark, batch):
    rng = random.Random(5)
    lengths = [float(rng.choice([1, 2, 5, 40, 100])) for _ in range(60)]
    scores = [(h, e, float(rng.randrange(20))) for h in range(5) for e in range(60)]
    s = spark.createDataFrame(scores, "h int, entity bigint, score double").select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))).alias("hour"), "entity", "score")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = spatial.within_budgets(s, spark.createDataFrame(list(enumerate(lengths)), "entity bigint, length double"), (0.03, 0.4, 1.0)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.budget, r.hour.hour, r.entity) for r in rows}
    want = set()
    for i, share in enumerate((0.03, 0.4, 1.0)):
        for h in range(5):
            left = share * sum(lengths)
            for _, _, e in sorted((-x, e, e) for k, e, x in scores if k == h):
                if lengths[e] <= left:
                    left -= lengths[e]
                    want.add((i, h, e))
    assert got == want and len(rows) == len(want)
    assert "collect_list" not in _plan(spatial.within_budget(s, spark.createDataFrame(list(enumerate(lengths)), "entity bigint, length double"), 0.1))


def test_planned_periods_never_meet(spark):
    rng = random.Random(6)
    episodes = spark.createDataFrame([(i, i % 37, ["train", "train", "validation", "test"][i % 37 % 4]) for i in range(900)], "id bigint, variant bigint, partition string")
    shares = {"train": 4, "validation": 1, "test": 1}
    planned = plan.assigned(episodes, shares, 300, 24, 6, "s")
    rows = planned.collect()
    assert len(rows) == 900 and plan.overlapping(planned, 24).count() == 0 and plan.contract(planned, "variant", "partition").count() == 0
    by = {}
    for r in rows:
        assert 0 <= r.begin < r.finish <= 300 * 24 and r.finish - r.begin == 6
        by.setdefault(r.variant, []).append(r.slot)
    assert all(len(set(v)) == len(v) for v in by.values())  # a variant's days differ
    assert [tuple(r) for r in plan.assigned(episodes.orderBy(F.desc("id")), shares, 300, 24, 6, "s").orderBy("id").collect()] == sorted(tuple(r) for r in rows)
    assert sorted(r.slot for r in plan.assigned(episodes, shares, 300, 24, 6, "t").collect()) != sorted(r.slot for r in rows)
    assert rng and plan.overlapping(planned.withColumn("partition", F.col("id").cast("string")), 24).count() > 0
    with pytest.raises(ValueError):
        plan.assigned(episodes, shares, 300, 5, 6, "s")
    with pytest.raises(Exception, match="no slot for test"):
        plan.assigned(episodes, {"train": 1, "validation": 1}, 300, 24, 6, "s").collect()


def test_pieces_become_one_run(spark):
    runs = [("e", b, f, i, 100 * n + i) for n, (b, f) in enumerate([(0, 3), (3, 4), (4, 9)]) for i in range(f - b + 1)]
    out = windows.concatenated(spark.createDataFrame(runs, "ep string, begin int, finish int, local int, value int"), "ep", 9)
    assert [(r.step, r.value) for r in out.orderBy("step").collect()] == [(0, 0), (1, 1), (2, 2), (3, 100), (4, 200), (5, 201), (6, 202), (7, 203), (8, 204), (9, 205)]


def _maps(spark, rng, names=("m",), hours=30, entities=12, ties=True):
    rows = [(n, "raw", h, e, float(rng.randrange(4) if ties else rng.random()), rng.random() < 0.2) for n in names for h in range(hours) for e in range(entities)]
    df = spark.createDataFrame(rows, "map string, mode string, h int, entity bigint, score double, active boolean")
    return rows, df.withColumn("hour", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h")))


def test_comparison_by_hand(spark):
    """One map: mean rank over all active entities, expected top-k, zones and footprints by plain loops."""
    rng = random.Random(7)
    rows, maps = _maps(spark, rng)
    near = spark.createDataFrame([(p, q) for p in range(12) for q in range(12) if abs(p - q) <= 1], "p bigint, q bigint")
    length = [1.0 + e % 3 for e in range(12)]
    got = compare.comparison(maps, near, spark.createDataFrame(list(enumerate(length)), "entity bigint, length double"), spark.range(12).select(F.col("id").alias("entity")).where("entity % 3 <> 0"), draws=4).first()
    by = {}
    for _, _, h, e, s, a in rows:
        by.setdefault(h, []).append((e, s, a))
    ranks, top5, zone, foot, out5 = [], [], [], [], []
    for items in by.values():
        score = {e: s for e, s, _ in items}
        active = [e for e, _, a in items if a]
        ranks += [1 + sum(x > score[e] for x in score.values()) + (sum(x == score[e] for x in score.values()) - 1) / 2 for e in active]
        if not active:
            continue
        order = sorted(score, key=lambda e: (-score[e], e))
        cut = score[order[4]]
        above, ties = [e for e in order if score[e] > cut], [e for e in order if score[e] == cut]

        def chance(e, above=above, ties=ties):
            if any(abs(e - x) <= 1 for x in above):
                return 1.0
            b, r, miss = sum(abs(e - x) <= 1 for x in ties), 5 - len(above), 1.0
            for i in range(r):
                miss *= max(len(ties) - b - i, 0) / (len(ties) - i)
            return 1 - miss

        top5.append(np.mean([chance(e) for e in active]))
        out5 += [np.mean([chance(e) for e in active if e % 3])] if any(e % 3 for e in active) else []
        left, bought = 0.1 * sum(length), []
        for e in order:
            if length[e] <= left:
                left -= length[e]
                bought.append(e)
        zone.append(np.mean([any(abs(e - x) <= 1 for x in bought) for e in active]))
        cover = set()
        for e in order:
            cover |= {q for q in range(12) if abs(e - q) <= 1}
            if sum(length[q] for q in cover) >= 0.2 * sum(length):
                break
        foot.append(np.mean([e in cover for e in active]))
    assert got.hours == 30 and got.hours_active == len(top5)
    assert got.mean_rank == pytest.approx(np.mean(ranks), abs=1e-4)
    assert (got.top5, got.top5_outside, got.zone_10, got.footprint_20) == pytest.approx((np.mean(top5), np.mean(out5), np.mean(zone), np.mean(foot)), abs=1e-6)
    assert got.ap == pytest.approx(rank.average_precision(maps, "score", "active").first().ap)


def test_comparison_without_active_entities(spark):
    _, maps = _maps(spark, random.Random(8), hours=3)
    near = spark.createDataFrame([(p, p) for p in range(12)], "p bigint, q bigint")
    row = compare.comparison(maps.withColumn("active", F.lit(False)), near, spark.range(12).select(F.col("id").alias("entity"), F.lit(1.0).alias("length")), spark.range(0).select(F.col("id").alias("entity"))).first()
    assert row.hours == 3 and row.hours_active == 0 and row.ap is None and row.mean_rank is None


def test_grids_are_not_broadcast(spark):
    """A grid is hours times its entities; Spark takes it to be as small as these."""
    hour = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") % 2 * 9).cast("int"))
    seen = spark.range(4).groupBy(hour.alias("hour"), F.floor(F.col("id") / 2).alias("entity")).agg(F.lit(2.0).alias("score"), F.lit(True).alias("active"))
    full = grid.fill(seen, {"score": 0.0, "active": False})
    assert full.count() == 20
    for df in (full.where("active"), seen.select("hour", "entity").join(rank.ordered(full), ["hour", "entity"]), seen.select("hour", "entity").join(full.where("score = 2"), ["hour", "entity"])):
        assert "BroadcastHashJoin" not in _plan(df) and df.count() == 4


def test_written_weights_of_a_comparison_are_not_broadcast(spark):
    """Packed files of weights and near pairs are many times smaller than the rows that a broadcast would hold."""
    x = spark.range(96).select(F.lit("m").alias("map"), F.lit("raw").alias("mode"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("id") % 12).cast("int"))).alias("hour"), F.floor(F.col("id") / 12).alias("entity"))
    maps = x.withColumn("score", (F.col("entity") * 7 % 5).cast("double")).withColumn("active", F.col("entity") % 3 == 0)
    users = spark.range(8).select(F.col("id").alias("entity"))
    lines = _plan(compare.comparison(maps, grid.ring(users), users.withColumn("length", F.lit(1.0)), users.where("entity > 2"), draws=2)).split("\n")
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            held = next((below for below in lines[i + 1 :] if re.search("FileScan|Range|Aggregate|Window|Join|Generate", below)), "")
            assert not re.search("FileScan.*compare-(weights|near|ranked)", held), held


def test_overlaps_are_counted_without_pairs(spark):
    """20 000 episodes of one slot, all but two of one partition: as many pairs as a loop finds, and no self-join."""
    p = spark.range(20_000).select("id", F.when(F.col("id") < 2, "b").otherwise("a").alias("partition"), F.lit(0).alias("begin"), F.lit(6).alias("finish"))
    assert plan.overlaps(p).agg(F.sum("pairs")).first()[0] == 2 * 19_998
    joined = study_queries.audited_overlaps(p)
    assert joined.first()["violations"] == 2 * 19_998 and "Join" not in _plan(joined)
    assert study_queries.audited_overlaps(p.where("id > 1")).first()["violations"] == 0


def test_near_pairs_are_found_by_many_tasks(spark):
    """Few points in one small file make many pairs: the tasks that find them follow the cores and not the file."""
    points = spark.range(2000).select(F.col("id").alias("entity"), (F.col("id") * 37 % 1009).alias("x"), (F.col("id") * 91 % 997).alias("y")).coalesce(1)
    near = spatial.near_pairs(points, 50.0)
    assert near.count() == near.distinct().count() > 2000
    assert near.groupBy(F.spark_partition_id()).count().count() > 8 and "BroadcastHashJoin" not in _plan(near)


def test_localisation_on_the_plane_makes_no_near_pairs(spark):
    """The same as with the pairs of all entities within reach, many tied; 600 entities in one cell would make 360 000 pairs."""
    points = spark.range(600).select(F.col("id").alias("entity"), F.when(F.col("id") != 7, F.col("id") * 37 % 1009).alias("x"), (F.col("id") * 91 % 997).alias("y"))
    scores = spark.range(6000).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.floor(F.col("id") / 600).cast("int"))).alias("hour"), (F.col("id") % 600).alias("entity"), (F.col("id") * 7919 % 101).cast("double").alias("score"), (F.col("id") % 11 == 0).alias("active"))
    for reach in (120.0, 5000.0):
        got, known = (sorted(tuple(r) for r in df.collect()) for df in (spatial.localisation_within(scores, points, reach, 5), rank.localisation(scores, spatial.near_pairs(points, reach), 5)))
        assert got == known and len(got) == 10
    assert "near_pairs" not in network_queries.localisation_planar.__code__.co_names
