"""Hand-computed cases, brute-force twins and invariants of the operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegrid.functions.scalar import decay, miss_probability, weighted_log_loss
from ripplegrid.operators import graph, grid, metrics, norm, plan, rank, scorer, spatial, windows
from ripplegrid.schema import TABLES, assert_schema

T0 = "2024-01-01 00:00:00"


def scores(spark, hours):
    """hours: one list of (score, active) by entity for each hour."""
    rows = [(h, e, float(s), bool(a)) for h, items in enumerate(hours) for e, (s, a) in enumerate(items)]
    return spark.createDataFrame(rows, "h int, entity bigint, score double, active boolean").select((F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("h"))).alias("hour"), "entity", "score", "active")


def alone(spark, n):
    return spark.createDataFrame([(i, i, 0.0) for i in range(n)], "p bigint, q bigint, d double")


def lengths(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "entity bigint, length double")


def test_miss_probability(spark):
    row = spark.range(1).select((1 - miss_probability(F.lit(4), F.lit(1), F.lit(2))).alias("a"), (1 - miss_probability(F.lit(905), F.lit(8), F.lit(5))).alias("b"), miss_probability(F.lit(3), F.lit(3), F.lit(1)).alias("c"), miss_probability(F.lit(3), F.lit(0), F.lit(0)).alias("d")).first()
    assert row.a == pytest.approx(0.5) and row.b == pytest.approx(1 - math.comb(897, 5) / math.comb(905, 5)) and row.c == 0 and row.d == 1


def test_ranks_with_ties(spark):
    s = scores(spark, [[(5, 0), (3, 1), (3, 0), (1, 0)]])
    assert rank.average_rank(s).first().mean_rank == 2.5
    assert rank.fractional_recall(s, 2).first().recall == 0.5
    assert rank.localisation(s, alone(spark, 4), 2).first().hit == 0.5


def test_average_precision(spark):
    pairs = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, label int")
    assert rank.average_precision(pairs).first().ap == pytest.approx(5 / 6, abs=1e-8)
    assert rank.average_precision(pairs.where("label = 0")).first().ap is None


def test_confusion_without_alarms(spark):
    row = rank.confusion(scores(spark, [[(1, 0), (2, 0)]]), 9.0).first()
    assert row.precision is None and row.recall is None


def test_budget_skips_what_does_not_fit(spark):
    s = scores(spark, [[(4, 0), (3, 0), (2, 0), (1, 0)]])
    got = spatial.within_budget(s, lengths(spark, [40, 70, 50, 10]), 100 / 170)
    assert sorted(r.entity for r in got.collect()) == [0, 2, 3]


def test_footprint_by_hand(spark):
    s, near, size = scores(spark, [[(3, 0), (2, 0), (1, 0)]]), alone(spark, 3), lengths(spark, [10, 10, 20])
    assert {r.entity: r.weight for r in spatial.footprint(s, near, size, 0.3).collect()} == {0: 1.0, 1: pytest.approx(0.2)}
    assert {r.entity: r.weight for r in spatial.footprint(s, near, size, 0.3, keep_last=True).collect()} == {0: 1.0, 1: 1.0}


def test_localisation_and_footprint_twins(spark):
    rng, n = random.Random(4), 12
    hours = [[(rng.randrange(4), rng.random() < 0.3) for _ in range(n)] for _ in range(15)]
    s, users = scores(spark, hours), spark.range(n).select(F.col("id").alias("entity"))
    near = grid.ring(users, 200.0)
    around = {p: [q for q in range(n) if min(abs(p - q), n - abs(p - q)) <= 2] for p in range(n)}
    want = {}
    for h, items in enumerate(hours):
        order = sorted((x for x, _ in items), reverse=True)
        cut = order[2]
        hi, e = sum(x > cut for x, _ in items), sum(x == cut for x, _ in items)
        hits = []
        for p in (p for p in range(n) if items[p][1]):
            if any(items[q][0] > cut for q in around[p]):
                hits.append(1.0)
            else:
                b = sum(items[q][0] == cut for q in around[p])
                hits.append(1 - math.comb(e - b, 3 - hi) / math.comb(e, 3 - hi))
        if hits:
            want[h] = sum(hits) / len(hits)
    got = {r.hour.hour: r.hit for r in rank.localisation(s, near, 3).collect()}
    assert got == {h: pytest.approx(v, abs=1e-8) for h, v in want.items()}
    size = [1 + i % 7 for i in range(n)]
    for h, items in enumerate(hours):
        seen, total, weights = set(), 0.0, {}
        for p in sorted(range(n), key=lambda p: (-items[p][0], p)):
            new = sum(size[q] for q in around[p] if q not in seen)
            if total >= 0.4 * sum(size):
                break
            weights[p] = 1.0 if total + new <= 0.4 * sum(size) else (0.4 * sum(size) - total) / new
            seen |= set(around[p])
            total += new
        hours[h] = weights
    found = {}
    for r in spatial.footprint(s, near, lengths(spark, size), 0.4).collect():
        found.setdefault(r.hour.hour, {})[r.entity] = r.weight
    assert found == {h: {p: pytest.approx(v, abs=1e-8) for p, v in w.items()} for h, w in enumerate(hours)}


def test_stability(spark):
    hour = F.lit(T0).cast("timestamp_ntz")
    sel = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "h int, entity bigint").select((hour + F.make_dt_interval(F.lit(0), F.col("h"))).alias("hour"), "entity")
    hours = spark.range(4).select((hour + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("hour"))
    got = {r.hour.hour: r.jaccard for r in spatial.stability(sel, lengths(spark, [10, 20, 30]), hours).collect()}
    assert got == {1: pytest.approx(1 / 3, abs=1e-8), 2: 0.0, 3: 1.0}


def test_kernel(spark):
    near = spark.createDataFrame([(0, 0, 0.0), (0, 1, 300.0), (1, 1, 0.0), (1, 0, 300.0)], "p bigint, q bigint, d double")
    got = {(r.p, r.q): r.weight for r in spatial.kernel(near, lengths(spark, [100, 100])).collect()}
    assert got[0, 0] == pytest.approx(1 / (1 + math.exp(-1)))
    assert spark.range(1).select(decay(F.lit(300.01), 300.0, F.lit(5.0)).alias("w")).first().w == 0


def test_norm(spark):
    df = spark.createDataFrame([(1.0, True, 5.0), (3.0, True, 5.0), (100.0, False, 5.0)], "x double, ok boolean, c double")
    stats = norm.fit(df, ["x", "c"], {"x": F.col("ok")})
    assert [(r.field, r.centre, r.spread) for r in stats.collect()] == [("x", 2.0, 1.0), ("c", 5.0, 1.0)]
    assert sorted(r.x for r in norm.apply(df, stats, ["x"], {"x": F.col("ok")}).collect()) == [-1.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        norm.apply(df, norm.fit(df.where("false"), ["x"], {}), ["x"], {})


def test_windows(spark):
    df = spark.createDataFrame([("a", i, float(i), v) for i, v in enumerate([True, False, True, True, True, True])], "u string, t int, x double, ok boolean")
    rows = windows.difference(df, ["u"], ["t"], "x", "ok").orderBy("t").collect()
    assert [r.change_valid for r in rows] == [False, False, False, True, True, True]
    assert [r.rolling for r in windows.rolling_mean(df, ["u"], ["t"], "x").orderBy("t").collect()] == [None] * 5 + [2.5]
    many = spark.range(61).select(F.lit(1).alias("u"), "id")
    assert [r.place for r in windows.spread_sample(many, ["u"], ["id"], 6).orderBy("id").collect()] == [0, 12, 24, 36, 48, 60]
    leaks = spark.createDataFrame([(1, 20, 54), (1, 34, 59)], "e int, begin int, finish int")
    assert [r.begin for r in windows.pieces(leaks, "e").orderBy("begin").collect()] == [0, 20, 34, 54, 59]


def test_graph(spark):
    links = spark.createDataFrame([(1, 1, 2, 5.0, 3.0)], "link int, a int, b int, q1 double, q2 double")
    assert {r.node: r.balance for r in graph.balance(links).collect()} == {1: -5.0, 2: 3.0}
    assert graph.losses(links).first().loss == 2.0
    assert {(r.segment, r.a, r.b) for r in graph.cut(links).collect()} == {(1, "1", "m1"), (2, "m1", "2")}


def test_plan(spark):
    p = spark.createDataFrame([(1, "a", 0, 72), (2, "b", 72, 144), (3, "b", 71, 80), (4, "a", 10, 20)], "id bigint, partition string, begin bigint, finish bigint")
    assert [(r.a, r.b) for r in plan.overlapping(p, 24).collect()] == [(1, 3)]


def test_losses_and_means(spark):
    row = spark.range(1).select(weighted_log_loss(F.lit(800.0), F.lit(0.0), F.lit(3.0)).alias("a"), weighted_log_loss(F.lit(0.0), F.lit(1.0), F.lit(3.0)).alias("b")).first()
    assert row.a == 800.0 and row.b == pytest.approx(3 * math.log(2))
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("b", 5.0)], "e string, x double")
    got = metrics.mean_of_means(df, "e", "x").first()
    assert got.scale == pytest.approx(math.sqrt(13), abs=1e-6) and got.pooled == pytest.approx(math.sqrt(7), abs=1e-5)


def test_scorer_equals_loop(spark):
    net = scorer.CausalNet.given(1, 4)
    x = np.random.default_rng(1).normal(size=(5, 12, 1))
    df = spark.createDataFrame([(i, [float(v) for v in x[i, :, 0]]) for i in range(5)], "id int, w array<double>")
    got = {r.id: r.score for r in scorer.score_windows(df, ["id"], ["w"], net).collect()}
    for i in range(5):
        h = x[i]
        for (w, b), gap in zip(net.layers, scorer.DILATIONS):
            h = np.array([np.maximum(sum(h[t - (2 - j) * gap] @ w[j] for j in range(3) if t - (2 - j) * gap >= 0) + b, 0) for t in range(12)])
        assert got[i] == pytest.approx(float(h[-1] @ net.head[0]))


def test_chained(spark):
    df = spark.createDataFrame([("e", 1, 10.0, 0.0), ("e", 2, 100.0, 0.0), ("e", 3, 0.0, 30.0)], "e string, i int, a double, b double")
    assert [r.level for r in scorer.chained(df, "e", "i", "a", "b", 50.0, 0.0, 100.0).orderBy("i").collect()] == [60.0, 100.0, 70.0]


def test_empty_tables(spark):
    none = scores(spark, [[]])
    assert grid.fill(none, {"score": 0.0}).count() == 0
    assert rank.average_precision(none.withColumn("label", F.lit(1))).first().ap is None
    assert rank.localisation(none, alone(spark, 2), 5).count() == 0


def test_assert_schema(spark):
    with pytest.raises(ValueError):
        assert_schema(spark.range(1), TABLES["events"])
