"""Event studies, conservation of flow, zone summaries, replays and audits by hand and by plain loops."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegrid.operators import conservation, event_study, metrics, norm, reports, scorer, spatial

T0 = datetime.datetime(2024, 1, 1)


def hours(spark, rows):
    """(hour number, entity, score, active) as scores."""
    return spark.createDataFrame([(T0 + datetime.timedelta(hours=h), e, float(s), bool(a)) for h, e, s, a in rows], "hour timestamp_ntz, entity bigint, score double, active boolean")


def test_scale_is_the_root_of_the_mean_over_episodes(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 5.0)] * 2, "e string, q double")
    row = metrics.mean_of_means(df, "e", "q").first()
    assert row.scale == pytest.approx(math.sqrt((1 + 25) / 2), abs=1e-6) and row.pooled == pytest.approx(math.sqrt(54 / 6), abs=1e-6)
    assert metrics.mean_of_means(df.withColumn("q", F.lit(0.0)), "e", "q").first().scale == 1e-6


def _flows(rng, steps=4, episodes=3):
    links = [(0, 0, 1), (1, 1, 2), (2, 2, 0), (3, 0, 3)]
    return [(e, t, k, a, b, *[rng.gauss(0, 3) for _ in range(4)], rng.gauss(0, 1), rng.random() < 0.3) for e in range(episodes) for t in range(steps) for k, a, b in links if rng.random() < 0.9]


def test_conservation_loss_equals_loops(spark):
    rng, inner = random.Random(1), [1, 2, 3, 7]
    rows = _flows(rng)
    df = spark.createDataFrame(rows, "episode int, step int, link int, a int, b int, y1 double, y2 double, p1 double, p2 double, z double, label boolean")
    nodes = spark.createDataFrame([(n,) for n in inner], "node int")
    by = [[(r[5] ** 2 + r[6] ** 2) / 2 for r in rows if r[0] == e] for e in range(3)]
    scale = math.sqrt(np.mean([np.mean(x) for x in by]))
    instants = {(r[0], r[1]) for r in rows}

    def junctions(value):
        total = 0.0
        for e, t in instants:
            for n in inner:
                here = [r for r in rows if (r[0], r[1]) == (e, t)]
                total += (sum(value(r)[1] for r in here if r[4] == n) - sum(value(r)[0] for r in here if r[3] == n)) ** 2
        return total / (len(instants) * len(inner))

    refs = conservation.fit(df, nodes, "y1", "y2")
    got = refs.first()
    mid = np.mean([(r[5] - r[6]) ** 2 for r in rows]) / scale**2
    jun = junctions(lambda r: (r[5], r[6])) / scale**2
    assert (got.scale, got.junctions, got.midpoints) == pytest.approx((scale, jun, mid))
    loss = conservation.loss(df, nodes, refs, "z", "label", 2.5, 0.9).first()
    dq = np.mean([((r[7] - r[5]) ** 2 + (r[8] - r[6]) ** 2) / 2 for r in rows]) / scale**2
    jun_loss = junctions(lambda r: (r[7] - r[5], r[8] - r[6])) / scale**2 / jun
    mid_loss = np.mean([(r[7] - r[5] - r[8] + r[6]) ** 2 for r in rows]) / scale**2 / mid
    leak = np.mean([math.log1p(math.exp(r[9])) * (not r[10]) + 2.5 * math.log1p(math.exp(-r[9])) * r[10] for r in rows]) / 0.9
    assert (loss.dq, loss.junctions, loss.midpoints, loss.leak) == pytest.approx((dq, jun_loss, mid_loss, leak))
    assert loss.total == pytest.approx(leak / 2 + (dq + jun_loss + mid_loss) / 6)
    none = conservation.loss(df.withColumns({"p1": F.lit(0.0), "p2": F.lit(0.0)}), nodes, refs, "z", "label", 2.5, 0.9).first()
    assert (none.junctions, none.midpoints) == pytest.approx((1, 1))  # predicting no change is the reference


def _world(spark, rng):
    entities, horizon = 6, 48
    scores = {(h, e): rng.random() * 10 for h in range(24 * 12) for e in range(entities)}
    near = {(p, q): float(100 * abs(p - q)) for p in range(entities) for q in range(entities) if abs(p - q) <= 1}
    length = {e: 1.0 + e for e in range(entities)}
    df = hours(spark, [(h, e, s, False) for (h, e), s in scores.items()])
    n = spark.createDataFrame([(p, q, d) for (p, q), d in near.items()], "p bigint, q bigint, d double")
    lengths = spark.createDataFrame(list(length.items()), "entity bigint, length double")
    cases = [(0, False, 2, 200), (1, True, 2, 200 - 48)]
    at = spark.createDataFrame([(c, k, e, T0 + datetime.timedelta(hours=h)) for c, k, e, h in cases], "case int, control boolean, entity bigint, anchor timestamp_ntz")
    return scores, near, length, df, n, lengths, cases, at, horizon


def test_event_study_equals_loops(spark):
    scores, near, length, df, n, lengths, cases, at, horizon = _world(spark, random.Random(2))
    kernel = {(p, q): math.exp(-d / 300) * length[q] for (p, q), d in near.items()}
    kernel = {(p, q): w / sum(v for (a, _), v in kernel.items() if a == p) for (p, q), w in kernel.items()}
    maps = event_study.modes(event_study.surroundings(df, at, horizon), spatial.kernel(n, lengths))
    rise = {r.case: r for r in event_study.local_rise(maps, at).collect()}
    gains = {(r.case, r.mode, r.share): r for r in event_study.footprint_gains(maps, at, n, lengths, (0.1, 0.3)).collect()}
    es = sorted(length)
    want_gain = {}
    for case, _, target, anchor in cases:
        window = [h for h in range(anchor - horizon, anchor + horizon + 1) if h != anchor]

        def still(values, window=window, anchor=anchor):
            return {(h, e): np.mean([values[g, e] for g in window if g < anchor and g % 24 == h % 24]) for h in window for e in es}

        def smoothed(values, window=window):
            return {(h, e): sum(w * values[h, q] for (p, q), w in kernel.items() if p == e) for h in window for e in es}

        raw = {(h, e): scores[h, e] for h in window for e in es}
        base = still(raw)
        absolute, change = smoothed(raw), smoothed({k: v - base[k] for k, v in raw.items()})
        background = still(absolute)
        before, after = [h for h in window if h < anchor], [h for h in window if h > anchor]
        gap = {h: absolute[h, target] - background[h, target] for h in window}
        r, sd = rise[case], np.std([gap[h] for h in before])
        assert (r.before, r.after, r.rise, r.deviation) == pytest.approx((np.mean([absolute[h, target] for h in before]), np.mean([absolute[h, target] for h in after]), np.mean([gap[h] for h in after]), sd), abs=1e-4)
        assert r.rise_deviations == pytest.approx(np.mean([gap[h] for h in after]) / sd, abs=1e-2)
        for mode, values in (("absolute", absolute), ("change", change), ("background", background)):
            for share in (0.1, 0.3):
                cover = {}
                for h in window:
                    covered, size, goal = set(), 0.0, share * sum(length.values())
                    for e in sorted(es, key=lambda e, h=h, values=values: (-round(values[h, e], 6), e)):
                        new = covered | {q for (p, q) in near if p == e}
                        grown = sum(length[q] for q in new)
                        if grown >= goal:
                            cover[h] = 1.0 if target in covered else (goal - size) / (grown - size) * (target in new)
                            break
                        covered, size = new, grown
                b, a = np.mean([cover[h] for h in before]), np.mean([cover[h] for h in after])
                g = gains[case, mode, share]
                want_gain[case, mode, share] = a - b
                assert (g.before, g.after, g.gain) == pytest.approx((b, a, a - b), abs=1e-3), (case, mode, share)
    both = {(r.mode, r.share): r for r in event_study.synthesis(event_study.footprint_gains(maps, at, n, lengths, (0.1, 0.3)), at).collect()}
    assert all(both[m, s].difference == pytest.approx(want_gain[0, m, s] - want_gain[1, m, s], abs=1e-3) for m, s in both)


def test_background_needs_every_hour_of_day(spark):
    df = hours(spark, [(h, 0, 1, False) for h in range(60)])
    case = spark.createDataFrame([(0, T0 + datetime.timedelta(hours=12))], "case int, anchor timestamp_ntz")
    with pytest.raises(Exception, match="no row before"):
        event_study.case_background(event_study.surroundings(df, case, 24)).collect()


def test_hours_that_select_nothing_count(spark):
    """Three hours, of which the last selects nothing; the first two select the same entity."""
    s = hours(spark, [(h, e, e == 1, e == 1 and h != 1) for h in range(3) for e in range(3)])
    near = spark.createDataFrame([(e, e) for e in range(3)], "p bigint, q bigint")
    lengths = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0)], "entity bigint, length double")
    selected = s.where((F.col("entity") == 1) & (F.col("hour") < F.lit(T0 + datetime.timedelta(hours=2)))).select("hour", "entity")
    r = reports.zone_summary(s, selected, spatial.covered(selected, near), lengths).first()
    assert (r.hours, r.hours_active, r.recall) == (3, 2, 0.5)
    assert (r.mean_length, r.least_length, r.most_length) == (pytest.approx(4 / 3, abs=1e-6), 0.0, 2.0)
    assert (r.covered, r.least_covered, r.most_covered) == (pytest.approx(1 / 3, abs=1e-6), 0.0, 0.5)
    assert (r.jaccard, r.pairs) == (0.5, 2)  # the same twice, then everything gone


def test_recall_is_a_mean_over_entities(spark):
    s = hours(spark, [(0, 0, 1, True), (1, 0, 1, True), (2, 0, 1, True), (0, 1, 1, True), (1, 1, 1, False)])
    found = s.where("entity = 0").where(F.col("hour") == F.lit(T0)).select("hour", "entity").unionByName(s.where("entity = 1").select("hour", "entity"))
    row = reports.event_recall(s, found).first()
    assert row.entities == 2 and row.recall == pytest.approx((1 / 3 + 1) / 2, abs=1e-9)


def test_flows_come_back_in_units(spark):
    df = spark.createDataFrame([(2.0, 10.0)], "q double, ref double")
    assert scorer.denormalised(df, ["q"], 3.0).first().q == 6.0 and scorer.denormalised(df, ["q"], 3.0, ["ref"]).first().q == 16.0


def test_one_step_of_each_episode(spark):
    df = spark.createDataFrame([(e, t, k) for e, t, k in itertools.product("ab", (3, 5, 9), (0, 1)) if (e, t) != ("b", 9)], "ep string, step int, link int")
    got = lambda n: {(r.ep, r.step) for r in scorer.at_step(df, "ep", "step", n).collect()}
    assert got(-1) == {("a", 9), ("b", 5)} and got(0) == {("a", 3), ("b", 3)} and got(2) == {("a", 9)} and scorer.at_step(df, "ep", "step", 0).count() == 4


def test_shape_of_what_is_near(spark):
    entities = spark.createDataFrame([(i,) for i in range(4)], "entity bigint")
    bad = [(0, 0, 0.0), (1, 1, 0.0), (2, 2, 5.0), (0, 1, 7.0), (1, 0, 7.0), (1, 2, 3.0), (2, 1, 4.0), (0, 2, 1.0), (0, 3, -1.0), (3, 0, -1.0), (9, 9, float("nan"))]
    got = {r.rule: r.violations for r in norm.pairwise_violations(spark.createDataFrame(bad, "p bigint, q bigint, d double"), entities).collect()}
    assert got["symmetry"] >= 3 and got["diagonal"] == 2 and got["distance"] == 3 and got["unknown"] == 2


def test_references_of_losses(spark):
    df = spark.createDataFrame([(True, 2.0), (False, 4.0), (False, 0.0), (False, 100.0)], "y boolean, q double")
    r = metrics.loss_references(df, F.col("y"), F.col("q") < 50, "q", 2.0).first()
    assert r.weight == 2.0 and r.even_loss == pytest.approx(math.log(2) * 4 / 3, abs=1e-8) and r.flow_loss == pytest.approx((1 + 4 + 0) / 3, abs=1e-8)
    with pytest.raises(Exception, match="both kinds"):
        metrics.loss_references(df, F.col("y"), F.col("q") > 3, "q", 2.0).collect()


def test_the_best_of_the_worst(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 9.0), ("x", "b", 3.0), ("x", "b", 4.0), ("x", "c", 3.0), ("y", "d", -1.0)], "g string, k string, v double")
    assert [(r.k, r.worst) for r in metrics.best_worst(df, "k", "v").collect()] == [("b", 3.0)]
    assert {(r.g, r.k, r.worst) for r in metrics.best_worst(df, "k", "v", ["g"]).collect()} == {("x", "b", 3.0), ("y", "d", -1.0)}


def test_a_tiny_spread_counts_as_one(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "e string, x double")
    row = norm.merged_moments(df, "e", "x", F.lit(True)).first()
    assert (row.centre, row.spread, row.n) == (2.0, 1.0, 2)
