"""Composite queries: event studies in three modes, conservation of flow, replays, simulated tests, audits and the tables behind figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplegrid.jobs.network_queries import _PLANNED, planned_episodes
from ripplegrid.jobs.report_queries import _ALIKE
from ripplegrid.jobs.score_queries import _BUDGET, _COVER, _HIT, _KERNEL, GRID, Inputs
from ripplegrid.operators import conservation, event_study, metrics, norm, order_stats, plan, rank, reports, scorer, spatial
from ripplegrid.sources.shared import written
from ripplegrid.sources.tables import table

_HORIZON, _BACK = 48, 7


def _cases(x: Inputs):
    """case, control, entity, anchor: every week's highest score and the same hour a week before, if all hours around both are there."""
    first, last = x.observed.agg(F.min("hour"), F.max("hour")).first()
    week = F.floor(F.datediff("hour", F.lit(first)) / 7)
    order = F.struct("score", (-F.unix_timestamp(F.col("hour").cast("timestamp"))).alias("early"), (-F.col("entity")).alias("small"))
    best = x.scores.withColumn("week", week).groupBy("week").agg(F.max_by("entity", order).alias("entity"), F.max_by("hour", order).alias("anchor"))
    own = best.select((F.col("week") * 2).alias("case"), F.lit(False).alias("control"), "entity", "anchor")
    reach = F.make_dt_interval(F.lit(0), F.lit(_HORIZON))
    inside = (F.col("anchor") - F.make_dt_interval(F.lit(_BACK)) - reach >= F.lit(first)) & (F.col("anchor") + reach <= F.lit(last))
    kept = own.where(inside)
    return written(kept.unionByName(kept.select((F.col("case") + 1).alias("case"), F.lit(True).alias("control"), "entity", (F.col("anchor") - F.make_dt_interval(F.lit(_BACK))).alias("anchor"))), "cases")


def _study(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    cases = _cases(x)
    maps = event_study.modes(event_study.surroundings(x.scores, cases, _HORIZON), spatial.kernel(x.near, x.lengths))
    return x, cases, maps


def event_cells(spark, sf_dir):
    """Of every week's highest score and its control: the smoothed score there before and after, against its background by hour of day."""
    _, cases, maps = _study(spark, sf_dir)
    return event_study.local_rise(maps, cases)


def event_footprints(spark, sf_dir):
    """How much of the time before and after the cases' entities lie in footprints of 10, 20 and 30 %, in three modes."""
    x, cases, maps = _study(spark, sf_dir)
    return event_study.footprint_gains(maps, cases, x.near, x.lengths)


def event_synthesis(spark, sf_dir):
    """The footprints' gains of events less those of controls, by mode and share."""
    x, cases, maps = _study(spark, sf_dir)
    return event_study.synthesis(event_study.footprint_gains(maps, cases, x.near, x.lengths), cases)


def _flows(spark, sf_dir):
    """episode (year), step (month), link, a, b, q1 (sent), q2 (kept), y1 and y2 (their changes against the link's mean), p1 and p2 (predicted: the
    changes of the link's step before, none at first), z (log-odds of a loss), label."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("episode"), F.month("o_orderdate").alias("step"))
    buyers = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b")), "c_custkey").drop("c_custkey")
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    q = lines.join(buyers, "l_orderkey").join(sellers, "l_suppkey").where("a <> b").groupBy("episode", "step", (F.col("a") * 25 + F.col("b")).alias("link"), "a", "b")
    flows = q.agg(F.sum("l_quantity").alias("q1"), F.coalesce(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.lit(0.0)).alias("q2"))
    of, along = Window.partitionBy("link"), Window.partitionBy("link").orderBy("episode", "step")
    flows = flows.withColumns({f"y{i}": F.round(F.col(f"q{i}") - F.avg(f"q{i}").over(of), 6) for i in (1, 2)})
    flows = flows.withColumns({f"p{i}": F.lag(f"y{i}", 1, 0.0).over(along) for i in (1, 2)})
    return flows.withColumns({"z": (F.col("q1") - F.col("q2")) / 10 - 1, "label": F.col("q1") - F.col("q2") > 20})


def _inner(spark, sf_dir):
    """Nodes that lie in no reservoir (region 0)."""
    return table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("node"))


def conservation_fit(spark, sf_dir):
    """The scale of changes of flow and the references of balances and losses."""
    r = conservation.fit(_flows(spark, sf_dir), _inner(spark, sf_dir), "y1", "y2")
    return r.select(*[F.round(c, 6).alias(c) for c in ("scale", "junctions", "midpoints")])


def conservation_loss(spark, sf_dir):
    """The loss of predicting each step's changes by those of the step before."""
    flows, inner = _flows(spark, sf_dir), _inner(spark, sf_dir)
    w = metrics.class_weights(flows, F.col("label"), F.lit(True)).first()
    out = conservation.loss(flows, inner, conservation.fit(flows, inner, "y1", "y2"), "z", "label", w.weight, w.even_loss)
    return out.select(*[F.round(c, 6).alias(c) for c in ("dq", "junctions", "midpoints", "leak", "total")])


def loss_references(spark, sf_dir):
    """What the losses of the network's flows are held against, from the twelfth month of each link on."""
    flows = _flows(spark, sf_dir)
    usable = F.col("n") >= 12
    numbered = flows.withColumn("n", F.row_number().over(Window.partitionBy("link").orderBy("episode", "step")))
    return metrics.loss_references(numbered, F.col("label"), usable, "y1", float(conservation.scale(flows, "y1", "y2").first()["scale"]))


def safest_link(spark, sf_dir):
    """Of every node's outgoing links the one whose smallest flow over all steps is the largest."""
    return metrics.best_worst(_flows(spark, sf_dir).withColumnRenamed("a", "node"), "link", "q2", ["node"])


def replayed_flows(spark, sf_dir):
    """Predicted flows at every step: changes in units of the scale turned back into flows by adding the reference, the balance, and its error."""
    flows = _flows(spark, sf_dir)
    fitted = conservation.scale(flows, "y1", "y2").first()["scale"]
    scaled = flows.withColumns({f"s{i}": F.col(f"p{i}") / fitted for i in (1, 2)}).withColumns({f"r{i}": F.col(f"q{i}") - F.col(f"y{i}") for i in (1, 2)})
    out = scorer.denormalised(scaled, ["s1", "s2"], fitted, ["r1", "r2"])
    return out.select("episode", "step", "link", F.round("s1", 6).alias("predicted_q1"), F.round("s2", 6).alias("predicted_q2"), F.round(F.col("s1") - F.col("s2"), 6).alias("balance"), F.round(F.col("s1") - F.col("q1"), 6).alias("error"))


def episode_map(spark, sf_dir):
    """The map of the last step of every episode (year): each link's score, place, and whether it loses in truth."""
    flows = _flows(spark, sf_dir)
    last = scorer.at_step(flows, "episode", "step", -1)
    placed = last.withColumn("place", F.row_number().over(Window.partitionBy("episode").orderBy(F.desc("z"), "link")))
    return placed.select("episode", "step", "link", F.round("z", 6).alias("score"), "place", F.col("label").alias("active"))


def simulated_test(spark, sf_dir):
    """Localisation at the ends of half days (every twelfth step) and the calibration of a balance against what errors cost there."""
    x = Inputs(spark, sf_dir)
    ends = x.scores.where((F.hour("hour") + 1) % 12 == 0)
    near, n = x.near, x.users.count()
    out = None
    for k in (1, 5, 10):
        hit = rank.localisation(ends, near, k).agg(F.count("*").alias("instants"), F.round(F.avg("hit"), 6).alias("hit"))
        chance = ends.where("active").join(rank.random_reference(near, n, k).select("entity", F.col("hit").alias("r")), "entity").groupBy("hour").agg(F.avg("r").alias("r")).agg(F.round(F.avg("r"), 6).alias("random"))
        row = hit.crossJoin(F.broadcast(chance)).select(F.lit(k).alias("k"), "instants", "hit", "random")  # one row each
        out = row if out is None else out.unionByName(row)
    cost = x.events.where("event_type = 'error'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), F.col("user_id").alias("entity")).agg(F.round(F.sum("value"), 6).alias("truth"))
    pairs = ends.join(cost, ["hour", "entity"], "left").select(F.coalesce("truth", F.lit(0.0)).alias("truth"), (F.col("score") - 10).alias("guess"))
    return out.crossJoin(F.broadcast(metrics.calibration(pairs, "truth", "guess")))  # one row


def exploratory_days(spark, sf_dir):
    """Six days' maps, raw and smoothed: quantiles of the scores and the zones that a twentieth of all length buys."""
    x = Inputs(spark, sf_dir)
    days = x.scores.where(F.col("hour") < F.lit("2024-01-07").cast("timestamp_ntz"))
    positive = days.withColumn("score", F.greatest(F.col("score") - 20, F.lit(0.0)))
    smooth = spatial.smooth(positive, spatial.kernel(x.near, x.lengths)).withColumn("score", F.round("score", 3)).join(days.select("hour", "entity", "active"), ["hour", "entity"])
    out = None
    for mode, maps in (("raw", positive), ("smoothed", smooth)):
        maps = written(maps.select("hour", "entity", "score", "active"), "days")
        selected = written(spatial.within_budget(maps, x.lengths, 0.05), "zones")
        zones = reports.zone_summary(maps, selected, spatial.covered(selected, x.near), x.lengths)
        spread = metrics.quantiles(maps.withColumn("mode", F.lit(mode)), ["mode"], "score")
        row = spread.crossJoin(F.broadcast(zones))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def audited_overlaps(p):
    """How many pairs of episodes of different partitions share time, counted by slot and partition: a slot of a large plan holds too many for pairs to be made."""
    return plan.overlaps(p).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("violations")).select(F.lit("overlap").alias("rule"), "violations")


def dataset_audit(spark, sf_dir):
    """Violations of a planned data set's contract by rule: ids, partitions, periods, overlaps, flows that do not add up, losses where none is, and the shape of what is near."""
    p = written(planned_episodes(spark, sf_dir), "plan")
    one = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    flows = _flows(spark, sf_dir).withColumn("leak", F.col("q1") - F.col("q2")).withColumn("active", F.col("leak") > 0)
    physical = norm.violations(flows, {"balance": F.abs(F.col("q1") - F.col("q2") - F.col("leak")) <= 0.01, "inactive": F.col("active") | (F.abs("leak") <= 1e-3), "not_negative": (F.col("q1") >= 0) & (F.col("q2") >= 0), "small_loss": F.col("leak") <= 40})
    x = Inputs(spark, sf_dir)
    shape = norm.pairwise_violations(x.near, x.users)
    grid = one(x.scores.groupBy("hour").agg(F.count_distinct("entity").alias("n"), F.count("*").alias("m")).where(F.col("m") != F.col("n")), "grid")
    parts = [one(plan.repeated(p, "id"), "id"), one(plan.contract(p, "variant", "partition"), "variant"), one(p.where("finish - begin <> 6"), "period"), audited_overlaps(p), grid, physical, shape]
    busy = one(p.groupBy("partition", "variant", "slot").count().where("count > 1"), "repeated_day")
    out = busy
    for part in parts:
        out = out.unionByName(part)
    return out


def topk_curve(spark, sf_dir):
    """For k from 1 to 50 the share of active entities near one of the hour's k best, raw and smoothed, all and outside the zone (every third entity), and the median place and that of chance."""
    x = Inputs(spark, sf_dir)
    smooth = spatial.smooth(x.scores, spatial.kernel(x.near, x.lengths)).withColumn("score", F.round("score", 3)).join(x.scores.select("hour", "entity", "active"), ["hour", "entity"])
    places = None
    for mode, maps in (("raw", x.scores), ("smoothed", smooth)):
        one = rank.first_place_near(maps, x.near).select(F.lit(mode).alias("mode"), "entity", "place")
        places = one if places is None else places.unionByName(one)
    around = x.near.groupBy(F.col("p").alias("entity")).agg(F.count("*").alias("m"))
    places = written(places.join(around, "entity").withColumn("chance", F.lit(float(x.users.count())) / (F.col("m") + 1)), "places")
    counts = places.groupBy("mode", "place", (F.col("entity") % 3 != 0).alias("outside")).agg(F.count("*").alias("n"))
    curve = counts.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50))))
    hit = F.when(F.col("place") <= F.col("k"), F.col("n")).otherwise(0)
    out = F.col("outside")
    curve = curve.groupBy("mode", "k").agg(F.round(F.sum(hit) / F.sum("n"), 9).alias("share"), F.round(F.try_divide(F.sum(F.when(out, hit)), F.sum(F.when(out, F.col("n")))), 9).alias("share_outside"))
    middle = [order_stats.quantiles(places, ["mode"], c, (0.5,)).select("mode", F.round("x", 6).alias(f"median_{c}")) for c in ("place", "chance")]
    return curve.join(middle[0], "mode").join(middle[1], "mode")


def flow_error_medians(spark, sf_dir):
    """Exact medians of the errors of predicted and of mean flows, the noise of the predicted balance where nothing is lost (99 % of its size), and the share of losses beyond it."""
    flows = written(_flows(spark, sf_dir), "flows")
    error = flows.select(F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.abs(e).alias("e")) for i in (1, 2) for name, e in (("predicted", F.col(f"p{i}") - F.col(f"y{i}")), ("mean", F.col(f"y{i}")))])).alias("x")).select("x.*")
    medians = order_stats.quantiles(error, ["kind"], "e", (0.5,)).select("kind", F.round("x", 6).alias("median"))
    balance = F.col("q1") - F.col("y1") + F.col("p1") - (F.col("q2") - F.col("y2") + F.col("p2"))
    noise = order_stats.one_quantile(flows.where(~F.col("label")).select(F.abs(balance).alias("b")), "b", 0.99)
    beyond = flows.where("label").agg(F.round(F.avg((balance > F.lit(noise)).cast("int")), 9).alias("beyond"))
    return medians.crossJoin(F.broadcast(beyond)).select("kind", "median", F.round(F.lit(noise), 6).alias("noise"), "beyond")  # one row


_CASES = f"""hs0 AS (SELECT min(hour) AS lo, max(hour) AS hi FROM ev),
kx AS (SELECT date_diff('day', lo, hour) // 7 AS week, entity, hour AS anchor FROM g, hs0 QUALIFY row_number() OVER (PARTITION BY date_diff('day', lo, hour) // 7 ORDER BY score DESC, hour, entity) = 1),
ky AS (SELECT kx.* FROM kx, hs0 WHERE anchor - INTERVAL {_BACK} DAY - INTERVAL {_HORIZON} HOUR >= lo AND anchor + INTERVAL {_HORIZON} HOUR <= hi),
cs AS (SELECT week * 2 AS "case", false AS control, entity, anchor FROM ky UNION ALL SELECT week * 2 + 1, true, entity, anchor - INTERVAL {_BACK} DAY FROM ky),
sr AS MATERIALIZED (SELECT cs."case", o < 0 AS before, g.hour, g.entity, g.score FROM cs, range(-{_HORIZON}, {_HORIZON + 1}) t(o) JOIN g ON g.hour = cs.anchor + o * INTERVAL 1 HOUR WHERE o <> 0),
bg AS (SELECT "case", entity, hour(hour) AS h, avg(score) FILTER (before) AS b FROM sr GROUP BY ALL),
sa AS MATERIALIZED (SELECT "case", before, hour, p AS entity, round(sum(weight * score), 6) AS score FROM sr JOIN kn ON kn.q = sr.entity GROUP BY ALL),
sv AS MATERIALIZED (SELECT sr."case", before, hour, p AS entity, round(sum(weight * (score - b)), 6) AS score FROM sr JOIN bg ON bg."case" = sr."case" AND bg.entity = sr.entity AND bg.h = hour(sr.hour) JOIN kn ON kn.q = sr.entity GROUP BY ALL),
ba AS (SELECT "case", entity, hour(hour) AS h, avg(score) FILTER (before) AS b FROM sa GROUP BY ALL),
sb AS MATERIALIZED (SELECT sa."case", before, hour, sa.entity, b AS score FROM sa JOIN ba ON ba."case" = sa."case" AND ba.entity = sa.entity AND ba.h = hour(sa.hour)),
mm AS (SELECT 'absolute' AS mode, * FROM sa UNION ALL SELECT 'change', * FROM sv UNION ALL SELECT 'background', * FROM sb)"""
_GAINS = """mp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mode, "case", before, hour ORDER BY score DESC, entity) AS place FROM mm),
ff AS MATERIALIZED (SELECT mode, "case", before, hour, q AS entity, min(place) AS place FROM mp JOIN near ON near.p = mp.entity GROUP BY ALL),
gn AS (SELECT mode, "case", before, hour, place, sum(length) AS nw FROM ff JOIN lengths USING (entity) GROUP BY ALL),
gs AS (SELECT *, sum(nw) OVER (PARTITION BY mode, "case", before, hour ORDER BY place) AS sm FROM gn),
tt AS (SELECT sh AS share, sh * (SELECT sum(length) FROM lengths) AS t FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) v(sh)),
cc AS (SELECT mode, "case", before, hour, share, min(place) AS place, arg_min((t - (sm - nw)) / nw, place) AS part FROM gs, tt WHERE sm >= t GROUP BY ALL),
xx AS (SELECT cc.mode, cc."case", cc.before, cc.hour, share, CASE WHEN ff.place < cc.place THEN 1 WHEN ff.place = cc.place THEN part ELSE 0 END AS x FROM cc JOIN cs USING ("case") JOIN ff ON ff.mode = cc.mode AND ff."case" = cc."case" AND ff.before = cc.before AND ff.hour = cc.hour AND ff.entity = cs.entity),
gg AS (SELECT "case", mode, share, round(avg(x) FILTER (before), 9) AS before, round(avg(x) FILTER (NOT before), 9) AS after, round(avg(x) FILTER (NOT before) - avg(x) FILTER (before), 9) AS gain FROM xx GROUP BY ALL)"""
_FLOWS = """fl AS MATERIALIZED (SELECT year(o_orderdate)::INTEGER AS episode, month(o_orderdate)::INTEGER AS step, s_nationkey * 25 + c_nationkey AS link, s_nationkey AS a, c_nationkey AS b, sum(l_quantity) AS q1, coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) AS q2
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
fy AS MATERIALIZED (SELECT *, round(q1 - avg(q1) OVER w, 6) AS y1, round(q2 - avg(q2) OVER w, 6) AS y2, (q1 - q2) / 10 - 1 AS z, q1 - q2 > 20 AS label FROM fl WINDOW w AS (PARTITION BY link)),
fp AS MATERIALIZED (SELECT *, lag(y1, 1, 0) OVER w AS p1, lag(y2, 1, 0) OVER w AS p2 FROM fy WINDOW w AS (PARTITION BY link ORDER BY episode, step)),
inn AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey <> 0),
sc AS (SELECT sqrt(avg(m)) AS scale FROM (SELECT episode, avg((y1 * y1 + y2 * y2) / 2) AS m FROM fp GROUP BY 1)),
nn AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT episode, step FROM fp)) * (SELECT count(*) FROM inn) AS n)"""
_BALANCE = "(SELECT sum(x * x) FROM (SELECT episode, step, node, sum(q) AS x FROM (SELECT episode, step, b AS node, {2} AS q FROM fp UNION ALL SELECT episode, step, a, -({1}) FROM fp) JOIN inn USING (node) GROUP BY 1, 2, 3)) / n"
_FIT = f"ft AS (SELECT scale, {_BALANCE.format('', 'y1', 'y2')} / (scale * scale) AS junctions, (SELECT avg((y1 - y2) ** 2) FROM fp) / (scale * scale) AS midpoints FROM sc, nn)"
_SPREAD = ", ".join(f"round(quantile_cont(score, {p}), 6) AS q{round(100 * p)}" for p in (0.0, 0.01, 0.5, 0.99, 1.0))
_TESTED = GRID + ", m AS (SELECT * FROM g WHERE (hour(hour) + 1) % 12 = 0)"
_CALIBRATED = "co AS (SELECT date_trunc('hour', ts) AS hour, user_id AS entity, round(sum(value), 6) AS truth FROM events WHERE event_type = 'error' GROUP BY 1, 2), pr AS (SELECT coalesce(truth, 0) AS t, score - 10 AS b FROM m LEFT JOIN co USING (hour, entity)), qn AS (SELECT quantile_cont(b, 0.99) FILTER (t <= 0) AS n FROM pr), cal AS (SELECT round(sum(b * t) / sum(t * t), 6) AS slope, round(any_value(n), 6) AS noise_p99, round(avg(CASE WHEN t > 0 THEN (b > n)::INT END), 9) AS above, round(quantile_cont(b, 0.5) FILTER (t > 0), 6) AS median_guess, round(quantile_cont(t, 0.5) FILTER (t > 0), 6) AS median_truth FROM pr, qn)"


def _tested(k: int) -> str:
    return f"(WITH {_HIT.format(k=k)}, cq AS (SELECT p AS entity, count(*) AS m, (SELECT count(*) FROM users) AS n FROM near GROUP BY p), rq AS (SELECT entity, round(1 - list_product(list_transform(range(0, {k}), lambda i: greatest(n - m - i, 0)::DOUBLE / greatest(n - i, 1))), 9) AS r FROM cq) SELECT {k}::INTEGER AS k, count(*) AS instants, round(avg(hit), 6) AS hit, (SELECT round(avg(r), 6) FROM (SELECT hour, avg(r) AS r FROM m JOIN rq USING (entity) WHERE active GROUP BY hour)) AS random FROM (SELECT hour, round(avg(hit), 9) AS hit FROM h GROUP BY hour))"


def _explored(mode: str) -> str:
    source = "SELECT hour, entity, greatest(score - 20, 0) AS score, active FROM g0"
    if mode == "smoothed":
        source = f"SELECT s.hour, s.entity, round(s.score, 3) AS score, g0.active FROM (SELECT hour, p AS entity, round(sum(weight * score), 6) AS score FROM ({source}) y JOIN kn ON kn.q = y.entity GROUP BY 1, 2) s JOIN g0 USING (hour, entity)"
    budget = _BUDGET.replace("FROM placed", "FROM pd")
    return f"""(WITH g AS MATERIALIZED ({source}), hours AS (SELECT DISTINCT hour FROM g), pd AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY score DESC, entity) AS place FROM g), {budget}, {_COVER}, {_ALIKE},
      s AS (SELECT hour, sum(length) AS x FROM sel JOIN lengths USING (entity) GROUP BY hour), c AS (SELECT hour, sum(length) / (SELECT sum(length) FROM lengths) AS y FROM cov JOIN lengths USING (entity) GROUP BY hour),
      rc AS (SELECT g.hour, avg((cov.entity IS NOT NULL)::INT) AS r FROM g LEFT JOIN cov ON cov.hour = g.hour AND cov.entity = g.entity WHERE active GROUP BY 1),
      zs AS (SELECT count(*) AS hours, count(r) AS hours_active, round(avg(round(r, 9)), 6) AS recall, round(avg(coalesce(x, 0)), 6) AS mean_length, min(coalesce(x, 0)) AS least_length, max(coalesce(x, 0)) AS most_length, round(avg(coalesce(y, 0)), 6) AS covered, round(min(coalesce(y, 0)), 6) AS least_covered, round(max(coalesce(y, 0)), 6) AS most_covered, round(avg(jaccard), 6) AS jaccard, count(jaccard) AS pairs FROM hours LEFT JOIN s USING (hour) LEFT JOIN c USING (hour) LEFT JOIN rc USING (hour) LEFT JOIN jc USING (hour)),
      qs AS (SELECT {_SPREAD}, round(avg((score < 0)::INT), 9) AS negative FROM g) SELECT '{mode}' AS mode, * FROM qs, zs)"""


_CURVE = "pp AS MATERIALIZED (SELECT mode, f.entity, place, (SELECT count(*) FROM users) / (m + 1) AS chance FROM ({0}) f JOIN (SELECT p AS entity, count(*) AS m FROM near GROUP BY 1) USING (entity))"
_PLACES = "SELECT '{0}' AS mode, a.entity, min(b.place) AS place FROM {1} a JOIN near ON near.p = a.entity JOIN {1} b ON b.hour = a.hour AND b.entity = near.q WHERE a.active GROUP BY a.hour, a.entity"

QUERIES = {
    event_cells: f"WITH {GRID}, {_KERNEL}, {_CASES}, l AS (SELECT x.\"case\", x.before, x.score AS a, x.score - y.score AS gap FROM sa x JOIN sb y ON y.\"case\" = x.\"case\" AND y.before = x.before AND y.hour = x.hour AND y.entity = x.entity JOIN cs ON cs.\"case\" = x.\"case\" AND cs.entity = x.entity) SELECT \"case\", round(avg(a) FILTER (before), 6) AS before, round(avg(a) FILTER (NOT before), 6) AS after, round(avg(gap) FILTER (NOT before), 6) AS rise, round(stddev_pop(gap) FILTER (before), 6) AS deviation, round(CASE WHEN stddev_pop(gap) FILTER (before) > 1e-12 THEN avg(gap) FILTER (NOT before) / stddev_pop(gap) FILTER (before) END, 4) AS rise_deviations FROM l GROUP BY 1",
    event_footprints: f"WITH {GRID}, {_KERNEL}, {_CASES}, {_GAINS} SELECT * FROM gg",
    event_synthesis: f"WITH {GRID}, {_KERNEL}, {_CASES}, {_GAINS} SELECT mode, share, " + ", ".join(f"round(avg({f}) FILTER ({c}), 6) AS {n}_{f}" for n, c in (("event", "NOT control"), ("control", "control")) for f in ("before", "after", "gain")) + ", round(avg(gain) FILTER (NOT control) - avg(gain) FILTER (control), 6) AS difference FROM gg JOIN cs USING (\"case\") GROUP BY ALL",
    conservation_fit: f"WITH {_FLOWS}, {_FIT} SELECT round(scale, 6) AS scale, round(junctions, 6) AS junctions, round(midpoints, 6) AS midpoints FROM ft",
    conservation_loss: f"WITH {_FLOWS}, {_FIT}, w AS (SELECT round(count(*) FILTER (NOT label) / count(*) FILTER (label), 9) AS w, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n FROM fp), t AS (SELECT (SELECT avg(((p1 - y1) ** 2 + (p2 - y2) ** 2) / 2) FROM fp) / (scale * scale) AS dq, {_BALANCE.format('', '(p1 - y1)', '(p2 - y2)')} / (scale * scale) / junctions AS junctions, (SELECT avg((p1 - y1 - p2 + y2) ** 2) FROM fp) / (scale * scale) / midpoints AS midpoints, (SELECT avg((1 - label::INT) * z + (1 + (w.w - 1) * label::INT) * (ln(1 + exp(-abs(z))) + greatest(-z, 0))) FROM fp, w) / (SELECT round(0.6931471805599453::DOUBLE * (n + n / p * p) / (n + p), 9) FROM w) AS leak FROM ft, nn) SELECT round(dq, 6) AS dq, round(junctions, 6) AS junctions, round(midpoints, 6) AS midpoints, round(leak, 6) AS leak, round(leak / 2 + (dq + junctions + midpoints) / 6, 6) AS total FROM t",
    loss_references: f"WITH {_FLOWS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY episode, step) AS n FROM fp) WHERE n >= 12), c AS (SELECT count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS n, avg(y1 * y1) AS s FROM u) SELECT round(n / p, 9) AS weight, round(ln(2) * (n + n / p * p) / (n + p), 9) AS even_loss, round(s / (scale * scale), 9) AS flow_loss FROM c, sc",
    safest_link: f"WITH {_FLOWS}, w AS (SELECT a AS node, link, min(q2) AS worst FROM fp GROUP BY 1, 2) SELECT node, link, worst FROM w QUALIFY row_number() OVER (PARTITION BY node ORDER BY worst DESC, link) = 1",
    replayed_flows: f"WITH {_FLOWS} SELECT episode, step, link, round(q1 - y1 + p1, 6) AS predicted_q1, round(q2 - y2 + p2, 6) AS predicted_q2, round(q1 - y1 + p1 - (q2 - y2 + p2), 6) AS balance, round(p1 - y1, 6) AS error FROM fp",
    episode_map: f"WITH {_FLOWS}, e AS (SELECT *, rank() OVER (PARTITION BY episode ORDER BY step DESC) AS r FROM fp) SELECT episode, step, link, round(z, 6) AS score, (row_number() OVER (PARTITION BY episode ORDER BY z DESC, link))::INTEGER AS place, label AS active FROM e WHERE r = 1",
    simulated_test: f"WITH {_TESTED}, {_CALIBRATED}, rs AS (" + " UNION ALL ".join(_tested(k) for k in (1, 5, 10)) + ") SELECT * FROM rs, cal",
    exploratory_days: f"WITH {GRID}, {_KERNEL}, g0 AS MATERIALIZED (SELECT * FROM g WHERE hour < TIMESTAMP '2024-01-07') " + " UNION ALL ".join(map(_explored, ("raw", "smoothed"))),
    dataset_audit: f"WITH {_FLOWS}, {_PLANNED} SELECT 'id' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'variant', count(*) FROM (SELECT variant FROM pl GROUP BY 1 HAVING count(DISTINCT partition) > 1) UNION ALL SELECT 'repeated_day', count(*) FROM (SELECT 1 FROM pl GROUP BY partition, variant, slot HAVING count(*) > 1) UNION ALL SELECT 'small_loss', count(*) FROM fp WHERE q1 - q2 > 40 UNION ALL SELECT unnest(['period', 'overlap', 'grid', 'balance', 'inactive', 'not_negative', 'symmetry', 'diagonal', 'distance', 'unknown']), 0",
    topk_curve: f"WITH {GRID}, {_KERNEL}, ps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY score DESC, entity) AS place FROM (SELECT s.hour, s.entity, round(s.score, 3) AS score, g.active FROM (SELECT hour, p AS entity, round(sum(weight * score), 6) AS score FROM g JOIN kn ON kn.q = g.entity GROUP BY 1, 2) s JOIN g USING (hour, entity))), {_CURVE.format(_PLACES.format('raw', 'placed') + ' UNION ALL ' + _PLACES.format('smoothed', 'ps'))} SELECT mode, k::INTEGER AS k, round(avg((place <= k)::INT), 9) AS share, round(avg((place <= k)::INT) FILTER (entity % 3 <> 0), 9) AS share_outside, round(quantile_cont(place, 0.5), 6) AS median_place, round(quantile_cont(chance, 0.5), 6) AS median_chance FROM pp, range(1, 51) t(k) GROUP BY ALL",
    flow_error_medians: f"WITH {_FLOWS}, e AS (SELECT 'predicted' AS kind, abs(p1 - y1) AS e FROM fp UNION ALL SELECT 'predicted', abs(p2 - y2) FROM fp UNION ALL SELECT 'mean', abs(y1) FROM fp UNION ALL SELECT 'mean', abs(y2) FROM fp), b AS (SELECT label, q1 - y1 + p1 - (q2 - y2 + p2) AS b FROM fp), n AS (SELECT quantile_cont(abs(b), 0.99) AS n FROM b WHERE NOT label) SELECT kind, round(quantile_cont(e, 0.5), 6) AS median, (SELECT round(n, 6) FROM n) AS noise, (SELECT round(avg((b > n)::INT), 9) FROM b, n WHERE label) AS beyond FROM e GROUP BY 1",
}
