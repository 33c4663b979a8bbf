"""Queries over the tables themselves: normalisation, windows, graphs, event studies, plans and metrics.

Episodes are users of the events table or years of orders, the network is the nations with the links that suppliers'
deliveries to customers make, training rows are those of the first twenty days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegrid.functions.scalar import clip, sigmoid
from ripplegrid.jobs.score_queries import GRID, Inputs
from ripplegrid.operators import event_study, graph, grid, metrics, norm, order_stats, plan, windows
from ripplegrid.sources.tables import resume, table


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with k out of their properties and flags: an error event's value is not valid."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.from_json("props", "k bigint")["k"].cast("double").alias("k"), (F.col("event_type") != "error").alias("valid"), F.col("value").isNotNull().alias("present"), (F.col("event_type") == "purchase").alias("bought"))


_FEATURES = "f AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, event_type <> 'error' AS valid, value IS NOT NULL AS present, event_type = 'purchase' AS bought FROM events)"
_TRAIN = "ts < TIMESTAMP '2024-01-21'"
_MASKS = {"value": ["present", "valid"], "k": ["valid"]}


def _masks():
    return {f: norm.mask_of(f, _MASKS) for f in _MASKS}


def scan_schema_violations(spark, sf_dir):
    """Rows of the events that break the table's contract, by rule."""
    e = table(spark, sf_dir, "events")
    return norm.violations(e, {"id": F.col("event_id").isNotNull() & (F.col("event_id") >= 0), "value": F.col("value") >= 0.5, "type": F.col("event_type").isin("view", "click", "error", "purchase", "signup"), "props": F.from_json("props", "k bigint")["k"].isNotNull()})


def norm_stats_masked(spark, sf_dir):
    s = norm.fit(_features(spark, sf_dir).where("ts < timestamp_ntz'2024-01-21'"), ["value", "k", "bought"], _masks(), ("bought",))
    return s.select("field", F.round("centre", 6).alias("centre"), F.round("spread", 6).alias("spread"), "n")


def norm_apply(spark, sf_dir):
    f = _features(spark, sf_dir)
    stats = norm.fit(f.where("ts < timestamp_ntz'2024-01-21'"), ["value", "k"], _masks())
    return norm.apply(f, stats, ["value", "k"], _masks()).select("event_id", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"))


def norm_ablation(spark, sf_dir):
    f = _features(spark, sf_dir)
    stats = norm.fit(f.where("ts < timestamp_ntz'2024-01-21'"), ["value", "k"], _masks())
    out = norm.apply(f, stats, ["value", "k"], _masks(), dropped=("k",))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"), F.sum("k").alias("k"))


def q_scale(spark, sf_dir):
    return norm.scale(_features(spark, sf_dir).where("ts < timestamp_ntz'2024-01-21'"), "value").select(F.round("scale", 6).alias("scale"))


def norm_merged_moments(spark, sf_dir):
    m = norm.merged_moments(_features(spark, sf_dir), "user_id", "value", F.col("valid"))
    return m.select(F.round("centre", 6).alias("centre"), F.round("spread", 4).alias("spread"), "n")


def class_weights(spark, sf_dir):
    w = windows.causal(_features(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").select("event_type")
    return metrics.class_weights(w, F.col("event_type") == "error", F.lit(True))


def causal_window12(spark, sf_dir):
    w = windows.causal(_features(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value")
    return w.select("event_id", "step", F.size("window").alias("width"), F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.element_at("window", 1).alias("oldest"))


def diff_valid(spark, sf_dir):
    return windows.difference(_features(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value", "valid").select("event_id", F.round("change", 6).alias("change"), "change_valid")


def rolling6(spark, sf_dir):
    return windows.rolling_mean(_features(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("rolling", 6).alias("rolling"))


def hourly_resample(spark, sf_dir):
    r = windows.resample(_features(spark, sf_dir).withColumn("seq", F.col("event_id")), "ts", ["event_type"], "value")
    return r.select("event_type", "slot", F.round("mean", 6).alias("mean"), "last", "n")


def subsample_linspace(spark, sf_dir):
    return windows.spread_sample(_features(spark, sf_dir), ["user_id"], ["ts", "event_id"], 6).select("user_id", "event_id", "place")


def _intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("user_id", (F.hour("ts") * 3).alias("begin"), (F.hour("ts") * 3 + 9 + F.col("user_id").cast("int") % 5).alias("finish"))


_INTERVALS = "i AS (SELECT user_id, hour(ts) * 3 AS b, hour(ts) * 3 + 9 + user_id % 5 AS f FROM events WHERE event_type = 'error'), t AS (SELECT user_id, 0 AS t FROM i UNION SELECT user_id, 72 FROM i UNION SELECT user_id, greatest(b, 0) FROM i UNION SELECT user_id, least(f, 72) FROM i), p AS (SELECT * FROM (SELECT user_id, t AS b, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS f FROM t) WHERE f IS NOT NULL)"


def changepoints(spark, sf_dir):
    return windows.pieces(_intervals(spark, sf_dir), "user_id")


def piece_states(spark, sf_dir):
    i = _intervals(spark, sf_dir)
    return windows.active_in(windows.pieces(i, "user_id"), i, "user_id")


def category_rotation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return windows.rotated(o, ["o_orderstatus"], [F.col("o_orderkey")])


def _links(spark, sf_dir):
    """link, a (supplier's nation), b (customer's nation), kind, q1 (sent) and q2 (kept): one row a pair of nations."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    buyers = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b")), "c_custkey").select("l_orderkey", "b")
    sellers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a"))
    flow = lines.join(buyers, "l_orderkey").join(sellers, "l_suppkey").groupBy("a", "b").agg(F.sum("l_quantity").alias("q1"), F.coalesce(F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))), F.lit(0.0)).alias("q2"))
    return flow.where("a <> b").select((F.col("a") * 25 + F.col("b")).alias("link"), "a", "b", F.when((F.col("a") + F.col("b")) % 9 == 0, "pump").otherwise("pipe").alias("kind"), "q1", "q2")


_LINKS = "l AS (SELECT a * 25 + b AS link, a, b, CASE WHEN (a + b) % 9 = 0 THEN 'pump' ELSE 'pipe' END AS kind, q1, q2 FROM (SELECT s_nationkey AS a, c_nationkey AS b, sum(l_quantity) AS q1, coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) AS q2 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) WHERE a <> b)"


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), "n_regionkey", F.length("n_name").cast("double").alias("size"))


def edge_cut(spark, sf_dir):
    return graph.cut(_links(spark, sf_dir))


def directed_doubling(spark, sf_dir):
    return graph.doubled(_links(spark, sf_dir))


def line_graph(spark, sf_dir):
    return graph.line_graph(_links(spark, sf_dir))


def line_features(spark, sf_dir):
    return graph.line_features(_links(spark, sf_dir), _nodes(spark, sf_dir), ["n_regionkey", "size"]).select("link", "start_n_regionkey", "end_n_regionkey", "start_size", "end_size", "q1")


def node_balance(spark, sf_dir):
    links = _links(spark, sf_dir)
    eligible = graph.all_of_kind(links.where("kind = 'pipe'"), "kind", "pipe")
    return graph.balance(links).join(eligible.select("node"), "node", "left_semi")


def midpoint_losses(spark, sf_dir):
    return graph.losses(_links(spark, sf_dir))


def eligible_nodes(spark, sf_dir):
    """Nodes without a valve; a link between two nodes of round number has one."""
    links = _links(spark, sf_dir).withColumn("kind", F.when((F.col("a") % 5 == 0) & (F.col("b") % 5 == 0), "valve").otherwise("pipe"))
    return graph.all_of_kind(links, "kind", "pipe")


def neighbour_mean(spark, sf_dir):
    return graph.neighbour_mean(_nodes(spark, sf_dir), _links(spark, sf_dir).where("kind = 'pipe'"), "size")


def edge_union(spark, sf_dir):
    arcs = graph.doubled(_links(spark, sf_dir).where("kind = 'pipe'")).select("src", "dst")
    n = _nodes(spark, sf_dir)
    ring = n.select(F.col("node").alias("src"), ((F.col("node") + 1) % 25).alias("dst"))
    return graph.union_edges(arcs, ring)


def path_distance(spark, sf_dir):
    arcs = graph.doubled(_links(spark, sf_dir)).join(_links(spark, sf_dir).select("link", "q1"), "link").select("src", "dst", (1 + F.col("link") % 7).cast("double").alias("length"))
    return graph.distances(arcs, _nodes(spark, sf_dir))


def static_scaling(spark, sf_dir):
    return graph.standard_static(_nodes(spark, sf_dir), ["size"]).select("node", F.round("size", 9).alias("size"))


def background_hourly(spark, sf_dir):
    b = event_study.background(Inputs(spark, sf_dir).scores, F.col("hour") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return b.select("hour", "entity", F.round("background", 6).alias("background"), F.round("residual", 6).alias("residual"))


def _anchors(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase' AND ts >= timestamp_ntz'2024-01-16'")
    return e.groupBy(F.col("user_id").alias("entity")).agg(grid.hour_of(F.min("ts")).alias("anchor"))


_STUDY = "a AS (SELECT user_id AS entity, date_trunc('hour', min(ts)) AS anchor FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-16' GROUP BY 1), k AS (SELECT 'event' AS \"case\", entity, anchor FROM a UNION ALL SELECT 'control_7', entity, anchor - INTERVAL 7 DAY FROM a UNION ALL SELECT 'control_14', entity, anchor - INTERVAL 14 DAY FROM a), w AS (SELECT k.\"case\", k.entity, o AS off, g.score FROM k CROSS JOIN (SELECT unnest(range(-24, 24)) AS o) JOIN g ON g.entity = k.entity AND g.hour = k.anchor + o * INTERVAL 1 HOUR), e AS (SELECT \"case\", entity, avg(score) FILTER (off < 0) AS b, avg(score) FILTER (off >= 0) AS a, stddev_pop(score) FILTER (off < 0) AS s FROM w GROUP BY 1, 2), gn AS (SELECT \"case\", entity, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS gain, round(CASE WHEN s > 1e-12 THEN (a - b) / s END, 6) AS rise FROM e)"


def event_gains(spark, sf_dir):
    return event_study.gains(event_study.around(Inputs(spark, sf_dir).scores, event_study.controls(_anchors(spark, sf_dir)), 24))


def diff_in_diff(spark, sf_dir):
    return event_study.difference_in_differences(event_gains(spark, sf_dir))


def concurrent_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("entity"), "ts")
    return event_study.concurrent(_anchors(spark, sf_dir), e, 6)


def _plan(spark, sf_dir):
    """Orders as planned episodes: id, variant (customer), partition (by year), begin and finish in hours."""
    o = table(spark, sf_dir, "orders")
    part = F.when(F.year("o_orderdate") < 1999, "train").when(F.year("o_orderdate") < 2000, "validation").otherwise("test")
    begin = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) % 600 * 24
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("variant"), part.alias("partition"), begin.cast("bigint").alias("begin"), (begin + 6).cast("bigint").alias("finish"))


_PLAN = "p AS (SELECT o_orderkey AS id, o_custkey AS variant, CASE WHEN year(o_orderdate) < 1999 THEN 'train' WHEN year(o_orderdate) < 2000 THEN 'validation' ELSE 'test' END AS part, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) % 600 * 24 AS b FROM orders)"


def plan_overlap(spark, sf_dir):
    """Pairs of planned episodes of different partitions that overlap, counted by the hour in which they begin to."""
    return plan.overlaps(_plan(spark, sf_dir))


def partition_contract(spark, sf_dir):
    return plan.contract(_plan(spark, sf_dir), "variant", "partition")


def repeated_keys(spark, sf_dir):
    return plan.repeated(table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key")), "key")


def resume_anti_join(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return resume(p.select("id", "partition"), p.where("variant % 3 <> 0").select("id"), ["id"])


def round_robin_shard(spark, sf_dir):
    return plan.shard(_plan(spark, sf_dir), ["partition"], ["id"], 4, 1).select("id", "partition")


def first_per_partition(spark, sf_dir):
    return plan.first_of(_plan(spark, sf_dir), ["partition"], [F.col("begin"), F.col("id")], 2).select("partition", "place", "id")


def seeded_sample(spark, sf_dir):
    return plan.sampled(_plan(spark, sf_dir), "id", ["partition"], "9", 20).select("partition", "place", "id")


def merged_manifests(spark, sf_dir):
    p = _plan(spark, sf_dir).select("id", "partition")
    return plan.merged(p.where("id % 2 = 0"), p.where("id % 3 = 0").withColumn("partition", F.lit("again")), ["id"])


def set_guards(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return plan.set_differences(e.where("event_type = 'error'").select(grid.hour_of(F.col("ts")).alias("hour")), e.where("event_type = 'purchase'").select(grid.hour_of(F.col("ts")).alias("hour")), "hour")


def overlaid_defaults(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1.0).alias("value"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("value"))
    return plan.overlaid(c, o, "c_custkey", "value")


def zone_membership(spark, sf_dir):
    """Links both of whose ends lie in region 2 or in none (region 4 stands for none)."""
    zone = lambda c: F.coalesce(F.when(F.col(c) != 4, F.col(c)), F.lit(2)) == 2
    f = graph.line_features(_links(spark, sf_dir), _nodes(spark, sf_dir), ["n_regionkey"])
    return f.select("link", (zone("start_n_regionkey") & zone("end_n_regionkey")).alias("inside"))


def flow_metrics(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity") - 1500).alias("truth"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity") - 1450).alias("guess"))
    return metrics.flow_errors(lines, ["l_returnflag", "l_linestatus"], "truth", "guess", 50.0)


def slope_noise(spark, sf_dir):
    e = _features(spark, sf_dir).select((F.col("value") - 50).alias("truth"), (F.col("k") / 2 - 10).alias("guess"))
    return metrics.calibration(e, "truth", "guess")


def quantiles_exact(spark, sf_dir):
    return metrics.quantiles(_features(spark, sf_dir).withColumn("x", F.col("value") - 10), ["event_type"], "x")


def crosstab(spark, sf_dir):
    return metrics.crosstab(table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")), "year", "o_orderstatus", ["F", "O", "P"])


def binned_mean(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag")
    return metrics.binned_share(lines, "l_quantity", [0, 4, 7, 10, 15, 21], F.col("l_returnflag") == "R")


def busiest_hour(spark, sf_dir):
    return metrics.busiest(Inputs(spark, sf_dir).scores)


def weighted_epoch_mean(spark, sf_dir):
    return metrics.weighted_mean(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")


def checkpoint_pick(spark, sf_dir):
    h = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.year("o_orderdate").alias("step")).agg(F.round(F.avg("o_totalprice") / 10000).alias("metric"), F.round(F.stddev_pop("o_totalprice"), 4).alias("loss"))
    return metrics.best_step(h, ["run"])


def median_pick(spark, sf_dir):
    return metrics.upper_median(table(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_acctbal", "s_suppkey"]).select("s_nationkey", "s_suppkey", "s_acctbal")


def log_odds_loss(spark, sf_dir):
    return metrics.log_loss(_features(spark, sf_dir), (F.col("value") - 50) / 20, (F.col("event_type") == "error").cast("double"), 4.0, ["event_type"])


def conservation_scale(spark, sf_dir):
    return metrics.mean_of_means(table(spark, sf_dir, "events"), "user_id", "value")


def per_event_mean(spark, sf_dir):
    return metrics.per_event(table(spark, sf_dir, "events"), "user_id", "value")


def scaled_colours(spark, sf_dir):
    """Values clipped to the 1 % and 99 % quantiles and scaled to 0 to 255, halves to even; sigmoid of the distance to the middle."""
    e = table(spark, sf_dir, "events")
    q = [order_stats.one_quantile(e, "value", p) for p in (0.01, 0.99)]
    share = (clip(F.col("value"), q[0], q[1]) - q[0]) / (q[1] - q[0])
    return e.select("event_id", F.floor(share * 255).cast("bigint").alias("colour"), F.round(sigmoid(share * 4 - 2), 9).alias("weight"))


def episode_audit(spark, sf_dir):
    """Violations of the orders' contract by rule: prices, dates, keys, and lines without an order."""
    o = table(spark, sf_dir, "orders")
    own = norm.violations(o, {"price": F.col("o_totalprice") > 2000, "date": F.col("o_orderdate") >= F.lit("1995-02-01").cast("timestamp_ntz"), "status": F.col("o_orderstatus").isin("F", "O")})
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(o.select("o_orderkey"), "o_orderkey", "left_anti")
    return own.unionByName(lines.agg(F.lit("orphan").alias("rule"), F.count("*").alias("violations")))


_BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"
_STATS = "s AS (SELECT avg(value) FILTER (valid AND present) AS vc, CASE WHEN stddev_pop(value) FILTER (valid AND present) < 1e-6 THEN 1 ELSE stddev_pop(value) FILTER (valid AND present) END AS vs, avg(k) FILTER (valid) AS kc, CASE WHEN stddev_pop(k) FILTER (valid) < 1e-6 THEN 1 ELSE stddev_pop(k) FILTER (valid) END AS ks, count(value) FILTER (valid AND present) AS vn, count(k) FILTER (valid) AS kn, count(bought) AS bn FROM f WHERE " + _TRAIN + ")"
_APPLIED = "SELECT event_id, event_type, CASE WHEN valid AND present THEN (value - vc) / vs ELSE 0 END AS value, CASE WHEN valid THEN (k - kc) / ks ELSE 0 END AS k FROM f, s"

QUERIES = {
    scan_schema_violations: "SELECT rule, violations FROM (SELECT count(*) FILTER (NOT coalesce(event_id >= 0, false)) AS id, count(*) FILTER (NOT coalesce(value >= 0.5, false)) AS value, count(*) FILTER (NOT coalesce(event_type IN ('view', 'click', 'error', 'purchase', 'signup'), false)) AS type, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS props FROM events) UNPIVOT (violations FOR rule IN (id, value, type, props))",
    norm_stats_masked: f"WITH {_FEATURES}, {_STATS} SELECT 'value' AS field, round(vc, 6) AS centre, round(vs, 6) AS spread, vn AS n FROM s UNION ALL SELECT 'k', round(kc, 6), round(ks, 6), kn FROM s UNION ALL SELECT 'bought', 0, 1, bn FROM s",
    norm_apply: f"WITH {_FEATURES}, {_STATS} SELECT event_id, round(value, 6) AS value, round(k, 6) AS k FROM ({_APPLIED})",
    norm_ablation: f"WITH {_FEATURES}, {_STATS} SELECT event_type, count(*) AS n, round(sum(value), 4) AS value, 0.0::DOUBLE AS k FROM ({_APPLIED}) GROUP BY event_type",
    q_scale: f"SELECT round(greatest(sqrt(avg(value * value)), 1e-6), 6) AS scale FROM events WHERE {_TRAIN}",
    norm_merged_moments: f"WITH {_FEATURES} SELECT round(avg(value), 6) AS centre, round(sqrt(greatest(avg(value * value) - avg(value) * avg(value), 0)), 4) AS spread, count(value) AS n FROM f WHERE valid",
    class_weights: f"WITH s AS (SELECT event_type, row_number() OVER ({_BY_USER}) AS n FROM events), c AS (SELECT count(*) FILTER (event_type = 'error') AS positives, count(*) FILTER (event_type <> 'error') AS negatives FROM s WHERE n >= 12) SELECT positives, negatives, round(negatives / positives, 9) AS weight, round(0.6931471805599453::DOUBLE * (negatives + negatives / positives * positives) / (negatives + positives), 9) AS even_loss FROM c",
    causal_window12: f"SELECT event_id, step, width, round(total, 4) AS total, oldest FROM (SELECT event_id, (row_number() OVER ({_BY_USER}) - 1)::INTEGER AS step, (count(*) OVER w)::INTEGER AS width, sum(value) OVER w AS total, first_value(value) OVER w AS oldest FROM events WINDOW w AS ({_BY_USER} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE step >= 11",
    diff_valid: f"WITH {_FEATURES}, d AS (SELECT event_id, value - lag(value) OVER ({_BY_USER}) AS d, coalesce(valid AND lag(valid) OVER ({_BY_USER}), false) AS ok FROM f) SELECT event_id, round(CASE WHEN ok THEN d ELSE 0 END, 6) AS change, ok AS change_valid FROM d",
    rolling6: f"SELECT event_id, round(CASE WHEN count(value) OVER w = 6 THEN avg(value) OVER w END, 6) AS rolling FROM events WINDOW w AS ({_BY_USER} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
    hourly_resample: "SELECT event_type, date_trunc('hour', ts) AS slot, round(avg(value), 6) AS mean, arg_max(value, (ts, event_id)) AS last, count(*) AS n FROM events GROUP BY 1, 2",
    subsample_linspace: f"WITH s AS (SELECT user_id, event_id, (row_number() OVER ({_BY_USER}) - 1)::INTEGER AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, place FROM s WHERE n <= 6 OR list_contains(list_transform(range(0, 6), lambda i: i * (n - 1) // 5), place)",
    changepoints: f"WITH {_INTERVALS} SELECT user_id, b::INTEGER AS begin, f::INTEGER AS finish FROM p",
    piece_states: f"WITH {_INTERVALS} SELECT p.user_id, p.b::INTEGER AS begin, p.f::INTEGER AS finish, count(*) FILTER (i.b <= p.b AND p.b < i.f) AS n_active FROM p JOIN i USING (user_id) GROUP BY 1, 2, 3",
    category_rotation: "SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 3)::INTEGER AS category FROM orders",
    edge_cut: f"WITH {_LINKS} SELECT link, 1 AS segment, a::VARCHAR AS a, 'm' || link AS b FROM l UNION ALL SELECT link, 2, 'm' || link, b::VARCHAR FROM l",
    directed_doubling: f"WITH {_LINKS} SELECT link, a AS src, b AS dst FROM l UNION ALL SELECT link, b, a FROM l",
    line_graph: f"WITH {_LINKS}, e AS (SELECT link, a AS node, -1 AS sign FROM l UNION ALL SELECT link, b, 1 FROM l) SELECT x.link AS l1, y.link AS l2, node, x.sign FROM e x JOIN (SELECT DISTINCT link, node FROM e) y USING (node) WHERE x.link <> y.link",
    line_features: f"WITH {_LINKS} SELECT link, s.n_regionkey AS start_n_regionkey, t.n_regionkey AS end_n_regionkey, length(s.n_name)::DOUBLE AS start_size, length(t.n_name)::DOUBLE AS end_size, q1 FROM l JOIN nation s ON s.n_nationkey = a JOIN nation t ON t.n_nationkey = b",
    node_balance: f"WITH {_LINKS}, e AS (SELECT b AS node, q2 AS q FROM l UNION ALL SELECT a, -q1 FROM l), ok AS (SELECT a AS node FROM l WHERE kind = 'pipe' UNION SELECT b FROM l WHERE kind = 'pipe') SELECT node, round(sum(q), 4) AS balance FROM e SEMI JOIN ok USING (node) GROUP BY node",
    midpoint_losses: f"WITH {_LINKS} SELECT link, round(q1 - q2, 4) AS loss FROM l",
    eligible_nodes: f"WITH {_LINKS}, k AS (SELECT a, b, CASE WHEN a % 5 = 0 AND b % 5 = 0 THEN 'valve' ELSE 'pipe' END AS kind FROM l), e AS (SELECT a AS node, kind FROM k UNION ALL SELECT b, kind FROM k) SELECT node, count(*) AS degree FROM e GROUP BY node HAVING bool_and(kind = 'pipe')",
    neighbour_mean: f"WITH {_LINKS}, e AS (SELECT a AS src, b AS dst FROM l WHERE kind = 'pipe' UNION ALL SELECT b, a FROM l WHERE kind = 'pipe') SELECT n.n_nationkey AS node, round(coalesce(avg(length(s.n_name)), 0), 6) AS mean FROM nation n LEFT JOIN e ON e.dst = n.n_nationkey LEFT JOIN nation s ON s.n_nationkey = e.src GROUP BY 1",
    edge_union: f"WITH {_LINKS}, u AS (SELECT a AS src, b AS dst, 0 AS origin FROM l WHERE kind = 'pipe' UNION ALL SELECT b, a, 0 FROM l WHERE kind = 'pipe' UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, 1 FROM nation) SELECT src, dst, min(origin) AS origin FROM u GROUP BY 1, 2",
    path_distance: f"WITH {_LINKS}, e AS (SELECT a AS src, b AS dst, (1 + link % 7)::DOUBLE AS w FROM l UNION ALL SELECT b, a, (1 + link % 7)::DOUBLE FROM l), d0 AS MATERIALIZED (SELECT source, node, min(d) AS d FROM (SELECT src AS source, dst AS node, w AS d FROM e UNION ALL SELECT n_nationkey, n_nationkey, 0::DOUBLE FROM nation) GROUP BY 1, 2), d1 AS MATERIALIZED (SELECT source, node, min(d) AS d FROM (SELECT * FROM d0 UNION ALL SELECT x.source, y.node, x.d + y.d FROM d0 x JOIN d0 y ON y.source = x.node) GROUP BY 1, 2), d2 AS MATERIALIZED (SELECT source, node, min(d) AS d FROM (SELECT * FROM d1 UNION ALL SELECT x.source, y.node, x.d + y.d FROM d1 x JOIN d1 y ON y.source = x.node) GROUP BY 1, 2), d3 AS MATERIALIZED (SELECT source, node, min(d) AS d FROM (SELECT * FROM d2 UNION ALL SELECT x.source, y.node, x.d + y.d FROM d2 x JOIN d2 y ON y.source = x.node) GROUP BY 1, 2), d4 AS MATERIALIZED (SELECT source, node, min(d) AS d FROM (SELECT * FROM d3 UNION ALL SELECT x.source, y.node, x.d + y.d FROM d3 x JOIN d3 y ON y.source = x.node) GROUP BY 1, 2), d5 AS MATERIALIZED (SELECT source, node, min(d) AS d FROM (SELECT * FROM d4 UNION ALL SELECT x.source, y.node, x.d + y.d FROM d4 x JOIN d4 y ON y.source = x.node) GROUP BY 1, 2) SELECT source, node, d AS distance FROM d5",
    static_scaling: "SELECT n_nationkey AS node, round((length(n_name) - avg(length(n_name)) OVER ()) / stddev_pop(length(n_name)) OVER (), 9) AS size FROM nation",
    background_hourly: f"WITH {GRID}, m AS (SELECT entity, hour(hour) AS h, avg(score) FILTER (hour < TIMESTAMP '2024-01-15') AS b FROM g GROUP BY 1, 2) SELECT g.hour, g.entity, round(b, 6) AS background, round(score - b, 6) AS residual FROM g JOIN m ON m.entity = g.entity AND m.h = hour(g.hour)",
    event_gains: f"WITH {GRID}, {_STUDY} SELECT * FROM gn",
    diff_in_diff: f"WITH {GRID}, {_STUDY} SELECT entity, round(avg(gain) FILTER (\"case\" = 'event'), 6) AS event_gain, round(avg(gain) FILTER (\"case\" <> 'event'), 8) AS control_gain, round(avg(gain) FILTER (\"case\" = 'event') - avg(gain) FILTER (\"case\" <> 'event'), 8) AS difference FROM gn GROUP BY entity",
    concurrent_events: f"WITH {GRID}, {_STUDY} SELECT a.entity, a.anchor, count(e.event_id) AS n FROM a LEFT JOIN events e ON e.event_type = 'purchase' AND e.user_id <> a.entity AND e.ts >= a.anchor - INTERVAL 6 HOUR AND e.ts < a.anchor + INTERVAL 7 HOUR GROUP BY 1, 2",
    plan_overlap: f"WITH {_PLAN} SELECT greatest(x.b, y.b) AS slot, count(*) AS pairs FROM p x JOIN p y ON x.part < y.part AND x.b < y.b + 6 AND y.b < x.b + 6 GROUP BY 1",
    partition_contract: f"WITH {_PLAN} SELECT variant, count(DISTINCT part) AS partitions FROM p GROUP BY 1 HAVING count(DISTINCT part) > 1",
    repeated_keys: "SELECT l_orderkey || '/' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    resume_anti_join: f"WITH {_PLAN} SELECT id, part AS partition FROM p WHERE id NOT IN (SELECT id FROM p WHERE variant % 3 <> 0)",
    round_robin_shard: f"WITH {_PLAN} SELECT id, part AS partition FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS n FROM p) WHERE n % 4 = 1",
    first_per_partition: f"WITH {_PLAN} SELECT part AS partition, n::INTEGER AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY b, id) AS n FROM p) WHERE n <= 2",
    seeded_sample: f"WITH {_PLAN} SELECT part AS partition, n::INTEGER AS place, id FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5('9|' || id), id) AS n FROM p) WHERE n <= 20",
    merged_manifests: f"WITH {_PLAN} SELECT id, part AS partition FROM p WHERE id % 2 = 0 UNION ALL SELECT id, 'again' FROM p WHERE id % 3 = 0 AND id % 2 <> 0",
    set_guards: "WITH a AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events WHERE event_type = 'purchase') SELECT (SELECT count(*) FROM (SELECT h FROM a EXCEPT SELECT h FROM b)) AS only_a, (SELECT count(*) FROM (SELECT h FROM b EXCEPT SELECT h FROM a)) AS only_b",
    overlaid_defaults: "SELECT c_custkey, coalesce(m, 1.0) AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    zone_membership: f"WITH {_LINKS} SELECT link, coalesce(nullif(s.n_regionkey, 4), 2) = 2 AND coalesce(nullif(t.n_regionkey, 4), 2) = 2 AS inside FROM l JOIN nation s ON s.n_nationkey = a JOIN nation t ON t.n_nationkey = b",
    flow_metrics: "WITH x AS (SELECT l_returnflag, l_linestatus, l_extendedprice / l_quantity - 1500 AS t, l_extendedprice * (1 - l_discount) / l_quantity - 1450 AS g FROM lineitem) SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs(g - t)), 6) AS mae, round(sqrt(avg((g - t) * (g - t))), 6) AS rmse, round(avg(CASE WHEN abs(t) > 50 THEN (sign(t) = sign(g))::INT END), 9) AS sign_accuracy FROM x GROUP BY 1, 2",
    slope_noise: f"WITH {_FEATURES}, x AS (SELECT value - 50 AS t, k / 2 - 10 AS g FROM f), q AS (SELECT quantile_cont(g, 0.99) FILTER (t <= 0) AS n FROM x) SELECT round(sum(g * t) / sum(t * t), 6) AS slope, round(any_value(n), 6) AS noise_p99, round(avg(CASE WHEN t > 0 THEN (g > n)::INT END), 9) AS above, round(quantile_cont(g, 0.5) FILTER (t > 0), 6) AS median_guess, round(quantile_cont(t, 0.5) FILTER (t > 0), 6) AS median_truth FROM x, q",
    quantiles_exact: "SELECT event_type, " + ", ".join(f"round(quantile_cont(value - 10, {p}), 6) AS q{round(p * 100)}" for p in (0.0, 0.01, 0.5, 0.99, 1.0)) + ", round(avg((value - 10 < 0)::INT), 9) AS negative FROM events GROUP BY 1",
    crosstab: "SELECT year(o_orderdate)::INTEGER AS year, count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (o_orderstatus = 'P') AS \"n_P\", count(*) AS total FROM orders GROUP BY 1",
    binned_mean: "SELECT CASE WHEN l_quantity <= 4 THEN 1 WHEN l_quantity <= 7 THEN 2 WHEN l_quantity <= 10 THEN 3 WHEN l_quantity <= 15 THEN 4 ELSE 5 END AS bin, count(*) AS n, round(avg((l_returnflag = 'R')::INT), 9) AS share FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 21 GROUP BY 1",
    busiest_hour: f"WITH {GRID} SELECT hour, count(*) AS n FROM g WHERE active GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    weighted_epoch_mean: "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    checkpoint_pick: "WITH h AS (SELECT o_orderpriority AS run, year(o_orderdate)::INTEGER AS step, round(avg(o_totalprice) / 10000) AS metric, round(stddev_pop(o_totalprice), 4) AS loss FROM orders GROUP BY 1, 2) SELECT run, arg_max(step, (metric, -step)) AS best, arg_min(step, (loss, step)) AS lowest_loss FROM h GROUP BY 1",
    median_pick: "SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE r = n // 2 + 1",
    log_odds_loss: "WITH x AS (SELECT event_type, (value - 50) / 20 AS z, (event_type = 'error')::INT AS y FROM events) SELECT event_type, round(avg((1 - y) * z + (1 + 3 * y) * (ln(1 + exp(-abs(z))) + greatest(-z, 0))), 6) AS loss FROM x GROUP BY 1",
    conservation_scale: "SELECT round(greatest(sqrt(avg(r)), 1e-6), 6) AS scale, round(sqrt(sum(s) / sum(n)), 6) AS pooled FROM (SELECT user_id, avg(value * value) AS r, sum(value * value) AS s, count(value) AS n FROM events GROUP BY 1)",
    per_event_mean: "SELECT count(*) AS n, round(avg(m), 9) AS mean FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY 1)",
    scaled_colours: "WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events), s AS (SELECT event_id, (greatest(least(value, hi), lo) - lo) / (hi - lo) AS x FROM events, q) SELECT event_id, floor(x * 255)::BIGINT AS colour, round(1 / (1 + exp(-(x * 4 - 2))), 9) AS weight FROM s",
    episode_audit: "SELECT 'price' AS rule, count(*) FILTER (NOT o_totalprice > 2000) AS violations FROM orders UNION ALL SELECT 'date', count(*) FILTER (o_orderdate < TIMESTAMP '1995-02-01') FROM orders UNION ALL SELECT 'status', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
}


def year_scores(spark, sf_dir):
    """Scores of the causal windows of all users by a convolution with given weights (no SQL: tests hold it against a loop)."""
    from ripplegrid.operators.scorer import CausalNet, score_windows

    f = _features(spark, sf_dir).withColumn("x", (F.col("value") - 50) / 50).withColumn("y", F.col("k") / 100)
    w = windows.causal(f, ["user_id"], ["ts", "event_id"], "x").withColumnRenamed("window", "wx").drop("step")
    w = windows.causal(f, ["user_id"], ["ts", "event_id"], "y").select("event_id", F.col("window").alias("wy")).join(w.select("event_id", "wx"), "event_id")
    return score_windows(w, ["event_id"], ["wx", "wy"], CausalNet.given(2, 8)).select("event_id", F.round("score", 9).alias("score"))


def chained_level(spark, sf_dir):
    """A tank's level per user along its pieces, filled by purchases and drained by clicks (sequential: no SQL)."""
    from ripplegrid.operators.scorer import chained

    e = table(spark, sf_dir, "events")
    p = e.groupBy(F.col("user_id"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("piece")).agg(F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)), 6).alias("inflow"), F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0.0)), 6).alias("outflow"))
    return chained(p, "user_id", "piece", "inflow", "outflow", 50.0, 0.0, 100.0).select("user_id", "piece", F.round("level", 6).alias("level"))


def extra_rollup(spark, sf_dir):
    """Beyond the reference: prices by year and status with subtotals."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus", "o_totalprice")
    return o.rollup("year", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))


def extra_as_of(spark, sf_dir):
    """Beyond the reference: for every error the value of the user's last purchase before it."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w)
    return e.withColumn("last_purchase", last).where("event_type = 'error'").select("event_id", "last_purchase")


QUERIES |= {
    year_scores: None,
    chained_level: None,
    extra_rollup: "SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(year(o_orderdate), o_orderstatus)::INTEGER AS level FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderstatus)",
    extra_as_of: "SELECT event_id, last_purchase FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events) WHERE event_type = 'error'",
}
