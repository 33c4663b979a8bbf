"""Queries over hour x entity score maps: grids, ranking metrics, zones and footprints.

The map is made of the events table: the hour's sum of values of a user is the score, an error event makes the user
active, users stand on a ring 100 m apart and have lengths 1 + id % 7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplegrid.operators import compare, grid, rank, spatial
from ripplegrid.sources.shared import written
from ripplegrid.sources.tables import table

GRID = """
ev AS (
  SELECT date_trunc('hour', ts) AS hour, user_id AS entity, round(sum(value), 6) AS score, bool_or(event_type = 'error') AS active
  FROM events GROUP BY ALL
), users AS (SELECT DISTINCT entity FROM ev), hours AS (
  SELECT unnest(generate_series((SELECT min(hour) FROM ev), (SELECT max(hour) FROM ev), INTERVAL 1 HOUR)) AS hour
), g AS (
  SELECT h.hour, u.entity, coalesce(ev.score, 0) AS score, coalesce(ev.active, false) AS active
  FROM hours h CROSS JOIN users u LEFT JOIN ev ON ev.hour = h.hour AND ev.entity = u.entity
), near AS (
  SELECT * FROM (
    SELECT a.entity AS p, b.entity AS q, 100.0::DOUBLE * least(abs(a.entity - b.entity), n - abs(a.entity - b.entity)) AS d
    FROM users a, users b, (SELECT count(*) AS n FROM users)
  ) WHERE d <= 300
), lengths AS (SELECT entity, (1 + entity % 7)::DOUBLE AS length FROM users),
placed AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY score DESC, entity) AS place FROM g)
"""


class Inputs:
    """The score map and its dimensions."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.events = table(spark, sf_dir, "events")
        self.observed = grid.hourly(self.events)
        self.scores = grid.score_map(self.events)
        self.users = self.events.select(F.col("user_id").alias("entity")).distinct()

    @property
    def near(self) -> DataFrame:
        return grid.ring(self.users)

    @property
    def lengths(self) -> DataFrame:
        return self.users.select("entity", (1 + F.col("entity") % 7).cast("double").alias("length"))

    def coarse(self) -> DataFrame:
        """Scores in steps of 40, so that many are tied."""
        return self.scores.withColumn("score", F.floor(F.col("score") / 40).cast("double"))


def gap_fill_hourly(spark, sf_dir):
    return Inputs(spark, sf_dir).scores


def sensor_scatter(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    buys = x.events.where("event_type = 'purchase'").groupBy(grid.hour_of(F.col("ts")).alias("hour"), F.col("user_id").alias("entity")).agg(F.round(F.sum("value"), 6).alias("value"))
    return grid.scatter(x.scores.select("hour", "entity"), buys, ["hour", "entity"], "value")


def finite_hours(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    odd = x.scores.select("hour", "entity", F.when((F.hour("hour") == 3) & (F.col("entity") == 0), F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))
    return grid.finite_hours(odd).groupBy("hour").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


_HIT = """
cut AS (SELECT hour, min(score) AS cutoff FROM (SELECT hour, score, row_number() OVER (PARTITION BY hour ORDER BY score DESC) AS n FROM m) WHERE n <= {k} GROUP BY hour),
r AS (SELECT m.*, cutoff, sum((score > cutoff)::INT) OVER w AS hi, sum((score = cutoff)::INT) OVER w AS e FROM m JOIN cut USING (hour) WINDOW w AS (PARTITION BY hour)),
c AS (
  SELECT a.hour, a.entity, any_value(a.hi) AS hi, any_value(a.e) AS e, bool_or(b.score > b.cutoff) AS sure, sum((b.score = b.cutoff)::INT) AS b
  FROM r a JOIN near ON near.p = a.entity JOIN r b ON b.hour = a.hour AND b.entity = near.q WHERE a.active GROUP BY 1, 2
),
h AS (
  SELECT hour, entity, CASE WHEN sure THEN 1.0::DOUBLE ELSE 1 - coalesce(list_product(list_transform(range(0, least({k} - hi, e)::BIGINT), lambda i: greatest(e - b - i, 0)::DOUBLE / (e - i))), 1.0) END AS hit FROM c
)
"""
_FINE, _COARSE = "m AS (SELECT * FROM g)", "m AS (SELECT hour, entity, floor(score / 40) AS score, active FROM g)"
_BY_HOUR = "SELECT hour, count(*) AS n_active, round(avg(hit), 9) AS hit FROM h GROUP BY hour"


def localisation_topk(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return rank.localisation(x.scores, x.near, 5)


def localisation_ties(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return rank.localisation(x.coarse(), x.near, 5)


def localisation_per_entity(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return rank.hits(x.coarse(), x.near, 10).groupBy("entity").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 9).alias("hit"))


def random_topk(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return rank.random_reference(x.near, x.users.count(), 5)


def mean_rank(spark, sf_dir):
    return rank.average_rank(Inputs(spark, sf_dir).coarse())


def fractional_topk(spark, sf_dir):
    return rank.fractional_recall(Inputs(spark, sf_dir).coarse(), 5)


def average_precision(spark, sf_dir):
    return rank.average_precision(Inputs(spark, sf_dir).coarse().withColumn("label", F.col("active")))


def average_precision_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return rank.average_precision(docs.withColumn("n_chars", F.col("n_chars").cast("double")), "n_chars", "quality")


def confusion(spark, sf_dir):
    return rank.confusion(Inputs(spark, sf_dir).scores, 60.0)


def false_alarms(spark, sf_dir):
    return rank.false_alarms(Inputs(spark, sf_dir).scores, 90.0)


def first_place_near(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return rank.first_place_near(x.scores, x.near)


def top5_frequency(spark, sf_dir):
    return rank.top_frequency(Inputs(spark, sf_dir).scores, 5)


def kernel_weights(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return spatial.kernel(x.near, x.lengths).select("p", "q", F.round("weight", 9).alias("weight"))


def kernel_smooth(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return spatial.smooth(x.scores, spatial.kernel(x.near, x.lengths))


def zone_budget(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return spatial.within_budget(x.scores, x.lengths, 0.05)


def zone_coverage(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return spatial.covered(spatial.within_budget(x.scores, x.lengths, 0.05), x.near).groupBy("hour").agg(F.count("*").alias("n"), F.sum("entity").alias("ids"))


def zone_recall(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return spatial.recall(x.scores, spatial.covered(spatial.within_budget(x.scores, x.lengths, 0.05), x.near))


def footprint_exact(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return spatial.footprint(x.scores, x.near, x.lengths, 0.2).select("hour", "entity", F.round("weight", 6).alias("weight"))


def footprint_keep(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return spatial.footprint(x.scores, x.near, x.lengths, 0.3, keep_last=True, most=400)


def footprint_recall(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    found = spatial.covered(spatial.footprint(x.scores, x.near, x.lengths, 0.2, keep_last=True, most=400), x.near)
    return spatial.recall(x.scores, found)


def jaccard_hourly(spark, sf_dir):
    x = Inputs(spark, sf_dir)
    return spatial.stability(spatial.within_budget(x.scores, x.lengths, 0.05), x.lengths, x.scores.select("hour").distinct())


def comparison_table(spark, sf_dir):
    """The metrics of two maps (fine and coarse scores), as they are and smoothed, and of their controls; every third entity lies in the zone."""
    x = Inputs(spark, sf_dir)
    both = written(x.scores.select("hour", "entity", "active", F.col("score").alias("fine"), F.floor(F.col("score") / 40).cast("double").alias("coarse")), "scores")
    around = both.select("hour", F.col("entity").alias("q"), "fine", "coarse").join(spatial.kernel(x.near, x.lengths), "q").groupBy("hour", F.col("p").alias("entity"))
    smooth = around.agg(*[F.round(F.round(F.sum(F.col("weight") * F.col(c)), 6), 3).alias(f"{c}_smooth") for c in ("fine", "coarse")])
    each = [F.struct(F.lit(m).alias("map"), F.lit(mode).alias("mode"), F.col(c).alias("score")) for m in ("fine", "coarse") for mode, c in (("raw", m), ("smoothed", f"{m}_smooth"))]
    maps = both.join(smooth, ["hour", "entity"]).select("hour", "entity", "active", F.explode(F.array(*each)).alias("m")).select("m.map", "m.mode", "hour", "entity", "m.score", "active")
    return compare.comparison(maps, x.near, x.lengths, x.users.where("entity % 3 <> 0"))


_BUDGET = """
fold AS (
  SELECT hour, list_reduce(list(struct_pack(left_ := length, got := [struct_pack(entity := entity, place := place)]) ORDER BY place),
    lambda a, x: CASE WHEN x.left_ <= a.left_ THEN struct_pack(left_ := a.left_ - x.left_, got := list_concat(a.got, x.got)) ELSE a END,
    struct_pack(left_ := (SELECT 0.05::DOUBLE * sum(length) FROM lengths), got := []::STRUCT(entity BIGINT, place BIGINT)[])) AS f
  FROM placed JOIN lengths USING (entity) GROUP BY hour
), sel AS (SELECT hour, x.entity AS entity, x.place::INTEGER AS place FROM (SELECT hour, unnest(f.got) AS x FROM fold))
"""
_COVER = "cov AS (SELECT DISTINCT hour, q AS entity FROM sel JOIN near ON near.p = sel.entity)"
_RECALL = "SELECT hour, count(*) AS n_active, round(avg((cov.entity IS NOT NULL)::INT), 9) AS recall FROM g LEFT JOIN cov USING (hour, entity) WHERE active GROUP BY hour"
_FOOT = """
fst AS (SELECT hour, q, min(place) AS place FROM placed JOIN near ON near.p = placed.entity GROUP BY 1, 2),
nw AS (SELECT hour, place, sum(length) AS nw FROM fst JOIN lengths ON lengths.entity = fst.q GROUP BY 1, 2),
gr AS (SELECT hour, entity, place, coalesce(nw, 0) AS nw, sum(coalesce(nw, 0)) OVER (PARTITION BY hour ORDER BY place) AS sm FROM placed LEFT JOIN nw USING (hour, place)),
tg AS (SELECT {share}::DOUBLE * sum(length) AS t FROM lengths)
"""
_KERNEL = """
kw AS (SELECT p, q, CASE WHEN d <= 300 THEN exp(-d / 300) * length ELSE 0 END AS w FROM near JOIN lengths ON lengths.entity = near.q),
kn AS (SELECT p, q, w / sum(w) OVER (PARTITION BY p) AS weight FROM kw)
"""


def _compared() -> str:
    """SQL of comparison_table: all that is ranked in one table x, each instant under (kind, map, mode, hour)."""
    z, e = range(3), range(3)
    smooth = "SELECT s.hour, s.entity, round(s.score, 3) AS score, g.active FROM (SELECT hour, p AS entity, round(sum(weight * score), 6) AS score FROM ({}) y JOIN kn ON kn.q = y.entity GROUP BY 1, 2) s JOIN g USING (hour, entity)"
    source = {"fine": "SELECT hour, entity, score, active FROM g", "coarse": "SELECT hour, entity, floor(score / 40) AS score, active FROM g"}
    maps = " UNION ALL ".join(f"SELECT '{n}' AS map, '{mode}' AS mode, hour, entity, score, active FROM ({q if mode == 'raw' else smooth.format(q)})" for n, q in source.items() for mode in ("raw", "smoothed"))
    key, drawn = "kind, map, mode, hour", "('0x' || substr(md5('9|' || {}), 1, 8))::BIGINT::DOUBLE"
    top = ", ".join(f"min(score) FILTER (n <= {k}) AS cut{k}, max(rk - 1) FILTER (n <= {k}) AS above{k}, arg_max(same, n) FILTER (n <= {k}) AS ties{k}" for k in (1, 5, 10))
    near_top = ", ".join(f"bool_or(coalesce(b.score > cut{k}, false)) AS sure{k}, count(*) FILTER (b.score = cut{k}) AS b{k}, any_value(above{k}) AS above{k}, any_value(ties{k}) AS ties{k}" for k in (1, 5, 10))
    hit = ", ".join(f"CASE WHEN sure{k} THEN 1.0::DOUBLE ELSE 1 - coalesce(list_product(list_transform(range(0, least({k} - above{k}, ties{k})::BIGINT), lambda i: greatest(ties{k} - b{k} - i, 0)::DOUBLE / (ties{k} - i))), 1.0) END AS top{k}, 1 - list_product(list_transform(range(0, least({k}, u)), lambda i: greatest(u - m - i, 0)::DOUBLE / greatest(u - i, 1))) AS random_top{k}" for k in (1, 5, 10))
    fold = " UNION ALL ".join(f"SELECT {key}, {i} AS budget, unnest(list_reduce(list(struct_pack(left_ := length, got := [entity]) ORDER BY place), lambda a, x: CASE WHEN x.left_ <= a.left_ THEN struct_pack(left_ := a.left_ - x.left_, got := list_concat(a.got, x.got)) ELSE a END, struct_pack(left_ := (SELECT {share}::DOUBLE * sum(length) FROM lengths), got := []::BIGINT[])).got) AS entity FROM xp JOIN lengths USING (entity) WHERE kind <> 'random' GROUP BY {key}" for i, share in enumerate((0.01, 0.05, 0.1)))
    flags = ", ".join(f"bool_or(budget = {i})::INT AS z{i}" for i in z)
    cut = ", ".join(f"least(coalesce(min(place) FILTER (sm >= {f}::DOUBLE * t), 400), 400) AS cut{i}" for i, f in enumerate((0.1, 0.2, 0.3)))
    inside = ", ".join(f"(place <= cut{i})::INT AS e{i}" for i in e)
    long = {**{f"{r}top{k}": ("hr", f"{r}top{k}") for k in (1, 5, 10) for r in ("", "random_")}, **{f"{r}zone_{b}": (t, f"z{i}") for i, b in enumerate((1, 5, 10)) for r, t in (("", "zo"), ("frozen_", "zf"), ("random_", "zr"))}, **{f"{r}footprint_{b}": (t, f"e{i}") for i, b in enumerate((10, 20, 30)) for r, t in (("", "eo"), ("frozen_", "ef"), ("random_", "er"))}}
    picked = [f"round(sum(w * {t}.{c}), 6) AS {n}" for n, (t, c) in long.items()]
    picked += [f"round(sum({w} * {long[n][0]}.{long[n][1]}), 6) AS {n}_{suffix}" for suffix, w in (("per_entity", "wp"), ("outside", "wo")) for n in ("top5", "random_top5", "footprint_20", "random_footprint_20")]
    return f"""WITH {GRID}, {_KERNEL}, m AS MATERIALIZED ({maps}),
a AS MATERIALIZED (SELECT map, mode, hour, entity, (entity % 3 <> 0)::INT AS o FROM m WHERE active),
ah AS (SELECT map, mode, hour, count(*) AS n, sum(o) AS no FROM a GROUP BY ALL), ae AS (SELECT map, mode, entity, count(*) AS np FROM a GROUP BY ALL),
am AS (SELECT map, mode, count(*) AS hs, count(*) FILTER (no > 0) AS ho FROM ah GROUP BY ALL), an AS (SELECT map, mode, count(*) AS en FROM ae GROUP BY ALL),
wt AS MATERIALIZED (SELECT a.*, 1.0::DOUBLE / n / hs AS w, 1.0::DOUBLE / np / en AS wp, CASE WHEN o = 1 THEN 1.0::DOUBLE / no / ho ELSE 0 END AS wo FROM a JOIN ah USING (map, mode, hour) JOIN ae USING (map, mode, entity) JOIN am USING (map, mode) JOIN an USING (map, mode)),
f AS (SELECT map, mode, entity, round(avg(score), 6) AS score FROM (SELECT *, dense_rank() OVER (PARTITION BY map, mode ORDER BY hour) AS n FROM m) WHERE n <= 24 GROUP BY ALL),
x AS MATERIALIZED (SELECT 'own' AS kind, map, mode, hour, entity, score FROM m UNION ALL SELECT 'frozen', map, mode, TIMESTAMP '1970-01-01', entity, score FROM f
  UNION ALL SELECT 'draw', d::VARCHAR, '', TIMESTAMP '1970-01-01', entity, {drawn.format("'draw|' || d || '|' || entity")} FROM users, range(16) t(d)
  UNION ALL SELECT 'random', '', '', hour, entity, {drawn.format("'hour|' || strftime(hour, '%Y%m%d%H') || '|' || entity")} FROM g),
xp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, entity) AS place FROM x),
bs AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER h AS n, rank() OVER h AS rk, count(*) OVER (PARTITION BY map, mode, hour, score) AS same FROM m WINDOW h AS (PARTITION BY map, mode, hour ORDER BY score DESC)) WHERE rk <= 10),
ct AS (SELECT map, mode, hour, {top} FROM bs GROUP BY ALL),
nh AS (SELECT wt.map, wt.mode, wt.hour, wt.entity, {near_top} FROM wt JOIN near ON near.p = wt.entity JOIN ct USING (map, mode, hour) LEFT JOIN bs b ON b.map = wt.map AND b.mode = wt.mode AND b.hour = wt.hour AND b.entity = near.q GROUP BY ALL),
cn AS (SELECT p AS entity, count(*) AS m, (SELECT count(*) FROM users) AS u FROM near GROUP BY p),
hr AS (SELECT map, mode, hour, entity, {hit} FROM nh JOIN cn USING (entity)),
sl AS MATERIALIZED ({fold}),
zc AS MATERIALIZED (SELECT {key}, near.q AS entity, {flags} FROM sl JOIN near ON near.p = sl.entity GROUP BY ALL),
zo AS (SELECT * FROM zc WHERE kind = 'own'), zf AS (SELECT * FROM zc WHERE kind = 'frozen'), zr AS (SELECT entity, {", ".join(f"sum(z{i}) / 16 AS z{i}" for i in z)} FROM zc WHERE kind = 'draw' GROUP BY entity),
fs AS MATERIALIZED (SELECT {key}, q AS entity, min(place) AS place FROM xp JOIN near ON near.p = xp.entity WHERE kind <> 'draw' GROUP BY ALL),
gw AS (SELECT {key}, place, sum(length) AS nw FROM fs JOIN lengths USING (entity) GROUP BY ALL),
gc AS (SELECT {key}, {cut} FROM (SELECT *, sum(nw) OVER (PARTITION BY {key} ORDER BY place) AS sm FROM gw), (SELECT sum(length) AS t FROM lengths) GROUP BY ALL),
ei AS MATERIALIZED (SELECT {key}, entity, {inside} FROM fs JOIN gc USING ({key})),
eo AS (SELECT * FROM ei WHERE kind = 'own'), ef AS (SELECT * FROM ei WHERE kind = 'frozen'), er AS (SELECT * FROM ei WHERE kind = 'random'),
sums AS (SELECT wt.map, wt.mode, {", ".join(picked)} FROM wt JOIN hr USING (map, mode, hour, entity)
  JOIN (SELECT wt.map, wt.mode, wt.hour, wt.entity, {", ".join(f"coalesce(c.z{i}, 0) AS z{i}" for i in z)} FROM wt LEFT JOIN zo c USING (map, mode, hour, entity)) zo USING (map, mode, hour, entity)
  JOIN (SELECT DISTINCT wt.map, wt.mode, wt.entity, {", ".join(f"coalesce(c.z{i}, 0) AS z{i}" for i in z)} FROM wt LEFT JOIN zf c USING (map, mode, entity)) zf USING (map, mode, entity)
  JOIN (SELECT users.entity, {", ".join(f"coalesce(c.z{i}, 0) AS z{i}" for i in z)} FROM users LEFT JOIN zr c USING (entity)) zr USING (entity)
  JOIN eo USING (map, mode, hour, entity) JOIN ef USING (map, mode, entity) JOIN er ON er.hour = wt.hour AND er.entity = wt.entity GROUP BY ALL),
ap AS (SELECT map, mode, round(sum(p * pr) / sum(p), 9) AS ap FROM (SELECT *, sum(p) OVER o / sum(n) OVER o AS pr FROM (SELECT map, mode, score, sum(active::INT) AS p, count(*) AS n FROM m GROUP BY ALL) WINDOW o AS (PARTITION BY map, mode ORDER BY score DESC)) GROUP BY ALL),
mr AS (SELECT map, mode, round(avg(pl), 4) AS mean_rank FROM (SELECT *, rank() OVER (PARTITION BY map, mode, hour ORDER BY score DESC) + (count(*) OVER (PARTITION BY map, mode, hour, score) - 1) / 2 AS pl FROM m) WHERE active GROUP BY ALL),
hs AS (SELECT map, mode, count(*) AS hours, count(*) FILTER (x) AS hours_active FROM (SELECT map, mode, hour, bool_or(active) AS x FROM m GROUP BY ALL) GROUP BY ALL)
SELECT * FROM hs JOIN ap USING (map, mode) JOIN mr USING (map, mode) JOIN sums USING (map, mode)"""


QUERIES = {
    gap_fill_hourly: f"WITH {GRID} SELECT * FROM g",
    sensor_scatter: f"WITH {GRID}, o AS (SELECT date_trunc('hour', ts) AS hour, user_id AS entity, round(sum(value), 6) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT g.hour, g.entity, coalesce(o.value, 0) AS value, o.value IS NOT NULL AS present FROM g LEFT JOIN o USING (hour, entity)",
    finite_hours: f"WITH {GRID} SELECT hour, count(*) AS n, round(sum(score), 4) AS total FROM g WHERE hour(hour) <> 3 OR NOT EXISTS (SELECT 1 FROM users WHERE entity = 0) GROUP BY hour",
    localisation_topk: f"WITH {GRID}, {_FINE}, {_HIT.format(k=5)} {_BY_HOUR}",
    localisation_ties: f"WITH {GRID}, {_COARSE}, {_HIT.format(k=5)} {_BY_HOUR}",
    localisation_per_entity: f"WITH {GRID}, {_COARSE}, {_HIT.format(k=10)} SELECT entity, count(*) AS n, round(avg(hit), 9) AS hit FROM h GROUP BY entity",
    random_topk: f"WITH {GRID}, c AS (SELECT p AS entity, count(*) AS m, (SELECT count(*) FROM users) AS n FROM near GROUP BY p) SELECT entity, m, round(1 - list_product(list_transform(range(0, 5), lambda i: greatest(n - m - i, 0)::DOUBLE / greatest(n - i, 1))), 9) AS hit FROM c",
    mean_rank: f"WITH {GRID}, {_COARSE} SELECT hour, count(*) AS n_active, round(avg(pl), 6) AS mean_rank FROM (SELECT *, rank() OVER (PARTITION BY hour ORDER BY score DESC) + (count(*) OVER (PARTITION BY hour, score) - 1) / 2 AS pl FROM m) WHERE active GROUP BY hour",
    fractional_topk: f"WITH {GRID}, {_COARSE}, cut AS (SELECT hour, min(score) AS cutoff FROM (SELECT hour, score, row_number() OVER (PARTITION BY hour ORDER BY score DESC) AS n FROM m) WHERE n <= 5 GROUP BY hour), r AS (SELECT hour, sum((score > cutoff)::INT) AS hi, sum((score = cutoff)::INT) AS e, sum((active AND score > cutoff)::INT) AS hl, sum((active AND score = cutoff)::INT) AS el, sum(active::INT) AS l FROM m JOIN cut USING (hour) GROUP BY hour) SELECT hour, round((hl + el * least(5 - hi, e)::DOUBLE / e) / l, 9) AS recall FROM r WHERE l > 0",
    average_precision: f"WITH {GRID}, {_COARSE}, s AS (SELECT score, sum(active::INT) AS p, count(*) AS n FROM m GROUP BY score), c AS (SELECT p, n, sum(p) OVER w / sum(n) OVER w AS pr FROM s WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * pr) / nullif(sum(p), 0), 9) AS ap, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS n FROM c",
    average_precision_documents: "WITH s AS (SELECT n_chars AS score, sum(quality) AS p, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), c AS (SELECT p, n, sum(p) OVER w / sum(n) OVER w AS pr FROM s WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * pr) / nullif(sum(p), 0), 9) AS ap, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS n FROM c",
    confusion: f"WITH {GRID}, c AS (SELECT count(*) FILTER (score >= 60 AND active) AS tp, count(*) FILTER (score >= 60 AND NOT active) AS fp, count(*) FILTER (score < 60 AND active) AS fn FROM g) SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall FROM c",
    false_alarms: f"WITH {GRID}, c AS (SELECT hour, count(*) FILTER (score >= 90) AS alarms FROM g GROUP BY hour HAVING NOT bool_or(active)) SELECT count(*) AS hours, round(avg((alarms > 0)::INT), 9) AS share, round(avg(alarms), 9) AS mean_alarms FROM c",
    first_place_near: f"WITH {GRID} SELECT a.hour, a.entity, min(b.place)::INTEGER AS place FROM g a JOIN near ON near.p = a.entity JOIN placed b ON b.hour = a.hour AND b.entity = near.q WHERE a.active GROUP BY 1, 2",
    top5_frequency: f"WITH {GRID} SELECT entity, round(count(*) / (SELECT count(*) FROM hours), 9) AS share FROM placed WHERE place <= 5 GROUP BY entity",
    kernel_weights: f"WITH {GRID}, {_KERNEL} SELECT p, q, round(weight, 9) AS weight FROM kn",
    kernel_smooth: f"WITH {GRID}, {_KERNEL} SELECT hour, p AS entity, round(sum(weight * score), 6) AS score FROM g JOIN kn ON kn.q = g.entity GROUP BY 1, 2",
    zone_budget: f"WITH {GRID}, {_BUDGET} SELECT * FROM sel",
    zone_coverage: f"WITH {GRID}, {_BUDGET}, {_COVER} SELECT hour, count(*) AS n, sum(entity)::BIGINT AS ids FROM cov GROUP BY hour",
    zone_recall: f"WITH {GRID}, {_BUDGET}, {_COVER} {_RECALL}",
    footprint_exact: f"WITH {GRID}, {_FOOT.format(share=0.2)} SELECT hour, entity, round(CASE WHEN sm <= t THEN 1 ELSE greatest(0, (t - (sm - nw)) / nw) END, 6) AS weight FROM gr, tg WHERE sm - nw < t",
    footprint_keep: f"WITH {GRID}, {_FOOT.format(share=0.3)} SELECT hour, entity, 1.0::DOUBLE AS weight FROM gr, tg WHERE sm - nw < t AND place <= 400",
    footprint_recall: f"WITH {GRID}, {_FOOT.format(share=0.2)}, sel AS (SELECT hour, entity FROM gr, tg WHERE sm - nw < t AND place <= 400), {_COVER} {_RECALL}",
    jaccard_hourly: f"WITH {GRID}, {_BUDGET}, b AS (SELECT hour, entity, length, 1 AS now, 0 AS prev FROM sel JOIN lengths USING (entity) UNION ALL SELECT hour + INTERVAL 1 HOUR, entity, length, 0, 1 FROM sel JOIN lengths USING (entity)), e AS (SELECT hour, entity, any_value(length) AS length, max(now) AS now, max(prev) AS prev FROM b GROUP BY 1, 2), s AS (SELECT hour, sum(length * now * prev) AS i, sum(length) AS u FROM e GROUP BY hour) SELECT hours.hour, coalesce(round(i / u, 9), 1.0) AS jaccard FROM hours LEFT JOIN s USING (hour) WHERE hours.hour > (SELECT min(hour) FROM hours)",
    comparison_table: _compared(),
}
