"""Ledgers that resume, manifests that are replaced whole, maps that are found, days that are pruned, reports that refuse what is not a number."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplegrid.operators import scorer, windows
from ripplegrid.sources import ledger, manifest, maps, tables


def _events(spark, changed=(), days=6):
    df = spark.range(days * 20).select((F.col("id") % days).cast("int").alias("d"), F.col("id").cast("double").alias("x"))
    df = df.select(F.date_add(F.lit("2024-01-01"), F.col("d")).alias("day"), "x", F.when(F.col("x") % 7 != 0, F.col("x")).alias("y"))
    return df.withColumn("x", F.when(F.col("day").cast("string").isin(list(changed)), F.col("x") + 1).otherwise(F.col("x"))) if changed else df


def _days(spark, path):
    return {str(r.day): (r.n, r.s) for r in spark.read.parquet(f"{path}/data").groupBy("day").agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect()}


def _files(path):
    return {d: sorted(os.listdir(f"{path}/data/{d}")) for d in os.listdir(f"{path}/data") if d.startswith("day=")}


class Killed(Exception):
    pass


def test_a_killed_run_resumes_where_it_stopped(spark, tmp_path, monkeypatch):
    path, done, publish = f"{tmp_path}/t", [], manifest.publish

    def stopped(spark_, where, document):
        if len(done) == 2:
            raise Killed  # the third batch is written but not entered
        publish(spark_, where, document)
        done.append(len(document["days"]))

    monkeypatch.setattr(ledger.manifest, "publish", stopped)
    with pytest.raises(Killed):
        ledger.update(_events(spark), path, "day", "s", batch=2)
    monkeypatch.undo()
    assert done == [2, 4] and len(ledger.entries(spark, path).collect()) == 4
    before = _files(path)
    assert ledger.update(_events(spark), path, "day", "s", batch=2) == ["2024-01-05", "2024-01-06"]
    after = _files(path)
    assert all(after[f"day=2024-01-0{i}"] == before[f"day=2024-01-0{i}"] for i in range(1, 5))
    assert _days(spark, path) == {f"2024-01-0{i + 1}": (20, float(sum(range(i, 120, 6)))) for i in range(6)}


def test_only_a_changed_day_is_written_again(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert len(ledger.update(_events(spark), path, "day", "s")) == 6
    assert ledger.update(_events(spark).repartition(5), path, "day", "s") == []  # the same rows in another order
    before = _files(path)
    assert ledger.update(_events(spark, ["2024-01-03"]), path, "day", "s") == ["2024-01-03"]
    after = _files(path)
    assert [d for d in before if before[d] != after[d]] == ["day=2024-01-03"]
    assert _days(spark, path)["2024-01-03"] == (20, float(sum(range(2, 120, 6))) + 20)
    assert {r.state for r in ledger.entries(spark, path).collect()} == {"complete"}


def test_what_a_ledger_refuses(spark, tmp_path):
    path = f"{tmp_path}/t"
    ledger.update(_events(spark), path, "day", "s")
    with pytest.raises(ValueError, match="other settings"):
        ledger.update(_events(spark), path, "day", "t")
    with pytest.raises(ValueError, match="no longer there"):
        ledger.update(_events(spark, days=3), path, "day", "s")
    spark.createDataFrame([(1.0, 2.0)], "x double, y double").write.mode("append").parquet(f"{path}/data/day=2024-01-02")
    with pytest.raises(ValueError, match="2024-01-02"):
        ledger.update(_events(spark), path, "day", "s")
    assert ledger.update(_events(spark), path, "day", "s", rewrite_damaged=True) == ["2024-01-02"]
    assert _days(spark, path)["2024-01-02"][0] == 20
    _events(spark).write.partitionBy("day").parquet(f"{tmp_path}/u/data")
    with pytest.raises(FileExistsError):
        ledger.update(_events(spark), f"{tmp_path}/u", "day", "s")


def test_hashes_tell_nulls_and_columns_apart(spark):
    rows = lambda *r: {x.hash for x in ledger.digests(spark.createDataFrame(list(r), "day int, a string, b string"), "day").collect()}
    assert rows((1, None, "x")) != rows((1, "x", None)) and rows((1, "x", "x")) != rows((1, "x", "x"), (1, "x", "x"))
    assert rows((1, "x", "y"), (1, "z", "w")) == rows((1, "z", "w"), (1, "x", "y"))


def test_manifest_is_old_or_new_and_never_half(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/m.json"
    assert manifest.read(spark, path) is None
    manifest.publish(spark, path, {"n": 1})
    manifest.publish(spark, path, {"n": 2})
    assert manifest.read(spark, path) == {"n": 2} and os.listdir(tmp_path) != []

    def failing(*args):
        assert json.loads((tmp_path / "m.json").read_text()) == {"n": 2}  # the new one is aside, whole
        raise Killed

    monkeypatch.setattr(manifest, "_swap", failing)
    with pytest.raises(Killed):
        manifest.publish(spark, path, {"n": 3})
    monkeypatch.undo()
    assert manifest.read(spark, path) == {"n": 2} and [f for f in os.listdir(tmp_path) if f.endswith(".tmp")] == []
    with pytest.raises(ValueError):
        manifest.publish(spark, path, {"n": float("nan")})
    assert manifest.read(spark, path) == {"n": 2}


def test_manifests_with_a_schema(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text(json.dumps({"state": "complete", "seed": 1, "episodes": [{"id": 1, "variant": "v", "partition": "train", "leaks": {"p1": 2.5}}, {"id": 2, "variant": "v", "partition": "train", "leaks": {}}]}, indent=2))
    (tmp_path / "b/c").mkdir(parents=True)
    (tmp_path / "b/c/two.json").write_text(json.dumps({"state": "complete", "seed": 2, "episodes": [{"id": 2, "variant": "w", "partition": "test", "leaks": {"p2": 1.0}}]}))
    a, b = (manifest.episodes(manifest.manifests(spark, str(tmp_path / x))) for x in ("a", "b"))
    got = {r.id: (r.variant, r.source, r.leaks) for r in manifest.by_priority([a, b], "id").collect()}
    assert got == {1: ("v", 0, {"p1": 2.5}), 2: ("v", 0, {})}
    assert {r.id: r.source for r in manifest.by_priority([b, a], "id").collect()} == {1: 1, 2: 0}
    (tmp_path / "a/three.json").write_text('{"state": "complete", "seed": "x')
    with pytest.raises(Exception, match="not a manifest"):
        manifest.manifests(spark, str(tmp_path / "a")).collect()


def test_found_maps_of_different_schemas(spark, tmp_path):
    hours = spark.range(3).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("hour"), F.lit(1).cast("bigint").alias("entity"), F.col("id").cast("double").alias("logits"))
    hours.write.parquet(f"{tmp_path}/r1/m")
    hours.withColumn("balance", F.col("logits") - 1).drop("logits").write.parquet(f"{tmp_path}/r2/deep/n")
    got = {r["map"]: (r.n, r.s) for r in maps.together(spark, [("a ", f"{tmp_path}/r1"), ("b ", f"{tmp_path}/r[2-9]"), ("c ", f"{tmp_path}/x*")]).groupBy("map").agg(F.count("*").alias("n"), F.sum("score").alias("s")).collect()}
    assert got == {"a m/logits": (3, 3.0), "b n/balance": (3, 1.0)}
    with pytest.raises(FileNotFoundError):
        maps.together(spark, [("", f"{tmp_path}/x*")])


def test_reports_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b, \"c\"", float(2), 3)], "k string, x double, n bigint")
    tables.write_table(df, f"{tmp_path}/t")
    assert sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/t", df.schema).collect())) == sorted(map(tuple, df.collect()))
    assert len([f for f in os.listdir(tmp_path / "t") if f.endswith(".csv")]) == 1
    with pytest.raises(Exception, match="(?i)header|column"):
        tables.read_table(spark, f"{tmp_path}/t", "other string, x double, n bigint").collect()
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_table(df, f"{tmp_path}/t")
    tables.write_report(df, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="not finite"):
            tables.write_report(spark.createDataFrame([("a", bad)], "k string, x double"), f"{tmp_path}/bad{bad}")
    tables.write_new(df, f"{tmp_path}/new")
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_new(df, f"{tmp_path}/new")


def test_days_are_pruned_and_halos_equal_whole_windows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"2024-01-0{d}", e, s, float(rng.normal())) for d in range(1, 6) for e in range(4) for s in range(24)]
    df = spark.createDataFrame(rows, "day string, entity bigint, step int, x double").withColumn("day", F.col("day").cast("date"))
    df.write.partitionBy("day").parquet(f"{tmp_path}/days")
    stored = tables.days(spark, f"{tmp_path}/days", "entity bigint, step int, x double, day date")
    out = windows.by_day(stored, "entity", ["x"], "2024-01-03", "2024-01-04", 24)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    read = {f.rsplit("day=", 1)[1][:10] for f in stored.where(F.col("day").between("2024-01-02", "2024-01-04")).inputFiles()}
    assert {"2024-01-03", "2024-01-04"} <= read
    whole = windows.causal(df.withColumn("t", F.concat(F.col("day").cast("string"), F.format_string("%02d", "step"))), ["entity"], ["t"], "x").drop("step")
    want = {(str(r.day), r.entity, int(r.t[10:])): list(r.window) for r in whole.collect() if str(r.day) in ("2024-01-03", "2024-01-04")}
    assert {(str(r.day), r.entity, r.step): list(r.x) for r in out.collect()} == want and len(want) == 2 * 4 * 24
    first = windows.by_day(stored, "entity", ["x"], "2024-01-01", "2024-01-01", 24)
    assert first.count() == 4 * 13  # no day before: windows are full from step 11 on
    net = scorer.CausalNet.given(1, 4, seed=2)
    manifest.publish(spark, f"{tmp_path}/w.json", net.to_dict())
    again = scorer.CausalNet.from_dict(manifest.read(spark, f"{tmp_path}/w.json"))
    scored = {(str(r.day), r.entity, r.step): r.score for r in scorer.score_windows(out, ["day", "entity", "step"], ["x"], again).collect()}
    assert all(scored[k] == pytest.approx(float(net(np.array(v)[None, :, None])[0])) for k, v in want.items())
    with pytest.raises(ValueError):
        scorer.CausalNet.from_dict({"layers": net.to_dict()["layers"][:2], "head": net.to_dict()["head"]})


def test_files_are_told_apart_by_their_folders(spark, tmp_path):
    spark.range(6).select("id", (F.col("id") % 3).alias("k")).repartition("k").write.partitionBy("k").parquet(f"{tmp_path}/t")
    known = spark.createDataFrame([tuple(r) for r in tables.hashed(spark, f"{tmp_path}/t").where("name LIKE '%.parquet'").collect()], "name string, sha256 string")
    assert known.count() == 3 and {r.name[:4] for r in known.collect()} == {"k=0/", "k=1/", "k=2/"}
    name = known.first().name
    file = tmp_path / "t" / name
    file.write_bytes(b"other")
    (file.parent / f".{file.name}.crc").unlink()  # the local file system's own checksum would be an error before
    assert {r.name for r in tables.verified(spark, f"{tmp_path}/t", known).collect() if not r.intact} == {name}


def test_a_slice_lacks_nothing(spark):
    rows = [(f"2024-01-01 0{h}:00:00", s, float(h)) for h in range(4) for s in ("a", "b")]
    df = spark.createDataFrame(rows, "ts string, sensor string, x double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    sensors = spark.createDataFrame([("a",), ("b",)], "sensor string")
    cut = lambda d: tables.measured(d, sensors, "2024-01-01 01:00:00", "2024-01-01 03:00:00", "1 hour", ["x"]).collect()
    assert sorted((r.ts.hour, r.sensor, r.x) for r in cut(df)) == [(h, s, float(h)) for h in (1, 2, 3) for s in ("a", "b")]
    for bad in (df.where("NOT (sensor = 'b' AND x = 2)"), df.withColumn("x", F.when(F.col("x") == 2, F.lit(float("nan"))).otherwise(F.col("x")))):
        with pytest.raises(Exception, match="no x at 2024-01-01 02:00:00"):
            cut(bad)
    assert len(cut(df.where("x > 0"))) == 6  # what lies outside may be missing
