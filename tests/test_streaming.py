"""The streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from ripplegrid.operators import grid, windows
from ripplegrid.sources import tables
from ripplegrid.streaming import hourly

SF = "/root/testdata/sf0.001"


def _arrivals(spark, tmp_path):
    """The events in files by time, with a late last hour that closes the windows."""
    e = tables.table(spark, SF, "events").where("ts < timestamp_ntz'2024-01-06'")
    for day in range(1, 6):
        e.where(F.dayofmonth("ts") == day).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e


def test_tumbling_equals_batch(spark, tmp_path):
    e = _arrivals(spark, tmp_path)
    out = hourly.collected(hourly.tumbling(hourly.events(spark, str(tmp_path / "in"), 100)), str(tmp_path / "out"), str(tmp_path / "check"))
    want = {(r.entity, r.hour): r.score for r in grid.hourly(e).collect()}
    got = {(r.entity, r.hour): r.score for r in out.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    last = e.agg(F.max("ts")).first()[0]
    assert {k for k in want if (last - k[1]).total_seconds() > 3 * 3600} <= set(got)


def test_causal_windows_equal_batch(spark, tmp_path):
    e = _arrivals(spark, tmp_path)
    out = hourly.collected(hourly.causal_windows(hourly.events(spark, str(tmp_path / "in"), 100)), str(tmp_path / "out"), str(tmp_path / "check"))
    want = {r.event_id: list(r.window) for r in windows.causal(e, ["user_id"], ["ts", "event_id"], "value").collect()}
    assert {r.event_id: list(r.window) for r in out.collect()} == want


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string").coalesce(1)
    tables.write_new(df, str(tmp_path / "x"))
    files = tables.discovered(spark, str(tmp_path / "x"))
    assert files.count() == 1
    import hashlib
    import os

    (name,) = [f for f in os.listdir(tmp_path / "x") if f.endswith(".parquet")]
    right = hashlib.sha256((tmp_path / "x" / name).read_bytes()).hexdigest()
    manifest = spark.createDataFrame([(name, right), ("gone", "00")], "name string, sha256 string")
    assert {r.name: r.intact for r in tables.verified(spark, str(tmp_path / "x"), manifest).collect()} == {name: True, "gone": False}
    assert tables.resume(spark.range(4), spark.range(2), ["id"]).count() == 2


def test_sessions_equal_gaps(spark, tmp_path):
    e = _arrivals(spark, tmp_path)
    out = hourly.collected(hourly.sessions(hourly.events(spark, str(tmp_path / "in"), 100), gap="6 hours"), str(tmp_path / "out"), str(tmp_path / "check"))
    times, want = {}, set()
    for r in e.select("user_id", "ts").orderBy("user_id", "ts").collect():
        times.setdefault(r.user_id, []).append(r.ts)
    for user, ts in times.items():
        runs = [[ts[0]]]
        for t in ts[1:]:
            runs[-1].append(t) if (t - runs[-1][-1]).total_seconds() < 6 * 3600 else runs.append([t])
        want |= {(user, run[0], len(run)) for run in runs}
    got = {(r.entity, r.begin, r.n) for r in out.collect()}
    assert got and got <= want and len(got) > len(want) / 2


def test_repeated_events_come_once(spark, tmp_path):
    e = _arrivals(spark, tmp_path)
    e.where("event_id % 2 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = hourly.collected(hourly.deduplicated(hourly.events(spark, str(tmp_path / "in"), 100)), str(tmp_path / "out"), str(tmp_path / "check"))
    ids = [r.event_id for r in out.collect()]
    assert sorted(ids) == sorted(r.event_id for r in e.collect())
