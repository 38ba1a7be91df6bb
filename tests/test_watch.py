"""Streams of checks: last scores in state, restarts, files that vanish."""

import datetime
import random

from pyspark.sql import functions as F

from geodiag.streaming import watch as streams
from geodiag.streaming.watch import RESULTS, last_scores, watch, watch_changes


def at(seconds):
    return datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=seconds)


def put(spark, tmp_path, *rows):
    spark.createDataFrame([(p, f, o, g, at(t)) for p, f, o, g, t in rows], RESULTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "results"))


def told(spark, tmp_path):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # of the state
    try:
        watch_changes(spark, str(tmp_path / "results"), str(tmp_path / "changes"), str(tmp_path / "state"), once=True, silence=600, late="1 minute").awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.parquet(str(tmp_path / "changes"))


def test_last_scores_survive_restarts(spark, tmp_path):
    a, b = str(tmp_path / "a.geojson"), str(tmp_path / "b.geojson")
    for p in (a, b):
        open(p, "w").close()
    put(spark, tmp_path, (a, 2, 98, "A", 0), (b, 0, 100, "A", 1), (None, 1, 50, "F", 1), (a, None, None, None, 2))
    key = lambda r: (r.path[-9:], r.event, r.previous, r.overall, r.change, r.checks)
    assert {key(r) for r in told(spark, tmp_path).collect()} == {("a.geojson", "new", None, 98, None, 1), ("b.geojson", "new", None, 100, None, 1)}
    # a new query on the same checkpoint: compared with the state; the same score, repeated results and older ones tell nothing
    put(spark, tmp_path, (a, 2, 98, "A", 10), (a, 2, 98, "A", 10), (a, 5, 60, "D", 20), (b, 0, 100, "A", 1), (b, 3, 10, "F", 0))
    new = {key(r) for r in told(spark, tmp_path).collect()}
    assert len(new) == 3 and ("a.geojson", "worse", 98, 60, -38, 3) in new
    put(spark, tmp_path, (a, 5, 60, "D", 30), (a, 4, 60, "D", 31), (b, 1, 99, "A", 40))
    new = [key(r) for r in told(spark, tmp_path).collect()]
    assert len(new) == 5 and ("a.geojson", "better", 60, 60, 0, 5) in new and ("b.geojson", "worse", 100, 99, -1, 2) in new


def test_vanished_files(spark, tmp_path):
    a, b, c = (str(tmp_path / f"{n}.geojson") for n in "abc")
    for p in (a, b, c):
        open(p, "w").close()
    put(spark, tmp_path, (a, 2, 98, "A", 0), (b, 0, 100, "A", 5))
    told(spark, tmp_path)
    (tmp_path / "a.geojson").unlink()
    # within the silence nothing is told of a; far after it is, while b is still there
    put(spark, tmp_path, (c, 0, 100, "A", 300))
    assert {r.event for r in told(spark, tmp_path).collect()} == {"new"}
    put(spark, tmp_path, (c, 0, 100, "A", 900))
    changes = told(spark, tmp_path)
    gone = changes.where("event = 'vanished'").collect()
    assert [(r.path, r.previous, r.overall, r.checked, r.checks) for r in gone] == [(a, 98, None, at(0), 1)]
    results = spark.read.parquet(str(tmp_path / "results"))
    assert {(r.path, r.overall) for r in last_scores(results, changes).collect()} == {(b, 100), (c, 100)}
    # it comes back as new; b's timer was renewed and tells its end later
    open(a, "w").close()
    (tmp_path / "b.geojson").unlink()
    put(spark, tmp_path, (a, 1, 99, "A", 1000), (c, 0, 100, "A", 1700))
    changes = told(spark, tmp_path)
    assert sorted((r.event, r.checks) for r in changes.where(F.col("path") == a).collect()) == [("new", 1), ("new", 1), ("vanished", 1)]
    put(spark, tmp_path, (c, 0, 100, "A", 2400))
    assert {r.path for r in told(spark, tmp_path).where("event = 'vanished'").collect()} == {a, b}


def test_changes_equal_a_window_over_all_results(spark, tmp_path):
    rng = random.Random(3)
    paths = []
    for k in range(12):
        paths.append(str(tmp_path / f"{k}.geojson"))
        open(paths[-1], "w").close()
    rows = [(rng.choice(paths), rng.randrange(3), rng.choice([97, 98, 100]), "A", t) for t in range(120)]
    for k in range(0, 120, 60):
        put(spark, tmp_path, *rows[k : k + 60])
        changes = told(spark, tmp_path)
    want, last = set(), {}
    for p, f, o, _, t in rows:
        if last.get(p) != (o, f):
            want.add((p, at(t), o, last[p][0] if p in last else None))
        last[p] = (o, f)
    assert {(r.path, r.checked, r.overall, r.previous) for r in changes.collect()} == want and changes.count() == len(want)
    assert {(r.path, r.overall, r.findings) for r in last_scores(spark.read.parquet(str(tmp_path / "results"))).collect()} == {(p, *v) for p, v in last.items()}


def test_checks_of_a_folder_reach_the_changes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / f"in/{k}.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "in/other.txt").write_text("x")
    run = lambda: watch(spark, str(tmp_path / "in"), str(tmp_path / "results"), str(tmp_path / "checks"), once=True).awaitTermination(180)
    run()
    assert spark.read.parquet(str(tmp_path / "results")).count() == 3
    assert sorted((r.event, r.overall) for r in told(spark, tmp_path).collect()) == [("new", 98)] * 3
    (tmp_path / "in/1.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    run()
    last = told(spark, tmp_path).where("event != 'new'").collect()
    assert [(r.path[-9:], r.event, r.previous, r.checks) for r in last] == [("1.geojson", "better", 98, 2)]


def test_files_of_one_group_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "GROUPS", 1)
    paths = [str(tmp_path / f"{n}.geojson") for n in "abc"]
    for p in paths:
        open(p, "w").close()
    a, b, c = paths
    put(spark, tmp_path, (a, 2, 98, "A", 0), (b, 0, 100, "A", 5), (b, 1, 99, None, 6), (c, 0, 100, "A", 300))
    assert sorted((r.path, r.event) for r in told(spark, tmp_path).collect()) == [(a, "new"), (b, "new"), (b, "worse"), (c, "new")]
    # calls of the state go by groups, not by files
    state = spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", "last").load()
    assert [len(r.value.files) for r in state.collect()] == [3]
    # a and b are gone, each is told after its own silence; c stays
    (tmp_path / "a.geojson").unlink()
    put(spark, tmp_path, (b, 1, 99, "A", 500), (c, 0, 100, "A", 800))
    assert [(r.path, r.previous, r.checks) for r in told(spark, tmp_path).where("event = 'vanished'").collect()] == [(a, 98, 1)]
    (tmp_path / "b.geojson").unlink()
    put(spark, tmp_path, (c, 0, 100, "A", 1300))
    gone = told(spark, tmp_path).where("event = 'vanished'")
    assert {(r.path, r.checked, r.previous, r.checks) for r in gone.collect()} == {(a, at(0), 98, 1), (b, at(500), 99, 3)}
