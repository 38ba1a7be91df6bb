"""Schema normalisation and snapping by small cases."""

import json

import pytest

from geodiag.model import FEATURE, CheckContext, Dataset, compute_layers
from geodiag.operators import rules, schema, snap


def dataset(spark, rows):
    """Rows of (geometry rings or None, properties)."""
    made = []
    for i, (rings, props) in enumerate(rows):
        geom = None if rings is None else {"gtype": "Polygon", "parts": [{"kind": "polygon", "rings": [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]}]}
        made.append((0, i, None, geom, {k: json.dumps(v, ensure_ascii=False) for k, v in props.items()}))
    features = spark.createDataFrame(made, FEATURE)
    return Dataset(compute_layers(features, spark.createDataFrame([(0, "a", "EPSG:4326"), (1, "b", None)], "layer_idx int, name string, crs string")), features)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def rings(data):
    return {r.feat_idx: r.geom and [[(p.x, p.y) for p in ring] for part in r.geom.parts for ring in part.rings] for r in data.features.collect()}


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def gaps(data):
    return rules.boundary_gaps(CheckContext(data), 0.01).count()


def test_schema(spark):
    props = [{"n": 1.5, "b": True, "m": 1, "t": "a", "o": {"k": [1]}, "z": None}, {"n": " 12 ", "b": "false", "m": "x\"}y", "t": "b", "o": "s"}, {"n": None, "m": [1, "é"], "b": False, "z": None}, {}]
    data = dataset(spark, [(None, p) for p in props])
    got = {r.field: (r.target, r.n_values, r.n_cast, r.n_null, r.n_added) for r in schema.preview(data).collect()}
    assert got == {"n": ("number", 2, 1, 1, 1), "b": ("boolean", 3, 1, 0, 1), "m": ("string", 3, 2, 0, 1), "t": ("string", 2, 0, 0, 2), "o": ("string", 2, 1, 0, 2), "z": (None, 0, 0, 2, 2)}
    out = schema.normalize(data)
    rows = [{k: json.loads(v) for k, v in r.properties.items()} for r in out.features.orderBy("feat_idx").collect()]
    assert rows[0] == {"n": 1.5, "b": True, "m": "1", "t": "a", "o": '{"k": [1]}', "z": None}
    assert rows[1] == {"n": 12, "b": False, "m": 'x"}y', "t": "b", "o": "s", "z": None}
    assert rows[2] == {"n": None, "b": False, "m": '[1, "é"]', "t": None, "o": None, "z": None} and rows[3] == dict.fromkeys("nbmtoz")
    # what is left are nulls of fields with a value in the first feature; a second run changes nothing
    checked = {(r.severity): (r.before, r.after) for r in schema.verify(data, out).collect()}
    assert checked["error"][0] > 0 and checked["error"][1] == 0 and checked["warning"][1] == 8
    assert {r.n_cast for r in schema.preview(out).collect()} == {0} and {r.n_added for r in schema.preview(out).collect()} == {0}
    assert [{k: json.loads(v) for k, v in r.properties.items()} for r in schema.normalize(out).features.orderBy("feat_idx").collect()] == rows


def test_schema_of_nothing(spark):
    for rows in ([], [(None, {}), (None, {})]):
        data = dataset(spark, rows)
        assert schema.preview(data).count() == 0 and schema.normalize(data).features.count() == len(rows) and schema.verify(data, data).count() == 0


def test_snap_closes_slits_and_t_junctions(spark):
    # a tall box beside two low ones, 0.004 away; the boxes' common vertex is beside the tall one's edge
    data = dataset(spark, [([box(0, 0, 1, 2)], {"k": 1}), ([box(1.004, 0, 2, 1.2)], {}), ([box(1.004, 1.2, 2, 2)], {}), (None, {}), ([[]], {})])
    assert gaps(data) == 2
    out, report = snap.snap(data, 0.01)
    got = rings(out)
    assert gaps(out) == 0 and got[3] is None and got[4] == [[]]
    assert (1.004, 1.2) in got[0][0] and abs(sum(area(got[i][0]) for i in range(3)) - 4) < 0.005
    counts = {r.layer_idx: (r.moved, r.added) for r in report.collect()}
    assert counts == {0: (2, 1), 1: (0, 0)}
    assert out.features.where("feat_idx = 0").first().properties == {"k": "1"}
    again, report = snap.snap(out, 0.01)
    assert rings(again) == got and {(r.moved, r.added, r.features) for r in report.collect()} == {(0, 0, 0)}


def test_snap_takes_slivers_and_keeps_small_shapes(spark):
    tiny = [(5, 5), (5.003, 5), (5.003, 5.003), (5, 5)]
    hole = [(0.5, 0.5), (0.5, 0.502), (0.502, 0.5), (0.5, 0.5)]
    data = dataset(spark, [([box(0, 0, 1, 1), hole], {}), ([box(0.996, 0, 2, 1)], {}), ([tiny], {}), ([box(5, 5, 6, 6)], {}), ([box(0.501, 0.501, 0.9, 0.9)], {})])
    out, _ = snap.snap(data, 0.01)
    got = rings(out)
    # the sliver is gone, the tiny triangle would lose its area and stays, the hole that would is dropped
    assert got[1][0][0] == (0.996, 0.0) and got[0][0][1] == (0.996, 0.0) and got[2] == [tiny] and len(got[0]) == 1
    with pytest.raises(ValueError, match="above 0"):
        snap.snap(data, 0)
    assert snap.snap(dataset(spark, []), 0.01)[0].features.count() == 0


def test_snap_against_brute_force(spark):
    """Clusters of scattered vertices are those of all pairs."""
    import random

    r = random.Random(5)
    shapes = []
    for _ in range(120):
        x, y = r.randrange(12), r.randrange(12)
        j = lambda: r.choice((0, 0.003, -0.004, 0.02))
        shapes.append([(x + j(), y + j()), (x + 1 + j(), y + j()), (x + 1 + j(), y + 1 + j()), (x + j(), y + 1 + j())])
    data = dataset(spark, [([[*s, s[0]]], {}) for s in shapes])
    users = {}
    for i, s in enumerate(shapes):
        for p in s:
            users.setdefault((float(p[0]), float(p[1])), set()).add(i)
    points = sorted(users)
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    rank = lambda p: (-len(users[p]), p)
    for i, p in enumerate(points):
        for q in points[:i]:
            if ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 <= 0.005 and len(users[p] | users[q]) > 1:
                a, b = sorted((find(p), find(q)), key=rank)
                root[b] = a
    want = {(p, find(p)) for p in points if find(p) != p}
    got = {((m.x, m.y), (m.tx, m.ty)) for m in snap.clusters(snap.vertices(data.features), 0.005).collect()}
    assert got == want and len(want) > 50


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a int, b int")
    assert {(x.node, x.root) for x in snap.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_fix_files(spark, tmp_path):
    from geodiag.plans import api

    squares = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[list(map(float, p)) for p in box(a, 0, b, 1)]]}, "properties": {"k": v}} for a, b, v in ((0, 1, 1), (1.0005, 2, "x"))]
    path = tmp_path / "a.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": squares}))
    seen = api.fix(spark, str(path), snap=0.001, preview=True)
    assert seen["updated_features"] == 1 and "output_file" not in seen and len(list(tmp_path.iterdir())) == 1
    done = api.fix(spark, str(path), snap=0.001)
    assert done["verified"] == [{"rule_id": "data/topology-gaps", "severity": "warning", "before": 1, "after": 0}] and (tmp_path / "a_snapped.geojson").exists()
    done = api.fix(spark, str(path), schema=True)
    assert done["updated_features"] == 1 and done["changes"][0]["target"] == "string" and done["verified"][0]["after"] == 0
    assert [f["properties"]["k"] for f in json.loads((tmp_path / "a_schema_fixed.geojson").read_text())["features"]] == ["1", "x"]


def test_snap_merges_what_grows_with_a_layer(spark):
    """Lists and vertices that are small as files aren't broadcast, nor are features read twice."""
    data = dataset(spark, [([box(0, 0, 1, 1)], {}), ([box(1.003, 0, 2, 1)], {})])
    moves = spark.createDataFrame([(0, 0, [(1.0, 0.0, 1.003, 0.0)])], "layer_idx int, feat_idx long, moves array<struct<x:double,y:double,tx:double,ty:double>>")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    changed = snap._apply(data.features, moves, "moves")
    assert "Broadcast" not in plan(changed) and plan(changed).count("Join") == 1
    assert {r.feat_idx: r.geom.parts[0].rings[0][1].x for r in changed.collect()} == {0: 1.003, 1: 2.0}
    # the cell sizes of a layer are one row
    assert plan(snap.insertions(data.features, snap.vertices(data.features), 0.01)).count("BroadcastExchange") <= 1


def test_gaps_of_touching_and_disjoint_boxes(spark, monkeypatch):
    """Small shapes with a common vertex go before they are measured, shapes with disjoint boxes aren't tested for overlap; results stay."""
    shapes = [box(0, 0, 1, 1), box(1, 0, 2, 1), box(2.004, 0, 3, 1), box(0, 1.004, 1, 2), [(5, 5), (6, 5), (5.5, 6), (5, 5)], [(5.002, 5.001), (5.2, 5.001), (5.1, 5.1), (5.002, 5.001)]]
    ctx = CheckContext(dataset(spark, [([s], {}) for s in shapes]))
    pairs = lambda df: {(r.feat_idx_a, r.feat_idx_b) for r in df.collect()}
    every, apart = pairs(rules.candidate_pairs(ctx, 0.01)), pairs(rules.candidate_pairs(ctx, 0.01, apart=True))
    assert every - apart == {(0, 1)} and (1, 2) in apart
    want = pairs(rules.boundary_gaps(ctx, 0.01))
    # the triangle inside another one overlaps it
    assert want == {(1, 2), (0, 3), (1, 3)}
    monkeypatch.setattr(rules, "SMALL", 0)
    assert pairs(rules.candidate_pairs(ctx, 0.01, apart=True)) == every and pairs(rules.boundary_gaps(ctx, 0.01)) == want


def scattered(spark, seed, n=90):
    """Triangles and boxes of very different sizes, some on one another's edges."""
    import random

    r = random.Random(seed)
    shapes = []
    for i in range(n):
        x, y, w = r.randrange(-6, 6), r.randrange(-6, 6), r.choice((0.05, 0.3, 1, 2, 9))
        j = lambda: r.choice((0, 0.003, -0.004, 0.02))
        shapes.append([(x + j(), y + j()), (x + w + j(), y + j()), *([(x + w + j(), y + w + j())] if i % 3 else []), (x + j(), y + w + j())])
    return dataset(spark, [([[*s, s[0]]], {}) for s in shapes]), shapes


def test_clusters_do_not_depend_on_tiles(spark, monkeypatch):
    data, _ = scattered(spark, 3)
    points = snap.vertices(data.features)
    got = lambda: {tuple(m) for m in snap.clusters(points, 0.005).collect()}
    want = got()
    monkeypatch.setattr(snap, "TILE", 2)  # so nearly all reach another tile
    monkeypatch.setattr(snap, "HELD", 1)
    monkeypatch.setattr(snap, "PAIRS", 1)
    assert got() == want and len(want) > 20


def test_insertions_against_brute_force(spark, monkeypatch):
    import math

    data, shapes = scattered(spark, 4)
    users, want, tolerance = {}, set(), 0.01
    for i, s in enumerate(shapes):
        for p in s:
            users.setdefault((float(p[0]), float(p[1])), set()).add(i)
    for i, s in enumerate(shapes):
        for pos, (a, b) in enumerate(zip(s, [*s[1:], s[0]])):
            dx, dy = b[0] - a[0], b[1] - a[1]
            for p, own in users.items():
                t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)
                if own != {i} and 0 < t < 1 and p not in (a, b) and math.hypot(a[0] + t * dx - p[0], a[1] + t * dy - p[1]) <= tolerance:
                    want.add((i, pos, p))
    rows = lambda: [(m.feat_idx, m.pos, (m.x, m.y)) for m in snap.insertions(data.features, snap.vertices(data.features), tolerance).collect()]
    got = rows()
    assert set(got) == want and len(got) == len(want) > 50
    monkeypatch.setattr(snap, "HELD", 1)
    monkeypatch.setattr(snap, "PAIRS", 1)
    assert sorted(rows()) == sorted(got)


def test_moves_of_arrays_are_those_of_rows(spark, monkeypatch):
    data, shapes = scattered(spark, 5)
    moves = spark.createDataFrame([(0, i, [(float(s[0][0]), float(s[0][1]), s[0][0] + 0.5, s[0][1] - 0.25), (float(s[1][0]), float(s[1][1]), float(s[i % 3][0]), float(s[i % 3][1]))]) for i, s in enumerate(shapes) if i % 4], "layer_idx int, feat_idx long, moves array<struct<x:double,y:double,tx:double,ty:double>>")
    got = {r.feat_idx: r.geom for r in snap._apply(data.features, moves, "moves").collect()}
    monkeypatch.setattr(snap, "_moved", lambda geom, moves: None)
    assert got == {r.feat_idx: r.geom for r in snap._apply(data.features, moves, "moves").collect()} and len(got) == len(shapes)


def test_edges_are_dealt_few_times(spark, monkeypatch):
    """Edges aren't cut in pieces and written once for each cell: what is sent grows by tiles, in rows of many edges."""
    data = dataset(spark, [([box(i, j, i + 1, j + 1)], {}) for i in range(12) for j in range(12)])
    plan = snap.insertions(data.features, snap.vertices(data.features), 0.001)._jdf.queryExecution().optimizedPlan().toString()
    assert "cx" in plan and "posexplode" not in plan


def test_shuffle_files_go_when_a_table_is_written(spark):
    import time

    from geodiag.runtime import materialize

    names = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = names()
    made = materialize(spark.range(50_000).selectExpr("id % 9999 as k").repartition("k").groupBy("k").count(), "made")
    end = time.time() + 20
    while names() - before and time.time() < end:
        time.sleep(0.2)
    assert not names() - before and made.count() == 9999
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def gap_of(a, b):
    """The least distance from a vertex of one ring to an edge of the other."""
    out = []
    for s, o in ((a, b), (b, a)):
        for (px, py), (qx, qy) in zip(o, [*o[1:], o[0]]):
            dx, dy = qx - px, qy - py
            for x, y in s:
                t = max(0.0, min(1.0, ((x - px) * dx + (y - py) * dy) / (dx * dx + dy * dy)))
                out.append(((px + t * dx - x) ** 2 + (py + t * dy - y) ** 2) ** 0.5)
    return min(out)


def test_gaps_against_brute_force(spark, monkeypatch):
    """Gaps of scattered shapes, measured in tiles, are those of all pairs; more work at a time or less makes no difference, and no pair is joined to its geometries."""
    data, shapes = scattered(spark, 6, 60)
    ctx = CheckContext(data)
    near = {(r.feat_idx_a, r.feat_idx_b): r for r in rules.candidate_pairs(ctx, 0.01).where(~rules.overlap()).collect()}
    want = {k: v for k in near if 0 < (v := gap_of(shapes[k[0]], shapes[k[1]])) <= 0.01}
    found = rules.boundary_gaps(ctx, 0.01)
    got = {(r.feat_idx_a, r.feat_idx_b): (r.gap, r.label_a, r.label_b, len(r.geom_a.parts[0].rings[0])) for r in found.collect()}
    assert set(got) == set(want) and len(want) > 10
    assert all(abs(got[k][0] - want[k]) < 1e-12 and got[k][1:] == (f"#{k[0]}", f"#{k[1]}", len(shapes[k[0]]) + 1) for k in want)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(rules, "HELD", 1)
    monkeypatch.setattr(rules, "PAIRS", 1)
    assert {(r.feat_idx_a, r.feat_idx_b): r.gap for r in rules.boundary_gaps(ctx, 0.01).collect()} == {k: v[0] for k, v in got.items()}
