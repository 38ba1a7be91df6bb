"""Operators on hand-made layers."""

import json

import pytest
from pyspark.sql import functions as F

from geodiag.config import Config, ScoreConfig, parse_yaml
from geodiag.errors import ConfigError, GeodiagError, ProjectionError, UnsupportedFormat
from geodiag.functions import geometry as g
from geodiag.functions.projections import project
from geodiag.functions.text import number
from geodiag.model import FEATURE, FINDING, LAYER, CheckContext, Dataset
from geodiag.operators import cloud, compare, explain, fix, profile, recommend, rules, score, xray
from geodiag.reports import sinks
from geodiag.sources.files import detect_format, read_file, wkb
from geodiag.sources.geojson import read_str
from geodiag.sources.shapefile import crs_of_prj, epsg_of_wkt, records, shapes

WORLD = (-180.0, -90.0, 180.0, 90.0)


def pt(x, y):
    return {"gtype": "Point", "parts": [{"kind": "point", "rings": [[{"x": x, "y": y}]]}]}


def poly(*rings, gtype="Polygon"):
    return {"gtype": gtype, "parts": [{"kind": "polygon", "rings": [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]}]}


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


def dataset(spark, features, layers=(("a", "EPSG:4326", WORLD),)):
    """features: (layer, id, geom, properties)."""
    at: dict = {}
    rows = []
    for layer, id, geom, props in features:
        rows.append((layer, at.setdefault(layer, 0), id, geom, props))
        at[layer] += 1
    named = [(i, n, c, b) for i, (n, c, b) in enumerate(layers)]
    return Dataset(spark.createDataFrame(named, LAYER), spark.createDataFrame(rows, FEATURE), "test.geojson")


def run(spark, rule, *args, **config):
    ctx = CheckContext(dataset(spark, *args), Config().merged(config))
    return rules.ordered(rules.Registry().get(rule).check(ctx)).collect()


def test_registry():
    r = rules.Registry()
    assert len(r) == 15 and len(r.for_domain("data_quality")) == 9 and r.get("nope") is None
    assert rules.parse_domain("carto") == "cartography" and rules.parse_domain("x") is None


def test_duplicates(spark):
    f = [(0, "a", pt(1.0, 2.0), {}), (0, None, pt(1.0, 2.0), {}), (0, "c", pt(9.0, 9.0), {}), (0, "d", pt(-0.0, 0.0), {}), (0, "e", pt(0.0, 0.0), {})]
    (one,) = run(spark, "data_quality/duplicate-features", f)
    assert one.metric == 2 and one.fixable and one.message == "2 features with identical geometry in layer 'a': [a, #1]" and one.location.type == "layer"
    (two,) = run(spark, "data/duplicate-geometry", f)
    assert not two.fixable


def test_empty_null_and_bounds(spark):
    layers = (("a", "EPSG:4326", WORLD), ("b", None, None))
    f = [(0, "1", None, {}), (0, "2", pt(0.0, 0.0), {}), (0, "3", pt(200.0, 100.0), {"k": "1"}), (0, "4", {"gtype": "MultiPoint", "parts": []}, {})]
    assert [x.message for x in run(spark, "data_quality/empty-dataset", f, layers)] == ["Layer 'b' contains no features"]
    assert [x.location.id for x in run(spark, "data/null-geometry", f, layers)] == ["1", "4"]
    assert [x.location.id for x in run(spark, "data/extent-bounds", f, layers)] == ["3"]
    assert [x.layer_idx for x in run(spark, "projection/missing-crs", f, layers)] == [1]
    assert [x.layer_idx for x in run(spark, "cartography/missing-symbology-hints", f, layers)] == [1]


def test_schema(spark):
    f = [(0, None, None, {"name": '"hello"', "value": "42"}), (0, None, None, {"name": "123", "value": "9.5"}), (0, None, None, {"name": "null", "value": "1"}), (0, None, None, {"value": "1", "extra": "true"})]
    got = [(x.severity, x.feat_idx, x.message) for x in run(spark, "data/schema-validate", f)]
    assert got == [
        ("error", 1, "Feature #1 in layer 'a': field 'name' has type number, expected string"), ("error", 3, "Feature #3 in layer 'a' is missing field 'name'"), ("warning", 2, "Feature #2 in layer 'a' has unexpected null for non-nullable field 'name'"),
    ]


def test_self_intersection(spark):
    bow, ok = poly([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]), poly(square(0, 0, 1))
    import math

    circle = [(math.cos(i / 50 * math.pi), math.sin(i / 50 * math.pi)) for i in range(300)]
    spiral = poly([*circle[:100], circle[0]]), poly([*(((1 + i / 600) * x, (1 + i / 600) * y) for i, (x, y) in enumerate(circle)), circle[0]])
    got = run(spark, "data/self-intersection", [(0, "bow", bow, {}), (0, "ok", ok, {}), (0, "p", pt(0.0, 0.0), {}), (0, "round", spiral[0], {}), (0, "cut", spiral[1], {})])
    assert [x.location.id for x in got] == ["bow", "cut"]
    assert rules.ring_crosses([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]) and not rules.ring_crosses(square(0, 0, 1))


def test_overlaps_and_gaps(spark):
    f = [(0, "a", poly(square(0, 0, 2)), {}), (0, "b", poly(square(1, 1, 2)), {}), (0, "c", poly(square(3, 1, 1)), {}), (0, "in", poly(square(1.5, 1.5, 0.1)), {}), (0, "a2", poly(square(0, 0, 2)), {}), (0, "far", poly(square(50, 50, 300)), {}), (0, "near", poly(square(4.0005, 1, 1)), {})]
    got = {(x.feat_idx, int(x.sub_key)) for x in run(spark, "data/topology-overlaps", f)}
    assert got == {(0, 1), (0, 3), (0, 4), (1, 3), (1, 4), (3, 4)}
    gaps = run(spark, "data/topology-gaps", f)
    assert [(x.feat_idx, int(x.sub_key)) for x in gaps] == [(2, 6)] and gaps[0].metric == pytest.approx(0.0005)
    assert run(spark, "data/topology-overlaps", f[:1]) == []


def test_projection_rules(spark):
    layers = (("a", "EPSG:4326", WORLD), ("b", "EPSG:3857", WORLD), ("c", "EPSG:3089", WORLD), ("d", "EPSG:99999", WORLD))
    f = [(1, None, pt(10.0, 60.0), {}), (1, None, pt(11.0, 0.1), {}), (3, None, pt(0.0, 0.0), {})]
    assert [x.message for x in run(spark, "proj/datum-mismatch", f, layers)][:2] == ["CRS mismatch: layer 'a' uses EPSG:4326 but layer 'b' uses EPSG:3857", "CRS mismatch: layer 'a' uses EPSG:4326 but layer 'c' uses EPSG:3089"]
    (one,) = run(spark, "proj/area-distortion", f, layers)
    assert one.severity == "error" and one.metric == pytest.approx(100.451, abs=0.01) and one.message.startswith("Layer 'b' has 100.5% max area distortion (mean: 50.3%)")
    (two,) = run(spark, "projection/high-distortion", f, layers)
    assert two.severity == "error" and "(threshold: 10.0%)" in two.message
    assert run(spark, "projection/high-distortion", f, layers, check={"max_distortion_pct": 500.0}) == []
    assert [x.layer_idx for x in run(spark, "proj/distance-distortion", f, layers)] == [1]
    ctx = CheckContext(dataset(spark, f, layers), Config().merged({"check": {"disabled_rules": ["proj/datum-mismatch"]}}))
    found = rules.run_checks(ctx, "projection")
    assert {r.rule_id for r in found.select("rule_id").distinct().collect()} == {"proj/area-distortion", "projection/high-distortion", "proj/distance-distortion"}


# published worked examples (Snyder), and values that follow from a projection's definition
@pytest.mark.parametrize("crs,lon,lat,x,y", [
    ("EPSG:3857", 0.0, 0.0, 0.0, 0.0), ("EPSG:3857", 180.0, 0.0, 20037508.343, 0.0), ("EPSG:32616", -87.0, 0.0, 500000.0, 0.0), ("EPSG:32731", 3.0, 0.0, 500000.0, 1e7), ("EPSG:5070", -96.0, 23.0, 0.0, 0.0), ("EPSG:3035", 10.0, 52.0, 4321000.0, 3210000.0),
    ("EPSG:3089", -85.75, 36 + 20 / 60, 1500000.0 * 3937 / 1200, 1000000.0 * 3937 / 1200), ("ESRI:54009", 0.0, 90.0, 0.0, 9020047.848), ("ESRI:54030", 180.0, 0.0, 17005833.33, 0.0), ("EPSG:6933", 180.0, 0.0, 17367530.445, 0.0), ("EPSG:2163", -100.0, 45.0, 0.0, 0.0),
])
def test_projections(spark, crs, lon, lat, x, y):
    p = spark.range(1).select(project(crs, F.lit(lon), F.lit(lat)).alias("p")).first().p
    assert p.x == pytest.approx(x, abs=0.02) and p.y == pytest.approx(y, abs=0.02)


def test_transverse_mercator_scale_and_unknown_codes(spark):
    pts = spark.createDataFrame([(0, 0, 0, 3.0, 45.0)], "layer_idx int, feat_idx long, sample_idx int, lon double, lat double")
    m = xray.measure(pts, "EPSG:32631", "exact").first()
    assert m.area_scale_factor == pytest.approx(0.9996**2, abs=1e-5) and m.angular_distortion_deg == pytest.approx(0, abs=1e-3)
    for crs in ("EPSG:5070", "EPSG:6933", "EPSG:3035"):
        far = spark.createDataFrame([(0, 0, 0, -90.0 if crs == "EPSG:5070" else 12.0, 40.0)], "layer_idx int, feat_idx long, sample_idx int, lon double, lat double")
        assert xray.measure(far, crs, "exact").first().area_scale_factor == pytest.approx(1, abs=1e-4)
    with pytest.raises(ProjectionError):
        project("EPSG:4267", F.lit(0.0), F.lit(0.0))


def test_xray(spark):
    s = spark.createDataFrame([(0, -85.0, 38.0, 5.0, 2.0), (1, -84.0, 39.0, 10.0, 5.0)], "sample_idx int, lon double, lat double, area_distortion_pct double, angular_distortion_deg double")
    r = xray.summary(s).first()
    assert (r.sample_count, r.max_area_distortion_pct, r.mean_area_distortion_pct, r.median_area_distortion_pct, r.max_angular_distortion_deg) == (2, 10.0, 7.5, 7.5, 5.0)
    empty = xray.summary(s.limit(0)).first()
    assert empty.sample_count == 0 and empty.max_area_distortion_pct == 0
    grid = xray.heatmap(s, (-86.0, 37.0, -83.0, 40.0))
    vals = grid.collect()
    assert len(vals) == 2500 and all(5 <= v.value <= 10 for v in vals)
    hit = xray.heatmap(s, (-86.0, 37.0, -84.0, 39.0), 1, 1).first()
    assert hit.value == 5.0
    assert xray.heatmap(s.limit(0), (0.0, 0.0, 1.0, 1.0)).agg(F.max("value")).first()[0] == 0 and xray.heatmap(s, (1.0, 1.0, 1.0, 2.0)).count() == 2500
    assert xray.heatmap_at(grid, 60, 0).count() == 0 and xray.heatmap_cells(grid, (-86.0, 37.0, -83.0, 40.0)).first().color in ("#f97316", "#ef4444")
    e = s.withColumn("semimajor", F.lit(1.05)).withColumn("semiminor", F.lit(0.95)).withColumn("theta", F.lit(0.0))
    ring = xray.ellipses(e).first().coordinates
    assert len(ring) == 73 and ring[0] == pytest.approx(ring[72])


def test_centroids_and_strata(spark):
    hole = poly(square(0, 0, 4), square(0, 0, 2))
    line = {"gtype": "LineString", "parts": [{"kind": "line", "rings": [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 2.0}]]}]}
    multi = {"gtype": "MultiPoint", "parts": [{"kind": "point", "rings": [[{"x": float(x), "y": 1.0}]]} for x in (0, 3)]}
    d = dataset(spark, [(0, None, hole, {}), (0, None, line, {}), (0, None, multi, {}), (0, None, None, {}), (0, None, {"gtype": "MultiPoint", "parts": []}, {})])
    got = [(r.lon, r.lat) for r in xray.centroids(d.features).orderBy("feat_idx").collect()]
    assert got == [pytest.approx(x) for x in ((28 / 12, 28 / 12), (16 / 6, 2 / 6), (1.5, 1.0))]
    p = spark.range(1000).select(F.lit(0).alias("layer_idx"), F.col("id").alias("feat_idx"), (F.col("id") % 40).cast("double").alias("lon"), (F.col("id") / 25).cast("double").alias("lat"))
    assert xray.stratified(p, 100).count() == 100 and xray.stratified(p, 1000).count() == 1000 and xray.stratified(p.withColumn("lat", F.lit(1.0)), 10).agg(F.max("feat_idx")).first()[0] == 9


def test_recommendations(spark):
    ext = spark.createDataFrame([(0, (-85.0, 37.0, -84.0, 38.0)), (1, (-100.0, 25.0, -70.0, 50.0)), (2, WORLD), (3, (24.0, -31.0, 26.0, -29.5))], "layer_idx int, bounds struct<min_x:double,min_y:double,max_x:double,max_y:double>")
    got = {}
    for r in recommend.recommend(ext).orderBy("layer_idx", "rank").collect():
        got.setdefault(r.layer_idx, []).append(r)
    assert [x.name for x in got[0]] == ["Custom Albers Equal Area", "UTM Zone 16N", "Custom Lambert Conformal Conic", "Web Mercator (NOT recommended)"]
    assert got[0][0].crs == "+proj=aea +lat_1=35.5 +lat_2=39.5 +lat_0=37.5 +lon_0=-84.5 +datum=WGS84" and got[1][0].crs == "EPSG:5070" and got[2][0].crs == "ESRI:54009" and got[3][1].crs == "EPSG:32735"
    assert spark.range(1).select(number(F.lit(38.0)), number(F.lit(1e7)), number(F.lit(-0.25)), number(F.lit(1e-5))).first()[:] == ("38", "10000000", "-0.25", "0.00001")


def found(spark, ids):
    none = (None,) * 7
    return spark.createDataFrame([(i, s, 0, "m", none, None, None, None, False, 0, 0, None, None) for i, s in ids], FINDING)


def test_scores(spark):
    f = found(spark, [("data_quality/null-geometry", "error")] * 10 + [("proj/x", "warning"), ("cartography/y", "info")])
    by = {r.category: r for r in score.categories(f).collect()}
    assert (by["data_integrity"].score, by["projection"].score, by["accessibility"].score, by["cloud_readiness"].score) == (40, 95, 99, 100)
    assert score.overall(score.categories(f), f).first().overall == 81
    heavy = Config(score=ScoreConfig(0.25, 0.30, 0.25, 0.20, 0.20))
    none = f.limit(0)
    top = score.overall(score.categories(none, heavy), none).first()
    assert (top.overall, top.grade) == (120, "F")
    exact = Config(score=heavy.score, mode="exact")
    assert score.overall(score.categories(none, exact), none).first().overall == 100
    assert score.filter_domain(f, "proj").count() == 1 and score.rolled_up(f).count() > 6
    assert sinks.badge_color(92) == "#4c1" and sinks.badge_color(120) == "#e05d44" and "81/100 — B" in sinks.badge(81, "B") and "█" in sinks.score_bar(50)


def test_compare_and_fix(spark):
    a = dataset(spark, [(0, "1", pt(0.0, 0.0), {}), (0, "2", pt(1.0, 1.0), {}), (0, "3", None, {}), (0, "4", pt(1.0, 1.0), {})])
    b = dataset(spark, [(0, "1", pt(0.0, 0.0), {"k": "1"}), (0, "2", pt(1.0, 2.0), {})])
    r = compare.compare(a, b)
    assert (r.first().removed, r.first().added, r.first().extent_changed) == (2, 0, False) and compare.changes(r).count() == 2
    assert {(x.k, x.change) for x in compare.feature_changes(a, b).collect()} == {("id:1", "properties"), ("id:2", "geometry"), ("id:3", "removed"), ("id:4", "removed")}
    healed, report = fix.heal(a)
    assert report.first().updated_features == 2 and [x.id for x in healed.features.orderBy("feat_idx").collect()] == ["1", "2"]
    moved, report = fix.reproject_dataset(a, "EPSG:3857")
    assert report.first().updated_features == 3 and moved.features.count() == 4
    bad = fix.reproject(dataset(spark, [(0, None, pt(0.0, -90.0), {})]).features, "EPSG:4326", "EPSG:3857").first().geom
    assert bad.parts[0].rings[0][0].y == -90.0
    f = rules.Registry().get("data/null-geometry").check(CheckContext(a))
    assert compare.join_findings(a.features, f).count() == 1


def test_profile_and_explain(spark):
    d = dataset(spark, [(0, None, pt(0.0, 0.0), {"a": "1", "b": "2"}), (0, None, None, {"c": "3"}), (0, None, poly(square(0, 0, 1)), {}), (0, None, pt(2.0, 0.0), {})], (("a", "EPSG:4326", WORLD), ("e", None, None)))
    one, two = profile.profile(d).orderBy("layer_idx").collect()
    assert (one.feature_count, one.geometry_type, one.field_count, one.null_geometry_count) == (4, "Mixed (primarily Point)", 3, 1) and (two.feature_count, two.geometry_type) == (0, "None")
    got = {r.crs: r for r in explain.explain(spark.createDataFrame([(c,) for c in ("EPSG:4326", "3857", "epsg:5070", "EPSG:32650", "99999", "Epsg:1", "x")], "crs string")).collect()}
    assert set(got) == {"EPSG:4326", "3857", "epsg:5070", "EPSG:32650", "99999"}
    assert got["3857"].projection_family == "Mercator" and len(got["3857"].warnings) == 2 and got["epsg:5070"].preserves_area and got["EPSG:32650"].name == "WGS84 / UTM Zone 50N" and got["99999"].projection_family == "Unknown"
    assert explain.database(spark).count() == 22


GEO = '{"type":"FeatureCollection","features":[{"type":"Feature","id":7,"geometry":{"type":"Point","coordinates":[-80,35,9]},"properties":{"n":"x","z":null,"v":1.5,"l":[1]}},{"type":"Feature","geometry":null,"properties":null},{"type":"Feature","id":"q","geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[-90,40]},{"type":"LineString","coordinates":[[0,0],[1,1]]}]},"properties":{}}]}'


def test_geojson(spark):
    d = read_str(spark, GEO)
    f = d.features.orderBy("feat_idx").collect()
    assert [x.id for x in f] == ["7", None, "q"] and f[0].properties == {"n": '"x"', "v": "1.5", "l": "[1]"} and f[1].geom is None and f[2].geom.gtype == "GeometryCollection"
    b = d.layers.first().bounds
    assert (b.min_x, b.min_y, b.max_x, b.max_y) == (-90.0, 0.0, 1.0, 40.0)
    text = json.loads(sinks.feature_collection(sinks.layer_features(d)))
    assert text["features"][0]["properties"] == {"layer": "inline", "id": "7", "n": "x", "v": 1.5, "l": [1]} and text["features"][0]["id"] == "7"
    bare = read_str(spark, '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}').features.first()
    assert bare.geom.gtype == "Polygon"
    for bad in ("not valid json at all", '{"type":"Nope"}'):
        with pytest.raises(Exception, match="GeoJSON error"):
            read_str(spark, bad).features.collect()


def shp_bytes(polygons):
    import struct

    out = b""
    for i, rings in enumerate(polygons):
        pts = [p for r in rings for p in r]
        starts, at = [], 0
        for r in rings:
            starts.append(at)
            at += len(r)
        body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(pts)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in pts)
        out += struct.pack(">2i", i + 1, len(body) // 2) + body
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(out)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + out


def dbf_bytes(rows):
    import struct

    fields = [(b"NAME", b"C", 8), (b"VAL", b"N", 6), (b"OK", b"L", 1), (b"DAY", b"D", 8)]
    head = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([s, 0]) + b"\0" * 14 for n, k, s in fields)
    width = 1 + sum(s for _, _, s in fields)
    body = b"".join(b" " + b"".join(v.ljust(s) for v, (_, _, s) in zip(r, fields)) for r in rows)
    return struct.pack("<4BIHH20x", 3, 0, 0, 0, len(rows), 32 + len(head) + 1, width) + head + b"\r" + body


def test_shapefile(spark, tmp_path):
    outer, hole = square(0, 0, 4)[::-1], square(1, 1, 1)
    (tmp_path / "a.shp").write_bytes(shp_bytes([[outer, hole], [square(9, 9, 1)[::-1]]]))
    (tmp_path / "a.dbf").write_bytes(dbf_bytes([(b"one", b"1.5", b"T", b"20200101"), (b"", b"", b"?", b"")]))
    (tmp_path / "a.prj").write_text('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32616"]]')
    d = read_file(spark, str(tmp_path / "a.shp"))
    f = d.features.orderBy("feat_idx").collect()
    assert len(f) == 2 and len(f[0].geom.parts[0].rings) == 2 and f[0].properties == {"NAME": '"one"', "VAL": "1.5", "OK": "true"} and f[1].properties == {}
    assert d.layers.first().crs == "EPSG:4326" and read_file(spark, str(tmp_path / "a.shp"), exact=True).layers.first().crs == "EPSG:32616"
    assert epsg_of_wkt("PROJCS[]") is None and crs_of_prj(" raw ") == "raw" and crs_of_prj(None) is None and records(dbf_bytes([])) == [] and len(shapes(shp_bytes([]))) == 0


def test_formats(spark, tmp_path):
    import struct

    assert detect_format("x/Y.GeoJSON") == "geojson" and detect_format("a.fgb") == "flatgeobuf"
    with pytest.raises(UnsupportedFormat, match="Unknown file extension: .csv"):
        detect_format("a.csv")
    (tmp_path / "a.gpkg").write_bytes(b"")
    with pytest.raises(UnsupportedFormat):
        read_file(spark, str(tmp_path / "a.gpkg"))
    assert wkb(struct.pack("<BI2d", 1, 1, 3.0, 4.0)) == pt(3.0, 4.0) and wkb(struct.pack(">BI3d", 0, 1001, 3.0, 4.0, 5.0)) == pt(3.0, 4.0)
    spark.createDataFrame([(bytearray(struct.pack("<BI2d", 1, 1, 3.0, 4.0)), "n"), (None, None)], "geometry binary, name string").write.parquet(str(tmp_path / "t.parquet"))
    d = read_file(spark, str(tmp_path / "t.parquet"))
    assert sorted((r.geom is None, r.properties) for r in d.features.collect()) == [(False, {"name": '"n"'}), (True, {})]
    (tmp_path / "s.geojsonl").write_text('{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":1}}\n\n{"type":"Feature","geometry":null,"properties":{}}\n')
    assert read_file(spark, str(tmp_path / "s.geojsonl")).features.count() == 2


def test_config(tmp_path):
    c = Config().merged(parse_yaml("check:\n  max_distortion_pct: 3\n  disabled_rules:\n    - a/b\nscore:\n  unknown: 1\n"))
    assert c.check.max_distortion_pct == 3.0 and c.check.disabled_rules == ("a/b",) and c.xray.max_samples == 1000
    for bad in ("check:\n  max_distortion_pct: x\n", "nonsense\n"):
        with pytest.raises(ConfigError):
            Config().merged(parse_yaml(bad))


def test_cloud_files(spark):
    f = spark.createDataFrame([("d/a.shp", 10), ("d/a.dbf", 1), ("d/b.shp", 3 << 30), ("d/b.shx", 1), ("d/b.dbf", 1), ("d/b.prj", 1), ("d/c.parquet", 5), ("d/e.geojson", 5)], "path string, length long")
    got = sorted((r.rule_id, r.sub_key) for r in cloud.check_files(f).collect())
    assert got == [("cloud/crs-metadata", "d/a.shp"), ("cloud/file-size", "d/b.shp"), ("cloud/file-size", "d/c.parquet"), ("cloud/format-recommendation", "d/a.shp"), ("cloud/format-recommendation", "d/b.shp"), ("cloud/multi-file-integrity", "d/a.shp")]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from geodiag.cli import main

    monkeypatch.chdir(tmp_path)
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[-84.5,38]},"properties":{"name":"a"}},{"type":"Feature","geometry":{"type":"Point","coordinates":[-84.4,38.1]},"properties":{"name":"b"}}]}')
    (tmp_path / "e.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    full = lambda a: [str(tmp_path / x) if x.endswith(".geojson") else x for x in a]  # noqa: E731  the JVM keeps its own working folder
    out = lambda *a: (main(full(a), spark), capsys.readouterr().out)
    assert json.loads(out("score", "p.geojson", "--json", "--badge", "b.svg")[1])["overall"] == 100 and (tmp_path / "b.svg").exists()
    r = json.loads(out("score", "e.geojson", "--json")[1])
    assert (r["overall"], r["grade"], r["finding_count"]) == (98, "A", 2)
    x = json.loads(out("xray", "p.geojson", "--recommend", "--json", "--html", "x.html")[1])
    assert x["summary"]["max_area_distortion_pct"] == 0 and [c["fitness"] for c in x["recommendations"]] == [0.9, 0.85, 0.85, 0.2] and "<svg" in (tmp_path / "x.html").read_text()
    s = json.loads(out("check", "e.geojson", "--sarif")[1])
    assert [x["level"] for x in s["runs"][0]["results"]] == ["warning", "note"]
    assert json.loads(out("diff", "p.geojson", "e.geojson", "--json")[1])["removed"] == 2
    assert out("fix", "p.geojson", "--topology")[0] == 0 and (tmp_path / "p_topology_fixed.geojson").exists()
    assert main(full(["fix", "p.geojson"]), spark) == 1 and out("init")[0] == 0 and main(["init"], spark) == 1
    assert json.loads(out("explain", "EPSG:3857")[1])["projection_family"] == "Mercator" and json.loads(out("profile", "p.geojson")[1])["layer_count"] == 1
    assert issubclass(UnsupportedFormat, GeodiagError)


def test_watch(spark, tmp_path):
    from geodiag.streaming.watch import score_trend, watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "in/other.txt").write_text("x")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    watch(*args, once=True).awaitTermination(120)
    assert [(r.findings, r.overall) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, 98)]
    (tmp_path / "in/e.geojson").write_text('{"type":"FeatureCollection","features":[ ]}')
    watch(*args, once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 and score_trend(spark.read.parquet(str(tmp_path / "out"))).agg(F.sum("checks")).first()[0] == 2


def test_geometry_text(spark):
    d = dataset(spark, [(0, None, poly(square(0, 0, 1), square(0, 0, 0.5)), {})])
    t = json.loads(d.features.select(g.to_geojson(F.col("geom")).alias("t")).first().t)
    assert t["type"] == "Polygon" and len(t["coordinates"]) == 2 and t["coordinates"][0][0] == [0.0, 0.0]
