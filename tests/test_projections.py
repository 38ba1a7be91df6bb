"""Projections and their inverses, parameters as columns, candidates, sampling and areas."""

import math

import pytest
from pyspark.sql import functions as F

from geodiag.config import Config
from geodiag.functions import projections as P
from geodiag.functions.projections import project, unproject, with_parameters
from geodiag.model import CheckContext
from geodiag.operators import fix, recommend, rules, xray
from test_core import WORLD, dataset, poly, pt, square

CLARKE = (6378206.4, 1 - math.sqrt(1 - 0.00676866))


# the worked examples of USGS PP 1395, given to 0.1 m there
@pytest.mark.parametrize("system, lon, lat, x, y", [
    (P.albers(CLARKE, 29.5, 45.5, 23.0, -96.0), -75.0, 35.0, 1885472.7, 1535925.0), (P.lambert_conic(CLARKE, 33.0, 45.0, 23.0, -96.0), -75.0, 35.0, 1894410.9, 1564649.5),
    (P.transverse_mercator(CLARKE, -75.0, 0.0, 0.9996, 0.0, 0.0), -73.5, 40.5, 127106.5, 4484124.4), (P.lambert_azimuthal(CLARKE, 40.0, -100.0), -110.0, 30.0, -965932.1, -1056814.9),
])
def test_published_examples_both_ways(spark, system, lon, lat, x, y):
    there, back = P.FORWARD[system["family"]](system, F.lit(lon), F.lit(lat)), P.BACK[system["family"]](system, F.lit(x), F.lit(y))
    r = spark.range(1).select(*(c.alias(n) for c, n in zip((*there, *back), "xyuv"))).first()
    assert (r.x, r.y) == pytest.approx((x, y), abs=0.06) and (r.u, r.v) == pytest.approx((lon, lat), abs=1e-6)


AREAS = {
    "EPSG:3857": (-179, -80, 179, 80), "EPSG:32616": (-91, -79, -83, 83), "EPSG:32733": (11, -79, 19, 5), "EPSG:26917": (-85, 10, -77, 70), "EPSG:5070": (-130, 20, -65, 55), "ESRI:102003": (-130, 20, -65, 55), "EPSG:3338": (-172, 51, -130, 71), "EPSG:3089": (-90, 36, -82, 40),
    "EPSG:2205": (-90, 36, -82, 40), "EPSG:2278": (-107, 26, -93, 33), "EPSG:3035": (-15, 32, 45, 72), "EPSG:2163": (-130, 20, -65, 55), "EPSG:6933": (-179, -85, 179, 85), "ESRI:54009": (-179, -89, 179, 89), "ESRI:54030": (-179, -90, 179, 90), "EPSG:3826": (119, 20, 123, 26),
    "+proj=lcc +lat_1=-20 +lat_2=-40 +lat_0=-30 +lon_0=140": (120, -45, 155, -10), "+proj=aea +lat_1=-20 +lat_2=-40 +lat_0=-30 +lon_0=140": (120, -45, 155, -10), "+proj=laea +lat_0=90 +lon_0=0": (-170, 20, 170, 89), "+proj=utm +zone=33 +south": (11, -79, 19, 5), "EPSG:4326": (-180, -90, 180, 90),
}


def grid(spark, n=21):
    rows = [(c, b[0] + (b[2] - b[0]) * i / n, b[1] + (b[3] - b[1]) * j / n) for c, b in AREAS.items() for i in range(n + 1) for j in range(n + 1)]
    return spark.createDataFrame(rows, "crs string, lon double, lat double")


def test_every_system_there_and_back_by_one_plan(spark):
    systems = with_parameters(spark.createDataFrame([(c,) for c in AREAS], "crs string"))
    trip = xray.round_trip(grid(spark).join(F.broadcast(systems), "crs"), F.col("projection")).groupBy("crs").agg(F.count_if(F.col("round_trip_deg").isNull()).alias("lost"), F.max("round_trip_deg").alias("most")).collect()
    # 1e-8 degrees are a millimetre
    assert len(trip) == len(AREAS) and all(r.lost == 0 and r.most < 1e-8 for r in trip), trip


def test_parameters_as_columns_equal_numbers(spark):
    systems = with_parameters(spark.createDataFrame([(c,) for c in AREAS] + [("EPSG:4267",), ("nonsense",), (None,)], "crs string"))
    assert {r.crs for r in systems.where("projection is null").collect()} == {"EPSG:4267", "nonsense", None}
    p = grid(spark, 5).join(F.broadcast(systems), "crs").select("crs", "lon", "lat", project(F.col("projection"), F.col("lon"), F.col("lat")).alias("p"))
    for crs in ("EPSG:32616", "EPSG:3089", "EPSG:3035", "EPSG:2163", "ESRI:54009", "ESRI:54030"):
        far = p.where(F.col("crs") == crs).select(F.col("p"), project(crs, F.col("lon"), F.col("lat")).alias("q")).agg(F.max(F.abs(F.col("p.x") - F.col("q.x"))), F.max(F.abs(F.col("p.y") - F.col("q.y")))).first()
        assert max(far) < 1e-6
    both = systems.where("crs in ('EPSG:5070', 'EPSG:4326')").select("crs", "projection", F.lit(-90.0).alias("lon"), F.lit(40.0).alias("lat"))
    by = {r.crs: r for r in xray.measure(both, F.col("projection"), "exact").collect()}
    want = xray.measure(both.drop("projection"), "EPSG:5070", "exact").first()
    assert by["EPSG:5070"].angular_distortion_deg == pytest.approx(want.angular_distortion_deg) and (by["EPSG:4326"].area_scale_factor, by["EPSG:4326"].area_distortion_pct, by["EPSG:4326"].semimajor) == (1, 0, 1)


def test_reprojection_from_projected_layers(spark):
    f = dataset(spark, [(0, "a", poly(square(-90.0, 38.0, 1.0)), {}), (0, "b", pt(-87.5, 39.25), {}), (0, "c", None, {})]).features
    at = lambda d: [None if r.geom is None else [(v.x, v.y) for p in r.geom.parts for ring in p.rings for v in ring] for r in d.orderBy("feat_idx").collect()]
    start = at(f)
    for crs in ("EPSG:3857", "EPSG:5070", "EPSG:32616", "EPSG:3089", "EPSG:2163"):
        moved = fix.reproject(f, "EPSG:4326", crs)
        back = at(fix.reproject(moved, crs, "EPSG:4326"))
        assert back[2] is None and all(u == pytest.approx(v, abs=1e-8) for a, b in zip(back[:2], start[:2]) for u, v in zip(a, b))
        # from one plane to another
        direct, by_way = at(fix.reproject(moved, crs, "EPSG:6933")), at(fix.reproject(f, "EPSG:4326", "EPSG:6933"))
        assert all(u == pytest.approx(v, abs=1e-3) for a, b in zip(direct[:2], by_way[:2]) for u, v in zip(a, b))
    # published: the false origin of zone 16, and the pole, which has no image in Web Mercator, stays
    assert at(fix.reproject(dataset(spark, [(0, None, pt(500000.0, 0.0), {})]).features, "EPSG:32616", "EPSG:4326"))[0][0] == pytest.approx((-87.0, 0.0), abs=1e-9)
    assert at(fix.reproject(dataset(spark, [(0, None, pt(20037508.342789244, 20037508.342789244), {})]).features, "EPSG:3857", "EPSG:4326"))[0][0] == pytest.approx((180.0, 85.0511287798), abs=1e-9)
    with pytest.raises(P.ProjectionError):
        fix.reproject(f, "EPSG:99999", "EPSG:4326")


def test_area_errors(spark):
    f = dataset(spark, [(0, "a", poly(square(0, 0, 1)), {}), (0, "b", poly(square(0, 60, 1)), {}), (0, "p", pt(0.0, 0.0), {}), (0, "flat", poly([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)]), {}), (0, "pole", poly(square(0, 89, 2)), {})]).features
    got = {r.feat_idx: r for r in xray.area_errors(f, "EPSG:3857").collect()}
    assert set(got) == {0, 1, 3, 4} and got[3].error_pct is None and got[4].error_pct is None
    # a square degree at the equator and at 60 degrees north, from published tables of the ellipsoid
    assert got[0].reference / 1e6 == pytest.approx(12308.8, abs=0.5) and got[1].error_pct == pytest.approx(300, rel=0.05)
    same = {r.feat_idx: r for r in xray.area_errors(f, "EPSG:6933").collect()}
    assert same[0].error_pct < 1e-9 and same[1].error_pct < 1e-9


def test_as_many_samples_as_a_layer_asks_for(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 1000, 1001, 50_000, 50_001)], "n long").select(xray.samples_wanted(F.col("n"))).collect()
    assert [r[0] for r in got] == [0, 1, 1000, 500, 500, 1000]
    k = F.col("id")
    points = spark.range(3000).select(F.when(k < 1500, 0).otherwise(1).cast("int").alias("layer_idx"), k.alias("feat_idx"), (k * 7919 % 3600 / 10 - 180).alias("lon"), (k * 104729 % 1600 / 10 - 80).alias("lat"))
    points = points.where("layer_idx = 0 or feat_idx < 2000")
    by = {r.layer_idx: r.n for r in xray.stratified(points, None).groupBy("layer_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert by[1] == 500 and 300 < by[0] <= 500
    one = points.where("feat_idx < 900")
    assert xray.stratified(one, None).count() == 900 and xray.stratified(points.limit(0), None).count() == 0


def test_candidates_are_ranked_by_what_they_distort(spark):
    rows = [(0, i, -90.0 + i % 10, 35.0 + i // 10) for i in range(100)] + [(1, i, 10.0 + i * 0.01, 50.0 + i * 0.005) for i in range(100)]
    samples = spark.createDataFrame(rows, "layer_idx int, sample_idx int, lon double, lat double")
    box = F.struct(F.min("lon").alias("min_x"), F.min("lat").alias("min_y"), F.max("lon").alias("max_x"), F.max("lat").alias("max_y"))
    extents = samples.groupBy("layer_idx").agg(box.alias("bounds"))
    current = spark.createDataFrame([(0, "EPSG:3857"), (1, None)], "layer_idx int, crs string")
    run = lambda **o: recommend.recommend_measured(samples, extents, current, mode="exact", **o).orderBy("layer_idx", "rank").collect()
    got = [r for r in run(top=99, include=("EPSG:5070", "EPSG:3089", "EPSG:99999")) if r.layer_idx == 0]
    crs = [r.crs for r in got]
    assert crs[-1] == "EPSG:4326" and crs[-2] == "EPSG:3857" and [r.crs for r in got if r.is_current] == ["EPSG:3857"] and "EPSG:99999" not in crs
    assert got[0].max_area_distortion_pct < 0.1 and got[0].crs in ("EPSG:5070", crs[0]) and got[-2].max_area_distortion_pct > 60
    # plain formulas: on the ellipsoid Web Mercator's scale along a parallel is (a / n) / cos, along a meridian (a / m) / cos
    e2, phi = (1 / 298.257223563) * (2 - 1 / 298.257223563), math.radians(44.0)
    w = 1 - e2 * math.sin(phi) ** 2
    assert got[-2].max_area_distortion_pct == pytest.approx((math.sqrt(w) * w * math.sqrt(w) / (1 - e2) / math.sqrt(w) / math.cos(phi) ** 2 * math.sqrt(w) - 1) * 100, rel=2e-3)
    assert run(top=99, target="shape")[0].max_angular_distortion_deg < 0.02
    assert "EPSG:3857" not in {r.crs for r in run(top=99, exclude=("EPSG:3857",))} and len([r for r in run(top=2) if r.layer_idx == 1]) == 2
    near = [r for r in run(top=99, target="distance") if r.layer_idx == 1 and not r.geographic]
    assert near[0].max_distance_error_pct == min(r.max_distance_error_pct for r in near)


def test_layers_of_many_systems_are_one_plan(spark):
    layers = tuple((f"l{i}", crs, WORLD) for i, crs in enumerate(["EPSG:3857", "EPSG:6933", "EPSG:32616", "EPSG:99999", "EPSG:4326", None, "EPSG:5070"]))
    f = [(i, None, pt(-88.0 + 0.1 * j, 40.0 + 0.1 * j), {}) for i in range(7) for j in range(3)]
    ctx = CheckContext(dataset(spark, f, layers), Config(mode="exact"))
    d = {r.layer_idx: r for r in rules.layer_distortion(ctx).collect()}
    assert set(d) == {0, 1, 2, 6} and all(r.sample_count == 3 for r in d.values()) and d[0].max_area_distortion_pct > 30 and d[2].max_area_distortion_pct < 1
    assert {r.layer_idx for r in rules.distance_errors(rules.projected_samples(ctx)).collect()} == {0, 1, 2, 6}


def test_a_place_is_computed_once(spark):
    """The formula of a vertex stands once in its expression, not once for each coordinate and each test."""
    for crs in ("EPSG:32616", "EPSG:3035"):
        place = spark.range(1).select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).select(unproject(crs, F.col("x"), F.col("y")).alias("p"))
        assert place._jdf.queryExecution().analyzed().toString().lower().count("atan2(") == 1
    # the angle's steps end early where ten reach the last bit
    for lat in (0.0, -33.0, 84.9, 89.0, 90.0):
        r = spark.range(1).select(project("ESRI:54009", F.lit(12.0), F.lit(lat)).alias("p")).first().p
        t = math.radians(lat)
        for _ in range(60):
            t -= (t + math.sin(t) - math.pi * math.sin(math.radians(lat))) / (1 + math.cos(t)) if 1 + math.cos(t) > 1e-12 else 0.0
        assert (r.x, r.y) == pytest.approx((6378137.0 * 2 * math.sqrt(2) / math.pi * math.radians(12) * math.cos(t / 2), 6378137.0 * math.sqrt(2) * math.sin(t / 2)), abs=1e-3)
