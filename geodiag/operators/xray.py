"""Projection distortion: centroids, stratified samples, indicatrix parameters, summary, heatmap and ellipses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodiag.functions import geometry as g
from geodiag.functions.projections import GEOGRAPHIC, WGS84, parameters, place, project, unproject
from geodiag.functions.text import distortion_color

DELTA = 0.001
EARTH = 6_371_000.0
GRID = 50
VERTICES = 72
RADIUS = 0.3


def centroids(features: DataFrame) -> DataFrame:
    """``layer_idx, feat_idx, lon, lat`` of features with a geometry that isn't empty."""
    return features.where("geom is not null").select("layer_idx", "feat_idx", g.centroid(F.col("geom")).alias("c")).where("c is not null").select("layer_idx", "feat_idx", F.col("c.x").alias("lon"), F.col("c.y").alias("lat"))


def samples_wanted(n: Column) -> Column:
    """How many of a layer's ``n`` points are sampled where no number is configured: all up to 1,000, 500 up to 50,000, else 1,000."""
    return F.when(n <= 1000, n).when(n <= 50_000, 500).otherwise(1000)


def stratified(points: DataFrame, target: int | None) -> DataFrame:
    """At most ``target`` points of each layer (None: :func:`samples_wanted`): the first of each cell of a square grid over its points, by row and column.

    A layer with no more points than that, keeps all; one without extent keeps its first. The
    first of a cell is an aggregate, combined before the shuffle; only cells, at most about ``target``
    per layer, are ranked.
    """
    box = points.groupBy("layer_idx").agg(F.count(F.lit(1)).alias("n"), F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))
    most = samples_wanted(F.col("n")) if target is None else F.lit(target)
    box = box.withColumn("most", most).withColumn("side", F.ceil(F.sqrt("most")))
    # a row per layer
    p = points.join(box, "layer_idx")
    cell = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / F.col("side"))), F.col("side") - 1)
    flat = (F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))
    kept = ["layer_idx", "feat_idx", "lon", "lat"]
    few = p.where(F.col("n") <= F.col("most")).select(*kept, F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"))
    many = p.where((F.col("n") > F.col("most")) & ~flat).withColumn("row", cell("lat", "y0", "y1")).withColumn("col", cell("lon", "x0", "x1"))
    firsts = many.groupBy("layer_idx", "row", "col").agg(F.min(F.struct("feat_idx", "lon", "lat")).alias("f"), F.first("most").alias("most"))
    firsts = firsts.select("layer_idx", "f.feat_idx", "f.lon", "f.lat", "row", "col", "most")
    ranked = firsts.withColumn("k", F.row_number().over(Window.partitionBy("layer_idx").orderBy("row", "col"))).where(F.col("k") <= F.col("most"))
    stacked = p.where((F.col("n") > F.col("most")) & flat).withColumn("k", F.row_number().over(Window.partitionBy("layer_idx").orderBy("feat_idx"))).where(F.col("k") <= F.col("most"))
    return few.unionByName(ranked.select(*few.columns)).unionByName(stacked.select(*kept, F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col")))


INDICATRIX = ("area_scale_factor", "area_distortion_pct", "angular_distortion_deg", "semimajor", "semiminor", "theta")


def measure(points: DataFrame, crs: str | Column, mode: str = "compat") -> DataFrame:
    """Add the indicatrix columns to points ``lon, lat``, by forward differences of the projection.

    ``crs`` is a system for all points, or a column of parameters (:func:`with_parameters`), so that layers and
    candidates of any number are one plan. ``compat``: the scale along parallels is weighted by cos(lat) before it's compared with the
    sphere's, as established results have it. ``exact``: true scales on the WGS 84 ellipsoid,
    axes without units. Each step is a projection of its own, so that no shared term is written
    out twice in the generated code.
    """
    one, keep = F.lit(1.0), points.columns
    plain = lambda c: 1.0 if c in ("area_scale_factor", "semimajor", "semiminor") else 0.0
    if isinstance(crs, str) and crs in GEOGRAPHIC:
        return points.select("*", *(F.lit(plain(c)).alias(c) for c in INDICATRIX))
    lon, lat = F.col("lon"), F.col("lat")
    if isinstance(crs, str):
        at = [place(crs, u, v) for u, v in ((lon, lat), (lon + DELTA, lat), (lon, lat + DELTA))]
    else:
        spot = lambda u, v: F.struct(u.alias("x"), v.alias("y"))
        three = F.transform(F.array(spot(lon, lat), spot(lon + DELTA, lat), spot(lon, lat + DELTA)), lambda q: place(crs, q["x"], q["y"]))
        points, at = points.withColumn("__three", three), [F.col("__three")[i] for i in range(3)]
        geographic = crs["family"] == "geographic"
        points = points.withColumn("__flat", geographic)
        keep = [*keep, "__flat"]
    # true scales need metres
    unit = 1.0 if mode == "compat" else parameters(crs)["unit"] if isinstance(crs, str) else crs["unit"]
    d = points.select(*keep, *(x.alias(n) for x, n in zip(at, ("__c", "__e", "__n"))), F.cos(F.radians(lat)).alias("__cos"), F.lit(unit).alias("__unit"))
    cos = F.col("__cos")
    if mode == "compat":
        sx, sy = cos, one
        ref = (EARTH * cos * math.pi / 180.0) * F.lit(EARTH * math.pi / 180.0)
    else:
        e2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
        w = 1 - e2 * (1 - cos * cos)
        sx = F.col("__unit") / (6378137.0 * cos / F.sqrt(w) * math.pi / 180.0)
        sy = F.col("__unit") / (6378137.0 * (1 - e2) / (w * F.sqrt(w)) * math.pi / 180.0)
        ref = one
    slope = lambda p, m, k: (F.col(f"__{p}")[m] - F.col("__c")[m]) / DELTA * k
    d = d.select(*keep, ref.alias("__ref"), slope("e", "x", sx).alias("a11"), slope("e", "y", sx).alias("a21"), slope("n", "x", sy).alias("a12"), slope("n", "y", sy).alias("a22"))
    a11, a21, a12, a22 = (F.col(c) for c in ("a11", "a21", "a12", "a22"))
    d = d.select(*keep, "__ref", F.abs(a11 * a22 - a12 * a21).alias("__det"), (a11 * a11 + a21 * a21).alias("__h2"), (a12 * a12 + a22 * a22).alias("__k2"), (a11 * a12 + a21 * a22).alias("__m"))
    h2, k2, m = F.col("__h2"), F.col("__k2"), F.col("__m")
    d = d.select(*keep, F.when(F.col("__ref") > 0, F.col("__det") / F.col("__ref")).otherwise(1.0).alias("area_scale_factor"), "__h2", "__k2", "__m", F.sqrt((h2 - k2) * (h2 - k2) + 4.0 * m * m).alias("__d"))
    least = 0.001 if mode == "compat" else 1e-12
    axis = lambda e: F.greatest(F.coalesce(F.nanvl(F.sqrt(e), F.lit(least)), F.lit(least)), F.lit(least))
    d = d.select(*keep, "area_scale_factor", axis((h2 + k2 + F.col("__d")) / 2.0).alias("semimajor"), axis((h2 + k2 - F.col("__d")) / 2.0).alias("semiminor"), (F.atan2(2.0 * m, h2 - k2) / 2.0).alias("theta"))
    big, small = F.col("semimajor"), F.col("semiminor")
    omega = F.abs(2.0 * F.degrees(F.asin(F.greatest(F.least((big - small) / (big + small), one), -one))))
    d = d.select(*keep, "area_scale_factor", (F.abs(F.col("area_scale_factor") - 1.0) * 100.0).alias("area_distortion_pct"), omega.alias("angular_distortion_deg"), "semimajor", "semiminor", "theta")
    return d if isinstance(crs, str) else d.select(*keep[:-1], *(F.when(F.col("__flat"), plain(c)).otherwise(F.col(c)).alias(c) for c in INDICATRIX))


def sample_points(features: DataFrame, max_samples: int | None = 1000) -> DataFrame:
    """``layer_idx, feat_idx, sample_idx, lon, lat`` of each layer's sampled centroids."""
    p = stratified(centroids(features), max_samples)
    # the samples are few; their order is the strata's
    p = p.withColumn("sample_idx", F.row_number().over(Window.partitionBy("layer_idx").orderBy("row", "col", "feat_idx")) - 1)
    return p.select("layer_idx", "feat_idx", "sample_idx", "lon", "lat")


def sample_layer(features: DataFrame, crs: str, max_samples: int | None = 1000, mode: str = "compat") -> DataFrame:
    """:func:`sample_points` with the six indicatrix columns."""
    return measure(sample_points(features, max_samples), crs, mode)


def summary(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, maximum, mean, median and standard deviation of area distortion, maximum and mean of angular distortion; zeros without samples."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    area, angle = "area_distortion_pct", "angular_distortion_deg"
    return samples.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("sample_count"), z(F.max(area)).alias("max_area_distortion_pct"), z(F.avg(area)).alias("mean_area_distortion_pct"), z(F.expr(f"percentile({area}, 0.5D)")).alias("median_area_distortion_pct"),
        z(F.stddev_pop(area)).alias("std_area_distortion_pct"),
        z(F.greatest(F.max(angle), F.lit(0.0))).alias("max_angular_distortion_deg"), z(F.avg(angle)).alias("mean_angular_distortion_deg"),
    )


def round_trip(points: DataFrame, crs: str | Column) -> DataFrame:
    """Add ``round_trip_deg``: how far a point is from itself after projection and back, along the farther axis; null where there is no image."""
    lon, lat = F.col("lon"), F.col("lat")
    there = points.withColumn("__there", project(crs, lon, lat)).withColumn("__back", unproject(crs, F.col("__there.x"), F.col("__there.y")))
    return there.withColumn("round_trip_deg", F.greatest(F.abs(F.col("__back.x") - lon), F.abs(F.col("__back.y") - lat))).drop("__there", "__back")


def _ring_sum(ring: Column, at) -> Column:
    """Twice the signed area of a ring whose vertices ``at`` places."""
    placed = F.transform(ring, at)
    steps = lambda r: F.when(F.size(r) > 1, F.sequence(F.lit(1), F.size(r) - 1)).otherwise(F.array().cast("array<int>"))
    return g.let(placed, lambda r: F.aggregate(steps(r), F.lit(0.0), lambda s, i: s + (r[i]["x"] - r[i - 1]["x"]) * (r[i]["y"] + r[i - 1]["y"])))


def area_errors(features: DataFrame, crs: str | Column) -> DataFrame:
    """``layer_idx, feat_idx, area, reference, error_pct`` of polygons in longitude and latitude.

    ``area`` is that in the system's plane, in its squared unit; ``reference`` that on the ellipsoid in square metres: the line integral of the
    authalic latitude's sine along the rings, whose edges are straight in a cylindrical equal-area plane. Holes are taken off.
    No error for an empty reference, or where a vertex has no image.
    """
    a, f = WGS84
    e = math.sqrt(f * (2 - f))
    equal = lambda p: F.struct((F.radians(p["x"]) * a).alias("x"), (a * (1 - e * e) / 2 * (lambda s: s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))(F.sin(F.radians(p["y"])))).alias("y"))
    polygons = F.filter(F.col("geom")["parts"], lambda p: p["kind"] == "polygon")

    def total(at):
        part = lambda p: F.aggregate(F.transform(p["rings"], lambda r, i: F.abs(_ring_sum(r, at)) / 2 * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, v: s + v)
        return F.aggregate(F.transform(polygons, part), F.lit(0.0), lambda s, v: s + v)

    own = total(lambda p: project(crs, p["x"], p["y"]))
    d = features.where(g.is_polygonal(F.col("geom"))).select("layer_idx", "feat_idx", own.alias("area"), total(equal).alias("reference"))
    return d.withColumn("error_pct", F.when(F.col("reference") > 0, F.abs(F.col("area") - F.col("reference")) / F.col("reference") * 100.0))


def heatmap(samples: DataFrame, bounds: tuple[float, float, float, float], cols: int = GRID, rows: int = GRID, by: list[str] | None = None) -> DataFrame:
    """``row, col, x, y, value``, for each value of the columns ``by`` if there are any: inverse-distance weights (power 2) at cell centres; an exact hit takes the first such sample.

    The grid is a constant, the samples at most the configured number, so the pairing is small.
    Without samples or extent all values are 0.
    """
    spark = samples.sparkSession
    x0, y0, x1, y1 = bounds
    w, h = (x1 - x0) / cols, (y1 - y0) / rows
    k = F.col("id")
    grid = spark.range(cols * rows).select((k / cols).cast("int").alias("row"), (k % cols).cast("int").alias("col"))
    grid = grid.select("row", "col", (F.lit(x0) + (F.col("col") + 0.5) * w).alias("x"), (F.lit(y0) + (F.col("row") + 0.5) * h).alias("y"))
    by = by or []
    if not (w > 0 and h > 0):
        grid = grid.withColumn("value", F.lit(0.0))
        return samples.select(*by).distinct().join(grid) if by else grid
    packed = samples.select(*by, F.struct("sample_idx", F.col("lon").alias("sx"), F.col("lat").alias("sy"), F.col("area_distortion_pct").alias("pct")).alias("s")).groupBy(*by).agg(F.sort_array(F.collect_list("s")).alias("ss"))

    def weigh(a, s):
        d2 = (F.col("x") - s["sx"]) * (F.col("x") - s["sx"]) + (F.col("y") - s["sy"]) * (F.col("y") - s["sy"])
        hit = d2 < 1e-12
        return F.struct(F.coalesce(a["hit"], F.when(hit, s["pct"])).alias("hit"), (a["n"] + F.when(hit, 0.0).otherwise(s["pct"] / d2)).alias("n"), (a["d"] + F.when(hit, 0.0).otherwise(1.0 / d2)).alias("d"))

    # a row for each layer, of at most the configured number of samples
    start = F.struct(F.lit(None).cast("double").alias("hit"), F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    value = F.aggregate("ss", start, weigh, lambda a: F.coalesce(a["hit"], F.when(a["d"] > 0, a["n"] / a["d"]), F.lit(0.0)))
    return grid.join(F.broadcast(packed)).select(*by, "row", "col", "x", "y", value.alias("value"))


def heatmap_at(grid: DataFrame, col: int, row: int) -> DataFrame:
    """The cell's value; no row outside the grid."""
    return grid.where((F.col("col") == col) & (F.col("row") == row)).select("value")


def heatmap_cells(grid: DataFrame, bounds: tuple[float, float, float, float], cols: int = GRID, rows: int = GRID) -> DataFrame:
    """Cells as closed rings with value and colour."""
    w, h = ((bounds[2] - bounds[0]) / cols, (bounds[3] - bounds[1]) / rows)
    w, h = (w if w > 0 else 0.001), (h if h > 0 else 0.001)
    x, y = F.lit(bounds[0]) + F.col("col") * w, F.lit(bounds[1]) + F.col("row") * h
    ring = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h), F.array(x, y))
    return grid.select(*(c for c in grid.columns if c not in ("x", "y", "row", "col", "value")), "row", "col", "value", distortion_color(F.col("value")).alias("color"), F.array(ring).alias("coordinates"))


def ellipses(samples: DataFrame) -> DataFrame:
    """Indicatrices as closed rings of 73 positions."""
    a, b, th = RADIUS * F.col("semimajor"), RADIUS * F.col("semiminor"), F.col("theta")
    cos = F.greatest(F.cos(F.radians("lat")), F.lit(0.01))

    def at(i):
        t = i * (2.0 * math.pi / VERTICES)
        ex, ey = a * F.cos(t), b * F.sin(t)
        return F.array(F.col("lon") + (ex * F.cos(th) - ey * F.sin(th)) / cos, F.col("lat") + ex * F.sin(th) + ey * F.cos(th))

    ring = F.transform(F.sequence(F.lit(0), F.lit(VERTICES)), at)
    keep = [*(c for c in ("layer_idx",) if c in samples.columns), "sample_idx", "lon", "lat", "semimajor", "semiminor", F.degrees("theta").alias("angle_deg"), "area_distortion_pct", "angular_distortion_deg"]
    return samples.select(*keep, ring.alias("coordinates"))
