"""Geometry as Column expressions over the struct of :data:`geodiag.model.GEOM`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: vertices of a ring up to which segment pairs are tested within an expression
LONG_RING = 200


def let(value: Column, f) -> Column:
    """``f(value)``, computing ``value`` once per row."""
    return F.transform(F.array(value), f)[0]


def point(x: Column, y: Column) -> Column:
    """A point; null where a coordinate is."""
    p = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.when(x.isNotNull() & y.isNotNull(), _geom("Point", "point", F.array(F.array(p))))


def polygon(rings: Column) -> Column:
    """A polygon of ``array<array<struct<x,y>>>``."""
    return F.when(rings.isNotNull(), _geom("Polygon", "polygon", rings))


def _geom(gtype: str, kind: str, rings: Column) -> Column:
    return F.struct(F.lit(gtype).alias("gtype"), F.array(F.struct(F.lit(kind).alias("kind"), rings.alias("rings"))).alias("parts"))


def points(geom: Column) -> Column:
    """All vertices."""
    return F.flatten(F.flatten(F.transform(geom["parts"], lambda p: p["rings"])))


def n_points(geom: Column) -> Column:
    return F.aggregate(geom["parts"], F.lit(0), lambda a, p: a + F.aggregate(p["rings"], F.lit(0), lambda b, r: b + F.size(r)))


def is_empty(geom: Column) -> Column:
    """Null, or without a vertex."""
    return geom.isNull() | (n_points(geom) == 0)


def is_polygonal(geom: Column) -> Column:
    return geom["gtype"].isin("Polygon", "MultiPolygon")


def bbox(geom: Column) -> Column:
    """Extent; null for null and empty geometries."""

    def box(ps: Column) -> Column:
        xs, ys = F.transform(ps, lambda p: p["x"]), F.transform(ps, lambda p: p["y"])
        b = F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
        return F.when(F.size(ps) > 0, b)

    return F.when(geom.isNotNull(), let(points(geom), box))


def outside(box: Column, bounds: Column) -> Column:
    return (box["min_x"] < bounds["min_x"]) | (box["min_y"] < bounds["min_y"]) | (box["max_x"] > bounds["max_x"]) | (box["max_y"] > bounds["max_y"])


def key(geom: Column) -> Column:
    """Text for exact equality: sensitive to vertex order and to -0.0."""
    return F.to_json(geom)


def _sums(w=0.0, x=0.0, y=0.0) -> Column:
    return F.struct(F.lit(w).alias("w"), F.lit(x).alias("x"), F.lit(y).alias("y"))


def _add(a: Column, w: Column, x: Column, y: Column) -> Column:
    return F.struct((a["w"] + w).alias("w"), (a["x"] + x).alias("x"), (a["y"] + y).alias("y"))


def _ring_area(r: Column) -> Column:
    """Twice the absolute area and the centroid, about the ring's first vertex."""
    o = r[0]
    steps = F.when(F.size(r) >= 3, F.sequence(F.lit(1), F.size(r) - 1)).otherwise(F.array().cast("array<int>"))

    def step(a, i):
        p, q = r[i - 1], r[i]
        px, py, qx, qy = p["x"] - o["x"], p["y"] - o["y"], q["x"] - o["x"], q["y"] - o["y"]
        c = px * qy - qx * py
        return _add(a, c, (px + qx) * c, (py + qy) * c)

    s = F.aggregate(steps, _sums(), step)
    return let(s, lambda t: F.struct(F.abs(t["w"]).alias("w"), (o["x"] + t["x"] / (3 * F.when(t["w"] != 0, t["w"]))).alias("x"), (o["y"] + t["y"] / (3 * F.when(t["w"] != 0, t["w"]))).alias("y")))


def _ring_length(a: Column, r: Column) -> Column:
    def step(s, i):
        p, q = r[i - 1], r[i]
        n = F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
        return _add(s, n, n * (p["x"] + q["x"]) / 2, n * (p["y"] + q["y"]) / 2)

    return F.aggregate(F.when(F.size(r) >= 2, F.sequence(F.lit(1), F.size(r) - 1)).otherwise(F.array().cast("array<int>")), a, step)


def centroid(geom: Column) -> Column:
    """``struct<x,y>`` of the parts of highest dimension: by area with holes taken off, else by length, else the mean vertex."""
    parts = geom["parts"]
    holes = F.flatten(F.transform(F.filter(parts, lambda p: p["kind"] == "polygon"), lambda p: F.transform(p["rings"], lambda r, i: F.struct(F.when(i == 0, 1.0).otherwise(-1.0).alias("s"), r.alias("r")))))

    def add_ring(a, h):
        return let(_ring_area(h["r"]), lambda t: F.when(t["w"] > 0, _add(a, h["s"] * t["w"], h["s"] * t["w"] * t["x"], h["s"] * t["w"] * t["y"])).otherwise(a))

    area = F.aggregate(holes, _sums(), add_ring)
    lines = F.flatten(F.transform(F.filter(parts, lambda p: p["kind"].isin("line", "polygon")), lambda p: p["rings"]))
    length = F.aggregate(lines, _sums(), _ring_length)
    mean = F.aggregate(points(geom), _sums(), lambda a, p: _add(a, F.lit(1.0), p["x"], p["y"]))
    out = lambda t: F.struct((t["x"] / t["w"]).alias("x"), (t["y"] / t["w"]).alias("y"))
    # a lone point needs no sums
    alone = F.when(geom["gtype"] == "Point", parts[0]["rings"][0][0])
    whole = let(F.struct(area.alias("a"), length.alias("l"), mean.alias("m")), lambda s: F.when(s["a"]["w"] > 0, out(s["a"])).when(s["l"]["w"] > 0, out(s["l"])).when(s["m"]["w"] > 0, out(s["m"])))
    return F.when(~is_empty(geom), F.coalesce(alone, whole))


def cross(p: Column, q: Column, r: Column) -> Column:
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def crosses(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Segments ab and cd cross properly: strictly opposite sides both ways."""
    d1, d2, d3, d4 = cross(c, d, a), cross(c, d, b), cross(a, b, c), cross(a, b, d)
    return (((d1 > 0) & (d2 < 0)) | ((d1 < 0) & (d2 > 0))) & (((d3 > 0) & (d4 < 0)) | ((d3 < 0) & (d4 > 0)))


def ring_self_intersects(r: Column) -> Column:
    """Two segments of a ring that aren't neighbours cross properly; for rings of moderate length."""
    n = F.size(r) - 1  # segments

    def against(i):
        js = F.when(i + 2 < n, F.sequence(i + 2, n - 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(js, lambda j: ~((i == 0) & (j == n - 1)) & crosses(r[i], r[i + 1], r[j], r[j + 1]))

    return F.when(F.size(r) >= 4, F.exists(F.sequence(F.lit(0), n - 1), against)).otherwise(False)


def rings(geom: Column) -> Column:
    return F.flatten(F.transform(F.filter(geom["parts"], lambda p: p["kind"] == "polygon"), lambda p: p["rings"]))


def self_intersects(geom: Column) -> Column:
    return F.coalesce(is_polygonal(geom) & F.exists(rings(geom), ring_self_intersects), F.lit(False))


def longest_ring(geom: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rings(geom), F.size)), F.lit(0))


def map_coords(geom: Column, f) -> Column:
    """Replace each vertex by ``f(x, y) -> struct<x,y>``; a null result keeps the vertex."""
    ring = lambda r: F.transform(r, lambda p: F.coalesce(f(p["x"], p["y"]), p))
    parts = F.transform(geom["parts"], lambda p: F.struct(p["kind"].alias("kind"), F.transform(p["rings"], ring).alias("rings")))
    return F.when(geom.isNotNull(), F.struct(geom["gtype"].alias("gtype"), parts.alias("parts")))


def to_geojson(geom: Column) -> Column:
    """GeoJSON text of a geometry."""
    pos = lambda p: F.array(p["x"], p["y"])
    line = lambda p: F.transform(p["rings"][0], pos)
    poly = lambda p: F.transform(p["rings"], lambda r: F.transform(r, pos))
    parts, t = geom["parts"], geom["gtype"]
    one = lambda kind, coords: F.to_json(F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")))
    single = lambda p: F.when(p["kind"] == "point", one("Point", pos(p["rings"][0][0]))).when(p["kind"] == "line", one("LineString", line(p))).otherwise(one("Polygon", poly(p)))
    return (
        F.when(t == "Point", one("Point", pos(parts[0]["rings"][0][0])))
        .when(t == "LineString", one("LineString", line(parts[0])))
        .when(t == "Polygon", one("Polygon", poly(parts[0])))
        .when(t == "MultiPoint", one("MultiPoint", F.transform(parts, lambda p: pos(p["rings"][0][0]))))
        .when(t == "MultiLineString", one("MultiLineString", F.transform(parts, line)))
        .when(t == "MultiPolygon", one("MultiPolygon", F.transform(parts, poly)))
        .when(t == "GeometryCollection", F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(F.transform(parts, single), ","), F.lit("]}")))
    )
