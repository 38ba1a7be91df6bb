"""Formats by file ending, and dispatch to their readers."""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geodiag.errors import ReadError, UnsupportedFormat
from geodiag.model import FEATURE, GEOM, Dataset, compute_layers
from geodiag.sources import flatgeobuf, geojson, shapefile

# fixed values: formats by ending
ENDINGS = {"geojson": "geojson", "json": "geojson", "shp": "shapefile", "fgb": "flatgeobuf", "gpkg": "geopackage", "geojsonl": "sequence", "geojsons": "sequence", "parquet": "geoparquet", "geoparquet": "geoparquet"}


def detect_format(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    ext = name.rpartition(".")[2].lower() if "." in name else ""
    if ext not in ENDINGS:
        raise UnsupportedFormat(f"Unknown file extension: .{ext}")
    return ENDINGS[ext]


def read_file(spark: SparkSession, path: str, exact: bool = False) -> Dataset:
    kind = detect_format(path)
    if kind == "geojson":
        return geojson.read(spark, path)
    if kind == "sequence":
        return geojson.read_sequence(spark, path)
    if kind == "shapefile":
        return shapefile.read(spark, path, exact)
    if kind == "flatgeobuf":
        return read_flatgeobuf(spark, path)
    if kind == "geoparquet":
        return read_geoparquet(spark, path)
    raise UnsupportedFormat("GeoPackage reading is not supported yet")


def read_flatgeobuf(spark: SparkSession, path: str) -> Dataset:
    """As many features as the header counts, without geometry and properties."""
    head = flatgeobuf.read_header(path)
    n, crs = head.n_features, head.crs
    features = spark.range(n).select(F.lit(0).alias("layer_idx"), F.col("id").alias("feat_idx"), F.lit(None).cast("string").alias("i"), F.lit(None).cast(GEOM).alias("geom"), F.create_map().cast("map<string,string>").alias("properties")).withColumnRenamed("i", "id")
    layers = spark.createDataFrame([(0, path, crs)], "layer_idx int, name string, crs string")
    return Dataset(compute_layers(features, layers), features, path)


def wkb(data: bytes | None) -> dict | None:
    """Well-known binary (either byte order, heights dropped) to a geometry."""
    if data is None:
        return None
    at = 0

    def take(fmt, order):
        nonlocal at
        out = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return out

    def one():
        order = "<" if data[at] == 1 else ">"
        take("B", "<")
        (code,) = take("I", order)
        if code & 0x20000000:  # a spatial reference
            take("I", order)
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        kind = code & 0xFFFF
        if kind >= 1000:
            dims, kind = {1: 3, 2: 3, 3: 4}[kind // 1000], kind % 1000
        pos = lambda: (lambda v: {"x": v[0], "y": v[1]})(take(f"{dims}d", order))
        run = lambda: [pos() for _ in range(take("I", order)[0])]
        if kind == 1:
            p = pos()
            return "Point", [] if p["x"] != p["x"] else [{"kind": "point", "rings": [[p]]}]
        if kind == 2:
            return "LineString", [{"kind": "line", "rings": [run()]}]
        if kind == 3:
            return "Polygon", [{"kind": "polygon", "rings": [run() for _ in range(take("I", order)[0])]}]
        names = {4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
        if kind not in names:
            raise ReadError(f"geometry code {kind} not supported")
        return names[kind], [p for _ in range(take("I", order)[0]) for p in one()[1]]

    kind, parts = one()
    return {"gtype": kind, "parts": parts}


def read_geoparquet(spark: SparkSession, path: str, column: str = "geometry") -> Dataset:
    """A Parquet table with a well-known-binary ``geometry`` column; the other columns are properties."""
    table = spark.read.parquet(path)
    others = [c for c in table.columns if c != column and dict(table.dtypes)[c] not in ("binary",)]
    texts = F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1) for c in others))) if others else F.create_map().cast("map<string,string>")
    props = F.map_filter(texts, lambda k, v: v.isNotNull() & (v != "null"))
    numbered = table.select(F.lit(0).alias("layer_idx"), F.monotonically_increasing_id().alias("feat_idx"), F.lit(None).cast("string").alias("id"), F.col(column).alias("geom"), props.alias("properties"))

    def parse(frames):
        for f in frames:
            f["geom"] = f["geom"].map(lambda b: wkb(bytes(b)) if b is not None else None)
            yield f

    features = numbered.mapInPandas(parse, FEATURE)
    layers = spark.createDataFrame([(0, path, "OGC:CRS84")], "layer_idx int, name string, crs string")
    return Dataset(compute_layers(features, layers), features, path)
