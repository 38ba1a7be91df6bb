"""GeoJSON reader: expressions over whole files, or over lines of GeoJSON text sequences for large data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodiag.errors import GeoJsonError, ReadError
from geodiag.model import GEOM, Dataset, compute_layers

_FEATURE = "struct<type:string,id:variant,geometry:string,properties:map<string,variant>>"
_DOC = "type string, id variant, geometry string, properties map<string,variant>, features array<struct<type:string,id:variant,geometry:string,properties:map<string,variant>>>, coordinates string, geometries string"
_SINGLE = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")


def _positions(depth: int) -> str:
    return "array<" * depth + "double" + ">" * depth


def _parts(kind: Column, coords: Column) -> Column:
    """Parts of a geometry that isn't a collection, from its type and its coordinates' text."""
    xy = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    ring = lambda r: F.transform(r, xy)
    part = lambda k, rings: F.struct(F.lit(k).alias("kind"), rings.alias("rings"))
    read = lambda d: F.from_json(coords, _positions(d))
    return (
        F.when(kind == "Point", F.filter(F.array(part("point", F.array(F.array(xy(read(1)))))), lambda p: F.size(read(1)) >= 2))
        .when(kind == "MultiPoint", F.transform(read(2), lambda p: part("point", F.array(F.array(xy(p))))))
        .when(kind == "LineString", F.array(part("line", F.array(ring(read(2))))))
        .when(kind == "MultiLineString", F.transform(read(3), lambda r: part("line", F.array(ring(r)))))
        .when(kind == "Polygon", F.array(part("polygon", F.transform(read(3), ring))))
        .when(kind == "MultiPolygon", F.transform(read(4), lambda p: part("polygon", F.transform(p, ring))))
    )


def geometry(text: Column) -> Column:
    """Geometry struct of a GeoJSON geometry's text; null for null or unknown types."""
    kind = F.get_json_object(text, "$.type")
    members = F.from_json(F.get_json_object(text, "$.geometries"), "array<struct<type:string,coordinates:string>>")
    parts = F.when(kind == "GeometryCollection", F.flatten(F.transform(members, lambda m: F.coalesce(_parts(m["type"], m["coordinates"]), F.array().cast("array<struct<kind:string,rings:array<array<struct<x:double,y:double>>>>>"))))).otherwise(_parts(kind, F.get_json_object(text, "$.coordinates")))
    return F.when(parts.isNotNull(), F.struct(kind.alias("gtype"), parts.alias("parts"))).cast(GEOM)


def _id(v: Column) -> Column:
    """A string or number as text."""
    text = F.to_json(v)
    return F.when(text.startswith('"') | text.rlike(r"^-?[0-9]"), F.when(text.startswith('"'), F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0]).otherwise(text))


def _properties(m: Column) -> Column:
    texts = F.transform_values(F.coalesce(m, F.create_map().cast("map<string,variant>")), lambda k, x: F.to_json(x))
    return F.map_filter(texts, lambda k, x: x.isNotNull() & (x != "null"))


def features_of(parsed: DataFrame) -> DataFrame:
    """``layer_idx, feat_idx`` and a raw feature struct ``f`` to features."""
    return parsed.select("layer_idx", "feat_idx", _id(F.col("f.id")).alias("id"), geometry(F.col("f.geometry")).alias("geom"), _properties(F.col("f.properties")).alias("properties"))


def read_text(rows: DataFrame, name: str) -> Dataset:
    """``rows`` with one column ``value`` and one row, a whole document, as one layer labelled EPSG:4326.

    A FeatureCollection, a Feature or a bare geometry; anything else fails.
    """
    spark = rows.sparkSession
    doc = rows.select(F.lit(0).alias("layer_idx"), "value", F.from_json("value", _DOC, {"mode": "PERMISSIVE"}).alias("d"))
    kind = F.col("d.type")
    bad = F.concat(F.lit("GeoJSON error: not a FeatureCollection, Feature or geometry: "), F.substring("value", 1, 60))
    none = F.lit(None)
    feature = F.struct(kind.alias("type"), F.col("d.id").alias("id"), F.col("d.geometry").alias("geometry"), F.col("d.properties").alias("properties")).cast(_FEATURE)
    bare = F.struct(F.lit("Feature").alias("type"), none.cast("variant").alias("id"), F.col("value").alias("geometry"), none.cast("map<string,variant>").alias("properties")).cast(_FEATURE)
    all_ = F.when(kind == "FeatureCollection", F.coalesce("d.features", F.array().cast(f"array<{_FEATURE}>"))).when(kind == "Feature", F.array(feature)).when(kind.isin(*_SINGLE, "GeometryCollection"), F.array(bare)).otherwise(F.raise_error(bad).cast(f"array<{_FEATURE}>"))
    flat = doc.select("layer_idx", F.posexplode(all_).alias("i", "f")).select("layer_idx", F.col("i").cast("long").alias("feat_idx"), "f")
    features = features_of(flat)
    layers = spark.range(1).select(F.lit(0).alias("layer_idx"), F.lit(name).alias("name"), F.lit("EPSG:4326").alias("crs"))
    return Dataset(compute_layers(features, layers), features, name)


def read(spark: SparkSession, path: str) -> Dataset:
    """A GeoJSON file as one layer named by its path. The document is one value, so use :func:`read_sequence` for large data."""
    try:
        rows = spark.read.text(path, wholetext=True)
        if rows.isEmpty():
            raise GeoJsonError(f"{path} is empty")
    except GeoJsonError:
        raise
    except Exception as e:
        raise ReadError(str(e).splitlines()[0]) from e
    return read_text(rows, path)


def read_str(spark: SparkSession, content: str, name: str = "inline") -> Dataset:
    return read_text(spark.createDataFrame([(content,)], "value string"), name)


def read_sequence(spark: SparkSession, path: str) -> Dataset:
    """One GeoJSON feature a line, split over tasks like any text. Features are numbered by file position."""
    lines = spark.read.text(path, lineSep="\n").where(F.length(F.trim("value")) > 0)
    f = F.from_json(F.regexp_replace("value", "^\x1e", ""), _FEATURE)
    parsed = lines.select(F.lit(0).alias("layer_idx"), F.monotonically_increasing_id().alias("feat_idx"), f.alias("f"))
    features = features_of(parsed)
    layers = spark.range(1).select(F.lit(0).alias("layer_idx"), F.lit(path).alias("name"), F.lit("EPSG:4326").alias("crs"))
    return Dataset(compute_layers(features, layers), features, path)
