"""Schemas of layers, features and findings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodiag.config import Config

#: parts[].rings: a point or line has one ring; a polygon's first ring is its exterior
GEOM = "struct<gtype:string,parts:array<struct<kind:string,rings:array<array<struct<x:double,y:double>>>>>>"
BOUNDS = "struct<min_x:double,min_y:double,max_x:double,max_y:double>"
LAYER = f"layer_idx int, name string, crs string, bounds {BOUNDS}"
#: properties hold each value's JSON text
FEATURE = f"layer_idx int, feat_idx long, id string, geom {GEOM}, properties map<string,string>"
LOCATION = "struct<type:string,id:string,name:string,min_x:double,min_y:double,max_x:double,max_y:double>"
FINDING = f"rule_id string, severity string, severity_rank int, message string, location {LOCATION}, geom {GEOM}, metric double, suggestion string, fixable boolean, rule_ord int, layer_idx int, feat_idx long, sub_key string"
RANK = {"info": 0, "warning": 1, "error": 2}
WORLD = (-180.0, -90.0, 180.0, 90.0)
GEOGRAPHIC = ("EPSG:4326", "OGC:CRS84")


@dataclass
class Dataset:
    """Layers and features as DataFrames. ``layers`` has a row for each layer, empty ones too."""

    layers: DataFrame
    features: DataFrame
    path: str = ""

    @property
    def spark(self) -> SparkSession:
        return self.layers.sparkSession

    def layer(self, idx: int) -> Dataset:
        return Dataset(self.layers.where(F.col("layer_idx") == idx), self.features.where(F.col("layer_idx") == idx), self.path)

    def cached(self) -> Dataset:
        return Dataset(self.layers.cache(), self.features.cache(), self.path)


@dataclass
class CheckContext:
    """What rules see; ``memo`` shares subplans between rules of one run."""

    data: Dataset
    config: Config = field(default_factory=Config)
    memo: dict = field(default_factory=dict)

    @property
    def layers(self) -> DataFrame:
        return self.data.layers

    @property
    def features(self) -> DataFrame:
        return self.data.features

    def shared(self, key, make):
        if key not in self.memo:
            self.memo[key] = make()
        return self.memo[key]


def label() -> Column:
    """A feature's id, or # and its place in the layer."""
    return F.coalesce(F.col("id"), F.concat(F.lit("#"), F.col("feat_idx").cast("string")))


def at_layer(name: Column) -> Column:
    return _location("layer", name=name)


def at_feature(name: Column) -> Column:
    return _location("feature", id=name)


def at_box(bounds: Column) -> Column:
    return _location("bounding_box", **{c: bounds[c] for c in ("min_x", "min_y", "max_x", "max_y")})


def _location(kind: str, **known: Column) -> Column:
    strings, doubles = ("id", "name"), ("min_x", "min_y", "max_x", "max_y")
    return F.struct(F.lit(kind).alias("type"), *(known.get(c, F.lit(None).cast("string")).alias(c) for c in strings), *(known.get(c, F.lit(None).cast("double")).alias(c) for c in doubles))


def compute_layers(features: DataFrame, layers: DataFrame) -> DataFrame:
    """``layers`` (layer_idx, name, crs) with bounds: the extent of each layer's features, null if they have no points."""
    from geodiag.functions.geometry import bbox

    boxed = features.select("layer_idx", bbox(F.col("geom")).alias("b")).where("b is not null")
    agg = boxed.groupBy("layer_idx").agg(F.struct(F.min("b.min_x").alias("min_x"), F.min("b.min_y").alias("min_y"), F.max("b.max_x").alias("max_x"), F.max("b.max_y").alias("max_y")).alias("bounds"))
    return layers.select("layer_idx", "name", "crs").join(agg, "layer_idx", "left")
