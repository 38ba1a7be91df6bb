"""Layers derived from plain tables by arithmetic: points of ``events``, squares of ``orders``, names of ``region``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodiag.functions import geometry as g
from geodiag.model import Dataset


def layer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    crs = F.when(k == 0, "EPSG:4326").when(k == 1, "EPSG:3857").when(k == 2, "EPSG:32617").when(k == 4, "EPSG:5070")
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(k.cast("int").alias("layer_idx"), F.col("r_name").alias("name"), crs.alias("crs"))


def point_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``layer_idx, feat_idx, id, lon, lat, props`` with nulls, missing ids and mixed properties."""
    e = F.col("event_id")
    gone = e % 17 == 0
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (e % 4).cast("int").alias("layer_idx"), e.alias("feat_idx"), F.when(e % 7 != 0, e.cast("string")).alias("id"),
        F.when(~gone, ((e * 7919) % 36000).cast("double") / 100 - 180).alias("lon"), F.when(~gone, ((e * 104729) % 16000).cast("double") / 100 - 80).alias("lat"),
        F.when(e % 19 == 0, "{}").when(e % 13 == 0, '{"k": "x"}').otherwise(F.col("props")).alias("props"),
    )


def properties(json: Column) -> Column:
    """Each value's JSON text of a flat object."""
    v = F.from_json(json, "map<string,variant>")
    return F.map_filter(F.transform_values(v, lambda k, x: F.to_json(x)), lambda k, x: x.isNotNull() & (x != "null"))


BOX = (-180.0, -80.0, 170.0, 75.0)


def points(spark: SparkSession, sf_dir: str, bounds: tuple[float, float, float, float] | None = BOX) -> Dataset:
    """Five layers of points; layer 4 is empty. ``bounds`` are declared for every layer; layer 2 is in a cylindrical equal-area system here."""
    p = point_columns(spark, sf_dir)
    features = p.select("layer_idx", "feat_idx", "id", g.point(F.col("lon"), F.col("lat")).alias("geom"), properties(F.col("props")).alias("properties"))
    box = F.struct(*(F.lit(v).alias(n) for v, n in zip(bounds, ("min_x", "min_y", "max_x", "max_y")))) if bounds else F.lit(None).cast("struct<min_x:double,min_y:double,max_x:double,max_y:double>")
    layers = layer_table(spark, sf_dir).withColumn("crs", F.when(F.col("layer_idx") == 2, "EPSG:6933").otherwise(F.col("crs")))
    return Dataset(layers.withColumn("bounds", box), features, "events")


def plots(spark: SparkSession, sf_dir: str) -> Dataset:
    """One layer of squares of ``orders`` in longitude and latitude, away from the poles; every 5th has a square hole."""
    o = F.col("o_orderkey")
    x, y, w = (o % 331).cast("double") - 170, (F.col("o_custkey") % 137).cast("double") - 70, (1 + o % 3).cast("double")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    square = lambda x, y, w: F.array(p(x, y), p(x + w, y), p(x + w, y + w), p(x, y + w), p(x, y))
    rings = F.when(o % 5 == 0, F.array(square(x, y, w), square(x + w / 4, y + w / 4, w / 2))).otherwise(F.array(square(x, y, w)))
    features = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(0).alias("layer_idx"), o.cast("long").alias("feat_idx"), o.cast("string").alias("id"), g.polygon(rings).alias("geom"), F.create_map().cast("map<string,string>").alias("properties"))
    layers = spark.range(1).select(F.lit(0).alias("layer_idx"), F.lit("plots").alias("name"), F.lit("EPSG:4326").alias("crs"), F.lit(None).cast("struct<min_x:double,min_y:double,max_x:double,max_y:double>").alias("bounds"))
    return Dataset(layers, features, sf_dir)


def quads(spark: SparkSession, sf_dir: str, dense: bool = True) -> Dataset:
    """One layer of squares of ``orders``, every 11th a bowtie. ``dense=False`` spreads them to a plane that grows with the table."""
    o = F.col("o_orderkey")
    table = spark.read.parquet(f"{sf_dir}/orders.parquet")
    if dense:
        x, y = (o % 97).cast("double"), (F.col("o_custkey") % 89).cast("double")
    else:
        x, y = (o * 7 % 1009).cast("double"), F.floor(o * 7 / 1009).cast("double")
    w = (1 + o % 3).cast("double")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    bow = o % 11 == 0
    ring = F.array(p(x, y), p(x + w, y), F.when(bow, p(x, y + w)).otherwise(p(x + w, y + w)), F.when(bow, p(x + w, y + w)).otherwise(p(x, y + w)), p(x, y))
    features = table.select(F.lit(0).alias("layer_idx"), o.cast("long").alias("feat_idx"), o.cast("string").alias("id"), g.polygon(F.array(ring)).alias("geom"), F.create_map().cast("map<string,string>").alias("properties"))
    layers = spark.range(1).select(F.lit(0).alias("layer_idx"), F.lit("quads").alias("name"), F.lit("EPSG:4326").alias("crs"), F.lit(None).cast("struct<min_x:double,min_y:double,max_x:double,max_y:double>").alias("bounds"))
    return Dataset(layers, features, sf_dir)
