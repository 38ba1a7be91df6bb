"""Comparison of two datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.functions import geometry as g
from geodiag.model import Dataset


def union_bounds(layers: DataFrame) -> DataFrame:
    """One row: the extent of all layers, null if none has one."""
    b = layers.agg(F.min("bounds.min_x").alias("min_x"), F.min("bounds.min_y").alias("min_y"), F.max("bounds.max_x").alias("max_x"), F.max("bounds.max_y").alias("max_y"))
    return b.select(F.when(F.col("min_x").isNotNull(), F.struct("min_x", "min_y", "max_x", "max_y")).alias("bounds"))


def compare(left: Dataset, right: Dataset) -> DataFrame:
    """One row: counts, how many more or fewer features, whether the extent changed."""
    n = lambda d, name: d.features.agg(F.count(F.lit(1)).alias(name))
    one = n(left, "left_features").join(F.broadcast(n(right, "right_features")))
    for d, name in ((left, "lb"), (right, "rb")):
        one = one.join(F.broadcast(union_bounds(d.layers).withColumnRenamed("bounds", name)))
    l, r = F.col("left_features"), F.col("right_features")
    zero = F.lit(0).cast("long")
    return one.select(F.lit(left.path).alias("left_file"), F.lit(right.path).alias("right_file"), l, r, F.greatest(r - l, zero).alias("added"), F.greatest(l - r, zero).alias("removed"), (~F.col("lb").eqNullSafe(F.col("rb"))).alias("extent_changed"))


def changes(report: DataFrame) -> DataFrame:
    """Rows ``change, id``: added-i, removed-i, or one extent row if only that changed."""
    ids = lambda n, kind: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.col(n)), lambda i: F.struct(F.lit(kind).alias("change"), F.concat(F.lit(f"{kind}-"), i.cast("string")).alias("id")))).otherwise(F.array())
    extent = F.when((F.col("added") == 0) & (F.col("removed") == 0) & F.col("extent_changed"), F.array(F.struct(F.lit("modified").alias("change"), F.lit("extent").alias("id")))).otherwise(F.array())
    return report.select(F.explode(F.concat(ids("added", "added"), ids("removed", "removed"), extent)).alias("c")).select("c.*")


def feature_changes(left: Dataset, right: Dataset) -> DataFrame:
    """Features by id: added, removed, geometry or properties changed, moved by exact text; unchanged ones are left out.

    Features without id are matched by geometry. Hashes, not geometries, are joined.
    """

    def keyed(d: Dataset, s: str) -> DataFrame:
        gk = F.sha2(F.coalesce(g.key(F.col("geom")), F.lit("")), 256)
        pk = F.sha2(F.to_json(F.array_sort(F.map_entries("properties"))), 256)
        k = F.coalesce(F.concat(F.lit("id:"), F.col("id")), F.concat(F.lit("geom:"), gk))
        return d.features.groupBy(k.alias("k")).agg(F.min(gk).alias(f"g{s}"), F.min(pk).alias(f"p{s}"), F.count(F.lit(1)).alias(f"n{s}"))

    j = keyed(left, "l").join(keyed(right, "r"), "k", "full_outer")
    kind = F.when(F.col("nl").isNull(), "added").when(F.col("nr").isNull(), "removed").when(F.col("gl") != F.col("gr"), "geometry").when(~F.col("pl").eqNullSafe(F.col("pr")), "properties").when(F.col("nl") != F.col("nr"), "count")
    return j.select("k", kind.alias("change")).where("change is not null")


def join_findings(features: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings about single features with the feature's geometry, by id or by an ``id``, ``fid`` or ``feature_id`` property."""
    own = lambda k: F.regexp_replace(F.element_at("properties", k), '^"|"$', "")
    keys = F.array_distinct(F.filter(F.array(F.col("id"), own("id"), own("fid"), own("feature_id")), lambda x: x.isNotNull()))
    f = features.select(F.explode(keys).alias("key"), F.col("geom").alias("feature_geom"), F.col("layer_idx").alias("feature_layer"), F.col("feat_idx").alias("feature_idx"))
    f = f.groupBy("key").agg(F.min(F.struct("feature_layer", "feature_idx")).alias("at"), F.min_by("feature_geom", F.struct("feature_layer", "feature_idx")).alias("feature_geom"))
    return findings.where("location.type = 'feature'").join(f, F.col("location.id") == F.col("key"))
