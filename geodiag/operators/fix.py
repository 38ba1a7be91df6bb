"""Repairs: reprojection, removal of null and duplicate geometries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.functions import geometry as g
from geodiag.functions.projections import GEOGRAPHIC, parameters, project, unproject
from geodiag.model import Dataset, compute_layers


def dedup(features: DataFrame) -> DataFrame:
    """Features with a geometry; of equal geometries across all layers the first is kept.

    The first of each key is an aggregate over hashes, combined before the shuffle; geometries
    meet their key in a semi-join.
    """
    keyed = features.where("geom is not null").withColumn("__k", F.sha2(g.key(F.col("geom")), 256))
    first = keyed.groupBy("__k").agg(F.min(F.struct("layer_idx", "feat_idx")).alias("f")).select(F.col("f.layer_idx").alias("layer_idx"), F.col("f.feat_idx").alias("feat_idx"))
    return keyed.drop("__k").join(first, ["layer_idx", "feat_idx"], "left_semi")


def reproject(features: DataFrame, source: str, target: str) -> DataFrame:
    """Features with every vertex taken from one system to another, by way of longitude and latitude; a vertex that can't be stays as it is."""
    parameters(source), parameters(target)  # unknown systems are told before any work

    def move(x, y):
        if source in GEOGRAPHIC:
            return project(target, x, y)
        back = unproject(source, x, y)
        return back if target in GEOGRAPHIC else g.let(back, lambda p: project(target, p["x"], p["y"]))

    return features.withColumn("geom", g.map_coords(F.col("geom"), move))


def heal(data: Dataset) -> tuple[Dataset, DataFrame]:
    """The dataset without null and duplicate geometries, and a one-row report."""
    kept = dedup(data.features)
    out = Dataset(compute_layers(kept, data.layers), kept, data.path)
    return out, _report(data, kept.agg(F.count(F.lit(1)).alias("updated_features")), ["Removed null geometries", "Removed duplicate geometries"])


def reproject_dataset(data: Dataset, target: str) -> tuple[Dataset, DataFrame]:
    """All layers by the first layer's CRS (EPSG:4326 if it has none)."""
    first = data.layers.orderBy("layer_idx").select("crs").first()
    source = (first and first.crs) or "EPSG:4326"
    moved = reproject(data.features, source, target)
    layers = compute_layers(moved, data.layers.withColumn("crs", F.lit(target)))
    report = data.features.agg(F.count("geom").alias("updated_features"))
    return Dataset(layers, moved, data.path), _report(data, report, [f"Reprojected coordinates from {source} to {target}"])


def _report(data: Dataset, counted: DataFrame, actions: list[str]) -> DataFrame:
    return counted.select(F.lit(data.path).alias("input_file"), "updated_features", F.array(*map(F.lit, actions)).alias("actions"))
