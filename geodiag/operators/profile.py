"""Dataset profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.functions import geometry as g
from geodiag.model import Dataset


def profile(data: Dataset) -> DataFrame:
    """A row per layer: ``layer_idx, name, feature_count, geometry_type, crs, extent, field_count, null_geometry_count``.

    The geometry type is the only one, or ``Mixed (primarily T)`` of the commonest (ties by name); None without geometries.
    """
    f = data.features
    counts = f.groupBy("layer_idx").agg(F.count(F.lit(1)).alias("feature_count"), F.count_if(g.is_empty(F.col("geom"))).alias("null_geometry_count"))
    types = f.where("geom is not null").groupBy("layer_idx", F.col("geom.gtype").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    # at most ten types a layer
    top = types.groupBy("layer_idx").agg(F.count(F.lit(1)).alias("kinds"), F.min(F.struct((-F.col("n")).alias("m"), "t"))["t"].alias("t"))
    fields = f.select("layer_idx", F.explode(F.map_keys("properties")).alias("k")).groupBy("layer_idx").agg(F.count_distinct("k").alias("field_count"))
    kind = F.when(F.col("kinds").isNull(), "None").when(F.col("kinds") == 1, F.col("t")).otherwise(F.concat(F.lit("Mixed (primarily "), "t", F.lit(")")))
    joined = data.layers.join(counts, "layer_idx", "left").join(top, "layer_idx", "left").join(fields, "layer_idx", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("layer_idx", "name", n("feature_count"), kind.alias("geometry_type"), "crs", F.col("bounds").alias("extent"), n("field_count"), n("null_geometry_count"))


# fixed values: formats by file ending
FORMATS = (
    ((".geojson", ".json"), "GeoJSON", ".geojson", False, None),
    ((".gpkg",), "GeoPackage", ".gpkg", False, "https://guide.cloudnativegeo.org/geopackage/"),
    ((".shp",), "Shapefile", ".shp", False, None),
    ((".fgb",), "FlatGeobuf", ".fgb", True, "https://guide.cloudnativegeo.org/flatgeobuf/"),
    ((".parquet", ".geoparquet"), "GeoParquet", ".parquet", True, "https://guide.cloudnativegeo.org/geoparquet/"),
    ((".pmtiles",), "PMTiles", ".pmtiles", True, "https://guide.cloudnativegeo.org/pmtiles/"),
    ((".tif", ".tiff"), "GeoTIFF", ".tif", False, "https://guide.cloudnativegeo.org/cloud-optimized-geotiffs/"),
    ((".qgz",), "QGIS Project", ".qgz", False, None),
    ((".qgs",), "QGIS Project", ".qgs", False, None),
)


def format_info(paths: DataFrame, column: str = "path") -> DataFrame:
    """``path`` with ``name, extension, cloud_optimized, guide_url`` by its ending; null for others."""
    low = F.lower(column)
    info = F.lit(None)
    for ends, name, ext, cloud, url in reversed(FORMATS):
        hit = F.lit(False)
        for e in ends:
            hit = hit | low.endswith(e)
        info = F.when(hit, F.struct(F.lit(name).alias("name"), F.lit(ext).alias("extension"), F.lit(cloud).alias("cloud_optimized"), F.lit(url).cast("string").alias("guide_url"))).otherwise(info)
    return paths.select("*", info.alias("i")).select(*paths.columns, "i.name", "i.extension", "i.cloud_optimized", "i.guide_url")
