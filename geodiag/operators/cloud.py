"""Cloud readiness of files: findings about formats, sizes and sidecars. These rules look at files, not features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodiag.model import FINDING, at_layer
from geodiag.operators.rules import findings

MB = 1 << 20
#: how often a FlatGeobuf index may cover its extent
OVERLAP = 4.0


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the files below a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def check_files(files: DataFrame) -> DataFrame:
    """Findings of the ``cloud/`` rules over ``path, length``."""
    f = files.select("path", "length", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), F.lit(0).alias("layer_idx"))
    ext, size = F.col("ext"), F.col("length")
    parquet = ext.isin("parquet", "geoparquet")

    def rule(rows: DataFrame, id: str, severity: str, message, advice: str, metric=None) -> DataFrame:
        return findings(rows, id, severity, message, at_layer(F.col("path")), advice, metric, sub=F.col("path"))

    shp = f.where("ext = 'shp'")
    sides = f.groupBy("stem").agg(F.collect_set("ext").alias("there")).withColumnRenamed("stem", "s")  # a stem's endings are few
    sided = shp.join(sides, F.col("stem") == F.col("s"))
    out = rule(f.where(ext.isin("shp", "gpkg") | (ext.isin("geojson", "json") & (size > 10 * MB))), "cloud/format-recommendation", "info", F.concat("path", F.lit(" isn't in a cloud-optimized format")), "Convert to FlatGeobuf or GeoParquet", size)
    for rows, text in ((f.where(size > 2048 * MB), " is larger than 2 GB"), (f.where(parquet & (size < MB)), " is a Parquet file of less than 1 MB")):
        out = out.unionByName(rule(rows, "cloud/file-size", "warning", F.concat("path", F.lit(text)), "Split or merge files to between 1 MB and 2 GB", size))
    out = out.unionByName(rule(sided.where(~F.array_contains("there", "prj")), "cloud/crs-metadata", "error", F.concat("path", F.lit(" has no .prj file")), "Write the coordinate system beside the file"))
    missing = F.array_except(F.array(F.lit("shx"), F.lit("dbf")), "there")
    out = out.unionByName(rule(sided.where(F.size(missing) > 0), "cloud/multi-file-integrity", "error", F.concat("path", F.lit(" lacks ."), F.array_join(missing, ", .")), "Keep .shp, .shx and .dbf together"))
    return out.select(*[c.split()[0] for c in _top_level(FINDING)])


def check_footers(footers: DataFrame) -> DataFrame:
    """Findings of the ``cloud/`` rules over Parquet footers (:func:`geodiag.sources.geoparquet.footers`): compression, spatial index, system."""
    file = footers.groupBy("path").agg(
        F.bool_and(F.coalesce(F.col("codec") == "UNCOMPRESSED", F.lit(True))).alias("plain"), F.count("column").alias("chunks"), F.max("geo").alias("geo"), F.max("n_bytes").alias("n_bytes"),
        F.coalesce(F.bool_or(F.col("column").rlike(r"^bbox[.]|^(xmin|minx|min_x)$")), F.lit(False)).alias("boxed"), F.lit(0).alias("layer_idx"),
    )
    geo = F.col("geo")
    indexed = F.col("boxed") | F.coalesce(geo.rlike(r'"covering"\s*:\s*[{]'), F.lit(False))

    def rule(rows, id, severity, text, advice):
        return findings(rows, id, severity, F.concat("path", F.lit(text)), at_layer(F.col("path")), advice, F.col("n_bytes"), sub=F.col("path"))

    out = rule(file.where("plain and chunks > 0"), "cloud/compression", "info", " uses no compression", "Write it with Zstandard compression")
    out = out.unionByName(rule(file.where(~indexed), "cloud/spatial-index", "warning", " has no bounding boxes, so spatial queries read all of it", "Write a bbox column and name it as the geometry's covering"))
    out = out.unionByName(rule(file.where(geo.isNull()), "cloud/crs-metadata", "error", " has no geo key", "Write GeoParquet metadata with the coordinate system"))
    return out.unionByName(rule(file.where(geo.rlike(r'"crs"\s*:\s*null')), "cloud/crs-metadata", "error", " doesn't say its coordinate system", "Write the coordinate system to the geo key"))


def check_headers(headers: DataFrame) -> DataFrame:
    """Findings of the ``cloud/`` rules over FlatGeobuf headers (:func:`geodiag.sources.flatgeobuf.headers`): spatial index, system.

    A file without features needs no index. The tree's boxes below its root may cover the root's area :data:`OVERLAP` times before it counts as unsorted.
    """
    h = headers.withColumn("layer_idx", F.lit(0))

    def rule(rows, id, severity, text, advice, metric):
        return findings(rows, id, severity, F.concat("path", text), at_layer(F.col("path")), advice, metric, sub=F.col("path"))

    out = rule(h.where("error is null and n_features > 0 and index_bytes = 0"), "cloud/spatial-index", "warning", F.lit(" has no spatial index, so spatial queries read all of it"), "Write it with a packed Hilbert tree", F.col("n_bytes"))
    out = out.unionByName(rule(h.where(F.col("share") > OVERLAP), "cloud/spatial-index", "info", F.lit(" has an index whose boxes overlap"), "Sort features along a Hilbert curve before writing", F.col("share")))
    out = out.unionByName(rule(h.where("error is not null"), "cloud/integrity", "error", F.concat(F.lit(" can't be used: "), "error"), "Write the file anew", F.col("n_bytes")))
    return out.unionByName(rule(h.where("n_features is not null and crs is null"), "cloud/crs-metadata", "error", F.lit(" doesn't say its coordinate system"), "Write the coordinate system to the header", F.col("n_bytes")))


def group_boxes(footers: DataFrame) -> DataFrame:
    """``path, row_group, n_rows, min_x, min_y, max_x, max_y`` of row groups whose bbox columns have statistics: what a reader skips by."""
    of = lambda c, v: F.max(F.when(F.col("column") == f"bbox.{c}", F.col(v))).alias(c)
    boxes = footers.where("row_group is not null").groupBy("path", "row_group").agg(F.max("group_rows").alias("n_rows"), of("min_x", "least"), of("min_y", "least"), of("max_x", "most"), of("max_y", "most"))
    return boxes.where("min_x is not null and max_y is not null")


def box_share(boxes: DataFrame) -> DataFrame:
    """``groups, share``: the boxes' areas against that of their extent. 1 where they tile it, as many as there are groups where each spans all of it."""
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    whole = (F.max("max_x") - F.min("min_x")) * (F.max("max_y") - F.min("min_y"))
    return boxes.agg(F.count(F.lit(1)).alias("groups"), (F.sum(area) / F.when(whole > 0, whole)).alias("share"))


def _top_level(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]
