"""Whole runs over a file: what the command line and other programs call. Each returns plain dictionaries."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geodiag.config import Config
from geodiag.errors import ConfigError, GeodiagError
from geodiag.model import WORLD, CheckContext, Dataset
from geodiag.operators import compare, fix as repairs, profile as profiles, rules, schema as schemas, score as scores, snap as snapping, xray as distortion
from geodiag.operators.explain import explain as explain_codes
from geodiag.operators.recommend import recommend, recommend_measured
from geodiag.reports import sinks
from geodiag.sources.files import read_file


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def xray(spark: SparkSession, path: str, config: Config | None = None, top: int | None = None, geometry: bool = False, crs: str | None = None) -> dict:
    """Distortion of the first layer. ``crs`` is only used in exact mode."""
    config = config or Config()
    data = read_file(spark, path).layer(0)
    layer = data.layers.first()
    if layer is None:
        raise GeodiagError("No layers found in input file")
    source = layer.crs or "EPSG:4326"
    if config.mode == "exact" and crs:
        source = crs
    b = layer.bounds
    bounds = (b.min_x, b.min_y, b.max_x, b.max_y) if b is not None else WORLD
    samples = distortion.sample_layer(data.features, source, config.xray.max_samples, config.mode).cache()
    extent = data.layers.select("layer_idx", F.coalesce("bounds", F.struct(*(F.lit(v).alias(n) for v, n in zip(WORLD, ("min_x", "min_y", "max_x", "max_y"))))).alias("bounds"))
    top = config.xray.top_recommendations if top is None else top
    best = recommend(extent, top)
    x = config.xray
    measured = recommend_measured(samples, extent, data.layers, x.optimize_for, top, x.include_crs, x.exclude_crs, config.mode)
    grid = distortion.heatmap(samples, bounds)
    out = {"file_path": path, "source_crs": source, "summary": _rows(distortion.summary(samples))[0], "samples": _rows(samples.drop("layer_idx", "feat_idx", "sample_idx").orderBy("lon", "lat")), "recommendations": _rows(best.drop("layer_idx", "rank").orderBy(F.desc("fitness"))), "candidates": _rows(measured.drop("layer_idx").orderBy("rank"))}
    cells = _rows(grid.orderBy("row", "col").select("value"))
    n = distortion.GRID
    out["heatmap"] = {"bounds": list(bounds), "cols": n, "rows": n, "values": [c["value"] for c in cells], "cell_width": max((bounds[2] - bounds[0]) / n, 0.001 if bounds[2] <= bounds[0] else 0), "cell_height": max((bounds[3] - bounds[1]) / n, 0.001 if bounds[3] <= bounds[1] else 0)}
    out["ellipses"] = _rows(distortion.ellipses(samples).drop("sample_idx", "layer_idx"))
    if geometry:
        out["ellipse_features"] = sinks.feature_collection(sinks.ellipse_features(distortion.ellipses(samples)))
        out["heatmap_features"] = sinks.feature_collection(sinks.heatmap_features(distortion.heatmap_cells(grid, bounds)))
    return out


def _checked(spark, path, config, domain=None):
    ctx = CheckContext(read_file(spark, path).cached(), config)
    return rules.ordered(rules.run_checks(ctx, rules.parse_domain(domain))).cache()


def check(spark: SparkSession, path: str, domain: str | None = None, config: Config | None = None) -> dict:
    """Findings, their counts, and the score of these findings. An unknown domain means all; in exact mode it's an error."""
    config = config or Config()
    if domain and config.mode == "exact" and rules.parse_domain(domain) is None:
        raise ConfigError(f"unknown domain {domain}")
    found = _checked(spark, path, config, domain)
    return {"file_path": path, "findings": sinks.finding_rows(found), "summary": {**_rows(scores.summary(found))[0], "by_domain": {r["domain"]: r["n"] for r in _rows(scores.by_domain(found))}}, "features": sinks.feature_collection(sinks.finding_features(found))}


def score(spark: SparkSession, path: str, config: Config | None = None, badge: str | None = None) -> dict:
    config = config or Config()
    found = _checked(spark, path, config)
    cats = scores.categories(found, config)
    out = _rows(scores.overall(cats, found))[0] | {"categories": _rows(cats.orderBy("ord").drop("ord"))}
    out["category_breakdown"] = {c["category"]: c["score"] for c in out["categories"]}
    if badge:
        with open(badge, "w", encoding="utf-8") as f:
            f.write(sinks.badge(out["overall"], out["grade"]))
    return out


def diff(spark: SparkSession, left: str, right: str) -> dict:
    report = compare.compare(read_file(spark, left), read_file(spark, right))
    return _rows(report)[0] | {"changes": _rows(compare.changes(report))}


def fix(spark: SparkSession, path: str, reproject: str | None = None, topology: bool = False, in_place: bool = False, snap: float | None = None, schema: bool = False, preview: bool = False) -> dict:
    """One repair, the first of those asked for in the order of the arguments; with ``preview`` what it would change, and nothing is written.

    Snapping and schema repair tell the findings of their rules before and after under ``verified``. Writes a GeoJSON file beside the input, or over it if it's GeoJSON."""
    data, changes, checked = read_file(spark, path), [], ()
    if reproject:
        out, report = repairs.reproject_dataset(data, reproject)
        suffix = "_fixed"
    elif topology:
        out, report = repairs.heal(data)
        suffix = "_topology_fixed"
    elif snap is not None:
        out, counts = snapping.snap(data, snap)
        report, suffix = repairs._report(data, counts.agg(F.sum("features").alias("updated_features")), [f"Snapped polygons within {snap}"]), "_snapped"
        checked = ("data/topology-gaps", "data/topology-overlaps")
    elif schema:
        out, suffix, checked = schemas.normalize(data), "_schema_fixed", ("data/schema-validate",)
        changes = _rows(schemas.preview(data).orderBy("layer_idx", "field"))
        changed = data.features.select("layer_idx", "feat_idx", F.col("properties").alias("p")).join(out.features.select("layer_idx", "feat_idx", "properties"), ["layer_idx", "feat_idx"]).where(F.to_json(F.array_sort(F.map_entries("p"))) != F.to_json(F.array_sort(F.map_entries("properties"))))
        report = repairs._report(data, changed.agg(F.count(F.lit(1)).alias("updated_features")), ["Normalized field types"])
    else:
        raise ConfigError("Specify --reproject <CRS>, --topology, --snap <tolerance> or --schema")
    extra = {"changes": changes} if changes else {}
    if preview:
        return _rows(report)[0] | extra
    if checked:
        extra["verified"] = _rows(schemas.verify(data, out, checked).orderBy("rule_id", "severity"))
    stem, ext = os.path.splitext(path)
    if in_place and ext.lower() not in (".geojson", ".json"):
        raise GeodiagError("only GeoJSON files can be overwritten")
    target = path if in_place else f"{stem}{suffix}.geojson"
    text = sinks.feature_collection(sinks.layer_features(out).orderBy("layer_idx", "feat_idx"))
    row = _rows(report)[0]
    with open(target + ".tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(target + ".tmp", target)
    return row | extra | {"output_file": target}


def profile(spark: SparkSession, path: str) -> dict:
    data: Dataset = read_file(spark, path)
    info = _rows(profiles.format_info(spark.createDataFrame([(path,)], "path string")))[0]
    layers = _rows(profiles.profile(data).orderBy("layer_idx"))
    return {"file_path": path, "format_name": info["name"], "file_size_bytes": os.path.getsize(path) if os.path.exists(path) else 0, "layer_count": len(layers), "layers": layers, "format": info}


def explain(spark: SparkSession, crs: str) -> dict | None:
    """None for what isn't an EPSG code."""
    return next(iter(_rows(explain_codes(spark.createDataFrame([(crs,)], "crs string")))), None)
