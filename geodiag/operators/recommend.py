"""CRS recommendations by the extent's scope and centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodiag.functions.projections import project, with_parameters
from geodiag.functions.text import number
from geodiag.operators import xray
from geodiag.runtime import materialize


def scope(bounds: Column) -> Column:
    """local, regional, continental or global by the larger span in degrees."""
    span = F.greatest(bounds["max_x"] - bounds["min_x"], bounds["max_y"] - bounds["min_y"])
    return F.when(span < 2, "local").when(span < 10, "regional").when(span < 60, "continental").otherwise("global")


def utm_zone(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Code and name of the UTM zone; longitude 180 gives zone 61, below -180 zone 1."""
    z = (F.greatest(F.floor((lon + 180.0) / 6.0), F.lit(0)) + 1).cast("int")
    north = lat >= 0
    code = F.concat(F.lit("EPSG:"), (z + F.when(north, 32600).otherwise(32700)).cast("string"))
    return code, F.concat(F.lit("UTM Zone "), z.cast("string"), F.when(north, "N").otherwise("S"))


def candidates(extents: DataFrame) -> DataFrame:
    """``extents`` (layer_idx, bounds) to candidates: ``layer_idx, crs, name, rationale, target, fitness, max_area_distortion_pct, max_angular_distortion_deg, ord``."""
    b = F.col("bounds")
    lon, lat = (b["min_x"] + b["max_x"]) / 2.0, (b["min_y"] + b["max_y"]) / 2.0
    s = scope(b)
    base = extents.select("layer_idx", lon.alias("lon"), lat.alias("lat"), s.alias("scope"))
    lon, lat, s = F.col("lon"), F.col("lat"), F.col("scope")
    near, code_name = s.isin("local", "regional"), utm_zone(lon, lat)
    own = lambda kind: F.concat(F.lit(f"+proj={kind} +lat_1="), number(lat - 2.0), F.lit(" +lat_2="), number(lat + 2.0), F.lit(" +lat_0="), number(lat), F.lit(" +lon_0="), number(lon), F.lit(" +datum=WGS84"))
    order = iter(range(100))

    def candidate(when, crs, name, rationale, target, fitness, area, angle):
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        row = F.struct(lit(crs).alias("crs"), lit(name).alias("name"), F.lit(rationale).alias("rationale"), F.lit(target).alias("target"), lit(fitness).cast("double").alias("fitness"), F.lit(area).alias("max_area_distortion_pct"), F.lit(angle).alias("max_angular_distortion_deg"), F.lit(next(order)).alias("ord"))
        return F.when(when, row) if when is not None else row

    # fixed values: candidates, their texts and their fitness
    rows = F.array(
        candidate(None, *code_name, "UTM zone for dataset centroid — good general-purpose projected CRS", "balanced", F.when(near, 0.85).when(s == "continental", 0.60).otherwise(0.30), 0.04, 0.0),
        candidate(near, own("aea"), "Custom Albers Equal Area", "Equal-area projection centered on your data — best for area measurements", "area", 0.90, 0.01, 2.0),
        candidate(near, own("lcc"), "Custom Lambert Conformal Conic", "Conformal projection centered on your data — best for preserving shapes", "shape", 0.85, 3.0, 0.0),
        candidate((s == "continental") & (lat > 20) & (lat < 72) & (lon > -170) & (lon < -50), "EPSG:5070", "NAD83 / Conus Albers", "Standard equal-area projection for CONUS", "area", 0.88, 0.5, 4.0),
        candidate((s == "continental") & (lat > 35) & (lat < 72) & (lon > -12) & (lon < 45), "EPSG:3035", "ETRS89-extended / LAEA Europe", "Standard equal-area projection for Europe", "area", 0.88, 0.5, 4.0),
        candidate(s == "global", "ESRI:54009", "World Mollweide", "Global equal-area projection — best for area comparison", "area", 0.75, 0.0, 20.0),
        candidate(s == "global", "ESRI:54030", "World Robinson", "Good compromise projection for global display", "balanced", 0.70, 5.0, 10.0),
        candidate(s == "global", "EPSG:4326", "WGS 84 (Geographic)", "Unprojected geographic coordinates — no projection distortion but not suitable for area/distance measurements", "balanced", 0.50, 0.0, 0.0),
        candidate(None, "EPSG:3857", "Web Mercator (NOT recommended)", "Web Mercator has severe area distortion away from equator — use only for web tile display", "balanced", 0.20, 30.0, 0.0),
    )
    return base.select("layer_idx", F.explode(F.filter(rows, lambda c: c.isNotNull())).alias("c")).select("layer_idx", "c.*")


def recommend(extents: DataFrame, top: int = 5) -> DataFrame:
    """``extents`` (layer_idx, bounds) to ranked candidates, by their fitness: ``layer_idx, rank, crs, name, rationale, target, fitness, max_area_distortion_pct, max_angular_distortion_deg``."""
    # at most nine rows a layer
    rank = F.row_number().over(Window.partitionBy("layer_idx").orderBy(F.desc("fitness"), "ord"))
    return candidates(extents).withColumn("rank", rank).where(F.col("rank") <= top).drop("ord")


def evaluate(samples: DataFrame, systems: DataFrame, mode: str = "compat") -> DataFrame:
    """Distortion of each of a layer's ``systems`` (layer_idx, crs) at its ``samples`` (layer_idx, sample_idx, lon, lat).

    ``layer_idx, crs, geographic``, the columns of :func:`xray.summary` and ``max_distance_error_pct, mean_distance_error_pct`` of
    consecutive samples. Each system is a row with its parameters, so all layers and systems are one plan; systems that aren't known are left out,
    as are points that a system has no image of. A sample meets the systems of its layer, a handful of rows.
    """
    from geodiag.operators.rules import haversine

    known = materialize(with_parameters(systems.select("layer_idx", "crs").distinct()).where("projection is not null"), "systems")  # a handful of rows for each layer
    pairs = samples.select("layer_idx", "sample_idx", "lon", "lat").join(known, "layer_idx")
    pairs = pairs.withColumn("p", project(F.col("projection"), F.col("lon"), F.col("lat"))).where("p is not null")
    by = ["layer_idx", "crs"]
    measured = xray.measure(pairs.select(*by, "projection", "lon", "lat"), F.col("projection"), mode).where("area_distortion_pct is not null and not isnan(area_distortion_pct)")
    total = xray.summary(measured, by).join(known.select(*by, (F.col("projection.family") == "geographic").alias("geographic")), by)
    w = Window.partitionBy(*by).orderBy("sample_idx")
    steps = pairs.select(*by, "projection", "lon", "lat", "p", *(F.lead(c).over(w).alias(f"{c}2") for c in ("lon", "lat", "p"))).where("p2 is not null")
    planar = F.sqrt((F.col("p2.x") - F.col("p.x")) * (F.col("p2.x") - F.col("p.x")) + (F.col("p2.y") - F.col("p.y")) * (F.col("p2.y") - F.col("p.y"))) * F.col("projection.unit")
    far = steps.select(*by, planar.alias("planar"), haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("geo")).where("geo > 0")
    error = F.abs(F.col("planar") - F.col("geo")) / F.col("geo") * 100.0
    return total.join(far.groupBy(*by).agg(F.max(error).alias("max_distance_error_pct"), F.avg(error).alias("mean_distance_error_pct")), by, "left")


#: what candidates are ranked by
TARGETS = {
    "area": "max_area_distortion_pct",
    "distance": "max_distance_error_pct",
    "shape": "max_angular_distortion_deg",
    "balanced": "max_area_distortion_pct + max_angular_distortion_deg",
}


def recommend_measured(samples: DataFrame, extents: DataFrame, current: DataFrame, target: str = "area", top: int = 5, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), mode: str = "compat") -> DataFrame:
    """Candidates ranked by what they distort at the layer's own samples, with the measures of :func:`evaluate`.

    Candidates are those of :func:`candidates`, the layer's present system (``current``: layer_idx, crs), WGS 84 as the baseline, and
    ``include``; never those of ``exclude``. ``is_current`` marks the present one. Geographic systems have no
    plane to measure in and come last; of equal ones the mean area distortion and then the code decide.
    """
    own = candidates(extents).select("layer_idx", "crs", "name", "rationale", "ord")
    none = [F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("rationale")]
    more = extents.select("layer_idx", F.explode(F.array(F.lit("EPSG:4326"), *map(F.lit, include))).alias("crs"), *none, F.lit(98).alias("ord"))
    now = current.where("crs is not null").select("layer_idx", "crs", *none, F.lit(99).alias("ord"))
    systems = own.unionByName(more).unionByName(now).groupBy("layer_idx", "crs").agg(F.min_by("name", "ord").alias("name"), F.min_by("rationale", "ord").alias("rationale"), F.bool_or(F.col("ord") == 99).alias("is_current"))
    systems = systems.where(~F.col("crs").isin(*exclude)) if exclude else systems
    measured = systems.join(evaluate(samples, systems, mode), ["layer_idx", "crs"])
    w = Window.partitionBy("layer_idx").orderBy("geographic", F.expr(TARGETS[target]).asc_nulls_last(), "mean_area_distortion_pct", "crs")
    return measured.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
