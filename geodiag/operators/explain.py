"""Explanations of coordinate systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "epsg int, name string, description string, preserves_area boolean, preserves_shape boolean, preserves_distance boolean, preserves_direction boolean, suitable_for string, region string"

# fixed values: curated systems (code, name, description, preserves area, shape, distance, direction, use, region)
DATABASE = (
    (4326, 'WGS 84', 'World Geodetic System 1984 — the GPS coordinate system. Geographic (lat/lon) coordinates on the WGS84 ellipsoid.', False, False, False, False, 'GPS data, worldwide reference, data exchange', 'World'),
    (3857, 'Web Mercator', 'Pseudo-Mercator projection used by web mapping services (Google Maps, OpenStreetMap). Severely distorts area at high latitudes.', False, True, False, True, 'Web maps, navigation, tile-based mapping', 'World (excl. poles)'),
    (3089, 'KY Single Zone (NAD83)', 'Kentucky Single Zone State Plane — Lambert Conformal Conic optimized for Kentucky.', False, True, False, False, 'Statewide mapping in Kentucky, cadastral, engineering', 'Kentucky, USA'),
    (2205, 'KY FIPS 1600 (NAD83, ft)', 'Kentucky FIPS Zone 1600 — single zone State Plane in US survey feet.', False, True, False, False, 'Kentucky engineering and surveying in US feet', 'Kentucky, USA'),
    (32617, 'UTM Zone 17N (WGS84)', 'Universal Transverse Mercator zone 17 North — covers 84°W to 78°W.', False, True, False, False, 'Topographic mapping, medium-scale regional work', 'Eastern USA, Caribbean (78°W–84°W)'),
    (32618, 'UTM Zone 18N (WGS84)', 'Universal Transverse Mercator zone 18 North — covers 78°W to 72°W.', False, True, False, False, 'Topographic mapping, medium-scale regional work', 'Mid-Atlantic USA (72°W–78°W)'),
    (32619, 'UTM Zone 19N (WGS84)', 'Universal Transverse Mercator zone 19 North — covers 72°W to 66°W.', False, True, False, False, 'Topographic mapping, medium-scale regional work', 'New England USA, Maritime Canada (66°W–72°W)'),
    (5070, 'NAD83 / Conus Albers', 'Albers Equal-Area Conic for the contiguous United States. Standard parallels at 29.5°N and 45.5°N.', True, False, False, False, 'Area calculations, thematic mapping, CONUS-wide analysis', 'Contiguous United States'),
    (6933, 'World Cylindrical Equal Area', 'Cylindrical Equal-Area projection for global equal-area analysis.', True, False, False, False, 'Global area calculations, density mapping', 'World'),
    (3035, 'ETRS89 / LAEA Europe', 'Lambert Azimuthal Equal-Area projection centered on Europe (52°N, 10°E).', True, False, False, False, 'European statistical mapping, EU INSPIRE compliance', 'Europe'),
    (4269, 'NAD83', 'North American Datum 1983 — geographic coordinates for North America. Very close to WGS84 but based on GRS80 ellipsoid.', False, False, False, False, 'North American geographic coordinates, datum for State Plane systems', 'North America'),
    (4267, 'NAD27', 'North American Datum 1927 — legacy datum based on the Clarke 1866 ellipsoid. Offsets from NAD83/WGS84 can exceed 100 meters.', False, False, False, False, 'Legacy data compatibility only — convert to NAD83 for modern use', 'North America (historical)'),
    (26917, 'NAD83 / UTM Zone 17N', 'UTM zone 17N on the NAD83 datum. Equivalent to EPSG:32617 but datum-specific.', False, True, False, False, 'Regional mapping in eastern USA on NAD83 datum', 'Eastern USA (78°W–84°W)'),
    (26918, 'NAD83 / UTM Zone 18N', 'UTM zone 18N on the NAD83 datum.', False, True, False, False, 'Regional mapping in mid-Atlantic USA on NAD83 datum', 'Mid-Atlantic USA (72°W–78°W)'),
    (26919, 'NAD83 / UTM Zone 19N', 'UTM zone 19N on the NAD83 datum.', False, True, False, False, 'Regional mapping in New England USA on NAD83 datum', 'New England USA (66°W–72°W)'),
    (2163, 'US National Atlas Equal Area', 'Lambert Azimuthal Equal-Area projection centered on the US (45°N, 100°W). Used for national-scale thematic maps.', True, False, False, False, 'US national-scale thematic and density maps', 'United States'),
    (102003, 'Albers Equal Area (North America)', 'Albers Equal-Area Conic for North America. Custom ESRI code (not official EPSG). Standard parallels at 20°N and 60°N.', True, False, False, False, 'Continental-scale area analysis across North America', 'North America'),
    (54030, 'Robinson', "Robinson projection — compromise projection that looks 'right' without preserving any metric property exactly. Used by National Geographic.", False, False, False, False, 'World wall maps, general reference, aesthetic global views', 'World'),
    (3338, 'NAD83 / Alaska Albers', 'Albers Equal-Area Conic optimized for Alaska. Standard parallels at 55°N and 65°N.', True, False, False, False, 'Alaska statewide mapping, area calculations', 'Alaska, USA'),
    (32601, 'UTM Zone 1N (WGS84)', 'Universal Transverse Mercator zone 1 North — covers 180°W to 174°W.', False, True, False, False, 'Topographic mapping in far western Pacific', 'Western Pacific (174°W–180°W)'),
    (2278, 'NAD83 / Texas Central (ftUS)', 'Texas Central Zone State Plane in US survey feet. Lambert Conformal Conic.', False, True, False, False, 'Central Texas surveying and engineering in US feet', 'Central Texas, USA'),
    (3826, 'TWD97 / TM2 zone 121', 'Taiwan Datum 1997 — Transverse Mercator for Taiwan.', False, True, False, False, 'Mapping and surveying in Taiwan', 'Taiwan'),
)

# fixed values: the curated systems' families, in their order
FAMILIES = (
    "Geographic (unprojected)", "Mercator", "Unknown", "Unknown", "Transverse Mercator", "Transverse Mercator", "Transverse Mercator", "Albers Equal-Area Conic", "Cylindrical Equal-Area", "Lambert Azimuthal Equal-Area",
    "Geographic (unprojected)", "Geographic (unprojected)", "Transverse Mercator", "Transverse Mercator", "Transverse Mercator", "Unknown", "Albers Equal-Area Conic", "Robinson (compromise)", "Albers Equal-Area Conic", "Transverse Mercator", "Unknown", "Transverse Mercator",
)


def database(spark: SparkSession) -> DataFrame:
    """The curated systems as a table of 22 rows."""
    return spark.createDataFrame(list(DATABASE), SCHEMA)


def parse_epsg(crs: Column) -> Column:
    """Code of EPSG:n, epsg:n or n; null otherwise."""
    t = F.trim(crs)
    digits = F.regexp_extract(t, r"^(?:EPSG:|epsg:)?(\+?\d+)$", 1)
    return F.when(digits != "", digits.try_cast("long").try_cast("int"))


def family(epsg: Column, name: Column) -> Column:
    """Projection family by the name, then the code."""
    low = F.lower(name)
    has = low.contains
    return (
        F.when(has("utm") | has("transverse mercator") | has("tm2"), "Transverse Mercator")
        .when(has("mercator") | (epsg == 3857), "Mercator")
        .when(has("lambert") & has("conformal"), "Lambert Conformal Conic")
        .when(has("albers"), "Albers Equal-Area Conic")
        .when(has("laea") | has("lambert azimuthal"), "Lambert Azimuthal Equal-Area")
        .when(has("robinson"), "Robinson (compromise)")
        .when(has("cylindrical equal area"), "Cylindrical Equal-Area")
        .when(epsg.isin(4326, 4269, 4267), "Geographic (unprojected)")
        .when(epsg.between(32600, 32660) | epsg.between(32700, 32760), "Transverse Mercator")
        .otherwise("Unknown")
    )


def _some(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(c, t) for c, t in pairs)), lambda x: x.isNotNull())


def explain(codes: DataFrame, column: str = "crs") -> DataFrame:
    """Each parseable identifier with ``epsg, name, projection_family, preserves, distortion_characteristics, recommended_use, warnings``.

    The 22 curated rows are a constant, so their join is a broadcast one.
    """
    c = codes.select("*", parse_epsg(F.col(column)).alias("epsg")).where("epsg is not null")
    j = c.join(F.broadcast(database(codes.sparkSession).withColumnRenamed("name", "db_name")), "epsg", "left")
    epsg, known = F.col("epsg"), F.col("db_name").isNotNull()
    area, shape = F.col("preserves_area"), F.col("preserves_shape")
    fam, low = family(epsg, F.col("db_name")), F.lower("db_name")
    neither = ~area & ~shape
    # fixed values: texts of the explanations
    traits = F.concat(F.array_join(_some(
        (area, "Preserves area — suitable for area measurements and density mapping"),
        (shape, "Preserves local shape (conformal) — angles are correct locally"),
        (neither & fam.contains("Geographic"), "Geographic coordinates (degrees) — not a projection, no metric properties preserved"),
        (neither & ~fam.contains("Geographic") & fam.contains("Robinson"), "Compromise projection — neither area nor shape is exactly preserved, but both are reasonable"),
        (neither & ~fam.contains("Geographic") & ~fam.contains("Robinson"), "Neither area nor shape is exactly preserved"),
        (low.contains("web mercator") | low.contains("pseudo"), "Area distortion increases dramatically with latitude — Greenland appears as large as Africa"),
    ), ". "), F.lit("."))
    geographic = epsg.isin(4326, 4269, 4267)
    warnings = _some(
        (epsg == 3857, "Do not use for area calculations — area distortion exceeds 400% near the poles."),
        (epsg == 3857, "Coordinates are in meters but do not represent true ground distances at most latitudes."),
        (geographic, "Geographic CRS — coordinates are in degrees, not meters. Do not use for distance or area calculations without projecting first."),
        (epsg == 4267, "NAD27 is a legacy datum. Positional offsets from NAD83/WGS84 can exceed 100 meters. Convert to NAD83 for modern use."),
        (neither, "This CRS does not preserve area or shape. Consider a more appropriate projection for analytical work."),
    )
    text, zone = epsg.cast("string"), (epsg % 100).cast("string")
    north, south = epsg.between(32600, 32660), epsg.between(32700, 32760)
    name = F.when(epsg.between(4000, 4999), F.concat(F.lit("Geographic CRS (EPSG:"), text, F.lit(")"))).when(epsg.between(2000, 2999), F.concat(F.lit("Projected CRS (EPSG:"), text, F.lit(")"))).when(north, F.concat(F.lit("WGS84 / UTM Zone "), zone, F.lit("N"))).when(south, F.concat(F.lit("WGS84 / UTM Zone "), zone, F.lit("S"))).otherwise(F.concat(F.lit("CRS EPSG:"), text))
    fam2 = F.when(epsg.between(4000, 4999), "Geographic (unprojected)").when(epsg.between(2000, 2999), "Projected (family unknown)").when(north | south, "Transverse Mercator").otherwise("Unknown")
    region = F.when(epsg.between(4000, 4999), "Varies by datum").when(epsg.between(2000, 2999), "Regional").when(north, F.concat(F.lit("UTM Zone "), zone, F.lit(" Northern Hemisphere"))).when(south, F.concat(F.lit("UTM Zone "), zone, F.lit(" Southern Hemisphere"))).otherwise("Unknown")
    pick = lambda a, b: F.when(known, a).otherwise(b)
    kept = [F.coalesce(F.col(f"preserves_{p}"), F.lit(False)).alias(f"preserves_{p}") for p in ("area", "shape", "distance", "direction")]
    return j.select(
        *codes.columns, "epsg", pick(F.col("db_name"), name).alias("name"), pick(fam, fam2).alias("projection_family"), *kept,
        pick(traits, F.lit("Properties unknown — not in curated database. Run `geodiag xray` to measure actual distortion.")).alias("distortion_characteristics"),
        pick(F.col("suitable_for"), F.concat(F.lit("Region: "), region, F.lit(". Use `geodiag xray` to evaluate suitability."))).alias("recommended_use"),
        pick(warnings, F.array(F.lit("This EPSG code is not in the curated database. Distortion properties are estimated."))).alias("warnings"),
    )
