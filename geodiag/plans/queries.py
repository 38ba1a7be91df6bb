"""Registered queries over layers derived from plain tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodiag.functions.projections import parameters, project, with_parameters
from geodiag.model import CheckContext, Dataset
from geodiag.operators import cloud, compare, explain, fix, profile, rules, schema, score, snap, xray
from geodiag.operators.recommend import evaluate, recommend, recommend_measured, scope, utm_zone
from geodiag.reports import sinks
from geodiag.runtime import materialize, scratch_path
from geodiag.sources import derived, geoparquet
from geodiag.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL of the derived layers
_LAYERS = """layers as (select r_regionkey as layer_idx, r_name as name, case r_regionkey when 0 then 'EPSG:4326' when 1 then 'EPSG:3857' when 2 then 'EPSG:6933' when 4 then 'EPSG:5070' end as crs from region)"""
_POINTS = """points as (select cast(event_id % 4 as int) as layer_idx, event_id as feat_idx, case when event_id % 7 = 0 then null else cast(event_id as varchar) end as id,
  case when event_id % 17 = 0 then null else cast((event_id * 7919) % 36000 as double) / 100 - 180 end as lon,
  case when event_id % 17 = 0 then null else cast((event_id * 104729) % 16000 as double) / 100 - 80 end as lat,
  case when event_id % 19 = 0 then '{}' when event_id % 13 = 0 then '{"k": "x"}' else props end as props from events)"""
_QUADS = """quads as (select o_orderkey as feat_idx, cast(o_orderkey % 97 as double) as x0, cast(o_custkey % 89 as double) as y0, cast(1 + o_orderkey % 3 as double) as w, o_orderkey % 11 = 0 as bow from orders)"""
_SPREAD = """quads as (select o_orderkey as feat_idx, cast(o_orderkey * 7 % 1009 as double) as x0, cast(floor(o_orderkey * 7 / 1009) as double) as y0, cast(1 + o_orderkey % 3 as double) as w, o_orderkey % 11 = 0 as bow from orders)"""
_LABEL = "coalesce(id, '#' || cast(feat_idx as varchar))"


def _number(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def _plane(crs: str, lon: str, lat: str) -> tuple[str, str]:
    """x and y of a longitude and a latitude, as SQL with the system's constants."""
    p = parameters(crs)
    a, e, n, c, r0, k, lon0, unit = (_number(p[x]) for x in ("a", "e", "n", "c", "r0", "k", "lon0", "unit"))
    s = f"sin(radians({lat}))"
    q = f"((1 - {e} * {e}) * ({s} / (1 - {e} * {e} * {s} * {s}) - ln((1 - {e} * {s}) / (1 + {e} * {s})) / (2 * {e})))"
    if p["family"] == "merc":
        return f"radians({lon}) * {a}", f"ln(tan(pi() / 4 + radians({lat}) / 2)) * {a}"
    if p["family"] == "cea":
        return f"{a} * {k} * radians({lon} - {lon0})", f"{a} * {q} / (2 * {k})"
    if p["family"] == "aea":
        r = f"({a} * sqrt({c} - {n} * {q}) / {n})"
    else:
        t = f"(tan(pi() / 4 - radians({lat}) / 2) / power((1 - {e} * {s}) / (1 + {e} * {s}), {e} / 2))"
        r = f"({k} * power({t}, {n}))"
    turn, fe, fn = f"({n} * radians({lon} - {lon0}))", _number(p["fe"]), _number(p["fn"])
    return f"({r} * sin({turn}) + {fe}) / {unit}", f"({r0} - {r} * cos({turn}) + {fn}) / {unit}"


def _indicatrix(source: str, crs: str = "crs") -> str:
    """CTEs that add the indicatrix to ``source`` (lon, lat and the system, a column or a literal) of two systems whose x and y depend on one coordinate each."""
    x = lambda lon: f"case {crs} when 'EPSG:6933' then {_plane('EPSG:6933', lon, 'lat')[0]} else {_plane('EPSG:3857', lon, 'lat')[0]} end"
    y = lambda lat: f"case {crs} when 'EPSG:6933' then {_plane('EPSG:6933', 'lon', lat)[1]} else {_plane('EPSG:3857', 'lon', lat)[1]} end"
    return f"""w1 as (select *, ({x('lon + 0.001e0')} - {x('lon')}) / 0.001e0 * cos(radians(lat)) as a11, ({y('lat + 0.001e0')} - {y('lat')}) / 0.001e0 as a22 from {source} where lon is not null),
w2 as (select *, abs(a11 * a22) / (6371000e0 * cos(radians(lat)) * pi() / 180 * (6371000e0 * pi() / 180)) as area_scale_factor,
  greatest(sqrt((a11*a11 + a22*a22 + abs(a11*a11 - a22*a22)) / 2), 0.001e0) as semimajor, greatest(sqrt((a11*a11 + a22*a22 - abs(a11*a11 - a22*a22)) / 2), 0.001e0) as semiminor from w1),
measured as (select *, abs(area_scale_factor - 1) * 100 as area_distortion_pct, abs(2 * degrees(asin((semimajor - semiminor) / (semimajor + semiminor)))) as angular_distortion_deg,
  atan2(0e0, a11*a11 - a22*a22) / 2 as theta from w2)"""


def _webmerc(source: str) -> str:
    return _indicatrix(source, "'EPSG:3857'")


def _strata(target: int | None, layer: str = "true") -> str:
    """CTEs of the sampled points of each layer; None: as many as its size asks for."""
    target = "case when n <= 1000 then n when n <= 50000 then 500 else 1000 end" if target is None else target
    n = f"ceil(sqrt({target}))"
    return f"""c0 as (select layer_idx, feat_idx, lon, lat from points where lon is not null and {layer}),
c1 as (select layer_idx, count(*) as n, min(lon) as x0, min(lat) as y0, max(lon) as x1, max(lat) as y1 from c0 group by layer_idx),
c2 as (select c0.*, c1.n, least(floor((lon - x0) / ((x1 - x0) / {n})), {n} - 1) as col, least(floor((lat - y0) / ((y1 - y0) / {n})), {n} - 1) as row from c0 join c1 using (layer_idx)),
c3 as (select *, row_number() over (partition by layer_idx, row, col order by feat_idx) as f from c2),
c4 as (select layer_idx, feat_idx, lon, lat, row, col, row_number() over (partition by layer_idx order by row, col) - 1 as sample_idx from c3 where f = 1 and n > ({target})
  union all select layer_idx, feat_idx, lon, lat, 0, 0, row_number() over (partition by layer_idx order by feat_idx) - 1 from c2 where n <= ({target})),
samples as (select layer_idx, feat_idx, lon, lat, sample_idx from c4 join c1 using (layer_idx) where sample_idx < ({target}))"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.point_columns(spark, sf_dir).where("lon is not null").select("layer_idx", "feat_idx", "lon", "lat")
    return xray.measure(p, "EPSG:3857")


@query(f"""with {_POINTS}, {_webmerc('points')} select layer_idx, feat_idx, round(area_scale_factor, 3) as area_scale_factor, round(area_distortion_pct, 3) as area_distortion_pct, round(angular_distortion_deg, 3) as angular_distortion_deg from measured""")
def xray_samples_webmerc(spark, sf_dir):
    r = lambda c: F.round(c, 3).alias(c)
    return _measured(spark, sf_dir).select("layer_idx", "feat_idx", r("area_scale_factor"), r("area_distortion_pct"), r("angular_distortion_deg"))


_SUMMARY = """count(*) as sample_count, round(max(area_distortion_pct), 6) as max_area_distortion_pct, round(avg(area_distortion_pct), 6) as mean_area_distortion_pct, round(median(area_distortion_pct), 6) as median_area_distortion_pct, round(stddev_pop(area_distortion_pct), 6) as std_area_distortion_pct, round(max(angular_distortion_deg), 6) as max_angular_distortion_deg, round(avg(angular_distortion_deg), 6) as mean_angular_distortion_deg"""


@query(f"with {_POINTS}, {_webmerc('points')} select layer_idx, {_SUMMARY} from measured group by layer_idx")
def xray_summary(spark, sf_dir):
    s = xray.summary(_measured(spark, sf_dir), ["layer_idx"])
    return s.select("layer_idx", "sample_count", *(F.round(c, 6).alias(c) for c in s.columns if c not in ("layer_idx", "sample_count")))


@query(f"with {_POINTS}, {_strata(1000)} select layer_idx, sample_idx, feat_idx from samples")
def xray_stratified_sample(spark, sf_dir):
    return xray.sample_points(derived.points(spark, sf_dir).features).select("layer_idx", F.col("sample_idx").cast("long").alias("sample_idx"), "feat_idx")


@query(f"with {_POINTS}, {_strata(None)} select layer_idx, sample_idx, feat_idx from samples")
def xray_adaptive_sample(spark, sf_dir):
    return xray.sample_points(derived.points(spark, sf_dir).features, None).select("layer_idx", F.col("sample_idx").cast("long").alias("sample_idx"), "feat_idx")


_GRID = (-180.0, -80.0, 180.0, 80.0)
_HEAT = f"""with {_POINTS}, {_strata(1000)}, {_webmerc('samples')},
grid as (select r.row, c.col, -180 + (c.col + 0.5e0) * 7.2e0 as x, -80 + (r.row + 0.5e0) * 3.2e0 as y from (select unnest(range(50)) as row) r, (select unnest(range(50)) as col) c),
d as (select layer_idx, row, col, sample_idx, area_distortion_pct as pct, (x - lon) * (x - lon) + (y - lat) * (y - lat) as d2 from grid, measured),
heat as (select layer_idx, row, col, coalesce(min_by(pct, sample_idx) filter (where d2 < 1e-12), sum(pct / d2) filter (where d2 >= 1e-12) / sum(1 / d2) filter (where d2 >= 1e-12)) as value from d group by layer_idx, row, col)"""


def _heat(spark, sf_dir):
    data = derived.points(spark, sf_dir)
    return xray.heatmap(xray.sample_layer(data.features, "EPSG:3857"), _GRID, by=["layer_idx"])


@query(_HEAT + "select layer_idx, cast(row as int) as row, cast(col as int) as col, round(value, 4) as value from heat")
def xray_heatmap_idw(spark, sf_dir):
    return _heat(spark, sf_dir).select("layer_idx", "row", "col", F.round("value", 4).alias("value"))


@query(_HEAT + "select layer_idx, case when value < 2 then '#22c55e' when value < 5 then '#eab308' when value < 10 then '#f97316' else '#ef4444' end as color, count(*) as cells from heat group by 1, 2")
def heatmap_color(spark, sf_dir):
    return xray.heatmap_cells(_heat(spark, sf_dir), _GRID).groupBy("layer_idx", "color").agg(F.count(F.lit(1)).alias("cells"))


@query(f"""with {_POINTS}, {_strata(50)}, {_webmerc('samples')}, v as (select *, unnest(range(73)) as i from measured), e as (select *, 0.3e0 * semimajor * cos(i * (2 * pi() / 72)) as ex, 0.3e0 * semiminor * sin(i * (2 * pi() / 72)) as ey from v)
select layer_idx, sample_idx, i, round(lon + (ex * cos(theta) - ey * sin(theta)) / greatest(cos(radians(lat)), 0.01e0)) + 0e0 as x, round(lat + ex * sin(theta) + ey * cos(theta)) + 0e0 as y from e""")
def xray_ellipses(spark, sf_dir):
    data = derived.points(spark, sf_dir)
    e = xray.ellipses(xray.sample_layer(data.features, "EPSG:3857", 50))
    flat = e.select("layer_idx", F.col("sample_idx").cast("long").alias("sample_idx"), F.posexplode("coordinates").alias("i", "c"))
    return flat.select("layer_idx", "sample_idx", F.col("i").cast("long").alias("i"), (F.round(F.col("c")[0]) + 0.0).alias("x"), (F.round(F.col("c")[1]) + 0.0).alias("y"))


_PLOTS = "plots as (select o_orderkey as feat_idx, cast(o_orderkey % 331 as double) - 170 as x0, cast(o_custkey % 137 as double) - 70 as y0, cast(1 + o_orderkey % 3 as double) as w, o_orderkey % 5 = 0 as holed from orders)"


def _box_area(crs: str) -> str:
    """Area of a plot in a system, as SQL; holes are half as wide."""
    box = lambda x, y, w: "({} - ({})) * ({} - ({}))".format(_plane(crs, f"({x} + {w})", y)[0], _plane(crs, x, y)[0], _plane(crs, x, f"({y} + {w})")[1], _plane(crs, x, y)[1])
    return f"(abs({box('x0', 'y0', 'w')}) - case when holed then abs({box('(x0 + w / 4)', '(y0 + w / 4)', '(w / 2)')}) else 0 end)"


@query(f"""with {_PLOTS}, areas as (select feat_idx, {_box_area('EPSG:3857')} as area, {_box_area('EPSG:6933')} as reference from plots)
select 0 as layer_idx, feat_idx, round(area / 1e6) as area_km2, round(reference / 1e6) as reference_km2, round(abs(area - reference) / reference * 100, 4) as error_pct from areas""")
def xray_area_error(spark, sf_dir):
    """Every plot's area in Web Mercator against that on the ellipsoid."""
    e = xray.area_errors(derived.plots(spark, sf_dir).features, "EPSG:3857")
    return e.select("layer_idx", "feat_idx", F.round(F.col("area") / 1e6).alias("area_km2"), F.round(F.col("reference") / 1e6).alias("reference_km2"), F.round("error_pct", 4).alias("error_pct"))


_EVALUATED = "systems(crs) as (values ('EPSG:3857'), ('EPSG:6933'))"


@query(f"""with {_POINTS}, {_strata(None)}, {_EVALUATED}, sampled as (select s.*, y.crs from samples s, systems y), {_indicatrix('sampled')},
placed as (select *, case crs when 'EPSG:6933' then {_plane('EPSG:6933', 'lon', 'lat')[0]} else {_plane('EPSG:3857', 'lon', 'lat')[0]} end as px, case crs when 'EPSG:6933' then {_plane('EPSG:6933', 'lon', 'lat')[1]} else {_plane('EPSG:3857', 'lon', 'lat')[1]} end as py from sampled),
steps as (select *, lead(lon) over w as lon2, lead(lat) over w as lat2, lead(px) over w as px2, lead(py) over w as py2 from placed window w as (partition by layer_idx, crs order by sample_idx)),
far as (select layer_idx, crs, sqrt((px2 - px) * (px2 - px) + (py2 - py) * (py2 - py)) as planar, 2 * 6371000e0 * asin(least(sqrt(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2)), 1e0)) as geo from steps where lon2 is not null),
distance as (select layer_idx, crs, max(abs(planar - geo) / geo * 100) as max_distance_error_pct from far where geo > 0 group by 1, 2),
total as (select layer_idx, crs, {_SUMMARY} from measured group by 1, 2)
select layer_idx, crs, cast(row_number() over (partition by layer_idx order by max_area_distortion_pct) as int) as rank, sample_count, max_area_distortion_pct, mean_area_distortion_pct, std_area_distortion_pct, max_angular_distortion_deg, round(max_distance_error_pct, 4) as max_distance_error_pct from total join distance using (layer_idx, crs)""")
def crs_evaluate(spark, sf_dir):
    """Two systems measured at the samples of all layers, the better one first."""
    from pyspark.sql import Window

    samples = materialize(xray.sample_points(derived.points(spark, sf_dir).features, None), "samples")  # read twice
    systems = derived.layer_table(spark, sf_dir).select("layer_idx", F.explode(F.array(F.lit("EPSG:3857"), F.lit("EPSG:6933"))).alias("crs"))
    e = evaluate(samples, systems)
    rank = F.row_number().over(Window.partitionBy("layer_idx").orderBy("max_area_distortion_pct"))
    r = lambda c, n=6: F.round(c, n).alias(c)
    return e.select("layer_idx", "crs", rank.alias("rank"), "sample_count", r("max_area_distortion_pct"), r("mean_area_distortion_pct"), r("std_area_distortion_pct"), r("max_angular_distortion_deg"), r("max_distance_error_pct", 4))


def crs_candidates(spark, sf_dir):
    """All candidates of every layer's extent, ranked by what they distort at its samples. Tested against plain formulas on a small table."""
    data = derived.points(spark, sf_dir)
    samples = materialize(xray.sample_points(data.features, None), "samples")
    extents = samples.groupBy("layer_idx").agg(F.struct(F.min("lon").alias("min_x"), F.min("lat").alias("min_y"), F.max("lon").alias("max_x"), F.max("lat").alias("max_y")).alias("bounds"))
    return recommend_measured(samples, extents, data.layers, top=99, include=("EPSG:6933", "EPSG:3035"))


QUERIES["crs_candidates"] = crs_candidates

_EXTENTS = """extents as (select n_nationkey as layer_idx, cast((n_nationkey * 37) % 300 - 170 as double) as x0, cast((n_nationkey * 29) % 130 - 70 as double) as y0,
  case n_nationkey % 5 when 0 then 1e0 when 1 then 5e0 when 2 then 30e0 when 3 then 20e0 else 120e0 end as s from nation),
boxes as (select layer_idx, x0, y0, x0 + s as x1, y0 + s / 4 as y1, x0 + s / 2 as lon, y0 + s / 8 as lat, case when s < 2 then 'local' when s < 10 then 'regional' when s < 60 then 'continental' else 'global' end as scope from extents)"""


def _extents(spark, sf_dir):
    k = F.col("n_nationkey")
    s = F.when(k % 5 == 0, 1.0).when(k % 5 == 1, 5.0).when(k % 5 == 2, 30.0).when(k % 5 == 3, 20.0).otherwise(120.0)
    x, y = ((k * 37) % 300 - 170).cast("double"), ((k * 29) % 130 - 70).cast("double")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("layer_idx"), F.struct(x.alias("min_x"), y.alias("min_y"), (x + s).alias("max_x"), (y + s / 4).alias("max_y")).alias("bounds"))


@query(f"with {_EXTENTS} select layer_idx, scope, 'EPSG:' || cast(cast(floor((lon + 180) / 6) as int) + 1 + case when lat >= 0 then 32600 else 32700 end as varchar) as utm from boxes")
def crs_scope(spark, sf_dir):
    e = _extents(spark, sf_dir)
    b = F.col("bounds")
    return e.select("layer_idx", scope(b).alias("scope"), utm_zone((b["min_x"] + b["max_x"]) / 2, (b["min_y"] + b["max_y"]) / 2)[0].alias("utm"))


@query(f"""with {_EXTENTS}, c as (
  select *, 'EPSG:' || cast(cast(floor((lon + 180) / 6) as int) + 1 + case when lat >= 0 then 32600 else 32700 end as varchar) as crs, case when scope in ('local', 'regional') then 0.85e0 when scope = 'continental' then 0.6e0 else 0.3e0 end as fitness, 'balanced' as target, 0 as o from boxes
  union all select *, 'aea', 0.9e0, 'area', 1 from boxes where scope in ('local', 'regional') union all select *, 'lcc', 0.85e0, 'shape', 2 from boxes where scope in ('local', 'regional')
  union all select *, 'EPSG:5070', 0.88e0, 'area', 3 from boxes where scope = 'continental' and lat > 20 and lat < 72 and lon > -170 and lon < -50
  union all select *, 'EPSG:3035', 0.88e0, 'area', 4 from boxes where scope = 'continental' and lat > 35 and lat < 72 and lon > -12 and lon < 45
  union all select *, 'ESRI:54009', 0.75e0, 'area', 5 from boxes where scope = 'global' union all select *, 'ESRI:54030', 0.7e0, 'balanced', 6 from boxes where scope = 'global'
  union all select *, 'EPSG:4326', 0.5e0, 'balanced', 7 from boxes where scope = 'global' union all select *, 'EPSG:3857', 0.2e0, 'balanced', 8 from boxes),
r as (select *, row_number() over (partition by layer_idx order by fitness desc, o) as rank from c) select layer_idx, cast(rank as int) as rank, crs, target, fitness from r where rank <= 5""")
def crs_recommend(spark, sf_dir):
    crs = F.when(F.col("crs").startswith("+proj"), F.regexp_extract("crs", r"proj=(\w+)", 1)).otherwise(F.col("crs"))
    return recommend(_extents(spark, sf_dir), 5).select("layer_idx", "rank", crs.alias("crs"), "target", "fitness")


# --- rules: each as a list of findings
_COLS = "rule_id, severity, message, metric, layer_idx, feat_idx, sub_key"


def _rows(found: DataFrame) -> DataFrame:
    return found.select("rule_id", "severity", "message", F.round("metric", 3).alias("metric"), "layer_idx", "feat_idx", "sub_key")


def _rule(id: str, make=derived.points):
    def run(spark, sf_dir):
        return _rows(rules.Registry().get(id).check(CheckContext(make(spark, sf_dir))))

    return run


def _finding(id: str, severity: str, message: str, metric: str = "null", feat: str = "null", sub: str = "null") -> str:
    sev = f"'{severity}'" if severity in ("error", "warning", "info") else severity
    return f"select '{id}' as rule_id, {sev} as severity, {message} as message, cast({metric} as double) as metric, cast(layer_idx as int) as layer_idx, cast({feat} as bigint) as feat_idx, cast({sub} as varchar) as sub_key"


_F = "(select p.*, l.name from points p join layers l using (layer_idx))"
_DUP = "dups as (select layer_idx, name, count(*) as n, string_agg({label}, ', ' order by feat_idx) as labels, min(feat_idx) as feat_idx from {src} group by layer_idx, name, {key} having count(*) > 1)"
_FIRSTS = "firsts as (select layer_idx, min_by(props, feat_idx) as fp, min(feat_idx) as ff from points group by layer_idx), fkeys as (select layer_idx, ff, unnest(json_keys(fp)) as k, fp from firsts), typed as (select f.layer_idx, f.feat_idx, f.name, coalesce(f.id, '#' || cast(f.feat_idx as varchar)) as label, k.k, json_type(k.fp, '$.' || k.k) as want0, json_type(f.props, '$.' || k.k) as got0 from " + _F + " f join fkeys k on f.layer_idx = k.layer_idx and f.feat_idx > k.ff), folded as (select *, case when want0 = 'VARCHAR' then 'string' when want0 in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'number' when want0 = 'BOOLEAN' then 'boolean' else lower(want0) end as want, case when got0 = 'VARCHAR' then 'string' when got0 in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'number' when got0 = 'BOOLEAN' then 'boolean' else lower(got0) end as got from typed)"
_DIST = f"dist as (select l.name, l.crs, s.* from layers l join (select layer_idx, max(area_distortion_pct) as most, avg(area_distortion_pct) as mean from measured group by layer_idx) s using (layer_idx) where l.crs in ('EPSG:3857', 'EPSG:6933'))"
# every layer has the declared extent -180 -80 170 75
_P = {
    "data_quality/duplicate-features": _finding("data_quality/duplicate-features", "warning", "cast(n as varchar) || ' features with identical geometry in layer ''' || name || ''': [' || labels || ']'", "n", "feat_idx") + " from dups",
    "data/duplicate-geometry": _finding("data/duplicate-geometry", "warning", "cast(n as varchar) || ' features with identical geometry in layer ''' || name || ''': [' || labels || ']'", "n", "feat_idx") + " from dups",
    "data_quality/empty-dataset": _finding("data_quality/empty-dataset", "warning", "'Layer ''' || name || ''' contains no features'", "0") + " from layers where layer_idx not in (select layer_idx from points)",
    "data/extent-bounds": _finding("data/extent-bounds", "warning", f"'Feature ' || {_LABEL} || ' in layer ''' || name || ''' extends outside declared bounds'", feat="feat_idx") + f" from {_F} where lon < -180 or lat < -80 or lon > 170 or lat > 75",
    "data/null-geometry": _finding("data/null-geometry", "error", f"'Feature ' || {_LABEL} || ' has null or empty geometry in layer ''' || name || ''''", feat="feat_idx") + f" from {_F} where lon is null",
    "data/schema-validate": _finding("data/schema-validate", "error", "case when got is null then 'Feature ' || label || ' in layer ''' || name || ''' is missing field ''' || k || '''' else 'Feature ' || label || ' in layer ''' || name || ''': field ''' || k || ''' has type ' || got || ', expected ' || want end", feat="feat_idx", sub="k") + " from folded where got is null or got <> want",
    "projection/missing-crs": _finding("projection/missing-crs", "error", "'Layer ''' || name || ''' has no coordinate reference system (CRS) defined'") + " from layers where crs is null",
    "proj/datum-mismatch": _finding("proj/datum-mismatch", "error", "'CRS mismatch: layer ''' || r.rn || ''' uses ' || r.rc || ' but layer ''' || name || ''' uses ' || crs") + " from layers, (select min_by(name, layer_idx) as rn, min_by(crs, layer_idx) as rc, min(layer_idx) as ri from layers where crs is not null) r where layer_idx > ri and crs <> rc",
    "proj/area-distortion": _finding("proj/area-distortion", "case when most > 10 then 'error' else 'warning' end", "'Layer ''' || name || ''' has ' || printf('%.1f', most) || '% max area distortion (mean: ' || printf('%.1f', mean) || '%) in CRS ' || crs", "round(most, 3)") + " from dist where most > 5",
    "projection/high-distortion": _finding("projection/high-distortion", "case when most > 20 then 'error' else 'warning' end", "'Layer ''' || name || ''' has ' || printf('%.1f', most) || '% max area distortion (threshold: 10.0%) in CRS ' || crs", "round(most, 3)") + " from dist where most > 10",
    "cartography/missing-symbology-hints": _finding("cartography/missing-symbology-hints", "info", "'Layer ''' || name || ''' has no style/classification hint attributes; cartographic checks are limited'") + " from layers where layer_idx not in (select layer_idx from points where props <> '{}')",
}
_DISTANCE = f"""placed as (select *, case crs when 'EPSG:6933' then {_plane('EPSG:6933', 'lon', 'lat')[0]} else {_plane('EPSG:3857', 'lon', 'lat')[0]} end as px, case crs when 'EPSG:6933' then {_plane('EPSG:6933', 'lon', 'lat')[1]} else {_plane('EPSG:3857', 'lon', 'lat')[1]} end as py from sampled), pairs as (select *, lead(lon) over w as lon2, lead(lat) over w as lat2, lead(px) over w as px2, lead(py) over w as py2 from placed window w as (partition by layer_idx order by sample_idx)),
meas as (select layer_idx, sqrt((px2 - px) * (px2 - px) + (py2 - py) * (py2 - py)) as planar, 2 * 6371000e0 * asin(least(sqrt(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2)), 1e0)) as geo from pairs where lon2 is not null),
far as (select l.name, l.crs, m.* from layers l join (select layer_idx, max(abs(planar - geo) / geo * 100) as most, avg(abs(planar - geo) / geo * 100) as mean from meas where geo > 0 group by layer_idx) m using (layer_idx) where l.crs in ('EPSG:3857', 'EPSG:6933'))"""
_P["proj/distance-distortion"] = _finding("proj/distance-distortion", "warning", "'Layer ''' || name || ''' has ' || printf('%.1f', most) || '% max distance distortion (mean: ' || printf('%.1f', mean) || '%) in CRS ' || crs", "round(most, 3)") + " from far where most > 10"
_WITH = f"with {_LAYERS}, {_POINTS}, {_strata(1000)}, sampled as (select s.*, l.crs from samples s join layers l using (layer_idx)), {_indicatrix('sampled')}, {_DIST}, {_DISTANCE}, {_FIRSTS}, " + _DUP.format(label=_LABEL, src=_F, key="lon, lat").replace("group by", "where lon is not null group by")

_QUAD_DUPS = "with " + _QUADS + ", dups as (select 0 as layer_idx, 'quads' as name, count(*) as n, string_agg(cast(feat_idx as varchar), ', ' order by feat_idx) as labels, min(feat_idx) as feat_idx from quads group by x0, y0, w, bow having count(*) > 1) "
for _name, _id in (("rule_duplicate_features", "data_quality/duplicate-features"), ("rule_duplicate_geometry", "data/duplicate-geometry")):
    QUERIES[_name], SQL[_name] = _rule(_id, derived.quads), _QUAD_DUPS + _P[_id]
for _name, _id in (
    ("rule_empty_dataset", "data_quality/empty-dataset"), ("rule_extent_bounds", "data/extent-bounds"), ("rule_null_geometry", "data/null-geometry"), ("rule_schema_validate", "data/schema-validate"), ("rule_missing_crs", "projection/missing-crs"),
    ("rule_datum_mismatch", "proj/datum-mismatch"), ("rule_area_distortion", "proj/area-distortion"), ("rule_high_distortion", "projection/high-distortion"), ("rule_distance_distortion", "proj/distance-distortion"), ("rule_missing_symbology", "cartography/missing-symbology-hints"),
):
    QUERIES[_name], SQL[_name] = _rule(_id), _WITH + " " + _P[_id]

QUERIES["rule_self_intersection"] = _rule("data/self-intersection", derived.quads)
SQL["rule_self_intersection"] = f"with {_QUADS} select 'data/self-intersection' as rule_id, 'error' as severity, 'Feature ' || feat_idx || ' in layer ''quads'' has self-intersecting geometry' as message, cast(null as double) as metric, 0 as layer_idx, feat_idx, cast(null as varchar) as sub_key from quads where bow"


QUERIES["rule_topology_overlaps"] = _rule("data/topology-overlaps", lambda spark, sf_dir: derived.quads(spark, sf_dir, dense=False))
# a square is convex, a bowtie two triangles; the normals of all their edges are x, y, x + y and x - y, on which convex shapes with a common area overlap
SQL["rule_topology_overlaps"] = f"""with {_SPREAD}, v as (
select feat_idx, unnest([(0, x0, y0), (0, x0 + w, y0), (0, x0 + w, y0 + w), (0, x0, y0 + w)]) as v from quads where not bow
union all select feat_idx, unnest([(0, x0, y0), (0, x0 + w, y0), (0, x0 + w / 2, y0 + w / 2), (1, x0, y0 + w), (1, x0 + w, y0 + w), (1, x0 + w / 2, y0 + w / 2)]) from quads where bow),
s as (select feat_idx, v[1] as part, min(v[2]) as xa, max(v[2]) as xb, min(v[3]) as ya, max(v[3]) as yb, min(v[2] + v[3]) as pa, max(v[2] + v[3]) as pb, min(v[2] - v[3]) as ma, max(v[2] - v[3]) as mb from v group by 1, 2)
select distinct 'data/topology-overlaps' as rule_id, 'warning' as severity, 'Features ' || a.feat_idx || ' and ' || b.feat_idx || ' overlap in layer ''quads''' as message, cast(null as double) as metric, 0 as layer_idx, a.feat_idx, printf('%012d', b.feat_idx) as sub_key
from s a join s b on a.feat_idx < b.feat_idx and a.xa < b.xb and b.xa < a.xb and a.ya < b.yb and b.ya < a.yb and a.pa < b.pb and b.pa < a.pb and a.ma < b.mb and b.ma < a.mb"""


def _slits(spark, sf_dir):
    """Unit squares in rows, every third moved by 1/2048 from its neighbour."""
    from geodiag.functions import geometry as g

    o = F.col("o_orderkey")
    x, y, d = (o % 211).cast("double"), F.floor(o / 211).cast("double"), F.when(o % 3 == 0, 1.0 / 2048).otherwise(0.0)
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(p(x + d, y), p(x + 1, y), p(x + 1, y + 1), p(x + d, y + 1), p(x + d, y))
    base = derived.quads(spark, sf_dir)
    features = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(0).alias("layer_idx"), o.cast("long").alias("feat_idx"), o.cast("string").alias("id"), g.polygon(F.array(ring)).alias("geom"), F.create_map().cast("map<string,string>").alias("properties"))
    return Dataset(base.layers, features, sf_dir)


QUERIES["rule_topology_gaps"] = _rule("data/topology-gaps", _slits)
SQL["rule_topology_gaps"] = """with q as (select o_orderkey as k, o_orderkey % 211 as x, o_orderkey // 211 as y, o_orderkey % 3 = 0 as moved from orders)
select 'data/topology-gaps' as rule_id, 'warning' as severity, 'Gap between features ' || least(a.k, b.k) || ' and ' || greatest(a.k, b.k) || ' in layer ''quads''' as message, round(1e0 / 2048, 3) as metric, 0 as layer_idx, least(a.k, b.k) as feat_idx, printf('%012d', greatest(a.k, b.k)) as sub_key
from q a join q b on b.moved and a.y - b.y between -1 and 1 and a.x = b.x - 1 where a.y = b.y
union all select 'data/topology-gaps', 'warning', 'Gap between features ' || least(a.k, b.k) || ' and ' || greatest(a.k, b.k) || ' in layer ''quads''', round(1e0 / 2048, 3), 0, least(a.k, b.k), printf('%012d', greatest(a.k, b.k))
from q a join q b on b.moved and a.x = b.x - 1 and abs(a.y - b.y) = 1"""


def _all(spark, sf_dir) -> DataFrame:
    return rules.run_checks(CheckContext(derived.points(spark, sf_dir)))


_ALL = _WITH + ", found as (" + " union all ".join(f"({x})" for x in _P.values()) + ") "


@query(_ALL + f"select {_COLS} from found")
def findings_all_sorted(spark, sf_dir):
    return _rows(rules.ordered(_all(spark, sf_dir)))


@query(_ALL + "select count(*) as total, count(*) filter (where severity = 'error') as errors, count(*) filter (where severity = 'warning') as warnings, count(*) filter (where severity = 'info') as info from found")
def findings_summary(spark, sf_dir):
    return score.summary(_all(spark, sf_dir))


@query(_ALL + "select split_part(rule_id, '/', 1) as domain, count(*) as n from found group by 1")
def findings_by_domain(spark, sf_dir):
    return score.by_domain(_all(spark, sf_dir))


_CATS = _ALL + """, cats(ord, category, prefix, weight) as (values (0, 'projection', 'proj', 0.25e0), (1, 'data_integrity', 'data', 0.3e0), (2, 'accessibility', 'cartography', 0.2e0), (3, 'cloud_readiness', 'cloud', 0.2e0), (4, 'classification', 'classification', 0.05e0)),
counted as (select c.ord, c.category, c.weight, count(*) filter (where f.severity = 'error') as e, count(*) filter (where f.severity = 'warning') as w, count(*) filter (where f.severity = 'info') as i from cats c left join found f on starts_with(f.rule_id, c.prefix) group by 1, 2, 3),
scored as (select *, cast(greatest(100 - least(15 * e, 60) - least(5 * w, 30) - least(i, 10), 0) as int) as score from counted) """
_GRADE = "case when {0} between 90 and 100 then 'A' when {0} between 75 and 89 then 'B' when {0} between 60 and 74 then 'C' when {0} between 40 and 59 then 'D' else 'F' end"


@query(_CATS + f"select category, score, weight, e + w + i as finding_count, {_GRADE.format('score')} as grade from scored")
def score_categories(spark, sf_dir):
    return score.categories(_all(spark, sf_dir)).select("category", "score", "weight", "finding_count", "grade")


@query(_CATS + f", o as (select cast(round(sum(score * weight)) as int) as overall from scored) select overall, {_GRADE.format('overall')} as grade, (select count(*) from found) as finding_count from o")
def score_overall(spark, sf_dir):
    found = materialize(_all(spark, sf_dir).select("rule_id", "severity"), "findings")  # read twice
    return score.overall(score.categories(found), found)


@query(f"with {_QUADS}, r as (select feat_idx, x0, y0, w, bow, row_number() over (partition by x0, y0, w, bow order by feat_idx) as k from quads) select 0 as layer_idx, feat_idx from r where k = 1")
def fix_dedup(spark, sf_dir):
    return fix.dedup(derived.quads(spark, sf_dir).features).select("layer_idx", "feat_idx")


@query(f"with {_POINTS} select layer_idx, feat_idx, round(radians(lon) * 6378137e0, 3) + 0e0 as x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0, 3) + 0e0 as y from points")
def fix_reproject(spark, sf_dir):
    moved = fix.reproject(derived.points(spark, sf_dir).features, "EPSG:4326", "EPSG:3857")
    p = F.col("geom.parts")[0]["rings"][0][0]
    return moved.select("layer_idx", "feat_idx", (F.round(p["x"], 3) + 0.0).alias("x"), (F.round(p["y"], 3) + 0.0).alias("y"))


_TYPED = f"""with {_POINTS}, values as (select layer_idx, feat_idx, field, json_type(props, '$.' || field) as jt, props ->> ('$.' || field) as v from (select *, unnest(json_keys(props)) as field from points)),
counts as (select layer_idx, field, count(*) as n, count(*) filter (where jt = 'VARCHAR') as texts, count(*) filter (where jt in ('UBIGINT', 'BIGINT', 'DOUBLE')) as numbers, count(*) filter (where jt = 'VARCHAR' and try_cast(trim(v) as double) is not null) as readable from values group by 1, 2),
preview as (select c.layer_idx, c.field, case when numbers = n then 'number' when texts = n then 'string' when numbers > 0 and numbers + readable = n then 'number' else 'string' end as target, n as n_values, case when numbers = n or texts = n then 0 when numbers + readable = n then texts else numbers end as n_cast, 0 as n_null, s.k - n as n_added
from counts c join (select layer_idx, count(*) as k from points group by 1) s using (layer_idx)) """


@query(_TYPED + "select * from preview")
def fix_schema_preview(spark, sf_dir):
    return schema.preview(derived.points(spark, sf_dir))


@query(_TYPED + "select p.layer_idx, p.feat_idx, r.field, case when v.v is null then 'null' when r.target = 'string' then '\"' || v.v || '\"' else v.v end as value from points p join preview r using (layer_idx) left join values v on p.layer_idx = v.layer_idx and p.feat_idx = v.feat_idx and r.field = v.field")
def fix_schema(spark, sf_dir):
    """Every value after normalisation."""
    return schema.normalize(derived.points(spark, sf_dir)).features.select("layer_idx", "feat_idx", F.explode("properties").alias("field", "value"))


@query(f"""with {_POINTS}, firsts as (select layer_idx, min_by(props, feat_idx) as fp, min(feat_idx) as ff from points group by 1),
c as (select count(*) filter (where props = '{{}}' or (json_type(props, '$.k') = 'VARCHAR') <> (json_type(fp, '$.k') = 'VARCHAR')) as wrong, count(*) filter (where props = '{{}}') as empty from points join firsts using (layer_idx) where feat_idx > ff and fp <> '{{}}')
select 'data/schema-validate' as rule_id, 'error' as severity, wrong as before, 0 as after from c where wrong > 0 union all select 'data/schema-validate', 'warning', 0, empty from c where empty > 0""")
def fix_schema_verify(spark, sf_dir):
    """Schema findings before and after: type errors and missing fields go, values that were missing are reported as nulls."""
    data = derived.points(spark, sf_dir)
    return schema.verify(data, schema.normalize(data))


# a vertex of a moved square goes to the unmoved place beside it if another square has a vertex there
_SNAPPED = """with q as (select o_orderkey as k, o_orderkey % 211 as x, o_orderkey // 211 as y, o_orderkey % 3 = 0 as moved from orders),
places as (select distinct x + 1 as x, y from q union select x + 1, y + 1 from q union select x, y from q where not moved union select x, y + 1 from q where not moved),
s as (select k, x, y, case when moved and a.ax is null then 1e0 / 2048 else 0e0 end as low, case when moved and b.bx is null then 1e0 / 2048 else 0e0 end as high from q left join (select x as ax, y as ay from places) a on ax = x and ay = y left join (select x as bx, y as beside from places) b on bx = x and beside = y + 1) """


@query(_SNAPPED + "select k as feat_idx, x + low as low_x, x + high as high_x, round(1 - (low + high) / 2, 9) as area from s")
def fix_snap(spark, sf_dir):
    """Squares with slits, snapped within 0.001."""
    healed, _ = snap.snap(_slits(spark, sf_dir), 0.001)
    ring = F.col("geom.parts")[0]["rings"][0]
    steps = F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda a, i: a + (ring[i - 1]["x"] - ring[0]["x"]) * (ring[i]["y"] - ring[0]["y"]) - (ring[i]["x"] - ring[0]["x"]) * (ring[i - 1]["y"] - ring[0]["y"]))
    return healed.features.select("feat_idx", ring[0]["x"].alias("low_x"), ring[3]["x"].alias("high_x"), F.round(steps / 2, 9).alias("area"))


@query(SQL["rule_topology_gaps"].join(("select 'data/topology-gaps' as rule_id, 'warning' as severity, count(*) as before, 0 as after from (", ") having count(*) > 0")))
def fix_snap_verify(spark, sf_dir):
    """Gaps before and after: none is left."""
    data = _slits(spark, sf_dir)
    return schema.verify(data, snap.snap(data, 0.001)[0], ("data/topology-gaps",))


_SYSTEMS = ("EPSG:3857", "EPSG:6933", "EPSG:5070", "EPSG:3089")
#: where each of the systems below is used
_AREAS = {"EPSG:3857": (-180, -80, 180, 80), "EPSG:6933": (-180, -80, 180, 80), "EPSG:5070": (-130, 20, -65, 55), "EPSG:3089": (-90, 36, -82, 40), "EPSG:3035": (-15, 32, 45, 72), "EPSG:32616": (-91, -80, -83, 80), "ESRI:54009": (-180, -80, 180, 80), "ESRI:54030": (-180, -80, 180, 80), "EPSG:2163": (-130, 20, -65, 55), "EPSG:3826": (110, 15, 130, 35)}


@query(" union all ".join(f"(with {_POINTS} select '{crs}' as crs, feat_idx, round({_plane(crs, 'lon', 'lat')[0]}, 2) + 0e0 as x, round({_plane(crs, 'lon', 'lat')[1]}, 2) + 0e0 as y from points where lon is not null)" for crs in _SYSTEMS))
def projections_forward(spark, sf_dir):
    """All points in four systems by one plan, each system a row of constants."""
    systems = with_parameters(spark.createDataFrame([(x,) for x in _SYSTEMS], "crs string"))
    p = derived.point_columns(spark, sf_dir).where("lon is not null").select("feat_idx", "lon", "lat").join(F.broadcast(systems))
    p = p.select("crs", "feat_idx", project(F.col("projection"), F.col("lon"), F.col("lat")).alias("p"))
    return p.select("crs", "feat_idx", (F.round("p.x", 2) + 0.0).alias("x"), (F.round("p.y", 2) + 0.0).alias("y"))


@query(" union all ".join(f"(with {_POINTS} select '{crs}' as crs, feat_idx, round(lon, 6) + 0e0 as lon, round(lat, 6) + 0e0 as lat from points where lon between {b[0]} and {b[2]} and lat between {b[1]} and {b[3]})" for crs, b in _AREAS.items()))
def fix_reproject_inverse(spark, sf_dir):
    """Points of ten systems' areas of use, given in each system, brought back to longitude and latitude."""
    out = None
    points = derived.points(spark, sf_dir).features
    p = F.col("geom.parts")[0]["rings"][0][0]
    for crs, (x0, y0, x1, y1) in _AREAS.items():
        inside = points.where(p["x"].between(x0, x1) & p["y"].between(y0, y1))
        back = fix.reproject(fix.reproject(inside, "EPSG:4326", crs), crs, "EPSG:4326")
        one = back.select(F.lit(crs).alias("crs"), "feat_idx", (F.round(p["x"], 6) + 0.0).alias("lon"), (F.round(p["y"], 6) + 0.0).alias("lat"))
        out = one if out is None else out.unionByName(one)
    return out


@query(" union all ".join(f"(with {_POINTS} select '{crs}' as crs, count(*) as points, cast(0 as bigint) as lost, true as exact from points where lon between {b[0]} and {b[2]} and lat between {b[1]} and {b[3]} having count(*) > 0)" for crs, b in _AREAS.items()))
def xray_round_trip(spark, sf_dir):
    """Each system's round trip over the points of its area of use: none is lost, and all come back within 1e-9 degrees (0.1 mm)."""
    areas = spark.createDataFrame([(c, *map(float, b)) for c, b in _AREAS.items()], "crs string, x0 double, y0 double, x1 double, y1 double")
    p = derived.point_columns(spark, sf_dir).where("lon is not null").select("lon", "lat").join(F.broadcast(with_parameters(areas)), F.expr("lon between x0 and x1 and lat between y0 and y1"))
    trip = xray.round_trip(p, F.col("projection"))
    return trip.groupBy("crs").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("round_trip_deg").isNull()).alias("lost"), (F.max("round_trip_deg") < 1e-9).alias("exact"))


def _pair(spark, sf_dir):
    from geodiag.model import compute_layers

    d = derived.points(spark, sf_dir)
    sides = (d.features.where("feat_idx % 10 <> 0"), d.features.where("feat_idx % 7 <> 1"))
    return tuple(Dataset(compute_layers(f, d.layers), f, n) for f, n in zip(sides, ("left", "right")))


_DIFF = f"""with {_POINTS}, l as (select count(*) as n, min(lon) as a, min(lat) as b, max(lon) as c, max(lat) as d from points where feat_idx % 10 <> 0), r as (select count(*) as n, min(lon) as a, min(lat) as b, max(lon) as c, max(lat) as d from points where feat_idx % 7 <> 1),
diff as (select l.n as left_features, r.n as right_features, greatest(r.n - l.n, 0) as added, greatest(l.n - r.n, 0) as removed, (l.a, l.b, l.c, l.d) is distinct from (r.a, r.b, r.c, r.d) as extent_changed from l, r) """


@query(_DIFF + "select * from diff")
def diff_summary(spark, sf_dir):
    return compare.compare(*_pair(spark, sf_dir)).drop("left_file", "right_file")


@query(_DIFF + "select 'added' as change, 'added-' || i as id from (select unnest(range(1, added + 1)) as i from diff) union all select 'removed', 'removed-' || i from (select unnest(range(1, removed + 1)) as i from diff) union all select 'modified', 'extent' from diff where added = 0 and removed = 0 and extent_changed")
def diff_changes(spark, sf_dir):
    return compare.changes(compare.compare(*_pair(spark, sf_dir)))


@query(f"""with {_POINTS}, l as (select coalesce(id, cast(lon as varchar) || ' ' || cast(lat as varchar)) as k, id is null as bare, count(*) as n from points where feat_idx % 10 <> 0 and (id is not null or lon is not null) group by 1, 2), r as (select coalesce(id, cast(lon as varchar) || ' ' || cast(lat as varchar)) as k, id is null as bare, count(*) as n from points where feat_idx % 7 <> 1 and (id is not null or lon is not null) group by 1, 2)
select change, count(*) as n from (select case when l.n is null then 'added' when r.n is null then 'removed' when l.n <> r.n then 'count' end as change from l full join r on l.k = r.k and l.bare = r.bare) where change is not null group by 1""")
def diff_features(spark, sf_dir):
    left, right = (Dataset(d.layers, d.features.where("id is not null or geom is not null"), d.path) for d in _pair(spark, sf_dir))
    return compare.feature_changes(left, right).where("change <> 'properties'").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_LAYERS}, {_POINTS}, f as (select layer_idx, count(distinct k) as n from (select layer_idx, unnest(json_keys(props)) as k from points) group by 1)
select layer_idx, name, count(p.feat_idx) as feature_count, case when count(p.lon) = 0 then 'None' else 'Point' end as geometry_type, crs, coalesce(max(f.n), 0) as field_count, count(*) filter (where p.feat_idx is not null and p.lon is null) as null_geometry_count from layers left join points p using (layer_idx) left join f using (layer_idx) group by layer_idx, name, crs""")
def profile_layers(spark, sf_dir):
    return profile.profile(derived.points(spark, sf_dir)).drop("extent")


_CURATED = "curated(epsg, name, family, area, shape) as (values " + ", ".join("({}, '{}', '{}', {}, {})".format(r[0], r[1].replace("'", "''"), f, str(r[3]).lower(), str(r[4]).lower()) for r, f in zip(explain.DATABASE, explain.FAMILIES)) + ")"
_CODES = "codes as (select distinct 'EPSG:' || c as crs from (select 4000 + n_nationkey * 41 as c from nation union all select 32590 + n_nationkey * 7 from nation union all select 2000 + n_nationkey * 50 from nation union all select n_nationkey from nation union all select epsg from curated))"


@query(f"""with {_CURATED}, {_CODES}, e as (select crs, cast(substr(crs, 6) as int) as epsg from codes)
select crs, epsg, coalesce(c.name, case when epsg between 4000 and 4999 then 'Geographic CRS (EPSG:' || epsg || ')' when epsg between 2000 and 2999 then 'Projected CRS (EPSG:' || epsg || ')' when epsg between 32600 and 32660 then 'WGS84 / UTM Zone ' || (epsg - 32600) || 'N' when epsg between 32700 and 32760 then 'WGS84 / UTM Zone ' || (epsg - 32700) || 'S' else 'CRS EPSG:' || epsg end) as name,
coalesce(c.family, case when epsg between 4000 and 4999 then 'Geographic (unprojected)' when epsg between 2000 and 2999 then 'Projected (family unknown)' when epsg between 32600 and 32660 or epsg between 32700 and 32760 then 'Transverse Mercator' else 'Unknown' end) as projection_family,
coalesce(c.area, false) as preserves_area, coalesce(c.shape, false) as preserves_shape from e left join curated c using (epsg)""")
def explain_crs(spark, sf_dir):
    k = F.col("n_nationkey")
    codes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.explode(F.array(4000 + k * 41, 32590 + k * 7, 2000 + k * 50, k)).alias("c"))
    codes = codes.union(explain.database(spark).select(F.col("epsg").cast("long"))).select(F.concat(F.lit("EPSG:"), F.col("c").cast("string")).alias("crs")).distinct()
    return explain.explain(codes).select("crs", "epsg", "name", "projection_family", "preserves_area", "preserves_shape")


@query(f"""with {_CURATED}, used as (select s_suppkey, [{", ".join(str(r[0]) for r in explain.DATABASE)}][1 + s_suppkey % {len(explain.DATABASE)}] as epsg from supplier)
select s_suppkey, epsg, name, family as projection_family, area as preserves_area, shape as preserves_shape from used join curated using (epsg)""")
def explain_database(spark, sf_dir):
    """A curated system for each supplier, explained."""
    codes = F.array(*(F.lit(r[0]) for r in explain.DATABASE))
    used = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", codes[(F.col("s_suppkey") % len(explain.DATABASE)).cast("int")].cast("string").alias("crs"))
    return explain.explain(used).select("s_suppkey", "epsg", "name", "projection_family", "preserves_area", "preserves_shape")


_ENDS = ("geojson", "JSON", "gpkg", "shp", "fgb", "parquet", "pmtiles", "tif", "qgz", "qgs", "csv")


@query("""with p as (select p_name || '.' || ['geojson','JSON','gpkg','shp','fgb','parquet','pmtiles','tif','qgz','qgs','csv'][1 + p_partkey % 11] as path, lower(['geojson','JSON','gpkg','shp','fgb','parquet','pmtiles','tif','qgz','qgs','csv'][1 + p_partkey % 11]) as e from part)
select path, case e when 'geojson' then 'GeoJSON' when 'json' then 'GeoJSON' when 'gpkg' then 'GeoPackage' when 'shp' then 'Shapefile' when 'fgb' then 'FlatGeobuf' when 'parquet' then 'GeoParquet' when 'pmtiles' then 'PMTiles' when 'tif' then 'GeoTIFF' when 'qgz' then 'QGIS Project' when 'qgs' then 'QGIS Project' end as name,
case when e = 'csv' then null when e = 'json' then '.geojson' else '.' || e end as extension, case when e = 'csv' then null else e in ('fgb', 'parquet', 'pmtiles') end as cloud_optimized from p""")
def format_info(spark, sf_dir):
    ends = F.array(*map(F.lit, _ENDS))
    paths = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_name", F.lit("."), ends[(F.col("p_partkey") % 11).cast("int")]).alias("path"))
    return profile.format_info(paths).drop("guide_url")


@query(_ALL + "select rule_id as \"ruleId\", case severity when 'error' then 'error' when 'warning' then 'warning' else 'note' end as level, message as text from found")
def sarif_results(spark, sf_dir):
    return sinks.sarif_results(_all(spark, sf_dir)).select("ruleId", "level", F.col("message.text").alias("text"))


@query(_ALL + "select rule_id, severity, message, cast(lon as varchar) || ' ' || cast(lat as varchar) as at from found f join points p using (layer_idx, feat_idx) where f.feat_idx is not null and p.lon is not null")
def findings_geojson(spark, sf_dir):
    g = sinks.finding_features(_all(spark, sf_dir))
    f = F.from_json("feature", "geometry struct<coordinates:array<double>>, properties struct<rule_id:string,severity:string,message:string>")
    return g.select(f.alias("f")).select("f.properties.*", F.concat(F.col("f.geometry.coordinates")[0].cast("string"), F.lit(" "), F.col("f.geometry.coordinates")[1].cast("string")).alias("at"))


@query(f"""with {_POINTS} select 'geo' as kind, count(*) as n_rows, min(lon) as min_x, min(lat) as min_y, max(lon) as max_x, max(lat) as max_y, 'ZSTD' as codecs, '' as findings from points
union all select 'plain', count(*), null, null, null, null, 'UNCOMPRESSED', 'cloud/compression,cloud/crs-metadata,cloud/spatial-index' from points
union all select 'snappy', count(*), null, null, null, null, 'SNAPPY', 'cloud/crs-metadata,cloud/spatial-index' from points""")
def geoparquet_footers(spark, sf_dir):
    """All points written as GeoParquet and as two plain Parquet tables; what their footers say."""
    root = scratch_path(spark, "footers")
    features = derived.points(spark, sf_dir).features
    geoparquet.write(features, f"{root}/geo", "EPSG:4326").count()
    flat = features.select("feat_idx", "id", F.to_json("geom").alias("geom"))
    flat.write.option("compression", "none").parquet(f"{root}/plain")
    flat.write.option("compression", "snappy").parquet(f"{root}/snappy")
    read = materialize(geoparquet.footers(spark, root), "footer-rows")  # read several times
    kind = F.regexp_extract("path", "/(geo|plain|snappy)/[^/]+$", 1).alias("kind")
    rows = read.select(kind, "path", "n_rows").distinct().groupBy("kind").agg(F.sum("n_rows").alias("n_rows"))
    boxes = cloud.group_boxes(read).groupBy(kind).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    codecs = read.groupBy(kind).agg(F.array_join(F.array_sort(F.collect_set("codec")), ",").alias("codecs"))  # a handful
    told = cloud.check_footers(read).select(F.col("sub_key").alias("path"), "rule_id").groupBy(kind).agg(F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("findings"))
    out = rows.join(boxes, "kind", "left").join(codecs, "kind", "left").join(told, "kind", "left")
    return out.withColumn("findings", F.coalesce("findings", F.lit("")))


@query("""with r as (select 'customer/' || o_custkey as path, 98 + o_orderkey % 3 as overall, o_orderkey % 2 as findings, o_orderdate as checked from orders),
t as (select *, row_number() over (partition by path, checked order by overall, findings) as k from r),
s as (select *, lag(overall) over w as previous, lag(findings) over w as had, row_number() over w as checks from t where k = 1 window w as (partition by path order by checked))
select path, cast(checked as date) as day, case when had is null then 'new' when overall > previous or overall = previous and findings < had then 'better' else 'worse' end as event,
findings, cast(overall as int) as overall, cast(previous as int) as previous, cast(overall - previous as int) as change, checks from s where had is null or overall <> previous or findings <> had""")
def watch_score_changes(spark, sf_dir):
    """Orders as checks of files named by customers: two streams, the second started on the first one's checkpoint, tell changes of each file's score."""
    root = scratch_path(spark, "watched")
    key = F.col("o_orderkey")
    checks = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("customer/"), "o_custkey").alias("path"), (key % 2).alias("findings"), (98 + key % 3).cast("int").alias("overall"), F.lit("A").alias("grade"), F.col("o_orderdate").cast("timestamp").alias("checked"))
    for when in ("checked < '1995-01-01'", "checked >= '1995-01-01'"):
        checks.where(when).write.mode("append").parquet(f"{root}/results")
        # no silence: the files don't exist
        watch.watch_changes(spark, f"{root}/results", f"{root}/changes", f"{root}/state", once=True, silence=10**10).awaitTermination()
    return spark.read.parquet(f"{root}/changes").select("path", F.to_date("checked").alias("day"), "event", "findings", "overall", "previous", "change", "checks")
