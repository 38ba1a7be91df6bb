"""The rule registry and its rules. A rule takes a :class:`CheckContext` and returns findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geodiag.functions import geometry as g
from geodiag.functions.flat import blocks, flat, ranges, tiles
from geodiag.functions.projections import project, with_parameters
from geodiag.functions.text import fixed
from geodiag.model import FINDING, GEOGRAPHIC, GEOM, LOCATION, RANK, CheckContext, at_feature, at_layer, label
from geodiag.operators import xray
from geodiag.operators.recommend import recommend
from geodiag.runtime import materialize, ship

TOOL = "geodiag"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    domain: str
    severity: str
    check: Callable[[CheckContext], DataFrame]
    weight: float = 1.0
    tags: tuple[str, ...] = ()
    can_fix: bool = False


_RULES: list[Rule] = []


def rule(id: str, name: str, domain: str, severity: str, weight: float = 1.0, tags: tuple[str, ...] = (), can_fix: bool = False):
    """Register ``f(ctx) -> findings``; any module may add rules."""

    def add(f):
        _RULES.append(Rule(id, name, domain, severity, f, weight, tags, can_fix))
        return f

    return add


class Registry:
    """All registered rules in order of id within the order of registration."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = list(_RULES if rules is None else rules)

    def for_domain(self, domain: str) -> list[Rule]:
        return [r for r in self.rules if r.domain == domain]

    def get(self, id: str) -> Rule | None:
        return next((r for r in self.rules if r.id == id), None)

    def __len__(self) -> int:
        return len(self.rules)


DOMAINS = {
    "projection": "projection", "proj": "projection", "crs": "projection", "quality": "data_quality", "data_quality": "data_quality", "data-quality": "data_quality",
    "cartography": "cartography", "carto": "cartography", "diff": "diff", "cloud": "cloud",
}


def parse_domain(text: str | None) -> str | None:
    """None, meaning all, for anything unknown."""
    return DOMAINS.get(text.lower()) if text else None


def findings(df: DataFrame, id: str, severity: str | Column, message: Column, location: Column, suggestion: Column | str, metric: Column | None = None, geom: Column | None = None, fixable: bool = False, feat: Column | None = None, sub: Column | None = None) -> DataFrame:
    """Rows with ``layer_idx`` to findings."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    rank = F.when(sev == "error", RANK["error"]).when(sev == "warning", RANK["warning"]).otherwise(RANK["info"])
    none = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return df.select(
        F.lit(id).alias("rule_id"), sev.alias("severity"), rank.alias("severity_rank"), message.alias("message"), location.cast(LOCATION).alias("location"), none(geom, GEOM).alias("geom"), none(metric, "double").alias("metric"),
        (F.lit(suggestion) if isinstance(suggestion, str) else suggestion).alias("suggestion"), F.lit(fixable).alias("fixable"), F.lit(order_of(id)).alias("rule_ord"), F.col("layer_idx").cast("int").alias("layer_idx"),
        none(feat, "long").alias("feat_idx"), none(sub, "string").alias("sub_key"),
    )


def order_of(id: str) -> int:
    return next((i for i, r in enumerate(_RULES) if r.id == id), len(_RULES))


def no_findings(ctx: CheckContext) -> DataFrame:
    return ctx.data.spark.createDataFrame([], FINDING)


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _named(ctx: CheckContext, features: DataFrame) -> DataFrame:
    """Features with their layer's name. Layers are few: Catalyst broadcasts them by their size."""
    return features.join(ctx.layers.select("layer_idx", F.col("name").alias("layer")), "layer_idx")


def layer_facts(ctx: CheckContext) -> DataFrame:
    """``layer_idx, bare, polygonal, first_idx, p``: a row for each layer with features, from one pass; written once, as several rules read it.

    ``bare``: no feature has properties. ``p``: those of the first feature, whose place is ``first_idx``.
    """

    def make():
        return materialize(ctx.features.groupBy("layer_idx").agg(
            F.bool_and(F.coalesce(F.size("properties"), F.lit(0)) == 0).alias("bare"), F.coalesce(F.bool_or(g.is_polygonal(F.col("geom"))), F.lit(False)).alias("polygonal"),
            F.min("feat_idx").alias("first_idx"), F.min_by("properties", "feat_idx").alias("p")), "facts")

    return ctx.shared("facts", make)


# --- duplicates: one aggregate for both rules


def duplicate_groups(ctx: CheckContext) -> DataFrame:
    """Groups of features of a layer with equal geometry: ``layer_idx, layer, n, labels, geom, feat_idx``.

    Keys are hashed to 128 bits before the shuffle, so that large geometries don't travel. A
    group's labels are one message, so they do meet in one row.
    """

    def make():
        keyed = ctx.features.where("geom is not null").select("layer_idx", "feat_idx", label().alias("label"), F.sha2(g.key(F.col("geom")), 256).alias("k"))
        # a pre-count drops what has no double before labels are gathered
        grouped = keyed.groupBy("layer_idx", "k").agg(F.sort_array(F.collect_list(F.struct("feat_idx", "label"))).alias("who"), F.count(F.lit(1)).alias("n")).where("n > 1")
        firsts = grouped.select("layer_idx", "n", F.array_join(F.transform("who", lambda w: w["label"]), ", ").alias("labels"), F.col("who")[0]["feat_idx"].alias("feat_idx"))
        geoms = ctx.features.select("layer_idx", "feat_idx", "geom")
        return _named(ctx, firsts.join(geoms, ["layer_idx", "feat_idx"]))

    return ctx.shared("duplicates", make)


def _duplicates(ctx: CheckContext, id: str, what: str, fixable: bool) -> DataFrame:
    d = duplicate_groups(ctx)
    message = _text(F.col("n").cast("string"), " features with identical geometry in layer '", F.col("layer"), "': [", F.col("labels"), "]")
    return findings(d, id, "warning", message, at_layer(F.col("layer")), f"Review and remove duplicate {what}, or run `{TOOL} fix --dedup`", F.col("n"), F.col("geom"), fixable, F.col("feat_idx"))


@rule("data_quality/duplicate-features", "Duplicate Features", "data_quality", "warning", 0.6, can_fix=True)
def duplicate_features(ctx):
    return _duplicates(ctx, "data_quality/duplicate-features", "features", True)


@rule("data/duplicate-geometry", "Duplicate Geometry", "data_quality", "warning", 0.6)
def duplicate_geometry(ctx):
    return _duplicates(ctx, "data/duplicate-geometry", "geometries", False)


@rule("data_quality/empty-dataset", "Empty Dataset", "data_quality", "warning")
def empty_dataset(ctx):
    d = ctx.layers.join(layer_facts(ctx).select("layer_idx"), "layer_idx", "left_anti")
    return findings(d, "data_quality/empty-dataset", "warning", _text("Layer '", F.col("name"), "' contains no features"), at_layer(F.col("name")), "Verify the data source is correct and contains features", F.lit(0.0))


@rule("data/extent-bounds", "Extent Bounds", "data_quality", "warning", 0.5)
def extent_bounds(ctx):
    boxed = ctx.features.where("geom is not null").select("layer_idx", "feat_idx", label().alias("label"), "geom", g.bbox(F.col("geom")).alias("box"))
    d = boxed.join(ctx.layers.select("layer_idx", F.col("name").alias("layer"), "bounds").where("bounds is not null"), "layer_idx").where(g.outside(F.col("box"), F.col("bounds")))
    message = _text("Feature ", F.col("label"), " in layer '", F.col("layer"), "' extends outside declared bounds")
    return findings(d, "data/extent-bounds", "warning", message, at_feature(F.col("label")), "Update the layer extent or correct the feature geometry", geom=F.col("geom"), feat=F.col("feat_idx"))


@rule("data/null-geometry", "Null Geometry", "data_quality", "error", 0.8)
def null_geometry(ctx):
    d = _named(ctx, ctx.features.where(g.is_empty(F.col("geom"))).select("layer_idx", "feat_idx", label().alias("label")))
    message = _text("Feature ", F.col("label"), " has null or empty geometry in layer '", F.col("layer"), "'")
    return findings(d, "data/null-geometry", "error", message, at_feature(F.col("label")), "Remove null-geometry features or add valid geometry", feat=F.col("feat_idx"))


def value_type(json: Column) -> Column:
    """One of six classes by a JSON text's first character; a missing value is a null."""
    c = F.substring(F.ltrim(json), 1, 1)
    return F.when(json.isNull() | (c == "n"), "null").when(c == '"', "string").when(c.isin("t", "f"), "boolean").when(c == "[", "array").when(c == "{", "object").otherwise("number")


@rule("data/schema-validate", "Schema Validation", "data_quality", "error", 0.8)
def schema_validate(ctx):
    # the fields of each layer's first feature
    schema = layer_facts(ctx).select("layer_idx", "first_idx", F.transform(F.map_entries("p"), lambda e: F.struct(e["key"].alias("key"), value_type(e["value"]).alias("type"))).alias("fields"))
    d = ctx.features.select("layer_idx", "feat_idx", label().alias("label"), "geom", "properties").join(schema, "layer_idx").where("feat_idx > first_idx")
    problems = F.filter(
        F.transform("fields", lambda f: F.struct(
            f["key"].alias("key"), f["type"].alias("want"), F.map_contains_key("properties", f["key"]).alias("there"), value_type(F.element_at("properties", f["key"])).alias("got"))),
        lambda f: ~f["there"] | ((f["got"] == "null") & (f["want"] != "null")) | ((f["got"] != "null") & (f["want"] != "null") & (f["got"] != f["want"])),
    )
    bad = _named(ctx, d.select("layer_idx", "feat_idx", "label", "geom", F.explode(problems).alias("f")))
    key, head = F.col("f.key"), _text("Feature ", F.col("label"), " in layer '", F.col("layer"), "'")
    missing, null = ~F.col("f.there"), F.col("f.there") & (F.col("f.got") == "null")
    message = F.when(missing, _text(head, " is missing field '", key, "'")).when(null, _text(head, " has unexpected null for non-nullable field '", key, "'")).otherwise(_text(head, ": field '", key, "' has type ", F.col("f.got"), ", expected ", F.col("f.want")))
    advice = F.when(missing, _text("Add the missing field '", key, "' or update the schema")).when(null, _text("Provide a value for field '", key, "' or mark the field as nullable")).otherwise(_text("Convert field '", key, "' to ", F.col("f.want")))
    return findings(bad, "data/schema-validate", F.when(null, "warning").otherwise("error"), message, at_feature(F.col("label")), advice, geom=F.col("geom"), feat=F.col("feat_idx"), sub=key)


@rule("data/self-intersection", "Self Intersection", "data_quality", "error", 0.9, ("topology", "geometry"))
def self_intersection(ctx):
    if not has_polygons(ctx):
        return no_findings(ctx)
    polys = ctx.features.where(g.is_polygonal(F.col("geom")))
    short = polys.where(g.longest_ring(F.col("geom")) <= g.LONG_RING).where(g.self_intersects(F.col("geom")))
    long = polys.where(g.longest_ring(F.col("geom")) > g.LONG_RING).where(_long_rings_cross()(g.rings(F.col("geom"))))
    d = _named(ctx, short.unionByName(long).select("layer_idx", "feat_idx", label().alias("label"), "geom"))
    message = _text("Feature ", F.col("label"), " in layer '", F.col("layer"), "' has self-intersecting geometry")
    return findings(d, "data/self-intersection", "error", message, at_feature(F.col("label")), f"Fix the geometry by removing self-intersections. Use `ST_MakeValid` or `{TOOL} fix --topology`", geom=F.col("geom"), feat=F.col("feat_idx"))


def _long_rings_cross():
    """Proper crossings in rings too long for expressions: segment blocks against each other, boxes first."""
    @F.pandas_udf("boolean")
    def cross(rings: pd.Series) -> pd.Series:
        return rings.map(lambda rs: any(ring_crosses([(p["x"], p["y"]) for p in r]) for r in rs))

    return cross


def ring_crosses(ring: list[tuple[float, float]]) -> bool:
    """Whether segments that aren't neighbours cross properly: swept by x, so only overlapping ones are tested."""
    p = np.asarray(ring, float)
    n = len(p) - 1
    if n < 3:
        return False
    a, b = p[:-1], p[1:]
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(lo[:, 0], kind="stable")
    starts = lo[order, 0]
    ends = np.searchsorted(starts, hi[order, 0], "right")
    side = lambda o, q, r: (q[..., 0] - o[..., 0]) * (r[..., 1] - o[..., 1]) - (q[..., 1] - o[..., 1]) * (r[..., 0] - o[..., 0])
    for k in range(n):
        i, js = order[k], order[k + 1 : ends[k]]
        js = js[(lo[js, 1] <= hi[i, 1]) & (hi[js, 1] >= lo[i, 1])]
        gap = np.abs(js - i)
        js = js[(gap > 1) & (gap < n - 1)]
        if len(js):
            d1, d2, d3, d4 = side(a[js], b[js], a[i]), side(a[js], b[js], b[i]), side(a[i], b[i], a[js]), side(a[i], b[i], b[js])
            if ((((d1 > 0) & (d2 < 0)) | ((d1 < 0) & (d2 > 0))) & (((d3 > 0) & (d4 < 0)) | ((d3 < 0) & (d4 > 0)))).any():
                return True
    return False


# --- polygon pairs


def has_polygons(ctx: CheckContext) -> bool:
    """Whether any feature is polygonal: decides, by the facts if they are there or else by one short scan, if plans over rings and pairs are built at all."""
    known = ctx.memo.get("facts")
    return ctx.shared("polygonal", lambda: not (known.where("polygonal") if known is not None else ctx.features.where(g.is_polygonal(F.col("geom")))).select("layer_idx").isEmpty())


def polygons(ctx: CheckContext) -> DataFrame:
    return ctx.features.where(g.is_polygonal(F.col("geom")))


def polygon_cells(ctx: CheckContext, grow: float = 0.0) -> DataFrame:
    """``layer_idx, feat_idx, b, level, lv, cx, cy``: polygons' boxes dealt to grid cells of about their typical size, one row for each cell that the box touches.

    Most polygons touch few cells. Those much larger than the typical one use coarser grids, by powers of two,
    and a pair meets in the coarser of its two grids: each polygon is also entered in all coarser grids in use.
    """
    p = polygons(ctx).select("layer_idx", "feat_idx", g.bbox(F.col("geom")).alias("b")).where("b is not null")
    size = F.greatest(F.col("b.max_x") - F.col("b.min_x"), F.col("b.max_y") - F.col("b.min_y"), F.lit(1e-9)) + 2 * grow
    p = p.withColumn("level", F.ceil(F.log2(size)).cast("int"))
    levels = p.groupBy("layer_idx").agg(F.sort_array(F.collect_set("level")).alias("levels"))  # a few dozen whole numbers at most
    p = p.join(levels, "layer_idx").withColumn("lv", F.explode(F.filter("levels", lambda x: x >= F.col("level")))).drop("levels")
    side = F.pow(F.lit(2.0), F.col("lv"))
    span = lambda lo, hi: F.sequence(F.floor((lo - grow) / side), F.floor((hi + grow) / side))
    p = p.withColumn("cx", F.explode(span(F.col("b.min_x"), F.col("b.max_x"))))
    return p.withColumn("cy", F.explode(span(F.col("b.min_y"), F.col("b.max_y"))))


#: vertices of one polygon times those of another, up to which all are compared
SMALL = 1024


def candidate_pairs(ctx: CheckContext, grow: float = 0.0, strict: bool = False, apart: bool = False) -> DataFrame:
    """Pairs of polygons of a layer whose boxes meet (``strict``: have an area in common), each once, with both boxes and geometries. ``apart``: without small ones that have a vertex in common.

    An equi-join on grid cells finds them from ids and boxes alone; geometries are then joined by id to the pairs that are left.
    """
    c = polygon_cells(ctx, grow)
    cols = lambda s: [F.col("layer_idx"), F.col("lv"), F.col("cx"), F.col("cy"), *(F.col(x).alias(f"{x}_{s}") for x in ("feat_idx", "b", "level"))]
    side = F.pow(F.lit(2.0), F.col("lv"))
    met = c.select(*cols("a")).join(c.select(*cols("b")), ["layer_idx", "lv", "cx", "cy"]).where("feat_idx_a < feat_idx_b and lv = greatest(level_a, level_b)")
    lo = lambda m: F.greatest(F.col(f"b_a.min_{m}"), F.col(f"b_b.min_{m}"))
    hi = lambda m: F.least(F.col(f"b_a.max_{m}"), F.col(f"b_b.max_{m}"))
    # boxes that meet in several cells count in that of their common corner
    corner = (F.floor((lo("x") - grow) / side) == F.col("cx")) & (F.floor((lo("y") - grow) / side) == F.col("cy"))
    close = (lo("x") < hi("x")) & (lo("y") < hi("y")) if strict else (lo("x") <= hi("x") + 2 * grow) & (lo("y") <= hi("y") + 2 * grow)
    pairs = met.where(close & corner).select("layer_idx", "feat_idx_a", "feat_idx_b", "b_a", "b_b")
    p = polygons(ctx).select("layer_idx", "feat_idx", label().alias("label"), "geom")
    for s in ("a", "b"):
        pairs = pairs.join(p.select("layer_idx", *(F.col(x).alias(f"{x}_{s}") for x in ("feat_idx", "label", "geom"))), ["layer_idx", f"feat_idx_{s}"])
    if apart:
        # a common vertex tells that boundaries touch; only of small shapes, as all vertices meet all
        va, vb = g.points(F.col("geom_a")), g.points(F.col("geom_b"))
        pairs = pairs.where(~F.when(g.n_points(F.col("geom_a")).cast("long") * g.n_points(F.col("geom_b")) <= SMALL, F.arrays_overlap(va, vb)).otherwise(False))
    return pairs.select("*", _segments(F.col("geom_a")).alias("s_a"), _segments(F.col("geom_b")).alias("s_b"))


def _segments(geom: Column) -> Column:
    return F.flatten(F.transform(g.rings(geom), lambda r: F.when(F.size(r) > 1, F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: F.struct(r[i].alias("p"), r[i + 1].alias("q")))).otherwise(F.array())))


def contains(segments: Column, pt: Column) -> Column:
    """Point strictly inside a polygon of these edges, by the parity of crossings over all rings; one pass."""

    def step(a, e):
        p, q = e["p"], e["q"]
        over = (p["y"] > pt["y"]) != (q["y"] > pt["y"])
        hit = over & (pt["x"] < (q["x"] - p["x"]) * (pt["y"] - p["y"]) / F.when(over, q["y"] - p["y"]) + p["x"])
        on = (g.cross(p, q, pt) == 0) & pt["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & pt["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        return F.when(on, 2).when(F.coalesce(hit, F.lit(False)) & (a < 2), 1 - a).otherwise(a)

    return F.aggregate(segments, F.lit(0), step) == 1


#: how far beside an edge's middle a point is taken, of the edge's length
BESIDE = 1e-6


def overlap() -> Column:
    """Interiors of a candidate pair meet: edges cross properly, or a vertex or an edge's middle of one lies inside the other, or a point close beside an edge's middle inside both.

    The last is for shapes whose edges lie on each other, as those of equal ones do.
    """
    sa, sb = F.col("s_a"), F.col("s_b")
    at = lambda e, k: F.struct(((e["p"]["x"] + e["q"]["x"]) / 2 - k * (e["q"]["y"] - e["p"]["y"])).alias("x"), ((e["p"]["y"] + e["q"]["y"]) / 2 + k * (e["q"]["x"] - e["p"]["x"])).alias("y"))
    crossing = F.exists(sa, lambda x: F.exists(sb, lambda y: g.crosses(x["p"], x["q"], y["p"], y["q"])))
    probes = lambda segs: F.concat(F.transform(segs, lambda e: e["p"]), F.transform(segs, lambda e: at(e, 0.0)))
    beside = lambda segs: F.concat(F.transform(segs, lambda e: at(e, BESIDE)), F.transform(segs, lambda e: at(e, -BESIDE)))
    both = lambda p: contains(sa, p) & contains(sb, p)
    return crossing | F.exists(probes(sa), lambda p: contains(sb, p)) | F.exists(probes(sb), lambda p: contains(sa, p)) | F.exists(beside(sa), both) | F.exists(beside(sb), both)


def overlapping_pairs(ctx: CheckContext) -> DataFrame:
    return ctx.shared("overlaps", lambda: candidate_pairs(ctx, strict=True).where(overlap()))


@rule("data/topology-overlaps", "Topology Overlaps", "data_quality", "warning", 0.7, ("topology",), can_fix=True)
def topology_overlaps(ctx):
    if not has_polygons(ctx):
        return no_findings(ctx)
    d = _named(ctx, overlapping_pairs(ctx).select("layer_idx", "feat_idx_a", "feat_idx_b", "label_a", "label_b", "geom_a"))
    message = _text("Features ", F.col("label_a"), " and ", F.col("label_b"), " overlap in layer '", F.col("layer"), "'")
    return findings(d, "data/topology-overlaps", "warning", message, at_feature(F.col("label_a")), "Edit the polygons so that they share an edge and don't overlap", geom=F.col("geom_a"), fixable=True, feat=F.col("feat_idx_a"), sub=F.format_string("%012d", F.col("feat_idx_b")))


#: bytes of polygons, and pairs of edges, that a task compares at a time
HELD, PAIRS = 16 << 20, 1 << 20
NEAR = f"layer_idx int, feat_idx_a long, feat_idx_b long, label_a string, label_b string, geom_a {GEOM}, geom_b {GEOM}, gap double, meet boolean"


def boundary_gaps(ctx: CheckContext, tolerance: float) -> DataFrame:
    """Pairs of polygons of a layer whose nearest boundaries are apart, by no more than ``tolerance``: ``layer_idx, feat_idx_a, feat_idx_b, label_a, label_b, geom_a, gap``.

    The gap is the least distance from a vertex of one to an edge of the other; pairs that touch or overlap have none. Polygons are sent whole to the
    tiles that they touch, some two to eight times as wide as they are, and measured there; only pairs with a gap leave a tile.
    """
    ship(ctx.data.spark)
    p = polygons(ctx).select("layer_idx", "feat_idx", label().alias("label"), "geom", g.bbox(F.col("geom")).alias("b")).where("b is not null")
    size = F.greatest(F.col("b.max_x") - F.col("b.min_x"), F.col("b.max_y") - F.col("b.min_y"), F.lit(1e-9)) + 2 * tolerance
    p = p.select("*", F.ceil(F.log2(2 * size) / 3).cast("int").alias("level"))
    # of polygons of several sizes a pair meets in the coarser of its two grids
    levels = p.groupBy("layer_idx").agg(F.collect_set("level").alias("levels"))  # a few dozen whole numbers at most
    p = p.join(F.broadcast(levels), "layer_idx").withColumn("lv", F.explode(F.filter("levels", lambda x: x >= F.col("level"))))
    for c in "xy":
        span = F.sequence(*(F.floor(v / F.pow(F.lit(8.0), F.col("lv"))) for v in (F.col("b.min_" + c) - tolerance, F.col("b.max_" + c) + tolerance)))
        p = p.withColumn("c" + c, F.explode(span))
    key = ["layer_idx", "lv", "cx", "cy"]
    dealt = p.select(*key, "feat_idx", "level", "label", "geom", *(F.col(f"b.{m}_{c}").alias(m + c) for c in "xy" for m in ("min", "max"))).repartition(*key).sortWithinPartitions(*key)

    def measure(batches):
        for b, t in tiles(batches, key, HELD):
            feat, level, lv, lo, hi = np.asarray(b["feat_idx"]), np.asarray(b["level"]), np.asarray(b["lv"]), {}, {}
            for c in "xy":
                lo[c], hi[c] = np.asarray(b["min" + c]), np.asarray(b["max" + c])
            ends = _ends(b["geom"])
            # complex numbers are in order of tile and place
            z = t + 1j * lo["x"]
            order = np.argsort(z, kind="stable")
            first = np.arange(1, len(z) + 1)
            n = np.searchsorted(z[order], t[order] + 1j * (hi["x"][order] + 2 * tolerance), "right") - first
            for s in blocks(n, PAIRS):
                i, j = np.repeat(order[s], n[s]), order[ranges(first[s], n[s])]
                i, j = np.where(feat[i] < feat[j], i, j), np.where(feat[i] < feat[j], j, i)
                ok = (feat[i] < feat[j]) & (lv[i] == np.maximum(level[i], level[j]))
                for c in "xy":
                    near, far = np.maximum(lo[c][i], lo[c][j]), np.minimum(hi[c][i], hi[c][j])
                    # boxes that meet in several tiles count in that of their common corner
                    ok &= (near <= far + 2 * tolerance) & (np.floor((near - tolerance) / 8.0 ** lv[i]) == np.asarray(b["c" + c])[i])
                i, j = i[ok], j[ok]
                gap = _nearest(i, j, ends, lo, hi, tolerance)
                ok = (gap > 0) & (gap <= tolerance)
                i, j, gap = i[ok], j[ok], gap[ok]
                meet = np.logical_and.reduce([(lo[c][i] <= hi[c][j]) & (lo[c][j] <= hi[c][i]) for c in "xy"])
                at, to = pa.array(i), pa.array(j)
                yield pa.RecordBatch.from_arrays([b["layer_idx"].take(at), b["feat_idx"].take(at), b["feat_idx"].take(to), b["label"].take(at), b["label"].take(to), b["geom"].take(at), b["geom"].take(pa.array(j, mask=~meet)), pa.array(gap), pa.array(meet)], names=["layer_idx", "feat_idx_a", "feat_idx_b", "label_a", "label_b", "geom_a", "geom_b", "gap", "meet"])

    found = dealt.mapInArrow(measure, NEAR)
    # shapes whose boxes don't meet can't overlap
    parts = found.select("*", *(F.when(F.col("meet"), _segments(F.col("geom_" + s))).alias("s_" + s) for s in "ab"))
    return parts.where(~(F.col("meet") & overlap())).select("layer_idx", "feat_idx_a", "feat_idx_b", "label_a", "label_b", "geom_a", "gap")


def _ends(geom: pa.StructArray) -> tuple:
    """Edges of polygons in order: of each polygon the first one and their number; and their ends ``px, py, qx, qy``."""
    f = flat(geom)
    kind = pc.struct_field(pc.struct_field(geom, "parts").flatten(), "kind")
    e = f.edges()
    e = e[np.asarray(pc.fill_null(pc.equal(kind, "polygon"), False))[f.part[f.ring[e]]]]
    n = np.bincount(f.row[e], minlength=len(geom))
    return np.cumsum(n) - n, n, f.x[e], f.y[e], f.x[e + 1], f.y[e + 1]


def _nearest(i: np.ndarray, j: np.ndarray, ends: tuple, lo: dict, hi: dict, tolerance: float) -> np.ndarray:
    """Least distance between vertices of one and edges of the other of pairs of polygons, of edges beside the other's box: only those can be as near as ``tolerance``."""
    first, n, *corner = ends
    out = np.full(len(i), np.inf)

    def beside(own, other):
        at = np.repeat(np.arange(len(own)), n[own])
        e = ranges(first[own], n[own])
        keep = np.ones(len(e), bool)
        for c, p, q in zip("xy", corner[:2], corner[2:]):
            keep &= (np.minimum(p[e], q[e]) - tolerance <= hi[c][other[at]]) & (np.maximum(p[e], q[e]) + tolerance >= lo[c][other[at]])
        return at[keep], e[keep]

    def distance(u, v):
        x, y, px, py, qx, qy = corner[0][u], corner[1][u], *(w[v] for w in corner)
        dx, dy = qx - px, qy - py
        m = dx * dx + dy * dy
        k = np.where(m > 0, np.maximum(0.0, np.minimum(1.0, ((x - px) * dx + (y - py) * dy) / np.where(m > 0, m, 1.0))), 0.0)
        x, y = px + k * dx - x, py + k * dy - y
        return np.sqrt(x * x + y * y)

    for s in blocks(n[i] + n[j], PAIRS):
        (at, u), (to, v) = beside(i[s], j[s]), beside(j[s], i[s])
        count = np.bincount(to, minlength=s.stop - s.start)
        begin = np.cumsum(count) - count
        for r in blocks(count[at], PAIRS):
            pair, a = np.repeat(at[r], count[at[r]]), np.repeat(u[r], count[at[r]])
            b = v[ranges(begin[at[r]], count[at[r]])]
            np.fmin.at(out, s.start + pair, np.fmin(distance(a, b), distance(b, a)))
    return out


@rule("data/topology-gaps", "Topology Gaps", "data_quality", "warning", 0.7, ("topology",), can_fix=True)
def topology_gaps(ctx):
    if not has_polygons(ctx):
        return no_findings(ctx)
    d = _named(ctx, boundary_gaps(ctx, ctx.config.check.topology_gap_tolerance))
    message = _text("Gap between features ", F.col("label_a"), " and ", F.col("label_b"), " in layer '", F.col("layer"), "'")
    return findings(d, "data/topology-gaps", "warning", message, at_feature(F.col("label_a")), "Snap the polygons' edges to each other", F.col("gap"), F.col("geom_a"), True, F.col("feat_idx_a"), F.format_string("%012d", F.col("feat_idx_b")))


# --- projection


@rule("projection/missing-crs", "Missing CRS", "projection", "error")
def missing_crs(ctx):
    d = ctx.layers.where("crs is null")
    return findings(d, "projection/missing-crs", "error", _text("Layer '", F.col("name"), "' has no coordinate reference system (CRS) defined"), at_layer(F.col("name")), "Define a CRS for the layer. If coordinates are lon/lat, use EPSG:4326.")


@rule("proj/datum-mismatch", "Datum Mismatch", "projection", "error", can_fix=True)
def datum_mismatch(ctx):
    known = ctx.layers.where("crs is not null").select("layer_idx", "name", "crs")
    first = known.agg(F.min(F.struct("layer_idx", "name", "crs")).alias("r"))  # one row
    d = known.join(F.broadcast(first)).where("layer_idx > r.layer_idx and crs <> r.crs")
    message = _text("CRS mismatch: layer '", F.col("r.name"), "' uses ", F.col("r.crs"), " but layer '", F.col("name"), "' uses ", F.col("crs"))
    return findings(d, "proj/datum-mismatch", "error", message, at_layer(F.col("name")), f"Reproject all layers to a common CRS. Run `{TOOL} fix --reproject` to align to a recommended CRS.", fixable=True)


def projected_layers(ctx: CheckContext) -> DataFrame:
    """``layer_idx, name, crs, projection`` of layers whose CRS is given, known and not geographic: a row for each with its parameters, so that all go through one plan. Other layers aren't measured."""
    given = ctx.layers.where(F.col("crs").isNotNull() & ~F.col("crs").isin(*GEOGRAPHIC)).select("layer_idx", "name", "crs")
    return ctx.shared("projected", lambda: materialize(with_parameters(given).where("projection is not null"), "projected"))


def projected_samples(ctx: CheckContext) -> DataFrame:
    """``layer_idx, feat_idx, sample_idx, lon, lat, name, crs, projection`` of the projected layers: at most the configured number each, written once for all rules."""

    def make():
        layers = projected_layers(ctx)
        samples = xray.sample_points(ctx.features.join(layers.select("layer_idx"), "layer_idx", "left_semi"), ctx.config.xray.max_samples)
        return materialize(samples.join(layers, "layer_idx"), "samples")

    return ctx.shared("samples", make)


def layer_distortion(ctx: CheckContext) -> DataFrame:
    """``layer_idx, name, crs, summary..., rec`` of projected layers, all in one plan."""

    def make():
        measured = xray.summary(xray.measure(projected_samples(ctx), F.col("projection"), ctx.config.mode), ["layer_idx"])
        # a layer without samples has zeros
        known = projected_layers(ctx).select("layer_idx", "name", "crs")
        zeros = {c: 0 for c in measured.columns if c != "layer_idx"}
        measured = known.join(measured, "layer_idx", "left").fillna(zeros)
        world = F.struct(F.lit(-180.0).alias("min_x"), F.lit(-90.0).alias("min_y"), F.lit(180.0).alias("max_x"), F.lit(90.0).alias("max_y"))
        best = recommend(ctx.layers.select("layer_idx", F.coalesce("bounds", world).alias("bounds")), min(1, ctx.config.xray.top_recommendations)).select("layer_idx", F.struct("crs", "name").alias("rec"))
        return materialize(measured.join(best, "layer_idx", "left"), "distortion")  # a row per layer, read by two rules

    return ctx.shared("distortion", make)


@rule("proj/area-distortion", "Area Distortion", "projection", "warning", can_fix=True)
def area_distortion(ctx):
    d = layer_distortion(ctx)
    most, mean = F.col("max_area_distortion_pct"), F.col("mean_area_distortion_pct")
    message = _text("Layer '", F.col("name"), "' has ", fixed(most, 1), "% max area distortion (mean: ", fixed(mean, 1), "%) in CRS ", F.col("crs"))
    advice = F.when(F.col("rec").isNotNull(), _text("Consider reprojecting to ", F.col("rec.crs"), " (", F.col("rec.name"), "). Max area distortion: ", fixed(most, 1), "%, mean: ", fixed(mean, 1), f"%. Run `{TOOL} fix --reproject`."))
    advice = F.coalesce(advice, _text(f"Run `{TOOL} xray {ctx.data.path}` for CRS recommendations. Max area distortion: ", fixed(most, 1), "%."))
    d = d.where(most > min(ctx.config.check.max_distortion_pct, 5.0))
    return findings(d, "proj/area-distortion", F.when(most > 10.0, "error").otherwise("warning"), message, at_layer(F.col("name")), advice, most, fixable=True)


@rule("projection/high-distortion", "High Distortion", "projection", "warning", can_fix=True)
def high_distortion(ctx):
    d = layer_distortion(ctx)
    most, limit = F.col("max_area_distortion_pct"), float(ctx.config.check.max_distortion_pct)
    message = _text("Layer '", F.col("name"), "' has ", fixed(most, 1), "% max area distortion (threshold: ", fixed(F.lit(limit), 1), "%) in CRS ", F.col("crs"))
    advice = F.coalesce(F.when(F.col("rec").isNotNull(), _text("Consider reprojecting to ", F.col("rec.crs"), " (", F.col("rec.name"), f"). Run `{TOOL} xray {ctx.data.path}` for details.")), F.lit(f"Run `{TOOL} xray {ctx.data.path}` for CRS recommendations."))
    return findings(d.where(most > limit), "projection/high-distortion", F.when(most > 2 * limit, "error").otherwise("warning"), message, at_layer(F.col("name")), advice, most, fixable=True)


def haversine(lon1, lat1, lon2, lat2, radius: float = xray.EARTH) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def distance_errors(samples: DataFrame) -> DataFrame:
    """Each sample of a layer against the next in order: ``layer_idx, name, crs, i, j, planar, geodesic, error_pct``, in metres.

    ``samples`` as of :func:`projected_samples`: at most the configured number a layer, so one ordered pass over each is small.
    """
    w = Window.partitionBy("layer_idx").orderBy("sample_idx")
    p = samples.withColumn("p", project(F.col("projection"), F.col("lon"), F.col("lat")))
    p = p.select("*", *(F.lead(c).over(w).alias(f"{c}2") for c in ("sample_idx", "lon", "lat", "p"))).where("p is not null and p2 is not null")
    planar = F.sqrt((F.col("p2.x") - F.col("p.x")) * (F.col("p2.x") - F.col("p.x")) + (F.col("p2.y") - F.col("p.y")) * (F.col("p2.y") - F.col("p.y"))) * F.col("projection.unit")
    geodesic = haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    d = p.select("layer_idx", "name", "crs", F.col("sample_idx").alias("i"), F.col("sample_idx2").alias("j"), planar.alias("planar"), geodesic.alias("geodesic")).where("geodesic > 0")
    return d.withColumn("error_pct", F.abs(F.col("planar") - F.col("geodesic")) / F.col("geodesic") * 100.0)


@rule("proj/distance-distortion", "Distance Distortion", "projection", "warning", 0.8)
def distance_distortion(ctx):
    d = distance_errors(projected_samples(ctx)).groupBy("layer_idx", "name", "crs").agg(F.max("error_pct").alias("most"), F.avg("error_pct").alias("mean"))
    d = d.where(F.col("most") > float(ctx.config.check.max_distortion_pct))
    message = _text("Layer '", F.col("name"), "' has ", fixed(F.col("most"), 1), "% max distance distortion (mean: ", fixed(F.col("mean"), 1), "%) in CRS ", F.col("crs"))
    return findings(d, "proj/distance-distortion", "warning", message, at_layer(F.col("name")), "Use geodesic distances, or an equidistant projection centred on the data", F.col("most"))


@rule("cartography/missing-symbology-hints", "Missing Symbology Hints", "cartography", "info")
def missing_symbology(ctx):
    d = ctx.layers.join(layer_facts(ctx).select("layer_idx", "bare"), "layer_idx", "left").where(F.coalesce("bare", F.lit(True)))
    message = _text("Layer '", F.col("name"), "' has no style/classification hint attributes; cartographic checks are limited")
    return findings(d, "cartography/missing-symbology-hints", "info", message, at_layer(F.col("name")), "Include style or class fields to enable deeper cartographic linting")


def run_checks(ctx: CheckContext, domain: str | None = None, registry: Registry | None = None) -> DataFrame:
    """Findings of all rules but those disabled or of another domain, in one plan; see :func:`ordered`."""
    rules = [r for r in (registry or Registry()).rules if r.id not in ctx.config.check.disabled_rules and domain in (None, r.domain)]
    return reduce(DataFrame.unionByName, [r.check(ctx) for r in rules]) if rules else no_findings(ctx)


def ordered(found: DataFrame) -> DataFrame:
    """Errors first; then by rule, layer, feature and field."""
    return found.orderBy(F.desc("severity_rank"), "rule_ord", "layer_idx", "feat_idx", "sub_key")
