"""Renderers: JSON, SARIF, GeoJSON, SVG badge, terminal text, HTML. Rows are built in the engine; the driver joins the final text."""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodiag.functions import geometry as g
from geodiag.functions.text import distortion_color

TOOL = "geodiag"
FINDING_JSON = ("rule_id", "severity", "message", "location", "metric", "suggestion", "fixable")


def location_json(loc: Column) -> Column:
    """The location's own keys only; null without one."""
    return F.when(loc.isNotNull(), F.to_json(F.struct(
        loc["type"].alias("type"), loc["id"].alias("id"), loc["name"].alias("name"),
        F.when(loc["min_x"].isNotNull(), F.struct(loc["min_x"].alias("min_x"), loc["min_y"].alias("min_y"), loc["max_x"].alias("max_x"), loc["max_y"].alias("max_y"))).alias("bounds"))))


def finding_rows(findings: DataFrame) -> list[dict]:
    """Findings in order as dictionaries, geometry left out. A report is read by people, so it's gathered."""
    cols = [c for c in FINDING_JSON if c != "location"]
    rows = findings.select(*cols, location_json(F.col("location")).alias("location")).collect()
    return [{c: (json.loads(r[c]) if r[c] else None) if c == "location" else r[c] for c in FINDING_JSON} for r in rows]


def check_json(path: str, findings: list[dict], summary: dict, by_domain: dict) -> str:
    return json.dumps({"file_path": path, "findings": findings, "summary": {**summary, "by_domain": by_domain}}, indent=2, ensure_ascii=False)


def sarif_results(findings: DataFrame) -> DataFrame:
    """``ruleId, level, message, rank`` of each finding."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    return findings.select(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"))


def check_sarif(path: str, findings: list[dict]) -> str:
    """SARIF 2.1.0; rules in order of first appearance."""
    level = {"error": "error", "warning": "warning", "info": "note"}
    ids = list(dict.fromkeys(f["rule_id"] for f in findings))
    return json.dumps({
        "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0",
        "runs": [{
            "tool": {"driver": {"name": TOOL, "rules": [{"id": i, "name": i, "shortDescription": {"text": i}} for i in ids]}},
            "results": [{"ruleId": f["rule_id"], "level": level[f["severity"]], "message": {"text": f["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": path}}}]} for f in findings],
        }],
    }, indent=2, ensure_ascii=False)


def _json(c: Column) -> Column:
    """JSON text of one value."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _feature(geometry: Column, properties: Column, id: Column | None = None) -> Column:
    own = F.lit("") if id is None else F.when(id.isNotNull(), F.concat(F.lit(',"id":'), _json(id))).otherwise("")
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), properties, own, F.lit("}"))


def finding_features(findings: DataFrame) -> DataFrame:
    """A GeoJSON feature of each finding with a geometry."""
    props = F.to_json(F.struct("rule_id", "severity", "message", "metric"))
    return findings.where("geom is not null").select(_feature(g.to_geojson(F.col("geom")), props).alias("feature"))


def ellipse_features(ellipses: DataFrame) -> DataFrame:
    props = F.to_json(F.struct("area_distortion_pct", "angular_distortion_deg", "semimajor", "semiminor", "angle_deg"))
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array("coordinates").alias("coordinates")))
    return ellipses.select(_feature(shape, props).alias("feature"))


def heatmap_features(cells: DataFrame) -> DataFrame:
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.col("coordinates")))
    return cells.select(_feature(shape, F.to_json(F.struct(F.col("value").alias("distortion_pct"), "color"))).alias("feature"))


def layer_features(data) -> DataFrame:
    """A GeoJSON feature of each feature with a geometry; its own properties may replace ``layer`` and ``id``."""
    f = data.features.where("geom is not null").join(data.layers.select("layer_idx", "name"), "layer_idx")
    base = F.map_filter(F.create_map(F.lit("layer"), _json(F.col("name")), F.lit("id"), F.when(F.col("id").isNotNull(), _json(F.col("id")))), lambda k, v: v.isNotNull())
    own = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
    pairs = F.transform(F.map_entries(merged), lambda e: F.concat(_json(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
    return f.select("layer_idx", "feat_idx", _feature(g.to_geojson(F.col("geom")), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), F.col("id")).alias("feature"))


def feature_collection(features: DataFrame) -> str:
    """One text of a report's features."""
    return '{"type":"FeatureCollection","features":[' + ",".join(r.feature for r in features.select("feature").toLocalIterator()) + "]}"


def write_features(features: DataFrame, path: str) -> None:
    """GeoJSON text sequences: one feature a line, written in parallel."""
    features.select("feature").write.mode("overwrite").text(path)


# fixed values: badge colours
BADGE = ((90, "#4c1"), (75, "#97ca00"), (60, "#dfb317"), (40, "#fe7d37"))


def badge_color(score: int) -> str:
    return next((c for least, c in BADGE if least <= score <= 100), "#e05d44")


def badge(overall: int, grade: str) -> str:
    """SVG with the score and grade."""
    label, value = "Geodiag Score", f"{overall}/100 — {grade}"
    text = lambda x, s: f'<text x="{x}" y="14">{s}</text>'
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="200" height="20" role="img" aria-label="{label}: {value}"><title>{label}: {value}</title>'
        f'<rect width="90" height="20" rx="3" fill="#555"/><rect x="90" width="110" height="20" rx="3" fill="{badge_color(overall)}"/>'
        f'<g fill="#fff" text-anchor="middle" font-family="Verdana,sans-serif" font-size="11">{text(45, label)}{text(145, value)}</g></svg>'
    )


_COLOR = {"red": "31", "green": "32", "yellow": "33", "blue": "34"}


def _paint(s: str, color: str) -> str:
    return f"\x1b[{_COLOR[color]}m{s}\x1b[0m"


def score_bar(score: int) -> str:
    full = score // 5
    return _paint("█" * full, "green" if score >= 75 else "yellow" if score >= 40 else "red") + "░" * (20 - full)


def terminal_check(path: str, findings: list[dict], summary: dict) -> str:
    icon = {"error": _paint("✗", "red"), "warning": _paint("⚠", "yellow"), "info": _paint("ℹ", "blue")}
    lines = ["", "  Check — diagnostic results", f"  File: {path}", f"  Found: {summary['total']} issues ({summary['errors']} errors, {summary['warnings']} warnings, {summary['info']} info)", ""]
    for f in findings:
        lines.append(f"  {icon[f['severity']]} [{f['rule_id']}] {f['message']}")
        if f["suggestion"]:
            lines.append(f"    → {f['suggestion']}")
    return "\n".join([*lines, ""])


def terminal_score(report: dict) -> str:
    color = {"A": "green", "B": "green", "C": "yellow", "D": "yellow"}.get(report["grade"], "red")
    lines = ["", "  Score — map quality", "  Overall: " + _paint(f"{report['overall']}/100 — {report['grade']}", color), ""]
    lines += [f"    {c['label']:<18} {score_bar(c['score'])} {c['score']}/100 ({c['grade']})" for c in report["categories"]]
    return "\n".join([*lines, "", f"  {report['finding_count']} findings analyzed", ""])


def terminal_xray(report: dict) -> str:
    s = report["summary"]
    most = s["max_area_distortion_pct"]
    lines = ["", "  X-ray — projection distortion", f"  File:   {report['file_path']}", f"  CRS:    {report['source_crs']}", f"  Points: {s['sample_count']}", ""]
    lines += ["    Max area distortion:     " + _paint(f"{most:.1f}%", "green" if most < 2 else "yellow" if most < 10 else "red"), f"    Mean area distortion:    {s['mean_area_distortion_pct']:.1f}%", f"    Median area distortion:  {s['median_area_distortion_pct']:.1f}%"]
    lines += [f"    Max angular distortion:  {s['max_angular_distortion_deg']:.1f}°", f"    Mean angular distortion: {s['mean_angular_distortion_deg']:.1f}°"]
    for i, r in enumerate(report["recommendations"], 1):
        lines += ["", f"    {i}. {r['crs']} — {r['name']} (fitness: {r['fitness'] * 100:.0f}%)", f"       {r['rationale']}"]
    return "\n".join([*lines, ""])


def html_report(title: str, report: dict, layers: dict[str, str] | None = None) -> str:
    """One self-contained page without outside scripts: the report as text and its GeoJSON layers drawn as SVG by an inline script."""
    safe = lambda s: s.replace("</", "<\\/")
    data = ",".join(f"{json.dumps(k)}:{v}" for k, v in (layers or {}).items())
    body = _html.escape(json.dumps(report, indent=2, ensure_ascii=False))
    script = (
        "const W=720,H=360,svg=document.getElementById('map'),ns='http://www.w3.org/2000/svg';"
        "const xy=p=>[(p[0]+180)*W/360,(90-p[1])*H/180].map(v=>v.toFixed(2)).join(',');"
        "const path=r=>'M'+r.map(xy).join('L')+'Z';"
        "const rings=g=>!g?[]:g.type==='Polygon'?g.coordinates:g.type==='MultiPolygon'?g.coordinates.flat():g.type==='LineString'?[g.coordinates]:g.type==='MultiLineString'?g.coordinates:[];"
        "for(const k in DATA)for(const f of DATA[k].features){const c=(f.properties||{}).color||'#2563eb';"
        "if(f.geometry&&f.geometry.type==='Point'){const e=document.createElementNS(ns,'circle'),q=xy(f.geometry.coordinates).split(',');e.setAttribute('cx',q[0]);e.setAttribute('cy',q[1]);e.setAttribute('r',2);e.setAttribute('fill',c);svg.appendChild(e)}"
        "else for(const r of rings(f.geometry)){const e=document.createElementNS(ns,'path');e.setAttribute('d',path(r));e.setAttribute('fill',c);e.setAttribute('fill-opacity',.4);e.setAttribute('stroke',c);svg.appendChild(e)}}"
    )
    return (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{_html.escape(title)}</title><style>body{{font-family:sans-serif;margin:2rem}}svg{{border:1px solid #ccc}}pre{{overflow:auto}}</style></head>'
        f'<body><h1>{_html.escape(title)}</h1><svg id="map" width="720" height="360"></svg><pre>{body}</pre><script>const DATA={{{safe(data)}}};{script}</script></body></html>'
    )


def color_of(pct: Column) -> Column:
    return distortion_color(pct)
