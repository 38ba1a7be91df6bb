"""Command line: xray, check, score, diff, fix, watch, init, profile, explain."""

from __future__ import annotations

import argparse
import json
import sys

from geodiag.config import Config, init
from geodiag.errors import GeodiagError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geodiag", description="Diagnostics for geospatial data")
    p.add_argument("--config")
    p.add_argument("--exact", action="store_true", help="true scales in place of the established formulas")
    s = p.add_subparsers(dest="command", required=True)

    def command(name, *files):
        c = s.add_parser(name)
        for f in files:
            c.add_argument(f)
        c.add_argument("--json", action="store_true")
        c.add_argument("--terminal", action="store_true")
        c.add_argument("--html")
        return c

    x = command("xray", "file")
    x.add_argument("--recommend", action="store_true")
    x.add_argument("--crs")
    c = command("check", "file")
    c.add_argument("--domain")
    c.add_argument("--sarif", action="store_true")
    command("score", "file").add_argument("--badge")
    command("diff", "left", "right")
    f = command("fix", "file")
    f.add_argument("--reproject")
    f.add_argument("--topology", action="store_true")
    f.add_argument("--snap", type=float, metavar="TOLERANCE")
    f.add_argument("--schema", action="store_true")
    f.add_argument("--preview", action="store_true")
    f.add_argument("--in-place", action="store_true")
    w = command("watch", "dir")
    w.add_argument("--results")
    w.add_argument("--changes", help="folder for changes of each file's score")
    w.add_argument("--state", help="folder of the streams' checkpoints, to go on from there")
    w.add_argument("--once", action="store_true")
    command("init").add_argument("--force", action="store_true")
    command("profile", "file")
    command("explain", "crs")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    try:
        return _run(a, spark)
    except GeodiagError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


def _run(a, spark) -> int:
    from dataclasses import replace

    from geodiag.plans import api
    from geodiag.reports import sinks

    if a.command == "init":
        print(f"Created {init(a.force)}")
        return 0
    config = Config.load(a.config) if a.config else Config.discover()
    config = replace(config, mode="exact") if a.exact else config
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("geodiag").getOrCreate()
    dump = lambda d: print(json.dumps(d, indent=2, ensure_ascii=False, default=str))
    if a.command == "xray":
        r = api.xray(spark, a.file, config, 5 if a.recommend else 0, bool(a.html), a.crs)
        layers = {k: r.pop(f"{k}_features") for k in ("heatmap", "ellipse") if f"{k}_features" in r}
        dump(r) if a.json else print(sinks.terminal_xray(r))
        title = "X-ray"
    elif a.command == "check":
        r = api.check(spark, a.file, a.domain, config)
        layers = {"findings": r.pop("features")}
        if a.sarif:
            print(sinks.check_sarif(a.file, r["findings"]))
        else:
            dump(r) if a.json else print(sinks.terminal_check(a.file, r["findings"], r["summary"]))
        title = "Check"
    elif a.command == "score":
        r, layers, title = api.score(spark, a.file, config, a.badge), {}, "Score"
        dump(r) if a.json else print(sinks.terminal_score(r))
    elif a.command == "diff":
        r, title = api.diff(spark, a.left, a.right), "Diff"
        layers = {}
        if a.html:
            from geodiag.sources.files import read_file

            layers = {k: sinks.feature_collection(sinks.layer_features(read_file(spark, p))) for k, p in (("left", a.left), ("right", a.right))}
        dump(r) if a.json else print(f"Left features:  {r['left_features']}\nRight features: {r['right_features']}\nAdded: {r['added']}\nRemoved: {r['removed']}\nExtent changed: {str(r['extent_changed']).lower()}")
    elif a.command == "fix":
        r, layers, title = api.fix(spark, a.file, a.reproject, a.topology, a.in_place, a.snap, a.schema, a.preview), {}, "Fix"
        dump(r) if a.json else print("\n".join([f"Fixed {r['input_file']} -> {r['output_file']}", f"Updated features: {r['updated_features']}", *(f"- {x}" for x in r["actions"])]))
    elif a.command == "watch":
        from geodiag.runtime import scratch_path
        from geodiag.streaming.watch import watch, watch_changes

        results, state = a.results or scratch_path(spark, "watch"), a.state or scratch_path(spark, "watch-state")
        told = [lambda: watch(spark, a.dir, results, f"{state}/checks", config, a.once)]
        if a.changes:
            told.append(lambda: watch_changes(spark, results, a.changes, f"{state}/changes", a.once))
        # once: the second stream reads what the first has written
        for q in (start() for start in told) if a.once else [start() for start in told]:
            q.awaitTermination()
        return 0
    else:
        r = api.profile(spark, a.file) if a.command == "profile" else api.explain(spark, a.crs)
        dump(r)
        return 0
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(sinks.html_report(title, json.loads(json.dumps(r, default=str)), layers))
    return 0


if __name__ == "__main__":
    sys.exit(main())
