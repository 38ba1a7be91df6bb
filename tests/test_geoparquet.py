"""GeoParquet files written and read, footers, and findings about them."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from geodiag.operators import cloud
from geodiag.sources import geoparquet
from geodiag.sources.files import read_geoparquet, wkb
from test_core import dataset, poly, pt, square


def curve(n):
    """Places along a Hilbert curve by its recursive definition."""
    if n == 0:
        return [(0, 0)]
    part, h = curve(n - 1), 1 << (n - 1)
    return [(y, x) for x, y in part] + [(x, y + h) for x, y in part] + [(x + h, y + h) for x, y in part] + [(2 * h - 1 - y, h - 1 - x) for x, y in part]


def test_hilbert_keys(spark):
    n = 1 << geoparquet.ORDER
    grid = [(x, y) for x in (0, 1, 2, 3, n - 2, n - 1) for y in (0, 1, 2, 3, n - 1)]
    d = spark.createDataFrame(grid, "x int, y int").select("x", "y", geoparquet.hilbert(F.col("x"), F.col("y")).alias("d")).collect()
    assert len({r.d for r in d}) == len(grid) and 0 <= min(r.d for r in d) and max(r.d for r in d) < n * n
    # scaled down, keys order the cells as the curve does, up to its orientation
    side = 16
    cells = spark.createDataFrame([(x, y) for x in range(side) for y in range(side)], "x int, y int")
    scale = n // side
    order = [(r.x, r.y) for r in cells.orderBy(geoparquet.hilbert(F.col("x") * scale, F.col("y") * scale)).collect()]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(order, order[1:])) and order[0] == (0, 0)
    assert order in (curve(4), [(y, x) for x, y in curve(4)])


def test_geometries_come_back(spark, tmp_path):
    both = poly(square(0, 0, 4), square(1, 1, 1))
    rows = [(0, "a", pt(1.0, 2.0), {"k": "1"}), (0, "b", both, {}), (0, None, None, {"n": '"x"'}), (0, "c", poly(square(9, 9, 1), gtype="Polygon"), {})]
    data = dataset(spark, rows)
    done = geoparquet.write(data.features, f"file://{tmp_path}/out", "EPSG:3857", files=2).collect()
    assert sum(r.n_rows for r in done) == 4 and all(r.n_bytes > 0 for r in done)
    back = read_geoparquet(spark, f"file://{tmp_path}/out").features
    got = sorted(str(r.geom) for r in back.collect())
    assert got == sorted(str(r.geom) for r in data.features.collect())
    assert geoparquet.encode(None) is None and all(wkb(geoparquet.encode(r.geom.asDict(recursive=True)))["gtype"] == r.geom.gtype for r in data.features.where("geom is not null").collect())
    empty = geoparquet.write(data.features.limit(0), f"file://{tmp_path}/none", None)
    assert empty.count() == 0 and geoparquet.footers(spark, f"file://{tmp_path}/none").count() == 0
    meta = json.loads(pq.read_metadata(done[0].path.removeprefix("file://")).metadata[b"geo"])
    assert meta["columns"]["geometry"]["crs"]["id"] == {"authority": "EPSG", "code": 3857} and meta["primary_column"] == "geometry"


def test_row_groups_hardly_overlap(spark, tmp_path):
    k = F.col("id")
    p = spark.range(8000).select(k.alias("feat_idx"), k.cast("string").alias("name"), ((k * 7919) % 36000 / 100 - 180).alias("x"), ((k * 104729) % 16000 / 100 - 80).alias("y"))
    from geodiag.functions import geometry as g

    features = p.select("feat_idx", F.col("name").alias("id"), g.point(F.col("x"), F.col("y")).alias("geom"), F.create_map().cast("map<string,string>").alias("properties"))
    geoparquet.write(features, f"file://{tmp_path}/h", "OGC:CRS84", files=4, group=250).count()
    read = geoparquet.footers(spark, f"file://{tmp_path}/h")
    share = cloud.box_share(cloud.group_boxes(read)).first()
    assert share.groups >= 32 and share.share < 2.5, share  # in the table's order each group spans all: its share is the number of groups
    assert cloud.check_footers(read).count() == 0 and read.agg(F.sum("nulls")).first()[0] is not None


def test_findings_about_footers(spark, tmp_path):
    t = pa.table({"geometry": pa.array([b""], pa.binary()), "v": [1]})
    box = pa.table({"bbox": pa.array([{"min_x": 0.0}]), "v": [1]})
    unknown = json.dumps({"columns": {"geometry": {"crs": None, "covering": {"bbox": {}}}}})
    for name, table, geo, codec in (("bare", t, None, "none"), ("known", t, json.dumps({"columns": {"geometry": {}}}), "zstd"), ("unknown", t, unknown, "gzip"), ("boxed", box, None, "snappy"), ("empty", t.slice(0, 0), None, "none")):
        pq.write_table(table.replace_schema_metadata({"geo": geo} if geo else {}), f"{tmp_path}/{name}.parquet", compression=codec)
    read = geoparquet.footers(spark, f"file://{tmp_path}")
    got = {}
    for r in cloud.check_footers(read).collect():
        got.setdefault(r.sub_key.rsplit("/", 1)[1].split(".")[0], set()).add(r.rule_id.split("/")[1])
    assert got == {"bare": {"compression", "spatial-index", "crs-metadata"}, "known": {"spatial-index"}, "unknown": {"crs-metadata"}, "boxed": {"crs-metadata"}, "empty": got["empty"]}
    assert {"spatial-index", "crs-metadata"} <= got["empty"]
    row = read.where("path like '%bare%' and column = 'v'").first()
    assert (row.n_rows, row.kind, row.codec, row.least, row.most, row.nulls) == (1, "INT64", "UNCOMPRESSED", 1.0, 1.0, 0)


def test_hilbert_places_are_those_of_single_bits(spark):
    import random

    def place(x, y):
        d, side = 0, 1 << geoparquet.ORDER - 1
        while side:
            rx, ry = int(x & side > 0), int(y & side > 0)
            d += side * side * ((3 * rx) ^ ry)
            x, y = x & side - 1, y & side - 1
            if not ry:
                x, y = (side - 1 - y, side - 1 - x) if rx else (y, x)
            side //= 2
        return d

    r = random.Random(2)
    at = [(r.randrange(1 << 16), r.randrange(1 << 16)) for _ in range(300)] + [(0, 0), (65535, 0), (0, 65535), (65535, 65535)]
    frame = spark.createDataFrame(at, "x long, y long").select("x", "y", geoparquet.hilbert(F.col("x"), F.col("y")).alias("d"))
    assert all(row.d == place(row.x, row.y) for row in frame.collect())


def test_points_are_encoded_at_once(monkeypatch):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    from geodiag.model import GEOM

    kind = to_arrow_type(_parse_datatype_string(GEOM))
    point = lambda x, y: {"gtype": "Point", "parts": [{"kind": "point", "rings": [[{"x": x, "y": y}]]}]}
    line = {"gtype": "LineString", "parts": [{"kind": "line", "rings": [[{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}]]}]}
    one = geoparquet.encode
    for rows in ([point(1.0, 2.0), None, point(-3.5, -0.0)], [None], [], [point(1.0, 2.0), line], [point(1.0, 2.0), {"gtype": "Point", "parts": []}]):
        want = [one(x) for x in rows]
        assert geoparquet.encode_all(pa.array(rows, kind)).to_pylist() == want and geoparquet.encode_all(pa.array(rows, kind).slice(1)).to_pylist() == want[1:]
    # none of its own
    monkeypatch.setattr(geoparquet, "encode", None)
    assert geoparquet.encode_all(pa.array([point(1.0, 2.0), None], kind)).to_pylist() == [one(point(1.0, 2.0)), None]
