"""FlatGeobuf headers and trees, built here byte by byte, and findings about them."""

import struct

import pytest
from pyspark.sql import functions as F

from geodiag.errors import ReadError
from geodiag.operators import cloud
from geodiag.sources import flatgeobuf, geoparquet
from geodiag.sources.files import read_file


def flat(fields):
    """A FlatBuffers table of number -> (format, value) or (None, (bytes, place)); and where it begins."""
    n, inline, later = max(fields, default=-1) + 1, b"", []
    slots = [0] * n
    for i, (kind, v) in fields.items():
        slots[i] = 4 + len(inline)
        if kind is None:
            later.append((len(inline), v))
        inline += bytes(4) if kind is None else struct.pack("<" + kind, v)
    table = struct.pack(f"<HH{n}H", 4 + 2 * n, 4 + len(inline), *slots)
    body = bytearray(table + struct.pack("<i", len(table)) + inline)
    for at, (blob, inner) in later:
        place = len(table) + 4 + at
        struct.pack_into("<I", body, place, len(body) + inner - place)
        body += blob
    return bytes(body), len(table)


def tree(boxes, node):
    """The packed tree over boxes in order, root first."""
    out = [boxes]
    while len(out[0]) > 1:
        low = out[0]
        out.insert(0, [(min(b[0] for b in g), min(b[1] for b in g), max(b[2] for b in g), max(b[3] for b in g)) for g in (low[i : i + node] for i in range(0, len(low), node))])
    return b"".join(struct.pack("<4dQ", *b, 0) for level in out for b in level)


def file(count, crs=None, node=None, boxes=(), envelope=None, name="roads", columns=2, kind=3):
    fields = {flatgeobuf.NAME: (None, (struct.pack("<I", len(name.encode())) + name.encode() + b"\0", 0)), flatgeobuf.TYPE: ("B", kind), flatgeobuf.COLUMNS: (None, (struct.pack("<I", columns) + bytes(4 * columns), 0)), flatgeobuf.COUNT: ("Q", count)}
    if envelope:
        fields[flatgeobuf.ENVELOPE] = (None, (struct.pack("<I4d", 4, *envelope), 0))
    if node is not None:
        fields[flatgeobuf.NODE_SIZE] = ("H", node)
    if crs:
        fields[flatgeobuf.CRS] = (None, flat({1: ("i", crs)}))
    body, at = flat(fields)
    body = struct.pack("<I", 4 + at) + body
    return b"fgb\x03fgb\x00" + struct.pack("<I", len(body)) + body + (tree(list(boxes), node or 16) if boxes else b"")


@pytest.mark.parametrize("n, node, want", [(0, 16, []), (1, 16, [1]), (16, 16, [1, 16]), (17, 16, [1, 2, 17]), (5, 2, [1, 2, 3, 5]), (5, 0, []), (5, 1, [])])
def test_levels(n, node, want):
    assert flatgeobuf.levels(n, node) == want


def test_headers_and_findings(spark, tmp_path):
    squares = [(float(i), 0.0, i + 1.0, 1.0) for i in range(40)]
    files = {
        "good.fgb": file(40, 4326, boxes=squares), "plain.fgb": file(7, 3857, node=0, envelope=(0, 1, 2, 3), name="Straße"), "empty.FGB": file(0, 4326),
        "nowhere.fgb": file(40, None, boxes=squares), "cut.fgb": file(40, 4326, boxes=squares)[:-41], "short.fgb": file(40, 4326)[:30], "text.fgb": b"hello, world, hello", "bytes.fgb": b"",
        "damaged.fgb": b"fgb\x03fgb\x00" + struct.pack("<I", 16) + struct.pack("<I", 900) + bytes(12), "other.txt": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    t = flatgeobuf.headers(spark, f"file://{tmp_path}").withColumn("path", F.element_at(F.split("path", "/"), -1))
    rows = {r.path: r for r in t.collect()}
    assert set(rows) == set(files) - {"other.txt"}
    good = rows["good.fgb"]
    assert (good.name, good.geometry_type, int(good.n_features), good.n_columns, good.crs, good.node_size, int(good.index_bytes)) == ("roads", "Polygon", 40, 2, "EPSG:4326", 16, (1 + 3 + 40) * 40)
    assert (good.min_x, good.min_y, good.max_x, good.max_y) == (0, 0, 40, 1) and good.share == 1 and good.n_bytes == len(files["good.fgb"])
    plain = rows["plain.fgb"]
    assert (plain.name, plain.index_bytes, plain.max_y, plain.share, plain.error) == ("Straße", 0, 3, None, None)
    assert {k: r.error for k, r in rows.items() if r.error} == {"cut.fgb": "the index is cut short", "short.fgb": "the header is cut short", "text.fgb": "not a FlatGeobuf file", "bytes.fgb": "not a FlatGeobuf file", "damaged.fgb": "the header is damaged"}
    found = {(r.rule_id, r.severity, r.sub_key) for r in cloud.check_headers(t).collect()}
    assert found == {("cloud/spatial-index", "warning", "plain.fgb"), ("cloud/crs-metadata", "error", "nowhere.fgb"), *(("cloud/integrity", "error", k) for k, r in rows.items() if r.error)}
    data = read_file(spark, f"file://{tmp_path}/plain.fgb")
    assert data.features.count() == 7 and data.layers.first().crs == "EPSG:3857"
    with pytest.raises(ReadError):
        read_file(spark, f"{tmp_path}/text.fgb")


def test_folder_without_files(spark, tmp_path):
    t = flatgeobuf.headers(spark, f"file://{tmp_path}")
    assert t.count() == 0 and cloud.check_headers(t).count() == 0


def test_an_unsorted_index_is_found(spark, tmp_path):
    k = F.col("id")
    side = 1 << geoparquet.ORDER
    p = spark.range(4096).select(k, ((k * 40503) % side).cast("int").alias("x"), ((k * 7919) % side).cast("int").alias("y"))
    for name, order in (("table", k), ("curve", geoparquet.hilbert(F.col("x"), F.col("y")))):
        boxes = [(r.x, r.y, r.x, r.y) for r in p.orderBy(order).collect()]
        (tmp_path / f"{name}.fgb").write_bytes(file(len(boxes), 3857, boxes=boxes, kind=1))
    t = flatgeobuf.headers(spark, f"file://{tmp_path}")
    share = {r.path.rpartition("/")[2]: r.share for r in t.collect()}
    assert share["curve.fgb"] < 2 < cloud.OVERLAP < share["table.fgb"]
    assert [r.metric for r in cloud.check_headers(t).collect()] == [share["table.fgb"]]
