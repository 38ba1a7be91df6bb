"""The splittable shapefile source against whole-file parsing."""

import struct

import pytest

from geodiag.errors import ReadError
from geodiag.sources import shapefile
from geodiag.sources.files import read_file


def point_file(folder, n, gone=(), index=True, rows=None):
    """Points (i, -i), every 50th a null shape, every 7th a polyline; rows NAME = i but for those of ``gone``, deleted rows between."""
    body, places = b"", []
    parts = []
    at = 100
    for i in range(n):
        if i % 50 == 49:
            c = struct.pack("<i", 0)
        elif i % 7 == 0:
            c = struct.pack("<i4d2ii", 3, 0, 0, 0, 0, 1, 2, 0) + struct.pack("<4d", i, -i, i + 1, -i)
        else:
            c = struct.pack("<i2d", 1, i, -i)
        places.append(struct.pack(">2i", at // 2, len(c) // 2))
        parts.append(struct.pack(">2i", i + 1, len(c) // 2) + c)
        at += 8 + len(c)
    body = b"".join(parts)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8)
    (folder / "a.shp").write_bytes(head + body)
    if index:
        (folder / "a.SHX").write_bytes(head + b"".join(places))
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([8, 0]) + b"\0" * 14
    lines = b"".join((b"*" if i in gone else b" ") + str(i).encode().ljust(8) for i in range(n if rows is None else rows))
    (folder / "a.dbf").write_bytes(struct.pack("<4BIHH20x", 3, 0, 0, 0, len(lines) // 9, 65, 9) + field + b"\r" + lines)
    return str(folder / "a.shp")


def whole(path):
    geoms = shapefile.shapes(open(path, "rb").read())
    rows = shapefile.records(open(path[:-3] + "dbf", "rb").read())
    return [(i, g and (g["gtype"], g["parts"][0]["rings"][0][0]["x"]), rows[i] if i < len(rows) else {}) for i, g in enumerate(geoms)]


def got(data):
    rows = data.features.collect()
    return sorted((r.feat_idx, r.geom and (r.geom.gtype, r.geom.parts[0].rings[0][0].x), r.properties) for r in rows)


@pytest.mark.parametrize("gone", [(), range(0, 900, 3), range(100, 800), range(1000)], ids=["none", "thirds", "block", "all"])
@pytest.mark.parametrize("index", [True, False])
def test_ranges_equal_whole_file(spark, tmp_path, gone, index):
    path = point_file(tmp_path, 1000, set(gone), index)
    for split in (1 << 20, 1900):
        data = shapefile.read(spark, path, split=split)
        assert got(data) == whole(path)
        assert (data.features.rdd.getNumPartitions() > 1) == (index and split < 1 << 20)


def test_table_shorter_or_longer_or_absent(spark, tmp_path):
    for rows in (0, 333, 1500):
        (folder := tmp_path / str(rows)).mkdir()
        path = point_file(folder, 1000, {5, 700}, rows=rows)
        assert got(shapefile.read(spark, path, split=2000)) == whole(path)
    (folder / "a.dbf").unlink()
    data = shapefile.read(spark, path, split=2000)
    assert data.features.count() == 1000 and all(r.properties == {} for r in data.features.select("properties").collect())


def test_wrong_index_and_cut_file(spark, tmp_path):
    (tmp_path := tmp_path / "a b%20c").mkdir()
    path = point_file(tmp_path, 300)
    shx = (tmp_path / "a.SHX").read_bytes()
    for bad in (shx[:-8], shx[:50], b""):  # an index of other records isn't followed
        (tmp_path / "a.SHX").write_bytes(bad)
        assert got(shapefile.read(spark, path, split=500)) == whole(path)
    empty = point_file(tmp_path, 0)
    assert shapefile.read(spark, empty).features.count() == 0
    (tmp_path / "b.shp").write_bytes(b"no")
    with pytest.raises(ReadError, match="not a shapefile"):
        read_file(spark, str(tmp_path / "b.shp"))
    with pytest.raises(ReadError, match="not found"):
        read_file(spark, str(tmp_path / "c.shp"))


def test_large_file(spark, tmp_path):
    path = point_file(tmp_path, 100_000, set(range(10, 100_000, 1000)))
    data = shapefile.read(spark, path, split=1 << 19)
    assert data.features.rdd.getNumPartitions() >= 6
    assert got(data) == whole(path)


def test_starts():
    assert shapefile.starts_of([(0, 4), (4, 0), (8, 4)], 12, 4) == [[0, 0], [8, 0], [1 << 40, 0]]
    assert shapefile.starts_of([(0, 3), (4, 4), (8, 1)], 8, 4) == [[0, 0], [4, 1]]
