"""FlatGeobuf: the header before a file's features, and the packed tree of boxes that may follow it.

Only those bytes are read: the header by its length, of the tree its root and the level below it. The source gives a row
for each file, some files for each task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from geodiag.errors import ReadError
from geodiag.runtime import ship
from geodiag.sources.geoparquet import Files, open_folder

#: files whose headers a task reads
HEADERS = 64
#: a longer header is taken as damage
LONGEST = 10 << 20
# fixed values of the format: the header's fields by number, bytes of a tree node (four doubles and a place), geometry types in order
NAME, ENVELOPE, TYPE, COLUMNS, COUNT, NODE_SIZE, CRS = 0, 1, 2, 7, 8, 9, 10
NODE = 40
TYPES = ("Unknown", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


class _Table:
    """Field access in a FlatBuffers table."""

    def __init__(self, buf: bytes, at: int):
        self.buf, self.at = buf, at
        self.vtable = at - struct.unpack_from("<i", buf, at)[0]
        self.size = struct.unpack_from("<H", buf, self.vtable)[0]

    def offset(self, i: int) -> int:
        slot = 4 + 2 * i
        o = struct.unpack_from("<H", self.buf, self.vtable + slot)[0] if slot < self.size else 0
        return self.at + o if o else 0

    def number(self, i: int, kind: str, default=0):
        o = self.offset(i)
        return struct.unpack_from("<" + kind, self.buf, o)[0] if o else default

    def _target(self, i: int) -> int:
        o = self.offset(i)
        return o + struct.unpack_from("<I", self.buf, o)[0] if o else 0

    def table(self, i: int) -> _Table | None:
        o = self._target(i)
        return _Table(self.buf, o) if o else None

    def length(self, i: int) -> int:
        o = self._target(i)
        return struct.unpack_from("<I", self.buf, o)[0] if o else 0

    def text(self, i: int) -> str | None:
        o = self._target(i)
        return self.buf[o + 4 : o + 4 + self.length(i)].decode("utf-8", "replace") if o else None

    def doubles(self, i: int) -> tuple[float, ...]:
        return struct.unpack_from(f"<{self.length(i)}d", self.buf, self._target(i) + 4) if self.length(i) else ()


class Header(NamedTuple):
    """``index_bytes`` is what the tree takes by the header, 0 without one; ``share`` is the boxes' areas on the level below the root against the root's."""

    n_bytes: int
    name: str | None
    geometry_type: str
    n_features: int
    n_columns: int
    crs: str | None
    node_size: int
    index_bytes: int
    min_x: float | None
    min_y: float | None
    max_x: float | None
    max_y: float | None
    share: float | None
    error: str | None


def levels(n: int, node_size: int) -> list[int]:
    """Nodes on each level of a packed tree over ``n`` features, the root's first."""
    if n <= 0 or node_size < 2:
        return []
    out = [n]
    while out[0] > 1:
        out.insert(0, -(-out[0] // node_size))
    return out


def _area(b: tuple) -> float:
    return (b[2] - b[0]) * (b[3] - b[1])


def header(f: BinaryIO, size: int) -> Header:
    """The header of an open file of ``size`` bytes; raises ReadError if it can't be one."""
    head = f.read(12)
    if len(head) < 12 or head[:3] != b"fgb":
        raise ReadError("not a FlatGeobuf file")
    (long,) = struct.unpack_from("<I", head, 8)
    buf = f.read(min(long, LONGEST)) if long <= LONGEST else b""
    if long < 8 or len(buf) < long:
        raise ReadError("the header is cut short")
    try:
        root = _Table(buf, struct.unpack_from("<I", buf)[0])
        n, node = root.number(COUNT, "Q"), root.number(NODE_SIZE, "H", 16)
        crs, box, kind = root.table(CRS), root.doubles(ENVELOPE), root.number(TYPE, "B")
        code = crs.number(1, "i") if crs else 0
        name, columns = root.text(NAME), root.length(COLUMNS)
    except struct.error as e:
        raise ReadError("the header is damaged") from e
    tree = levels(n, node)
    index, start, share, error = sum(tree) * NODE, 12 + long, None, None
    box = tuple(box[:4]) if len(box) >= 4 else None
    if start + index > size:
        error = "the index is cut short"
    elif tree:
        some = f.read(NODE * (1 + (tree[1] if len(tree) > 1 else 0)))
        boxes = [struct.unpack_from("<4d", some, at) for at in range(0, len(some), NODE)]
        box = box or boxes[0]
        if boxes[1:] and _area(boxes[0]) > 0:
            share = sum(map(_area, boxes[1:])) / _area(boxes[0])
    return Header(size, name, TYPES[kind] if kind < len(TYPES) else "Unknown", n, columns, f"EPSG:{code}" if code > 0 else None, node, index, *(box or (None,) * 4), share, error)


def read_header(path: str) -> Header:
    where, name = open_folder(path)
    try:
        with where.open_input_file(name) as f:
            return header(f, f.size())
    except OSError as e:
        raise ReadError(str(e).splitlines()[0]) from e


HEADER = (
    "path string, n_bytes long, name string, geometry_type string, n_features decimal(20,0), n_columns int, crs string, node_size int, index_bytes decimal(20,0), "
    "min_x double, min_y double, max_x double, max_y double, share double, error string"
)


class HeaderReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Files]:
        where, root = open_folder(self.folder)
        found = sorted(x.path for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith(".fgb"))
        return [Files(found[i : i + HEADERS]) for i in range(0, len(found), HEADERS)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from decimal import Decimal

        where, _ = open_folder(self.folder)
        for path in partition.paths:
            with where.open_input_file(path) as f:
                size = f.size()
                try:
                    h = header(f, size)
                    yield (path, *h._replace(n_features=Decimal(h.n_features), index_bytes=Decimal(h.index_bytes)))
                except ReadError as e:
                    yield (path, size, *[None] * 12, str(e).removeprefix("IO error: "))


class HeaderSource(DataSource):
    """``spark.read.format("flatgeobuf_headers").load(folder)``: headers of all FlatGeobuf files below a folder; a file that has none gives a row with ``error``."""

    @classmethod
    def name(cls) -> str:
        return "flatgeobuf_headers"

    def schema(self) -> str:
        return HEADER

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["path"])


def headers(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and a :class:`Header` for each FlatGeobuf file below ``folder``."""
    ship(spark)
    spark.dataSource.register(HeaderSource)
    return spark.read.format("flatgeobuf_headers").load(folder)
