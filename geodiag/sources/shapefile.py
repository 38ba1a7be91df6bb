"""Shapefile reader (ESRI's published format) with its dBASE table and .prj file.

Files are listed by Spark's binary source, without their contents, and read by a partitioned data source: its tasks
take ranges of records, whose places the index file (.shx) tells, and fetch only those bytes of .shp and .dbf. Without a usable
index one task walks through the .shp file, as only the records themselves then tell where the next one begins.
"""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from geodiag.errors import ReadError
from geodiag.model import FEATURE, Dataset, compute_layers
from geodiag.runtime import ship
from geodiag.sources.geoparquet import open_folder

#: bytes of a .shp file for one task
SPLIT = 32 << 20
#: features of an Arrow batch
BATCH = 5000
_POINTS, _LINES, _POLYGONS, _MULTI = (1, 11, 21), (3, 13, 23), (5, 15, 25), (8,)


def _area2(ring: list) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def _xy(p) -> dict:
    return {"x": p[0], "y": p[1]}


def shape(data: bytes) -> dict | None:
    """A record's content to a geometry. Heights and measures are dropped; measured multipoints and multipatches count as none."""
    kind = struct.unpack_from("<i", data)[0]
    if kind in _POINTS:
        return {"gtype": "Point", "parts": [{"kind": "point", "rings": [[_xy(struct.unpack_from("<2d", data, 4))]]}]}
    if kind in _MULTI:
        n = struct.unpack_from("<i", data, 36)[0]
        xs = struct.unpack_from(f"<{2 * n}d", data, 40)
        return {"gtype": "MultiPoint", "parts": [{"kind": "point", "rings": [[_xy(xs[2 * i : 2 * i + 2])]]} for i in range(n)]}
    if kind not in _LINES + _POLYGONS:
        return None
    parts, n = struct.unpack_from("<2i", data, 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, 44), n]
    xs = struct.unpack_from(f"<{2 * n}d", data, 44 + 4 * parts)
    runs = [[(xs[2 * i], xs[2 * i + 1]) for i in range(a, b)] for a, b in zip(starts, starts[1:])]
    if kind in _LINES:
        if not runs:
            return None
        made = [{"kind": "line", "rings": [[_xy(p) for p in r]]} for r in runs]
        return {"gtype": "LineString" if len(made) == 1 else "MultiLineString", "parts": made}
    polygons: list[list] = []
    early = []
    for r in runs:
        if _area2(r) <= 0:  # clockwise: an outer ring
            polygons.append([r])
            if early:
                polygons[0].extend(early)
                early = []
        elif polygons:
            polygons[-1].append(r)
        else:
            early.append(r)
    if not polygons:
        return None
    made = [{"kind": "polygon", "rings": [[_xy(p) for p in r] for r in p_]} for p_ in polygons]
    return {"gtype": "Polygon" if len(made) == 1 else "MultiPolygon", "parts": made}


def shapes(data: bytes) -> list[dict | None]:
    """All records of a .shp file."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ReadError("not a shapefile")
    out, at = [], 100
    while at + 8 <= len(data):
        n = 2 * struct.unpack_from(">i", data, at + 4)[0]
        out.append(shape(data[at + 8 : at + 8 + n]))
        at += 8 + n
    return out


class Table:
    """Layout of a dBASE file by its header."""

    def __init__(self, f: BinaryIO):
        f.seek(0)
        self.rows, self.head, self.width = struct.unpack("<IHH", f.read(12)[4:])
        f.seek(32)
        names, at = f.read(max(0, self.head - 32)), 0
        self.fields = []
        while at + 32 <= len(names) and names[at] != 0x0D:
            self.fields.append((names[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(names[at + 11]), names[at + 16]))
            at += 32

    def values(self, row: bytes) -> dict[str, str]:
        """A row's values as JSON texts. Characters, numbers and logicals are kept; dates, memos and empty values count as missing."""
        out, at = {}, 1
        for name, kind, size in self.fields:
            raw = row[at : at + size]
            at += size
            if kind == "I":
                out[name] = json.dumps(float(struct.unpack("<i", raw)[0]))
                continue
            if kind in "BO" and size == 8:
                out[name] = json.dumps(struct.unpack("<d", raw)[0])
                continue
            text = raw.decode("utf-8", "replace").rstrip("\0 ")
            if kind == "C" and text:
                out[name] = json.dumps(text, ensure_ascii=False)
            elif kind in "NF" and text.strip():
                try:
                    out[name] = json.dumps(float(text))
                except ValueError:
                    pass
            elif kind == "L" and text[:1] in tuple("TtYyFfNn"):
                out[name] = json.dumps(text[0] in "TtYy")
        return out

    def live(self, f: BinaryIO, start: int, stop: int | None = None) -> Iterator[bytes]:
        """Rows that aren't deleted, from the ``start``-th on."""
        stop = self.rows if stop is None else min(stop, self.rows)
        step = max(1, (1 << 20) // max(1, self.width))
        for i in range(start, stop, step):
            f.seek(self.head + i * self.width)
            block = f.read(min(step, stop - i) * self.width)
            for at in range(0, len(block) - self.width + 1, self.width):
                if block[at : at + 1] != b"*":
                    yield block[at : at + self.width]


def records(data: bytes) -> list[dict[str, str]]:
    """All rows of a dBASE file."""
    f = io.BytesIO(data)
    table = Table(f)
    return [table.values(row) for row in table.live(f, 0)]


def epsg_of_wkt(wkt: str, exact: bool = False) -> int | None:
    """The first ``AUTHORITY["EPSG","n"]`` of a text, the last one with ``exact``: nested systems name their parts first."""
    found = re.findall(r'AUTHORITY\["EPSG",\s*"(\d+)"', wkt.upper())
    return int(found[-1 if exact else 0]) if found else None


def crs_of_prj(text: str | None, exact: bool = False) -> str | None:
    if text is None:
        return None
    code = epsg_of_wkt(text, exact)
    return f"EPSG:{code}" if code is not None else text.strip()


class Range(InputPartition):
    """Records ``first`` up to ``stop`` (None: to the end, walked without an index); attributes begin after ``skip`` live rows from row ``row`` on."""

    def __init__(self, first: int, stop: int | None, row: int = 0, skip: int = 0):
        self.first, self.stop, self.row, self.skip = first, stop, row, skip


def _spans(shp: BinaryIO, shx: BinaryIO | None, part: Range) -> Iterator[dict | None]:
    """Geometries of a range of records."""
    if shx is None:
        shp.seek(100)
        while len(head := shp.read(8)) == 8:
            n = 2 * struct.unpack(">2i", head)[1]
            body = shp.read(n)
            yield shape(body) if len(body) >= 4 else None
        return
    for i in range(part.first, part.stop, BATCH):
        n = min(BATCH, part.stop - i)
        shx.seek(100 + 8 * i)
        places = struct.unpack(f">{2 * n}i", shx.read(8 * n))
        for at, words in zip(places[::2], places[1::2]):
            # neighbours mostly follow each other, so that a buffered file reads on
            shp.seek(2 * at + 8)
            body = shp.read(2 * words)
            yield shape(body) if len(body) >= 4 else None


class _Reader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.files = {k: options.get(k) for k in ("shp", "shx", "dbf")}
        self.split, self.starts, self.schema = int(options.get("split", SPLIT)), json.loads(options.get("starts", "null")), schema

    def open(self, kind: str) -> BinaryIO | None:
        if not self.files[kind]:
            return None
        # names of local files aren't escaped, those of a URI are
        uri = self.files[kind]
        where, path = (fs.LocalFileSystem(), re.sub("^file:(//)?", "", uri)) if re.match("file:|/", uri) else open_folder(uri)
        return io.BufferedReader(pa.PythonFile(where.open_input_file(path), mode="r"), 1 << 20)


class FeatureReader(_Reader):
    def partitions(self) -> list[Range]:
        n, step = layout(self)
        if n is None:
            return [Range(0, None)]
        starts = self.starts or [[i, 0] for i in range(0, n, step)]
        return [Range(i, min(n, i + step), *at) for i, at in zip(range(0, n, step), starts)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        shp, dbf = self.open("shp"), self.open("dbf")
        shx = self.open("shx") if part.stop is not None else None
        table = Table(dbf) if dbf else None
        rows = table.live(dbf, part.row) if table else iter(())
        for _ in range(part.skip):
            next(rows, None)
        arrow = to_arrow_schema(self.schema)
        batch, idx = [], part.first
        for geom in _spans(shp, shx, part):
            row = next(rows, None)
            batch.append((geom, list(table.values(row).items()) if row is not None else []))
            if len(batch) == BATCH:
                yield self.batch(batch, idx, arrow)
                batch, idx = [], idx + BATCH
        if batch:
            yield self.batch(batch, idx, arrow)

    def batch(self, rows: list, idx: int, arrow: pa.Schema) -> pa.RecordBatch:
        n = len(rows)
        columns = ([0] * n, range(idx, idx + n), [None] * n, [g for g, _ in rows], [p for _, p in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


class LiveReader(_Reader):
    def partitions(self) -> list[Range]:
        n, step = layout(self)
        with self.open("dbf") as f:
            rows = Table(f).rows
        return [Range(i, min(rows, i + step)) for i in range(0, rows if n else 0, step)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        with self.open("dbf") as f:
            yield part.first, sum(1 for _ in Table(f).live(f, part.first, part.stop))


def layout(reader: _Reader) -> tuple[int | None, int]:
    """Number of records and records of a task; None without an index that fits its file."""
    size = lambda f: f.seek(0, io.SEEK_END)
    with reader.open("shp") as shp:
        whole = size(shp)
        shp.seek(0)
        if whole < 100 or struct.unpack(">i", shp.read(4))[0] != 9994:
            raise ReadError("not a shapefile")
        if not reader.files["shx"]:
            return None, 1
        with reader.open("shx") as shx:
            n = (size(shx) - 100) // 8
            if n < 0:
                return None, 1
            if n == 0:
                return (0, 1) if whole == 100 else (None, 1)
            shx.seek(100 + 8 * (n - 1))
            at, words = struct.unpack(">2i", shx.read(8))
        # the last record ends where the file ends
        if 2 * (at + words) + 8 != whole:
            return None, 1
        return n, max(1, -(-n * reader.split // whole))


class FeatureSource(DataSource):
    """``shapefile_features``: options shp, shx, dbf (paths), split (bytes), starts (first row and live rows to skip of each range)."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_features"

    def schema(self) -> str:
        return FEATURE

    def reader(self, schema: StructType) -> FeatureReader:
        return FeatureReader(self.options, schema)


class LiveSource(DataSource):
    """``shapefile_live_rows``: of each range of rows of a .dbf file, how many aren't deleted."""

    @classmethod
    def name(cls) -> str:
        return "shapefile_live_rows"

    def schema(self) -> str:
        return "first long, live long"

    def reader(self, schema: StructType) -> LiveReader:
        return LiveReader(self.options, schema)


def starts_of(ranges: list[tuple[int, int]], n: int, step: int) -> list[list[int]]:
    """Where each range of ``step`` records finds its attributes: a row and how many live rows from it on belong to earlier records.

    The i-th record has the i-th row that isn't deleted; ``ranges`` are (first row, live rows) in order.
    """
    out, k, before = [], 0, 0
    for i in range(0, n, step):
        while k < len(ranges) and before + ranges[k][1] <= i:
            before += ranges[k][1]
            k += 1
        out.append([ranges[k][0], i - before] if k < len(ranges) else [1 << 40, 0])
    return out


def read(spark: SparkSession, path: str, exact: bool = False, split: int = SPLIT) -> Dataset:
    """One shapefile as one layer named by its path, a task for each ``split`` bytes of it.

    A record without a row has no properties; rows beyond the last record, and deleted ones, are left out. One small job counts the
    rows that aren't deleted, where there is more than one range.
    """
    stem = re.sub(r"(?i)\.shp$", "", path)
    folder, _, base = stem.rpartition("/")
    glob = re.sub(r"([\\*?\[\]{}])", r"\\\1", base)
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"{glob}.*").load(folder or ".").withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
        paths = {r.ext: r.path for r in files.select("ext", "path").orderBy(F.desc("path")).collect()}
        if "shp" not in paths:
            raise ReadError(f"{path} not found")
        prj = files.where("ext = 'prj'").select(F.decode("content", "UTF-8").alias("t")).first() if "prj" in paths else None
    except ReadError:
        raise
    except Exception as e:
        raise ReadError(str(e).splitlines()[0]) from e
    ship(spark)
    spark.dataSource.register(FeatureSource)
    spark.dataSource.register(LiveSource)
    options = {k: paths[k] for k in ("shp", "shx", "dbf") if k in paths} | {"split": str(split)}
    n, step = layout(FeatureReader(options, StructType()))
    if n and n > step and "dbf" in options:
        live = [tuple(r) for r in spark.read.format("shapefile_live_rows").options(**options).load().orderBy("first").collect()]
        options["starts"] = json.dumps(starts_of(live, n, step))
    features = spark.read.format("shapefile_features").options(**options).load()
    layers = spark.createDataFrame([(0, path, crs_of_prj(prj and prj.t, exact))], "layer_idx int, name string, crs string")
    return Dataset(compute_layers(features, layers), features, path)
