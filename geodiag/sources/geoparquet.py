"""GeoParquet: a writer in Hilbert order with bounding boxes and the ``geo`` key, and a source of Parquet footers.

The writer orders features along a Hilbert curve over their layer's extent by a range partitioning, so that files
and row groups have small boxes that hardly overlap, and a reader can skip those apart from its window. Files are written by tasks to
a staging folder; names that Spark committed are moved in place by a second small job, so a repeated task leaves no row twice.

The footer source reads the metadata at each file's end and no data: a row for each file, row group and column.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geodiag.functions import geometry as g
from geodiag.runtime import materialize, ship

#: bits of a Hilbert key along each axis
ORDER = 16
#: files whose footers a task reads
FOOTERS = 64
_CODES = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def encode(geom: dict | None) -> bytes | None:
    """Little-endian well-known binary of a geometry; null stays null."""
    if geom is None:
        return None
    run = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in r)

    def part(kind: str, rings: list) -> bytes:
        if kind == "point":
            p = rings[0][0] if rings and rings[0] else {"x": float("nan"), "y": float("nan")}
            return struct.pack("<BI2d", 1, 1, p["x"], p["y"])
        if kind == "line":
            return struct.pack("<BI", 1, 2) + run(rings[0] if rings else [])
        return struct.pack("<BII", 1, 3, len(rings)) + b"".join(map(run, rings))

    parts, code = geom["parts"] or [], _CODES[geom["gtype"]]
    if code <= 3:
        kind = ("point", "line", "polygon")[code - 1]
        return part(kind, parts[0]["rings"] if parts else [])
    return struct.pack("<BII", 1, code, len(parts)) + b"".join(part(p["kind"], p["rings"]) for p in parts)


def encode_all(geoms: pa.Array) -> pa.Array:
    """:func:`encode` of a column; points all at once."""
    rings = geoms.field("parts").flatten().field("rings").flatten()
    places = rings.flatten()
    n = len(geoms)
    kinds = pc.unique(geoms.field("gtype").filter(geoms.is_valid())).to_pylist()
    alone = lambda a: pc.all(pc.equal(pc.list_value_length(a), 1)).as_py()
    parts = geoms.field("parts").filter(geoms.is_valid())
    whole = geoms.null_count + len(places) == n and places.null_count == 0
    if kinds != ["Point"] or not (whole and alone(parts) and alone(parts.flatten().field("rings")) and alone(rings)):
        return pa.array([encode(x) for x in geoms.to_pylist()], pa.binary())
    made = np.zeros(len(places), np.dtype([("order", "u1"), ("code", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    made["order"], made["code"], made["x"], made["y"] = 1, 1, places.field("x"), places.field("y")
    there = np.asarray(geoms.is_valid())
    off = np.concatenate([[0], np.cumsum(np.where(there, made.dtype.itemsize, 0))]).astype(np.int32)
    valid = pa.py_buffer(np.packbits(there, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(off.tobytes()), pa.py_buffer(made.tobytes())])


def _turns() -> list[int]:
    """For each turn of the curve (flipped, swapped) and two bits of x and of y: four bits of the place and, in the low two, the next turn."""
    out = []
    for turn, x, y in product(range(4), range(4), range(4)):
        place = 0
        for k in (1, 0):
            u, v = x >> k & 1, y >> k & 1
            if turn & 1:
                u, v = v, u
            u, v = u ^ turn >> 1, v ^ turn >> 1
            place = place << 2 | (3 * u) ^ v
            turn ^= 0 if v else u << 1 | 1
        out.append(place << 2 | turn)
    return out


def hilbert(x: Column, y: Column) -> Column:
    """Place along a Hilbert curve of ``ORDER`` bits for each axis, of two integers of so many bits: two bits of each at a step, by a table."""
    table = F.lit(_turns()).cast("array<long>")

    def step(a, k):
        two = lambda c: F.call_function("shiftright", c.cast("long"), k).bitwiseAND(3)
        at = a.bitwiseAND(3) * 16 + two(x) * 4 + two(y)
        return a.bitwiseAND(-4) * 16 + table[at.cast("int")]

    return F.shiftright(F.aggregate(F.array(*map(F.lit, range(ORDER - 2, -1, -2))), F.lit(0).cast("long"), step), 2)


WRITTEN = "name string, n_rows long, n_bytes long"


def write(features: DataFrame, folder: str, crs: str | None, compression: str = "zstd", files: int = 8, group: int = 10_000) -> DataFrame:
    """Write features (feat_idx, id, geom, properties) as about ``files`` GeoParquet files with row groups of ``group`` rows; ``path, n_rows, n_bytes`` of each.

    Columns: ``id``, ``geometry`` (well-known binary), ``bbox`` (a struct, null without a geometry) and ``properties``. Features without a
    geometry or with an empty one come last. An empty table writes no file. ``crs``: an EPSG code or OGC:CRS84, else unknown.
    """
    spark = features.sparkSession
    ship(spark)
    where, root = open_folder(folder)
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    where.create_dir(staging, recursive=True)
    boxed = features.select("feat_idx", F.col("id").cast("string"), "geom", "properties", g.bbox(F.col("geom")).alias("bbox"))
    extent = boxed.agg(F.min("bbox.min_x").alias("x0"), F.min("bbox.min_y").alias("y0"), F.max("bbox.max_x").alias("x1"), F.max("bbox.max_y").alias("y1"))  # one row
    cell = lambda lo, hi, a, b: F.least(F.greatest(F.floor(((F.col(lo) + F.col(hi)) / 2 - F.col(a)) / F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(1.0) * (1 << ORDER)), F.lit(0)), F.lit((1 << ORDER) - 1))
    keyed = boxed.join(F.broadcast(extent)).withColumn("key", hilbert(cell("bbox.min_x", "bbox.max_x", "x0", "x1"), cell("bbox.min_y", "bbox.max_y", "y0", "y1"))).drop("x0", "y0", "x1", "y1")
    dealt = keyed.repartitionByRange(files, F.col("key").asc_nulls_last(), "feat_idx").sortWithinPartitions(F.col("key").asc_nulls_last(), "feat_idx")
    box = pa.struct([(c, pa.float64()) for c in ("min_x", "min_y", "max_x", "max_y")])
    schema = pa.schema([("id", pa.string()), ("geometry", pa.binary()), ("bbox", box), ("properties", pa.map_(pa.string(), pa.string()))])

    def geo(kinds: set[str], bounds: list[float] | None) -> bytes:
        column = {"encoding": "WKB", "geometry_types": sorted(kinds), "covering": {"bbox": {k: ["bbox", f"{c}_{a}"] for k, c, a in (("xmin", "min", "x"), ("ymin", "min", "y"), ("xmax", "max", "x"), ("ymax", "max", "y"))}}}
        if bounds:
            column["bbox"] = bounds
        authority, _, code = (crs or "").partition(":")
        if crs != "OGC:CRS84":  # the format's default
            column["crs"] = {"type": "GeographicCRS" if code in ("4326", "4269") else "ProjectedCRS", "name": crs, "id": {"authority": authority, "code": int(code)}} if code.isdigit() else None
        return json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}).encode()

    def put(batches) -> Iterator[pa.RecordBatch]:
        there, _ = open_folder(folder)
        name, writer, kinds, bounds, n = f"part-{uuid.uuid4().hex}.parquet", None, set(), None, 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            geoms = batch["geom"]
            kinds |= set(pc.unique(geoms.field("gtype").filter(geoms.is_valid())).to_pylist())
            boxes = batch["bbox"].filter(batch["bbox"].is_valid())
            if len(boxes):
                now = [f(boxes.field(c)).as_py() for f, c in ((pc.min, "min_x"), (pc.min, "min_y"), (pc.max, "max_x"), (pc.max, "max_y"))]
                bounds = now if bounds is None else [*map(min, bounds[:2], now[:2]), *map(max, bounds[2:], now[2:])]
            if writer is None:
                out = there.open_output_stream(f"{staging}/{name}")
                writer = pq.ParquetWriter(out, schema, compression=compression)
            for a in range(0, batch.num_rows, group):
                some = batch.slice(a, group)
                writer.write_table(pa.table([some["id"], encode_all(some["geom"]), some["bbox"].cast(box), some["properties"].cast(schema.field("properties").type)], schema=schema), row_group_size=group)
            n += batch.num_rows
        if writer is not None:
            writer.add_key_value_metadata({"geo": geo(kinds, bounds).decode()})
            writer.close()
            size = out.tell() if not out.closed else there.get_file_info(f"{staging}/{name}").size
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["name", "n_rows", "n_bytes"])

    def move(batches) -> Iterator[pa.RecordBatch]:
        there, top = open_folder(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                # a repeated task finds it moved
                if there.get_file_info(f"{staging}/{name}").type != fs.FileType.NotFound:
                    there.move(f"{staging}/{name}", f"{top}/{name}")
            yield batch

    # committed names are written first, so that a repeated move names the same files
    written = materialize(dealt.mapInArrow(put, WRITTEN), "written")
    moved = materialize(written.mapInArrow(move, WRITTEN), "moved")
    where.delete_dir(staging)
    return moved.select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"), "n_rows", "n_bytes")


FOOTER = "path string, n_bytes long, n_rows long, n_groups int, row_group int, group_rows long, column string, kind string, codec string, compressed long, uncompressed long, nulls long, least double, most double, geo string"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FooterReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Files]:
        where, root = open_folder(self.folder)
        found = sorted(x.path for x in where.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File and x.path.lower().endswith((".parquet", ".geoparquet")) and not x.base_name.startswith(("_", ".")))
        return [Files(found[i : i + FOOTERS]) for i in range(0, len(found), FOOTERS)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        where, _ = open_folder(self.folder)
        number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None
        for path in partition.paths:
            with where.open_input_file(path) as f:
                size = f.size()
                meta = pq.read_metadata(f)
            geo = (meta.metadata or {}).get(b"geo")
            head = (path, size, meta.num_rows, meta.num_row_groups)
            if not meta.num_row_groups or not meta.num_columns:
                yield (*head, *[None] * 10, geo.decode() if geo else None)
            for k in range(meta.num_row_groups):
                group = meta.row_group(k)
                for j in range(group.num_columns):
                    c = group.column(j)
                    s = c.statistics if c.is_stats_set else None
                    low, high = (number(s.min), number(s.max)) if s is not None and s.has_min_max else (None, None)
                    yield (*head, k, group.num_rows, c.path_in_schema, c.physical_type, c.compression, c.total_compressed_size, c.total_uncompressed_size, s.null_count if s is not None and s.has_null_count else None, low, high, geo.decode() if geo else None)


class FooterSource(DataSource):
    """``spark.read.format("parquet_footers").load(folder)``: footers of all Parquet files below a folder, some files for each task."""

    @classmethod
    def name(cls) -> str:
        return "parquet_footers"

    def schema(self) -> str:
        return FOOTER

    def reader(self, schema) -> FooterReader:
        return FooterReader(self.options["path"])


def footers(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of every column of every row group of the Parquet files below a folder; a file without row groups is one row with nulls."""
    ship(spark)
    spark.dataSource.register(FooterSource)
    return spark.read.format("parquet_footers").option("path", folder).load()
