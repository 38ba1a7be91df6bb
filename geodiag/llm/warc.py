"""Operator 10: WARC archives with revisit records, and a normaliser for whole-file gzip.

Writers make archives whose records share one gzip stream, as many crawlers' tools do. The
normaliser inflates such a stream once, front to back, rewrites every record as a gzip
member of its own and writes a sidecar index of offsets, so that one record can be read
without the rest. Readers go by that index.

Files go to the folder given, by ``pyarrow.fs``, under names that no two task attempts
share; only names in the manifest that Spark commits count, so a lost or repeated task
leaves an unused file and no wrong one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.llm.tables import table
from geodiag.runtime import discard, materialize, parallelism, scratch_path, ship

#: bytes of payload after which a writer begins another archive
ROLL = 32 << 20
LEVEL = 1
_STAMP = "2000-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPACE = uuid.UUID("8a5e6f3e-3f0c-5c1b-9f52-0d7f5d1c0a10")


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit (``refers_to``) carries the HTTP head only."""
    target = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {_STAMP}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = _HTTP if revisit else _HTTP + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and whole bytes of each record of a gzip stream of any number of members, read once."""
    inflate, pending = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal inflate
        data = inflate.unused_data if inflate.eof else b""
        if inflate.eof:
            data = data or stream.read(1 << 20)
            if not data:
                return False
            inflate = zlib.decompressobj(31)
        else:
            data = stream.read(1 << 20)
            if not data:
                if pending or inflate.flush():
                    raise ValueError("the gzip stream ends within a record")
                return False
        pending.extend(inflate.decompress(data))
        return True

    at = 0
    while True:
        while (cut := pending.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(pending) > at:
                    raise ValueError("the archive ends within a record")
                return
        known = fields(bytes(pending[at:cut]))
        end = cut + 8 + int(known["Content-Length"])
        while len(pending) < end:
            if not more():
                raise ValueError("the archive ends within a record")
        yield known, bytes(pending[at:end])
        at = end
        if at > 4 << 20:
            del pending[:at]
            at = 0


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


MANIFEST = "archive string, n_records long"
INDEX = "archive string, start long, size long, record_id string, kind string"


def decide(pages: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Digest each payload and choose response or revisit: the smallest page_id of equal payloads of ``least`` bytes or more is the response.

    Returns the rows, and the written table of ids and digests that they read, for the caller to discard.
    Ids and digests alone meet by digest. What they tell, the revisits, meets payloads by page_id: broadcast where Catalyst finds
    it small, else one exchange without hot keys, as rows that can't be revisits are spread by a number of their own.
    """
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.select("*", F.sha2(F.encode("payload", "UTF-8"), 256).alias("digest"))
    able = (F.octet_length("payload") >= least) & F.col("page_id").isNotNull()
    keys = materialize(p.where(able).select("page_id", F.unhex("digest").alias("same")), "digests")
    first = keys.groupBy("same").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    revisits = keys.join(first, "same").where("page_id > refers_to").distinct().select("page_id", F.lower(F.hex("same")).alias("digest"), F.lit(0).cast("long").alias("spread"), "refers_to")
    spread = p.withColumn("spread", F.when(able, 0).otherwise(F.monotonically_increasing_id() + 1))
    return spread.join(revisits, ["page_id", "digest", "spread"], "left").select("page_id", "url", "payload", "digest", "refers_to"), keys


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write all pages to archives of one gzip stream each below ``folder``; the manifest of archives.

    Null html is an empty payload, a null page_id is always a response, equal page_ids with
    equal payloads are both responses. No pages, no archives.
    """
    ship(pages.sparkSession)

    def write(batches):
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        out, stream, size, n, name = [], None, 0, 0, ""

        def close():
            stream.write(gz.flush())
            stream.close()
            out.append((name, n))

        for batch in batches:
            for page, url, payload, digest, ref in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if stream is None:
                    name, gz, size, n = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                body = payload.as_py().encode()
                if data := gz.compress(record(page.as_py(), url.as_py(), body, digest.as_py(), ref.as_py())):
                    stream.write(data)
                size, n = size + len(body), n + 1
                if size >= ROLL:
                    close()
                    stream = None
        if stream is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["archive", "n_records"])

    decided, keys = decide(pages, least)
    manifest = materialize(decided.mapInArrow(write, MANIFEST), "manifest")
    discard(keys)
    return manifest


def tasks_for(archives: int, most: int) -> int:
    """Tasks for a number of archives of :data:`ROLL` bytes: one each up to ``most`` tasks, then up to eight a task. Rows that name archives are tiny, so they'd be put together by their bytes if not told."""
    return max(1, min(archives, max(most, archives // 8)))


def normalise(manifest: DataFrame, folder: str, out: str) -> DataFrame:
    """Rewrite each archive with a gzip member per record, beside it ``.idx`` with a line of JSON per record; the index as a table."""
    spark = manifest.sparkSession
    ship(spark)

    def rewrite(batches):
        (store, root), (to, target) = open_folder(folder), open_folder(out)
        to.create_dir(target, recursive=True)
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                name, rows, at = f"{uuid.uuid4().hex}.warc.gz", [], 0
                with store.open_input_stream(f"{root}/{archive}", compression=None) as source, to.open_output_stream(f"{target}/{name}", compression=None) as sink:
                    for known, data in records(source):
                        member = _member(data)
                        sink.write(member)
                        rows.append((name, at, len(member), known["WARC-Record-ID"], known["WARC-Type"]))
                        at += len(member)
                with to.open_output_stream(f"{target}/{name}.idx", compression=None) as side:
                    side.write("".join(json.dumps({"offset": r[1], "length": r[2], "id": r[3], "type": r[4]}) + "\n" for r in rows).encode())
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["archive", "start", "size", "record_id", "kind"])

    tasks = tasks_for(manifest.count(), parallelism(spark))
    return materialize(manifest.select("archive").repartition(tasks).mapInArrow(rewrite, INDEX), "warc-index")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string, payload string"


def read_archives(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Each indexed record, read at its offset; a response's payload is checked against its digest."""
    spark = index.sparkSession
    ship(spark)
    tasks = tasks_for(index.select("archive").distinct().count(), parallelism(spark))

    def read(batches):
        store, root = open_folder(folder)
        now, source = None, None
        for batch in batches:
            out = []
            for archive, start, size in zip(batch["archive"].to_pylist(), batch["start"].to_pylist(), batch["size"].to_pylist()):
                if archive != now:
                    now, source = archive, store.open_input_file(f"{root}/{archive}")
                source.seek(start)
                head, _, block = zlib.decompress(source.read(size), 31).partition(b"\r\n\r\n")
                f = fields(head)
                block = block[: int(f["Content-Length"])]
                body = block.partition(b"\r\n\r\n")[2]
                digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                if f["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(f["X-Payload-Length"])):
                    raise ValueError(f"record {f['WARC-Record-ID']} doesn't match its digest")
                out.append((int(f["X-Page-ID"]) if f["X-Page-ID"] else None, int(f["X-Payload-Length"]), digest, f["WARC-Type"], int(f["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in f else None, f["WARC-Target-URI"], body.decode() if payload and f["WARC-Type"] == "response" else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in READ.split(", ")])

    return index.select("archive", "start", "size").repartition(tasks, "archive").sortWithinPartitions("archive", "start").mapInArrow(read, READ)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written, normalised and read back."""
    whole, split = scratch_path(spark, "warc"), scratch_path(spark, "warc-split")
    manifest = write_archives(table(spark, sf_dir, "pages"), whole)
    index = normalise(manifest, whole, split)
    return read_archives(index, split, payload=False).drop("target", "payload")


OP10_SQL = """
with p as (
  select page_id, coalesce(html, '') as body from pages),
q as (select *, strlen(body) as n, sha256(body) as digest from p),
r as (select *, min(page_id) over (partition by digest) as first from q)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > first then first end as refers_to
from r
"""
