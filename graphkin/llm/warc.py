"""WARC archives with revisit records.

``resolve`` needs headers only: it groups records by payload digest (partial
sums come first, so a digest of any number of copies costs one row for each
task), finds the first record of each and marks the others as revisits.
``write`` then writes archives, gzipped record by record and rolled at
``ROLL`` bytes of payload, with fresh headers: a revisit has no payload and
refers to its response.  Files go to a folder that driver and executors share,
each under a name of its own and renamed when whole.  The manifest is a written
table: archives are made once, and those of a task that failed are in no
manifest.  ``read`` parses every record of the archives that the manifest names;
``resolve_revisits`` joins revisit records to the responses by digest.

A record is the unit of work: a very long payload is held whole by its task.

Defined cases: a null payload is empty; payloads of under ``min_bytes`` are
always responses; rows that repeat the id of a response with its payload are
responses as well; a null url gives an empty target; rows with
a null id are records as well (never a response that others refer to, if a row
with an id has the same payload); a revisit whose response is in no archive has
a null length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, new_path, put, shared_dir, store

ROLL = 32 << 20
DATE = "2024-01-01T00:00:00Z"


def payload_of(c):
    return F.coalesce(c, F.lit("")).cast("binary")


def resolve(pages: DataFrame, *, id_col: str = "page_id", html: str = "html", min_bytes: int = 100) -> DataFrame:
    """id, digest, bytes, first: the id of the response (null: the record is itself one).  One row for each id and digest."""
    body = payload_of(F.col(html))
    headers = pages.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    heads = headers.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    return headers.join(heads, "digest", "left")


def _urn(page: object) -> str:
    return f"<urn:page:{'' if page is None else 'id:' + quote(str(page), safe='')}>"


def _page(urn: str | None) -> str | None:
    text = urn[len("<urn:page:") : -1] if urn else ""
    return unquote(text[3:]) if text else None


def _record(kind: str, page: object, url: str, digest: str, size: int, refers: object, body: bytes) -> bytes:
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + body
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write(records: DataFrame, folder: str) -> DataFrame:
    """Archives of records (id, url, body binary, digest, first) in the folder; a manifest row (path, records, bytes) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            path = new_path(folder) + ".warc.gz"
            n = put(path, held)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([n], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            for page, url, body, digest, first, is_head in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "body", "digest", "first", "head")), strict=True):
                kind = "response" if is_head else "revisit"
                body = body or b""
                held.append(_gzip(_record(kind, page, url or "", digest, len(body), first, body if is_head else b"")))
                size += len(held[-1])
                if size >= ROLL:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return checkpoint(records.mapInArrow(run, "path string, records bigint, bytes bigint"))


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped stream; reads a bounded part at a time."""
    unzip, raw = zlib.decompressobj(31), b""

    def more() -> bool:
        nonlocal unzip, raw
        data = unzip.unused_data if unzip.eof else b""
        if unzip.eof:
            unzip = zlib.decompressobj(31)
        if not data:
            data = stream.read(1 << 16)
        if not data:
            return False
        raw += unzip.decompress(data)
        return True

    while True:
        while b"\r\n\r\n" not in raw:
            if not more():
                return
        head, raw = raw.split(b"\r\n\r\n", 1)
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        while len(raw) < size + 4:
            if not more():
                raise ValueError("the archive ends inside a record")
        block, raw = raw[:size], raw[size + 4 :]
        yield headers, block


def read(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, record_type, payload_digest (of the header), refers_to, url, payload (null for revisits) of each record in the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, where = store(path)
                rows, size = [], 0
                with fs.open_input_stream(where, compression=None) as stream:
                    for h, block in parse(stream):
                        kind = h["WARC-Type"]
                        body = block.split(b"\r\n\r\n", 1)[1] if kind == "response" else None
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if body is not None and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"a payload of {path} differs from its digest")
                        rows.append({"page_id": _page(h["WARC-Record-ID"]), "record_type": kind, "payload_digest": digest, "refers_to": _page(h.get("WARC-Refers-To")), "url": h["WARC-Target-URI"], "payload": body})
                        size += len(block)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # a row of the manifest stands for a whole archive
    paths = manifest.select("path").repartition(max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "path")
    found = paths.mapInArrow(run, "page_id string, record_type string, payload_digest string, refers_to string, url string, payload binary")
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def resolve_revisits(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: revisits get the length from the response of their digest."""
    # archives are read once: the headers are small
    headers = checkpoint(records.select("page_id", "record_type", "payload_digest", "refers_to", F.octet_length("payload").cast("long").alias("own")))
    originals = headers.where((F.col("record_type") == "response")).groupBy("payload_digest").agg(F.max("own").alias("original"))
    used = headers.where(F.col("record_type") == "revisit")
    resolved = used.join(originals, "payload_digest", "left").select("page_id", F.col("original").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return headers.where(F.col("record_type") == "response").select("page_id", F.col("own").alias("payload_bytes"), "payload_digest", "record_type", "refers_to").unionByName(resolved)


def archive(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """Write pages as deduplicated archives; returns the manifest."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    heads = resolve(pages, id_col=id_col, html=html, min_bytes=min_bytes).where(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).select("id", "first", "digest")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload_of(F.col(html)).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256))
    # only revisits are looked up: the ids that have a row here
    marked = rows.join(heads.distinct().withColumnsRenamed({"id": "_id", "digest": "_digest"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest")
    return write(marked.select("id", "url", "body", "digest", "first", F.col("first").isNull().alias("head")), folder)
