"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each task writes one archive, a gzip member per record, into the folder that the
cluster shares, and returns the index of what it wrote: file, offset, length, URL,
digest.  File names hold the attempt, and only files named in the stored index are
read, so a task that runs twice does no harm.  Of equal payloads the smallest page is
a response and the others are revisits without a body.  Readers sort the selected
index rows by file and offset and merge neighbouring ranges into one read.

Defined results: a null html is an empty payload; rows that repeat a page with one
payload are responses each; rows without page_id are revisits if a page with an id
has their payload, and else responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, shared_dir, stash


@dataclass(frozen=True)
class Warc:
    least_revisit_bytes: int = 0  # smaller payloads are always responses
    level: int = 3
    gap: int = 65_536  # bytes between two records that one read still spans
    read: int = 8_000_000  # bytes of a read at most, if a record isn't longer


_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string())])
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
_DATE = "2024-01-01T00:00:00Z"  # of the capture; pages carry none


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _clean(x: str | None) -> str:
    return (x or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to, refers: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers else http + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(root: str, p: Warc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        store, folder = _filesystem(root)
        out, at = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{folder}/{name}", compression=None)
            rows = []
            for r in batch.to_pylist():
                payload = r["html"] or b""
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                refers = r["refers"]
                pack = zlib.compressobj(p.level, zlib.DEFLATED, 31)
                data = pack.compress(record(r["page_id"], r["url"], payload, digest, r["size"], r["refers_to"], refers)) + pack.flush()
                out.write(data)
                rows.append((r["page_id"], r["url"], name, at, len(data), digest, "revisit" if refers else "response"))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, params: Warc = Warc()) -> tuple[DataFrame, str]:
    """(index, folder of the archives)."""
    p = params
    root = f"{shared_dir(pages.sparkSession)}/paceline/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    # Only payloads that several rows have need a join; digests alone are grouped.
    first = rows.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    rows = rows.join(first, ["sha", "size"], "left")
    refers = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("size") >= p.least_revisit_bytes)
    rows = rows.select("page_id", "url", F.when(refers, F.lit(b"")).otherwise(F.col("html")).alias("html"), "sha", "size", F.when(refers, F.col("first")).alias("refers_to"), refers.alias("refers"))
    return stash(rows.mapInArrow(_write(root, p), INDEX), "warc-index"), root


def _read(root: str, p: Warc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _filesystem(root)
        for batch in batches:
            names, offsets, lengths = (column(batch, x).to_pylist() for x in ("file", "offset", "length"))
            lo = 0
            while lo < len(names):
                hi, end = lo + 1, offsets[lo] + lengths[lo]
                while hi < len(names) and names[hi] == names[lo] and offsets[hi] - end <= p.gap and offsets[hi] + lengths[hi] - offsets[lo] <= p.read:
                    end = max(end, offsets[hi] + lengths[hi])
                    hi += 1
                with store.open_input_file(f"{folder}/{names[lo]}") as f:
                    data = f.read_at(end - offsets[lo], offsets[lo])
                rows = []
                for k in range(lo, hi):
                    at = offsets[k] - offsets[lo]
                    fields, http, payload = parse(zlib.decompress(data[at : at + lengths[k]], 31))
                    kind, size = fields["WARC-Type"], int(http["Content-Length"])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{names[k]} at {offsets[k]}: the payload isn't what its record says")
                    page, refers = (x[len("<urn:page:") : -1] if x else "" for x in (fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                    rows.append((int(page) if page else None, fields["WARC-Target-URI"], size, digest, kind, int(refers) if refers else None, payload if kind == "response" else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)],
                    names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )
                lo = hi

    return run


def read_records(index: DataFrame, root: str, params: Warc = Warc()) -> DataFrame:
    """The records of the index rows given (any selection of them)."""
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(_read(root, params), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def warc_digest(pages: DataFrame, params: Warc = Warc()) -> DataFrame:
    index, root = write_archives(pages, params)
    return read_records(index, root, params).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
