"""WARC archives: one gzip member per record, written from pages and read back sequentially.

An archive is a row of a Parquet table in the shared folder (its bytes are a WARC file as such), since executors share
nothing else. Of equal payloads of at least MIN_REVISIT bytes the one with the largest page_id is a response and the
others are revisits that refer to it; a revisit's block is the HTTP header alone, whose Content-Length keeps the size.

Null html is an empty payload; a null url is ``urn:none``; rows that repeat the largest page_id are all responses; a null
page_id is a revisit wherever an equal payload has an id, else a response. An empty table gives no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xpanel.llm.common import materialise, small

MIN_REVISIT = 1000
ARCHIVE_BYTES = 4_000_000
BROADCAST_KEEPERS, READ_BYTES = 300_000, 4_000_000  #: up to so many repeated payloads pages stay where they are; payload bytes a batch
ARCHIVES = "archive string, n_records int, warc binary"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def plan_records(pages: DataFrame) -> DataFrame:
    """pages with payload_digest, payload_bytes and refers_to (null: a response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    keepers = rows.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    keepers = materialise(keepers)
    joined = rows.join(F.broadcast(keepers) if small(keepers, BROADCAST_KEEPERS) else keepers, "payload_digest", "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "urn:none" if url is None else re.sub(rb"[\x00-\x20\x7f%]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, k, n, held = TaskContext.get().partitionId(), 0, 0, bytearray()

    def archive() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{k:06d}.warc.gz"]), pa.array([n], pa.int32()), pa.array([bytes(held)], pa.binary())], ["archive", "n_records", "warc"])

    for b in batches:
        for page_id, url, html, digest, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to"))):
            held += record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py())
            n += 1
            if len(held) >= ARCHIVE_BYTES:
                yield archive()
                k, n, held = k + 1, 0, bytearray()
    if n:
        yield archive()


def write_archives(pages: DataFrame, path: str) -> None:
    plan_records(pages).mapInArrow(_write, ARCHIVES).write.parquet(path)


class WarcError(ValueError):
    pass


def members(data: bytes, step: int = 65536) -> Iterator[Iterator[bytes]]:
    """For each gzip member an iterator over its decompressed pieces; each is to be used up before the next."""
    view, at = memoryview(data), 0
    while at < len(view):
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal at
            while not inflate.eof:
                if at >= len(view):
                    raise WarcError("an archive ends within a record")
                piece = view[at : at + step]
                at += len(piece)
                yield inflate.decompress(piece)
            at -= len(inflate.unused_data)

        yield pieces()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(WARC header, HTTP header, payload) of each record; checks framing and digests."""
    for pieces in members(data):
        held = bytearray()
        while (cut := held.find(b"\r\n\r\n")) < 0:
            piece = next(pieces, None)
            if piece is None:
                raise WarcError("a record without a header")
            held += piece
        version, *lines = held[:cut].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"not a record: {version[:20]}")
        header = dict(x.split(": ", 1) for x in lines)
        need = cut + 4 + int(header["Content-Length"])
        for piece in pieces:
            held += piece
        if bytes(held[need:]) != b"\r\n\r\n":
            raise WarcError("a record's length differs from its Content-Length")
        block = bytes(held[cut + 4 : need])
        if header["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
            raise WarcError("a block differs from its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if header["WARC-Type"] == "response" and header["WARC-Payload-Digest"] != f"sha1:{hashlib.sha1(payload).hexdigest()}":
            raise WarcError("a payload differs from its digest")
        yield header, http, payload


def _number(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:None>" else int(urn[len("<urn:page:") : -1])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
    for b in batches:
        for data, n in zip(b.column("warc"), b.column("n_records")):
            rows, held, count = [], 0, 0
            for header, http, payload in records(data.as_py()):
                revisit = header["WARC-Type"] == "revisit"
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                rows.append((_number(header["WARC-Record-ID"]), size, header["WARC-Payload-Digest"][5:], header["WARC-Type"], _number(header.get("WARC-Refers-To")), header["WARC-Target-URI"], None if revisit else payload))
                held, count = held + len(payload), count + 1
                if held >= READ_BYTES or len(rows) >= 1000:
                    yield batch(rows)
                    rows, held = [], 0
            if count != n.as_py():
                raise WarcError("an archive has lost records")
            if rows:
                yield batch(rows)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record; payload is null for revisits."""
    return archives.mapInArrow(_read, RECORDS)
