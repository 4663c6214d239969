"""WARC archives in seekable Zstandard bundles.

A bundle is the bytes of one ``.warc.zst`` file: records are grouped into frames of about FRAME_BYTES that
decompress on their own, and a skippable footer frame holds the seek table (compressed and
decompressed size of each frame), as in the public Zstandard seekable format. The index maps a record
identifier to its bundle, frame and the offset within the frame, so one record costs one frame.

Bundles are rows of a Parquet table in the shared folder, a binary column each, as executors can
reach every store only through Spark; :func:`export_bundles` writes them as files.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, materialize, text_of

FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
#: Fixed values of the seekable format: skippable frame and seek table magic numbers.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2020-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """(record id, bytes) of a response record, or of a revisit of page ``refers_to``, which keeps the HTTP head only."""
    digest = payload_digest(payload)
    name = record_id(page_id, digest)
    target = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {target}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>"]
    else:
        block += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and the offset after it. Raises ValueError for damaged records."""
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n") if end >= 0 else [""]
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has a wrong length")
    http = data.index(b"\r\n\r\n", start, stop) + 4
    length = int(re.search(rb"Content-Length: (\d+)", data[start:http])[1])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    payload = data[http:stop] if kind == "response" else None
    if payload is not None and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"the payload of the record at {at} doesn't match its digest")
    ids = [head.get(f"WARC-{x}", "").strip("<>") for x in ("Record-ID", "Refers-To")]
    pages = [int(x.split(":")[2]) if x and x.split(":")[2] else None for x in ids]
    return {"record_id": ids[0], "page_id": pages[0], "url": head["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": pages[1], "payload": payload}, stop + 4


class BundleWriter:
    """Collects records into frames; ``finish`` appends the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3) -> None:
        self.frame_bytes, self.pack = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.held = self.written = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset in the frame) of the record."""
        if self.open and self.held + len(record) > self.frame_bytes:
            self._close()
        place = len(self.sizes), self.held
        self.open.append(record)
        self.held += len(record)
        return place

    def _close(self) -> None:
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.parts.append(frame)
            self.sizes.append((len(frame), self.held))
            self.written += len(frame)
            self.open, self.held = [], 0

    def finish(self) -> bytes:
        self._close()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", _SKIPPABLE, len(entries)) + entries


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, read from the footer."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    first = len(bundle) - 9 - 8 * count
    if struct.unpack("<II", bundle[first - 8 : first]) != (_SKIPPABLE, 8 * count + 9):
        raise ValueError("damaged seek table")
    out, start = [], 0
    for packed, size in struct.iter_unpack("<II", bundle[first : len(bundle) - 9]):
        out.append((start, packed, size))
        start += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    start, packed, size = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size)


def read_record(bundle: bytes, frame: int, offset: int) -> dict:
    """One record by its place; decompresses its frame only."""
    return parse_record(read_frame(bundle, frame), offset)[0]


_STORED = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_STORED_SQL = "bundle string, data binary, record_id string, page_id long, frame int, offset long, length long"


def _writer(frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        writer, index = BundleWriter(frame_bytes), []

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{serial:06d}.warc.zst"
            rows = [(name, writer.finish(), None, None, None, None, None), *((name, None, *x) for x in index)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _STORED, strict=True)], schema=_STORED)

        for batch in batches:
            pages, urls, htmls, refers = (batch.column(c) for c in ("page_id", "url", "html", "refers_to"))
            for k in range(batch.num_rows):
                page = pages[k].as_py()
                name, record = make_record(page, urls[k].as_py(), htmls[k].as_py().encode("utf-8", "surrogatepass"), refers[k].as_py())
                index.append((name, page, *writer.add(record), len(record)))
                if writer.written >= bundle_bytes:
                    yield flush()
                    writer, index, serial = BundleWriter(frame_bytes), [], serial + 1
        if index:
            yield flush()

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("bundle", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for name, data in zip(batch.column("bundle").to_pylist(), batch.column("data"), strict=True):
            bundle = data.as_py()
            for start, packed, size in seek_table(bundle):
                frame = unzip.decompress(bundle[start : start + packed], max_output_size=size)
                at, rows = 0, []
                while at < len(frame):
                    record, at = parse_record(frame, at)
                    rows.append((name, *(record[f.name] for f in schema if f.name != "bundle")))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write a record per page; returns (bundles, index) as stored tables.

    bundles: (bundle, data). index: (record_id, page_id, bundle, frame, offset, length). Of records with
    equal payloads of at least ``min_bytes`` bytes the one with the largest page id is the response and
    others revisit it; smaller payloads are all responses.

    - A null html is an empty payload, a null url an empty target.
    - A null page id loses against any other; pages that only null ids share are all responses.
    - Repeated rows each have a record; those with the largest id are all responses.
    - An empty table gives empty tables; other columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    html = text_of(pages[html_col])
    source = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha"), F.sha2(html, 256).alias("sha256"))
    last = materialize(source.groupBy("sha", "sha256").agg(F.max("page_id").alias("last")))
    last = last.select(F.col("sha").alias("sha_"), F.col("sha256").alias("sha256_"), "last")
    refers = F.when((F.octet_length("html") >= min_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    joined = source.join(last, (F.col("sha") == F.col("sha_")) & (F.col("sha256") == F.col("sha256_"))).select("page_id", "url", "html", refers.alias("refers_to"))
    stored = materialize(joined.mapInArrow(_writer(frame_bytes, bundle_bytes), _STORED_SQL))
    return stored.where("data is not null").select("bundle", "data"), stored.where("data is null").select("record_id", "page_id", "bundle", "frame", "offset", "length")


def read_archives(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, each payload checked against its digest: (bundle, record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""
    return bundles.mapInArrow(_unpack, "bundle string, record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export_bundles(bundles: DataFrame, folder: str) -> list[str]:
    """Write each bundle as a file of the driver's ``folder``, one at a time."""
    names = []
    for row in bundles.toLocalIterator():
        Path(folder, row["bundle"]).write_bytes(row["data"])
        names.append(row["bundle"])
    return sorted(names)
