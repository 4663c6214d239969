"""Decoders: one stored object to its canonical documents.

The format is read off the leading bytes; only brotli, zlib and bare Arrow streams are told by the
name. Compressed payloads are sniffed again, archives give one document a member, tabular files
one JSON line a row. Damaged streams keep the good part before the damage if there is any.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import decimal
import io
import json
import lzma
import math
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime, time
from typing import Any

import pyarrow as pa

#: Limits of nesting, members and decoded bytes of one object.
MAX_DEPTH, MAX_MEMBERS, MAX_BYTES = 4, 100_000, 64 << 30


class DecodeError(ValueError):
    pass


@dataclass(frozen=True)
class Limits:
    depth: int = MAX_DEPTH
    members: int = MAX_MEMBERS
    expanded: int = MAX_BYTES

    def __post_init__(self) -> None:
        if min(self.depth, self.members, self.expanded) <= 0:
            raise ValueError("limits must be positive")


@dataclass(frozen=True)
class Document:
    display_key: str
    member_path: str | None
    content: bytes


def sniff(name: str, data: bytes) -> str:
    """The encoding of an object."""
    if data[:3] == b"\x1f\x8b\x08":
        return "gzip"
    magic = int.from_bytes(data[:4], "little")
    if magic == 0xFD2FB528:
        return "zstd"
    if 0x184D2A50 <= magic <= 0x184D2A5F and len(data) >= 8:
        after = data[8 + int.from_bytes(data[4:8], "little") :]
        return sniff("", after) if sniff("", after) in ("zstd", "lz4") else "zstd"
    if data[:3] == b"BZh" and data[3:4] in b"123456789" and data[4:10] in (b"1AY&SY", b"\x17rE8P\x90"):
        return "bzip2"
    if data[:6] == b"\xfd7zXZ\0":
        return "xz"
    if data[:10] == b"\xff\x06\0\0sNaPpY":
        return "snappy"
    if magic == 0x184D2204:
        return "lz4"
    if magic == 0x184C2102:
        raise DecodeError("the legacy lz4 format is not supported")
    if data[:4] == b"PAR1" and data[-4:] == b"PAR1" and len(data) >= 12:
        return "parquet"
    if data[:4] == b"Obj\x01":
        return "avro"
    if data[:6] == b"ARROW1":
        return "arrow"
    if data[:4] == b"\xff\xff\xff\xff" and len(data) > 8 and 0 < int.from_bytes(data[4:8], "little") < len(data):
        return "arrow_stream"
    if data[:3] == b"ORC" and len(data) > 16:
        return "orc"
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if _is_tar(data):
        return "tar"
    low = name.lower()
    if low.endswith(".br"):
        return "brotli"
    if low.endswith((".zlib", ".zz")):
        return "zlib"
    if low.endswith((".arrows", ".ipc")) and len(data) > 8:
        return "arrow_stream"
    return "raw"


def _is_tar(data: bytes) -> bool:
    if len(data) < 512 or not any(data[:512]):
        return False
    try:
        stored = int(data[148:156].split(b"\0")[0].strip() or b"-1", 8)
    except ValueError:
        return False
    return stored == sum(data[:148]) + 8 * 32 + sum(data[156:512])


# ---------------------------------------------------------------- compressed streams


class _Out:
    """Collects decoded bytes up to a limit."""

    def __init__(self, limit: int) -> None:
        self.parts: list[bytes] = []
        self.left = limit

    def add(self, data: bytes) -> None:
        self.left -= len(data)
        if self.left < 0:
            raise OverflowError("the object expands beyond its limit")
        self.parts.append(data)

    def done(self) -> bytes:
        return b"".join(self.parts)


def _salvage(out: _Out, error: Exception, what: str) -> bytes:
    if not any(out.parts):
        raise DecodeError(f"{what}: {error}") from error
    return out.done()


def _gzip(data: bytes, limit: int) -> bytes:
    out = _Out(limit)
    try:
        while data.strip(b"\0") and data[:2] == b"\x1f\x8b" or not out.parts:
            unzip = zlib.decompressobj(31)
            rest = data
            while rest and not unzip.eof:
                out.add(unzip.decompress(rest, 1 << 20))
                rest = unzip.unconsumed_tail
            if not unzip.eof:
                raise zlib.error("the stream ends early")
            out.add(unzip.flush())
            data = unzip.unused_data
            if not data:
                break
    except zlib.error as e:
        return _salvage(out, e, "gzip")
    return out.done()


def _members(data: bytes, limit: int, make, what: str, error) -> bytes:
    """Streams one after the other, zero bytes between them allowed."""
    out = _Out(limit)
    try:
        while data:
            unzip = make()
            rest = data
            while not unzip.eof:
                piece = unzip.decompress(rest, 1 << 20)
                rest = b""
                out.add(piece)
                if not piece and unzip.needs_input and not unzip.eof:
                    raise error("the stream ends early")
            data = unzip.unused_data.lstrip(b"\0")
    except (error, EOFError, OSError) as e:
        return _salvage(out, e, what)
    return out.done()


def _zstd(data: bytes, limit: int) -> bytes:
    import zstandard

    out = _Out(limit)
    try:
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
            while piece := reader.read(1 << 20):
                out.add(piece)
    except zstandard.ZstdError as e:
        return _salvage(out, e, "zstd")
    return out.done()


def _arrow_codec(data: bytes, limit: int, codec: str, strict: bool) -> bytes:
    out = _Out(limit)
    try:
        with pa.CompressedInputStream(pa.BufferReader(data), codec) as reader:
            while piece := reader.read(1 << 20):
                out.add(piece)
    except (OSError, pa.ArrowException) as e:
        if strict:
            raise DecodeError(f"{codec}: {e}") from e
        return _salvage(out, e, codec)
    return out.done()


def _lz4(data: bytes, limit: int) -> bytes:
    out, first = [], True
    while data:
        magic = int.from_bytes(data[:4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            data = data[8 + int.from_bytes(data[4:8], "little") :]
            continue
        if magic != 0x184D2204:
            if first:
                raise DecodeError("lz4: no frame")
            break
        size = _lz4_frame(data)
        piece = _arrow_codec(data[:size], limit, "lz4", False)
        limit -= len(piece)
        out.append(piece)
        data, first = data[size:], False
    return b"".join(out)


def _lz4_frame(data: bytes) -> int:
    """Length of the frame that ``data`` starts with."""
    flags = data[4]
    at = 7 + (8 if flags & 8 else 0) + (4 if flags & 1 else 0)
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        at += 4
        if not size:
            return min(len(data), at + (4 if flags & 4 else 0))
        at += (size & 0x7FFFFFFF) + (4 if flags & 16 else 0)
    return len(data)


def _snappy(data: bytes, limit: int) -> bytes:
    out, at = _Out(limit), 0
    codec = pa.Codec("snappy")
    try:
        while at + 4 <= len(data):
            kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "little")
            body = data[at + 4 : at + 4 + size]
            if len(body) < size:
                raise DecodeError("the stream ends early")
            if kind == 0:
                length, shift, k = 0, 0, 4
                while True:
                    length |= (body[k] & 127) << shift
                    if body[k] < 128:
                        break
                    shift, k = shift + 7, k + 1
                out.add(codec.decompress(body[4:], decompressed_size=length, asbytes=True))
            elif kind == 1:
                out.add(body[4:])
            elif 2 <= kind <= 0x7F:
                raise DecodeError(f"unknown chunk {kind}")
            at += 4 + size
    except (DecodeError, OSError, pa.ArrowException, IndexError) as e:
        return _salvage(out, e, "snappy")
    return out.done()


def _zlib(data: bytes, limit: int) -> bytes:
    unzip = zlib.decompressobj()
    out, rest = _Out(limit), data
    try:
        while rest and not unzip.eof:
            out.add(unzip.decompress(rest, 1 << 20))
            rest = unzip.unconsumed_tail
    except zlib.error as e:
        raise DecodeError(f"zlib: {e}") from e
    if not unzip.eof or unzip.unused_data:
        raise DecodeError("zlib: the stream ends early or has a tail")
    return out.done()


_STREAMS = {
    "gzip": _gzip,
    "zstd": _zstd,
    "bzip2": lambda d, n: _members(d, n, bz2.BZ2Decompressor, "bzip2", OSError),
    "xz": lambda d, n: _members(d, n, lzma.LZMADecompressor, "xz", lzma.LZMAError),
    "snappy": _snappy,
    "lz4": _lz4,
    "brotli": lambda d, n: _arrow_codec(d, n, "brotli", True),
    "zlib": _zlib,
}

# ---------------------------------------------------------------- tabular files


def _plain(value: Any) -> Any:
    """A cell as JSON can hold it: decimals as text, floats that are not finite as null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime, date, time)):
        return value.isoformat()
    if isinstance(value, bytes):
        try:
            return value.decode()
        except UnicodeDecodeError:
            return base64.b64encode(value).decode()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def _json_line(row: dict) -> bytes:
    return json.dumps(_plain(row), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass") + b"\n"


def _tabular(batches: Iterator[pa.RecordBatch], limit: int, what: str) -> bytes:
    out = _Out(limit)
    try:
        for batch in batches:
            for row in batch.to_pylist():
                out.add(_json_line(row))
    except (pa.ArrowException, OSError) as e:
        return _salvage(out, e, what)
    return out.done()


def _table(kind: str, data: bytes, limit: int) -> bytes:
    try:
        if kind == "parquet":
            import pyarrow.parquet as pq

            return _tabular(pq.ParquetFile(pa.BufferReader(data)).iter_batches(), limit, kind)
        if kind == "orc":
            from pyarrow import orc

            file = orc.ORCFile(pa.BufferReader(data))
            return _tabular((file.read_stripe(k) for k in range(file.nstripes)), limit, kind)
        if kind == "arrow":
            file = pa.ipc.open_file(pa.BufferReader(data))
            return _tabular((file.get_batch(k) for k in range(file.num_record_batches)), limit, kind)
        if kind == "arrow_stream":
            return _tabular(iter(pa.ipc.open_stream(pa.BufferReader(data))), limit, kind)
    except (pa.ArrowException, OSError) as e:
        raise DecodeError(f"{kind}: {e}") from e
    from .avro import read_avro

    out = _Out(limit)
    try:
        for row in read_avro(data):
            out.add(_json_line(row))
    except OverflowError:
        raise
    except (ValueError, IndexError, KeyError, struct.error, zlib.error, EOFError) as e:
        return _salvage(out, e, "avro")
    return out.done()


_TABLES = frozenset(("parquet", "orc", "arrow", "arrow_stream", "avro"))

# ---------------------------------------------------------------- archives and nesting


def clean_member(path: str) -> str:
    """A member's path with ``/`` and without ``.`` parts; absolute paths and ``..`` are refused."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".")]
    if "\0" in path or path.replace("\\", "/").startswith("/") or ".." in parts or not parts:
        raise DecodeError(f"unsafe member path {path!r}")
    return "/".join(parts)


def canonical(data: bytes) -> bytes:
    """Text in UTF-8 without a byte order mark."""
    for mark, name in ((codecs.BOM_UTF8, None), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            body = data[len(mark) :]
            return body if name is None else body.decode(name, "replace").encode("utf-8", "replace")
    return data


def decode(key: str, data: bytes, limits: Limits | None = None) -> list[Document]:
    """The documents of an object by display key; raises DecodeError if it can't be decoded."""
    limits = limits or Limits()
    left = [limits.expanded, limits.members]
    found: list[Document] = []

    def emit(path: str | None, content: bytes) -> None:
        content = canonical(content)
        found.append(Document(f"{key}!/{path}" if path else key, path, content))

    def spend(content: bytes) -> bytes:
        left[0] -= len(content)
        return content

    def members(kind: str, body: bytes) -> Iterator[tuple[str, bytes]]:
        if kind == "zip":
            try:
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    names = [i.orig_filename for i in z.infolist()]
                    if len(set(names)) < len(names):
                        raise DecodeError("zip: two members have the same name")
                    for info in z.infolist():
                        if info.is_dir():
                            continue
                        if info.flag_bits & 1:
                            raise DecodeError("zip: encrypted")
                        if info.external_attr >> 28 not in (0, 8):
                            continue
                        with z.open(info) as f:
                            content = f.read(min(info.file_size, max(left[0], 0)) + 1)
                        yield info.filename, content
            except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, OSError) as e:
                raise DecodeError(f"zip: {e}") from e
        else:
            try:
                with tarfile.open(fileobj=io.BytesIO(body)) as t:
                    for info in t:
                        if info.isreg():
                            yield info.name, t.extractfile(info).read(min(info.size, max(left[0], 0) + 1))
            except (tarfile.TarError, EOFError, OSError) as e:
                raise DecodeError(f"tar: {e}") from e

    def walk(path: str | None, name: str, body: bytes, depth: int, hint: bool = True) -> None:
        kind = sniff(name if hint else "", body)
        if kind == "raw":
            emit(path, body)
            return
        if depth >= limits.depth:
            raise DecodeError(f"nested deeper than {limits.depth}")
        try:
            if kind in _STREAMS:
                walk(path, name, spend(_STREAMS[kind](body, left[0])), depth + 1, False)
                return
            if kind in _TABLES:
                emit(path, spend(_table(kind, body, left[0])))
                return
            seen: dict[str, int] = {}
            for raw, content in members(kind, body):
                left[1] -= 1
                if left[1] < 0:
                    raise DecodeError(f"more than {limits.members} members")
                spend(content)
                if left[0] < 0:
                    raise OverflowError
                member = clean_member(raw)
                seen[member] = seen.get(member, 0) + 1
                if seen[member] > 1:
                    member = f"{member}#{seen[member]}"
                walk(f"{path}!/{member}" if path else member, member, content, depth + 1)
        except OverflowError as e:
            raise DecodeError("the object expands beyond its limit") from e

    walk(None, key, data, 0)
    return sorted(found, key=lambda d: d.display_key)


def decode_requested(key: str, data: bytes, wanted: list[str | None], limits: Limits | None = None) -> list[Document]:
    """The documents of the given member paths (None: the object itself); a missing one is an error."""
    by_path = {d.member_path: d for d in decode(key, data, limits)}
    missing = [w for w in wanted if w not in by_path]
    if missing:
        raise DecodeError(f"{key} has no member {missing[0]!r}")
    return [by_path[w] for w in wanted]
