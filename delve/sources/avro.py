"""Rows of an Avro object container file, following the public Avro specification."""

from __future__ import annotations

import decimal
import io
import json
import struct
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pyarrow as pa

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_NAMED = ("record", "enum", "fixed")


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.f = io.BytesIO(data)

    def take(self, n: int) -> bytes:
        out = self.f.read(n)
        if n < 0 or len(out) < n:
            raise EOFError("the file ends early")
        return out

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def blob(self) -> bytes:
        return self.take(self.long())


def _names(schema: Any, known: dict[str, Any], space: str = "") -> None:
    """Collect named types, so that later uses by name resolve."""
    if isinstance(schema, list):
        for s in schema:
            _names(s, known, space)
    elif isinstance(schema, dict):
        if schema.get("type") in _NAMED:
            space = schema.get("namespace", space)
            known[schema["name"]] = known[f"{space}.{schema['name']}"] = schema
        for s in (schema.get("items"), schema.get("values"), *(f["type"] for f in schema.get("fields", ()))):
            _names(s, known, space)
        if isinstance(schema.get("type"), (dict, list)):
            _names(schema["type"], known, space)


def _value(r: _Reader, schema: Any, known: dict[str, Any]) -> Any:
    if isinstance(schema, list):
        return _value(r, schema[r.long()], known)
    spec = schema if isinstance(schema, dict) else {}
    kind = spec.get("type", schema)
    if isinstance(kind, (dict, list)):
        return _value(r, kind, known)
    if kind in known and kind not in _NAMED:
        return _value(r, known[kind], known)
    logical = spec.get("logicalType")
    match kind:
        case "null":
            return None
        case "boolean":
            return r.take(1) != b"\0"
        case "int" | "long":
            n = r.long()
            if logical == "date":
                return (_EPOCH + timedelta(days=n)).date()
            if logical in ("timestamp-millis", "timestamp-micros"):
                return _EPOCH + timedelta(microseconds=n * (1000 if logical.endswith("millis") else 1))
            return n
        case "float":
            return struct.unpack("<f", r.take(4))[0]
        case "double":
            return struct.unpack("<d", r.take(8))[0]
        case "bytes" | "fixed":
            raw = r.blob() if kind == "bytes" else r.take(spec["size"])
            return decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-spec.get("scale", 0)) if logical == "decimal" else raw
        case "string":
            return r.blob().decode()
        case "enum":
            return spec["symbols"][r.long()]
        case "record":
            return {f["name"]: _value(r, f["type"], known) for f in spec["fields"]}
        case "array" | "map":
            items, pairs = [], {}
            while count := r.long():
                if count < 0:
                    count = -count
                    r.long()
                for _ in range(count):
                    if kind == "array":
                        items.append(_value(r, spec["items"], known))
                    else:
                        name = r.blob().decode()
                        pairs[name] = _value(r, spec["values"], known)
            return items if kind == "array" else pairs
    raise ValueError(f"unknown Avro type {kind!r}")


def read_avro(data: bytes) -> Iterator[dict]:
    r = _Reader(data)
    if r.take(4) != b"Obj\x01":
        raise ValueError("not an Avro file")
    meta = _value(r, {"type": "map", "values": "bytes"}, {})
    schema = json.loads(meta["avro.schema"])
    codec = meta.get("avro.codec", b"null").decode()
    known: dict[str, Any] = {}
    _names(schema, known)
    mark = r.take(16)
    while r.f.tell() < len(data):
        count, block = r.long(), r.blob()
        if codec == "deflate":
            block = zlib.decompress(block, -15)
        elif codec == "zstandard":
            import zstandard

            block = zstandard.ZstdDecompressor().decompressobj().decompress(block)
        elif codec == "bzip2":
            import bz2

            block = bz2.decompress(block)
        elif codec == "xz":
            import lzma

            block = lzma.decompress(block)
        elif codec == "snappy":
            length = shift = 0
            for b in block:
                length |= (b & 127) << shift
                shift += 7
                if b < 128:
                    break
            block = pa.Codec("snappy").decompress(block[:-4], decompressed_size=length, asbytes=True)
        elif codec != "null":
            raise ValueError(f"unknown Avro codec {codec!r}")
        inner = _Reader(block)
        for _ in range(count):
            row = _value(inner, schema, known)
            yield row if isinstance(row, dict) else {"value": row}
        if r.take(16) != mark:
            raise ValueError("damaged Avro block")
