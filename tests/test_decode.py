import bz2
import gzip
import io
import json
import lzma
import struct
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pytest
import zstandard

from delve.sources.corpus import line_blocks
from delve.sources.decode import DecodeError, Limits, clean_member, decode, decode_requested, sniff

BODY = b"first line\nsecond line\n" * 50


def one(name, data):
    (doc,) = decode(name, data)
    return doc.content


def lz4(data):
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "lz4") as f:
        f.write(data)
    return out.getvalue().to_pybytes()


def snappy(data):
    packed = pa.compress(data, "snappy", asbytes=True)
    body = b"\0\0\0\0" + packed
    raw = b"\0\0\0\0" + data
    return b"\xff\x06\0\0sNaPpY" + b"\0" + len(body).to_bytes(3, "little") + body + b"\x01" + len(raw).to_bytes(3, "little") + raw


def tar(members):
    f = io.BytesIO()
    with tarfile.open(fileobj=f, mode="w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return f.getvalue()


def zipped(members):
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return f.getvalue()


@pytest.mark.parametrize(
    ("name", "data", "want"),
    [
        ("a.log", BODY, BODY),
        ("a.gz", gzip.compress(BODY[:500]) + gzip.compress(BODY[500:]), BODY),
        ("a.zst", zstandard.compress(BODY[:500]) + struct.pack("<II", 0x184D2A50, 3) + b"xyz" + zstandard.compress(BODY[500:]), BODY),
        ("a.bz2", bz2.compress(BODY[:500]) + bz2.compress(BODY[500:]), BODY),
        ("a.xz", lzma.compress(BODY[:500]) + b"\0" * 8 + lzma.compress(BODY[500:]), BODY),
        ("a.lz4", lz4(BODY[:500]) + lz4(BODY[500:]), BODY),
        ("a.sz", snappy(BODY), BODY + BODY),
        ("a.zz", zlib.compress(BODY), BODY),
        ("utf16", "﻿hé\n".encode("utf-16-le"), "hé\n".encode()),
        ("bom", b"\xef\xbb\xbfhi", b"hi"),
        ("empty", b"", b""),
    ],
)
def test_streams(name, data, want):
    assert one(name, data) == want


def test_brotli():
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "brotli") as f:
        f.write(BODY)
    assert one("a.br", out.getvalue().to_pybytes()) == BODY
    with pytest.raises(DecodeError):
        decode("a.br", out.getvalue().to_pybytes()[:-5] + b"zzzzz")


def test_damaged_streams_keep_the_good_part():
    cut = gzip.compress(bytes(range(256)) * 4000)[:-2000]
    assert one("a.gz", cut).startswith(bytes(range(256)))
    with pytest.raises(DecodeError):
        decode("a.gz", b"\x1f\x8b\x08garbage")
    with pytest.raises(DecodeError):
        decode("a.lz4", struct.pack("<I", 0x184C2102) + b"....")


def test_tables(tmp_path):
    import pyarrow.orc as orc
    import pyarrow.parquet as pq

    t = pa.table({"n": [1, None], "s": ["a", "é"], "x": [float("nan"), 1.5]})
    want = b'{"n":1,"s":"a","x":null}\n{"n":null,"s":"\xc3\xa9","x":1.5}\n'
    pq.write_table(t, tmp_path / "t.parquet")
    orc.write_table(t, tmp_path / "t.orc")
    for name in ("t.parquet", "t.orc"):
        assert one(name, (tmp_path / name).read_bytes()) == want
    for make in (pa.ipc.new_file, pa.ipc.new_stream):
        sink = pa.BufferOutputStream()
        with make(sink, t.schema) as w:
            w.write_table(t)
        assert one("t.arrow", sink.getvalue().to_pybytes()) == want


def test_avro():
    schema = {"type": "record", "name": "row", "fields": [{"name": "line", "type": ["null", "string"]}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "scale": 2}}]}
    long = lambda n: bytes([n << 1])
    blob = lambda b: long(len(b)) + b
    s = json.dumps(schema).encode()
    size = len(s) << 1
    coded = bytes([size & 127 | 128, size >> 7]) + s
    rows = long(1) + blob(b"hi") + blob((1234).to_bytes(2, "big")) + long(0) + blob(b"\xff")
    data = b"Obj\x01" + long(1) + blob(b"avro.schema") + coded + long(0) + b"M" * 16 + long(2) + blob(rows) + b"M" * 16
    assert one("x.avro", data) == b'{"line":"hi","d":"12.34"}\n{"line":null,"d":"-0.01"}\n'


def test_archives():
    inner = zipped([("b/c.log", b"deep")])
    data = tar([("./x.log", b"1"), ("x.log", b"2"), ("in.zip", inner), ("g.gz", gzip.compress(b"3"))])
    assert {d.display_key: d.content for d in decode("t.tar", data)} == {"t.tar!/x.log": b"1", "t.tar!/x.log#2": b"2", "t.tar!/in.zip!/b/c.log": b"deep", "t.tar!/g.gz": b"3"}
    assert [d.content for d in decode_requested("t.tar", data, ["x.log#2"])] == [b"2"]
    with pytest.raises(DecodeError):
        decode_requested("t.tar", data, ["nope"])


def test_limits():
    for bad in ("/abs", "a/../b", "", "a\0b"):
        with pytest.raises(DecodeError):
            clean_member(bad)
    assert clean_member(".\\a\\b") == "a/b"
    nested = b"x"
    for _ in range(6):
        nested = gzip.compress(nested)
    with pytest.raises(DecodeError, match="nested"):
        decode("n.gz", nested)
    with pytest.raises(DecodeError, match="members"):
        decode("z.zip", zipped([("a", b"1"), ("b", b"2")]), Limits(members=1))
    with pytest.raises(DecodeError, match="limit"):
        decode("z.gz", gzip.compress(b"x" * 100), Limits(expanded=10))
    with pytest.raises(ValueError):
        Limits(depth=0)
    assert sniff("a.br", b"BZh9notreally") == "brotli"


def test_line_blocks():
    data = b"aa\nbbbbbbbbbbbb\n\nc"
    blocks = list(line_blocks(data, 4))
    assert b"".join(b[3] for b in blocks) == data
    assert all(p.endswith(b"\n") for *_, p in blocks[:-1])
    assert [(b[1], b[2]) for b in blocks] == [(data[: b[2]].count(b"\n"), b[2]) for b in blocks]
    assert list(line_blocks(b"")) == []
