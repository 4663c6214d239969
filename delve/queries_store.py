"""More of the engine's operators as queries: formats, sources, index maintenance, sinks, and searches of a stored index."""

from __future__ import annotations

import atexit
import bz2
import io
import lzma
import struct
import tarfile
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyarrow import orc

from delve.functions.grams import document_grams
from delve.functions.patterns import compile_patterns, max_length, plan_kinds, search_extent, witnesses
from delve.operators import lines as L
from delve.operators import render
from delve.operators.candidates import candidate_blocks, gram_counts
from delve.operators.index import MERGE_BYTES, MERGE_DOCS, Index, diff_listing, pick_merge, update_index
from delve.operators.scope import Scope, candidate_prefix, parse_instant, prefix_range
from delve.operators.search import list_files, search, search_collect, search_null, search_stats
from delve.plans.gramplan import plan, simplify
from delve.queries import _DOCS, _LINES, _candidates, _docs, _hit_offsets, _postings, _t, query
from delve.operators.regions import chunked_hits, coalesce_ranges, fetch_documents, line_of_offset, whole_lines
from delve.sources.corpus import decode_corpus, document_keys, list_objects, listed, outside, scan_documents, stale, table_corpus, vanished
from delve.sources.decode import Limits, decode_requested

# ---------------------------------------------------------------- formats


def _lz4(data: bytes) -> bytes:
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "lz4") as f:
        f.write(data)
    return out.getvalue().to_pybytes()


def _brotli(data: bytes) -> bytes:
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, "brotli") as f:
        f.write(data)
    return out.getvalue().to_pybytes()


def _zstd(data: bytes) -> bytes:
    half = len(data) // 2
    return zstandard.compress(data[:half], 1) + struct.pack("<II", 0x184D2A50, 3) + b"xyz" + zstandard.compress(data[half:], 1)


def _snappy(data: bytes) -> bytes:
    out = [b"\xff\x06\0\0sNaPpY"]
    for at in range(0, len(data), 65536):
        body = b"\0\0\0\0" + pa.compress(data[at : at + 65536], "snappy", asbytes=True)
        out.append(b"\0" + len(body).to_bytes(3, "little") + body)
    return b"".join(out)


def _tar(data: bytes) -> bytes:
    f = io.BytesIO()
    with tarfile.open(fileobj=f, mode="w") as t:
        info = tarfile.TarInfo("in/text")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    return f.getvalue()


def _zip(data: bytes) -> bytes:
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("text", data)
    return f.getvalue()


def _utf16(data: bytes) -> bytes:
    return b"\xff\xfe" + data.decode().encode("utf-16-le")


def _nested(data: bytes) -> bytes:
    f = io.BytesIO()
    inner = bz2.compress(_zip(data), 1)
    with tarfile.open(fileobj=f, mode="w") as t:
        info = tarfile.TarInfo("deep.bin")
        info.size = len(inner)
        t.addfile(info, io.BytesIO(inner))
    return f.getvalue()


def _one_row(data: bytes) -> pa.Table:
    return pa.table({"text": [data.decode()], "none": pa.array([None], pa.string())})


def _parquet(data: bytes) -> bytes:
    f = io.BytesIO()
    pq.write_table(_one_row(data), f)
    return f.getvalue()


def _orc(data: bytes) -> bytes:
    f = io.BytesIO()
    orc.write_table(_one_row(data), f)
    return f.getvalue()


def _arrow(stream: bool) -> Callable[[bytes], bytes]:
    def write(data: bytes) -> bytes:
        f = io.BytesIO()
        table = _one_row(data)
        with (pa.ipc.new_stream if stream else pa.ipc.new_file)(f, table.schema) as w:
            w.write_table(table)
        return f.getvalue()

    return write


def _zigzag(n: int) -> bytes:
    n, out = n << 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _avro(data: bytes) -> bytes:
    blob = lambda b: _zigzag(len(b)) + b
    schema = b'{"type":"record","name":"row","fields":[{"name":"text","type":"string"},{"name":"none","type":["null","string"]}]}'
    row = blob(data) + _zigzag(0)
    return b"Obj\x01" + _zigzag(1) + blob(b"avro.schema") + blob(schema) + _zigzag(0) + b"M" * 16 + _zigzag(1) + _zigzag(len(row)) + row + b"M" * 16


def _objects(table: DataFrame, key: Column, text: Column, suffix: str, make: Callable[[bytes], bytes]) -> DataFrame:
    """A corpus with an object in some format for each row."""

    @F.pandas_udf(BinaryType())
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([make((t or "").encode()) for t in texts], dtype=object)

    rows = table.select(F.concat(key, F.lit(suffix)).alias("key"), packed(F.coalesce(text, F.lit(""))).alias("content"))
    return rows.select("key", F.sha2("content", 256).alias("version"), F.octet_length("content").cast("long").alias("encoded_size"), "content")


def _read_back(name: str, suffix: str, make: Callable[[bytes], bytes], member: str = "", body: str = "text") -> None:
    """A query that packs every document, decodes the objects and gives size and digest of each document."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = _t(spark, sf, "documents")
        rows = scan_documents(_objects(d, document_keys(d), d["text"], suffix, make))
        return rows.select("key", F.octet_length("bytes").cast("long").alias("n"), F.sha2("bytes", 256).alias("sha"))

    query(name, f"WITH {_DOCS} SELECT key || '{suffix}{member}' AS key, strlen({body})::BIGINT AS n, sha256({body}) AS sha FROM docs")(run)


_ROW = """('{"text":' || CAST(to_json(text) AS VARCHAR) || ',"none":null}' || chr(10))"""
_read_back("fmt01_raw", "", lambda b: b)
_read_back("fmt03_zstd", ".zst", _zstd)
_read_back("fmt04_bzip2", ".bz2", lambda b: bz2.compress(b[: len(b) // 2], 1) + bz2.compress(b[len(b) // 2 :], 1))
_read_back("fmt05_xz", ".xz", lambda b: lzma.compress(b[: len(b) // 2], preset=0) + b"\0" * 8 + lzma.compress(b[len(b) // 2 :], preset=0))
_read_back("fmt06_snappy", ".sz", _snappy)
_read_back("fmt07_lz4", ".lz4", lambda b: _lz4(b[: len(b) // 2]) + _lz4(b[len(b) // 2 :]))
_read_back("fmt09_brotli", ".br", _brotli)
_read_back("fmt10_zlib", ".zz", zlib.compress)
_read_back("fmt11_parquet", ".parquet", _parquet, body=_ROW)
_read_back("fmt12_avro", ".avro", _avro, body=_ROW)
_read_back("fmt13_arrow_file", ".arrow", _arrow(False), body=_ROW)
_read_back("fmt14_arrow_stream", ".arrows", _arrow(True), body=_ROW)
_read_back("fmt15_orc", ".orc", _orc, body=_ROW)
_read_back("fmt17_tar", ".tar", _tar, "!/in/text")
_read_back("fmt18_nested", ".tar", _nested, "!/deep.bin!/text")
_read_back("fmt19_utf16", "", _utf16)


def _failures(name: str, make: Callable[[bytes], bytes], suffix: str, limits: Limits | None, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = _t(spark, sf, "documents")
        rows = decode_corpus(_objects(d, document_keys(d), d["text"], suffix, make), limits)
        per = rows.groupBy("source_key").agg(F.max("failed").alias("failed"), F.count("display_key").alias("documents"))
        return per.select(F.col("source_key").alias("key"), "failed", "documents")

    query(name, f"WITH {_DOCS} SELECT key || '{suffix}' AS key, {sql} AS failed, CASE WHEN {sql} THEN 0 ELSE 1 END AS documents FROM docs")(run)


_failures("fmt08_lz4_legacy", lambda b: bytes.fromhex("02214c18") + b, ".lz4", None, "true")
_failures("fmt20_failures", lambda b: b"\x1f\x8b\x08" + b"\xff" * 20 if len(b) % 2 else b, "", None, "strlen(text) % 2 = 1")
_failures("fmt21_limits", zlib.compress, ".zz", Limits(expanded=4096), "strlen(text) > 4096")

# ---------------------------------------------------------------- sources


@query("src01_list")
def src01(spark, sf):
    return list_objects(spark, sf).select("key", "encoded_size")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = _t(spark, sf, "documents")
    return table_corpus(d, document_keys(d), d["text"])


@query("src03_listing_subset", f"WITH {_DOCS} SELECT key, sha256(text) AS version, strlen(text)::BIGINT AS encoded_size FROM docs WHERE doc_id % 5 = 0")
def src03(spark, sf):
    d = _t(spark, sf, "documents")
    return listed(_corpus(spark, sf), d.where("doc_id % 5 = 0").select(document_keys(d).alias("key"))).drop("content")


@query("src04_vanished", f"WITH {_DOCS} SELECT key FROM docs WHERE doc_id % 9 = 4")
def src04(spark, sf):
    d = _t(spark, sf, "documents")
    left = d.where("doc_id % 9 <> 4")
    return vanished(d.select(document_keys(d).alias("key")), table_corpus(left, document_keys(left), left["text"]))


@query("src06_stale", f"WITH {_DOCS} SELECT key FROM docs WHERE doc_id % 11 = 5")
def src06(spark, sf):
    d = _t(spark, sf, "documents")
    now = table_corpus(d, document_keys(d), F.when(d["doc_id"] % 11 == 5, F.concat(F.coalesce(d["text"], F.lit("")), F.lit("!"))).otherwise(d["text"]))
    return stale(_corpus(spark, sf), now)


@query("src09_fetch_members", "SELECT 'conv/' || conv_id || '.zip!/' || turn || '-' || role || '.txt' AS key, sha256(coalesce(text, '')) AS sha FROM conversations WHERE turn % 2 = 1")
def src09(spark, sf):
    """Every second turn out of archives that hold a conversation each: an object is decoded once, whatever is asked of it."""
    schema = "key string, content binary"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for turn, role, text in zip(rows["turn"], rows["role"], rows["text"], strict=True):
                z.writestr(f"{turn}-{role}.txt", text or "")
        return pd.DataFrame({"key": [f"conv/{rows['conv_id'].iloc[0]}.zip"], "content": [f.getvalue()]})

    turns = _t(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    packed = turns.groupBy("conv_id").applyInPandas(pack, schema)  # an archive holds one conversation
    corpus = packed.select("key", F.lit("1").alias("version"), F.octet_length("content").cast("long").alias("encoded_size"), "content")
    name = F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".zip"))
    wanted = turns.where("turn % 2 = 1").select(name.alias("source_key"), F.lit("1").alias("version"), F.concat(name, F.lit("!/"), F.col("turn").cast("string"), F.lit("-"), "role", F.lit(".txt")).alias("key"))
    return fetch_documents(corpus, wanted).select("key", F.sha2("bytes", 256).alias("sha"))


@query("src08_requested_member", "SELECT conv_id, turn, sha256(coalesce(text, '')) AS sha FROM conversations")
def src08(spark, sf):
    @F.pandas_udf("binary")
    def member(texts: pd.Series) -> pd.Series:
        return pd.Series([decode_requested("a.tar", _tar((t or "").encode()), ["in/text"])[0].content for t in texts], dtype=object)

    return _t(spark, sf, "conversations").select("conv_id", "turn", F.sha2(member("text"), 256).alias("sha"))


# ---------------------------------------------------------------- scope and patterns


@query("flt03_candidate_prefix", f"WITH {_DOCS} SELECT key FROM docs WHERE starts_with(key, 'docs/src1/fr')")
def flt03(spark, sf):
    return _docs(spark, sf).where(prefix_range(F.col("key"), candidate_prefix("docs", "docs/src1/fr"))).select("key")


@query("flt08_instants", "SELECT * FROM (VALUES ('2024-02-28', '2024-02-28 00:00:00', '2024-02-29 00:00:00'), ('2024-02-28T10:30', '2024-02-28 10:30:00', '2024-02-28 10:31:00'), ('2024-02-28 10:30:59Z', '2024-02-28 10:30:59', '2024-02-28 10:31:00'), ('3d', '2024-03-12 12:00:00', '2024-03-12 12:00:00')) v(word, since, until)")
def flt08(spark, sf):
    now = datetime(2024, 3, 15, 12, tzinfo=timezone.utc)
    words = ("2024-02-28", "2024-02-28T10:30", "2024-02-28 10:30:59Z", "3d")
    rows = [(w, *(parse_instant(w, now, u).strftime("%Y-%m-%d %H:%M:%S") for u in (False, True))) for w in words]
    return spark.createDataFrame(rows, "word string, since string, until string")


@query("flt11_index_namespace", f"WITH {_DOCS} SELECT key FROM docs WHERE NOT starts_with(key, 'docs/src0/')")
def flt11(spark, sf):
    return outside(_corpus(spark, sf), "docs/src0/").select("key")


@query("flt12_matching_documents", f"WITH {_LINES} SELECT DISTINCT key FROM lines WHERE regexp_matches(text, '[a-z]tion[.]$')")
def flt12(spark, sf):
    return L.document_hits(_docs(spark, sf), compile_patterns(["[a-z]tion[.]$"])).select("key")


#: Patterns whose plans are shown, with their bound in bytes (-1: none).
SHAPES = ("abc", "a{2,5}", "x.*y", r"\Aabc", "colou?r")


@query("pat09_plan_kinds", "SELECT * FROM (VALUES ('abc', 3::BIGINT, 'bytes', 1), ('a{2,5}', 5, 'bytes', 1), ('x.*y', -1, 'lines', 0), ('\\Aabc', -1, 'document', 0), ('colou?r', 6, 'bytes', 1)) v(pattern, bound, extent, exact)")
def pat09(spark, sf):
    rows = []
    for p in SHAPES:
        program = compile_patterns([p])
        rows.append((p, max_length(program.trees[0]) or -1, search_extent(program.trees[0])[0], plan_kinds(program)["exact"]))
    return spark.createDataFrame(rows, "pattern string, bound long, extent string, exact int")


#: Patterns whose proofs are shown.
PROOFS = ("foo.*", ".*token", "foo.*bar", "é.*", "(ab|cd)+x*", "a+b", "x*", r"^ab.*")


@query("pat11_witness_proofs", "SELECT * FROM (VALUES ('foo.*', 3::BIGINT, 'forward'), ('.*token', 5, 'reverse'), ('foo.*bar', -1, 'none'), ('é.*', 2, 'forward'), ('(ab|cd)+x*', 2, 'forward'), ('a+b', 2, 'reverse'), ('x*', -1, 'none'), ('^ab.*', -1, 'none')) v(pattern, bytes, direction)")
def pat11(spark, sf):
    found = [(p, witnesses(compile_patterns([p]))[0]) for p in PROOFS]
    return spark.createDataFrame([(p, w.bytes if w else -1, ("forward" if w.forward else "reverse") if w else "none") for p, w in found], "pattern string, bytes long, direction string")


def _witnessed(spark, sf, pattern: str) -> DataFrame:
    program = compile_patterns([pattern])
    found = L.witness_spans(L.matching_lines(_docs(spark, sf), program, spans=True), program)
    return found.select("key", "line", F.col("witness_start").alias("start"), F.col("witness_end").alias("end"))


@query("pat12_witness_ahead", f"WITH {_LINES} SELECT key, line, strlen(string_split(text, 'Licensed')[1])::BIGINT AS start, (strlen(string_split(text, 'Licensed')[1]) + 8)::BIGINT AS \"end\" FROM lines WHERE contains(text, 'Licensed')")
def pat12_ahead(spark, sf):
    return _witnessed(spark, sf, "Licensed.*")


@query("pat12_witness_behind", f"WITH {_LINES}, t AS (SELECT key, line, strlen(text) - strlen(string_split(text, 'tion')[-1]) AS e FROM lines WHERE contains(text, 'tion')) SELECT key, line, (e - 4)::BIGINT AS start, e::BIGINT AS \"end\" FROM t")
def pat12_behind(spark, sf):
    return _witnessed(spark, sf, ".*tion")


@query("pat13_find_iter", f"WITH {_DOCS} SELECT key, len(regexp_extract_all(text, '[a-z]ing'))::BIGINT AS n FROM docs")
def pat13(spark, sf):
    return _docs(spark, sf).select("key", F.size(L.submatches(F.col("text"), compile_patterns(["[a-z]ing"]))).cast("long").alias("n"))


# ---------------------------------------------------------------- grams and candidates


@query("idx04_covering_grams")
def idx04(spark, sf):
    return document_grams(_docs(spark, sf), covering=True).select("doc_id", F.hex("gram").alias("gram"))


@query("idx12_and_pruning", f"WITH {_LINES} SELECT key, line, text FROM lines WHERE contains(text, 'Licensed under')")
def idx12(spark, sf):
    docs = _docs(spark, sf)
    postings, program = _postings(docs), compile_patterns(["Licensed under"])
    queries = plan(program)
    counts = gram_counts(postings, set().union(*(q.grams() for q in queries)))
    few = [simplify(q, counts, 1 << 20, keep=2) for q in queries]  # the two rarest grams alone
    chosen = candidate_blocks(postings, docs.select("doc_id", F.lit(0).alias("block")), few)
    return L.matching_lines(docs.join(chosen, "doc_id", "left_semi"), program)


@query("idx19_candidate_documents", f"WITH {_DOCS} SELECT key FROM docs WHERE contains(text, 'unde') OR (contains(text, 'und') AND contains(text, 'nde'))")
def idx19(spark, sf):
    docs = _docs(spark, sf)
    return docs.join(_candidates(docs, compile_patterns(["unde"])).select("doc_id").distinct(), "doc_id", "left_semi").select("key")


# ---------------------------------------------------------------- lines


@query("mat01_line_counts", f"WITH {_LINES} SELECT key, count(*) AS n FROM lines GROUP BY key")
def mat01(spark, sf):
    return L.plain_lines(_docs(spark, sf)).groupBy("key").agg(F.count("*").alias("n"))


@query("mat12_capped_lines", f"WITH {_LINES} SELECT key, line FROM (SELECT key, line, row_number() OVER (PARTITION BY key ORDER BY line) AS k FROM lines WHERE contains(text, 'tion')) WHERE k <= 2")
def mat12(spark, sf):
    found = L.matching_lines(_docs(spark, sf), compile_patterns(["tion"])).select("key", "line")
    return L.first_lines(found.unionByName(found), 2)  # regions may overlap


@query("mat14_full_lines", f"WITH {_LINES} SELECT key, line, text FROM lines WHERE contains(text, 'Licensed')")
def mat14(spark, sf):
    docs, program = _docs(spark, sf), compile_patterns(["Licensed"])
    return L.verified_lines(docs, L.plain_lines(docs).where("line % 2 = 0 or contains(text, 'Licensed')"), program)


@query("mat15_chunked_match", f"WITH {_LINES} SELECT DISTINCT key FROM lines WHERE regexp_matches(text, '[a-z]{{4}}ing [a-z]{{2}} the')")
def mat15(spark, sf):
    return chunked_hits(_docs(spark, sf), compile_patterns(["[a-z]{4}ing [a-z]{2} the"]), size=4096)


_PLACES = "o AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place, max(line) OVER (PARTITION BY key) AS n FROM lines)"


@query("mat16_whole_lines", f"""WITH {_LINES}, {_PLACES}, h AS (
  SELECT key, line, n, place + strlen(string_split(text, 'Licensed')[1]) AS s FROM o WHERE contains(text, 'Licensed')),
r AS (SELECT key, s, greatest(1, line - 1) AS a, least(n, line + 2) AS b FROM h)
SELECT r.key, s::BIGINT AS start, min(o.place)::BIGINT AS from_byte, least(max(o.place + strlen(o.text) + 1), max(strlen(d.text)))::BIGINT AS to_byte, a::BIGINT AS from_line, b::BIGINT AS to_line
FROM r JOIN o ON r.key = o.key AND o.line BETWEEN a AND b JOIN docs d ON d.key = r.key GROUP BY r.key, s, a, b""")
def mat16(spark, sf):
    blocks = decode_corpus(_corpus(spark, sf), block=1024).where("display_key is not null").select(F.col("display_key").alias("key"), "first_line", "start", "newlines", "bytes")
    hits = L.matching_lines(_docs(spark, sf), compile_patterns(["Licensed"]), spans=True, offsets=True)
    first = F.col("offset") + F.get("submatches", F.lit(0))["start"]
    ranges = hits.select("key", first.alias("start"), (first + 8).alias("end"))
    return whole_lines(blocks, ranges, 1, 2).select("key", "start", "from_byte", "to_byte", "from_line", "to_line")


@query("mat18_coalesced_ranges", f"""WITH {_DOCS}, w AS (SELECT key, strlen(text)::BIGINT AS size, string_split(text, 'tion') AS p FROM docs WHERE contains(text, 'tion')),
e AS (SELECT key, size, unnest(range(1, len(p))) AS k, p FROM w),
h AS (SELECT key, size, (list_sum(list_transform(p[1:k], lambda x: strlen(x))) + 4 * (k - 1))::BIGINT AS s FROM e),
m AS (SELECT *, coalesce(s > max(s + 4) OVER (PARTITION BY key ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 64, true)::INT AS new FROM h),
g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m),
c AS (SELECT key, size, run, min(s) AS s, max(s) + 4 AS t FROM g GROUP BY key, size, run),
t AS (SELECT key, size, count(*) > 20 OR sum(t - s) >= 0.5 * size AS whole FROM c GROUP BY key, size)
SELECT c.key, c.s::BIGINT AS start, c.t::BIGINT AS "end" FROM c JOIN t ON c.key = t.key WHERE NOT whole UNION ALL SELECT key, 0, size FROM t WHERE whole""")
def mat18(spark, sf):
    docs = _docs(spark, sf)
    hits = _hit_offsets(docs, "tion").select("key", F.col("offset").alias("start"), (F.col("offset") + 4).alias("end"))
    return coalesce_ranges(hits, docs.select("key", F.octet_length("text").cast("long").alias("size")), gap=64, most=20, key="key")


@query("mat17_line_of_offset", f"WITH {_DOCS} SELECT key, strlen(string_split(text, 'Licensed')[1])::BIGINT AS \"offset\", (len(string_split(string_split(text, 'Licensed')[1], chr(10))))::BIGINT AS line FROM docs WHERE contains(text, 'Licensed')")
def mat17(spark, sf):
    hits = _hit_offsets(_docs(spark, sf), "Licensed").select("key", "offset")
    blocks = decode_corpus(_corpus(spark, sf), block=1024).where("display_key is not null").select(F.col("display_key").alias("key"), "first_line", "start", "bytes")
    return line_of_offset(blocks, hits)


# ---------------------------------------------------------------- a stored index

_made: list[tuple[SparkSession, str]] = []


def _fresh(spark: SparkSession) -> str:
    """A new folder that all executors share, deleted when the interpreter ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{root.rstrip('/')}/delve-index-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _drop_all() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            pass


atexit.register(_drop_all)


def _indexed(spark: SparkSession, sf: str, strategy: str = "trigram") -> Index:
    root = _fresh(spark)
    update_index(spark, root, _corpus(spark, sf), strategy=strategy)
    return Index(spark, root)


def _churned(spark: SparkSession, sf: str, max_segments: int = 8) -> Index:
    """An index of documents that were added in two parts; then some went away and some changed."""
    root, d = _fresh(spark), _t(spark, sf, "documents")
    part = lambda rows, text: table_corpus(rows, document_keys(rows), text(rows))
    plain = lambda rows: rows["text"]
    first, both = d.where("doc_id % 2 = 0"), d
    update_index(spark, root, part(first, plain), strategy="trigram", max_segments=max_segments)
    update_index(spark, root, part(both, plain), max_segments=max_segments)
    changed = lambda rows: F.when(rows["doc_id"] % 10 == 3, F.concat(F.lit("CHANGED\n"), F.coalesce(rows["text"], F.lit("")))).otherwise(rows["text"])
    update_index(spark, root, part(d.where("doc_id % 10 <> 7"), changed), max_segments=max_segments)
    return Index(spark, root)


_EVENTS = f"WITH {_LINES}, o AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY key ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM lines) SELECT key, line, place AS \"offset\", text FROM o WHERE "


@query("e2e_search_trigram", _EVENTS + "contains(text, 'Licensed')")
def e2e_trigram(spark, sf):
    return search(_indexed(spark, sf), compile_patterns(["Licensed"])).select("key", "line", "offset", "text")


@query("e2e_search_sparse", _EVENTS + "contains(text, 'Licensed under')")
def e2e_sparse(spark, sf):
    return search(_indexed(spark, sf, "sparse"), compile_patterns(["Licensed under"])).select("key", "line", "offset", "text")


@query("e2e_search_scoped", f"WITH {_LINES} SELECT key, count(*) AS n FROM lines WHERE starts_with(key, 'docs/src1/') AND regexp_matches(text, '[a-z]tion') GROUP BY key")
def e2e_scoped(spark, sf):
    return search(_indexed(spark, sf), compile_patterns(["[a-z]tion"]), Scope(target="docs", key_prefix="docs/src1/"), "count_lines")


def _e2e(name: str, pattern: str, where: str) -> None:
    program = compile_patterns([pattern])
    query(name, f"WITH {_LINES} SELECT key, line, text FROM lines WHERE {where}")(lambda spark, sf: search(_indexed(spark, sf), program).select("key", "line", "text"))


_e2e("e2e_inline_flag", "(?i)LICENSED", "regexp_matches(text, '[Ll][Ii][Cc][Ee][Nn][Ss][Ee][Dd]')")
_e2e("e2e_flag_of_a_group", "(?i:LICENSED) under", "regexp_matches(text, '[Ll][Ii][Cc][Ee][Nn][Ss][Ee][Dd] under')")
_e2e("e2e_property", r"^\p{Lu}\p{Ll}{15,}[^\p{L}]", r"regexp_matches(text, '^\p{Lu}\p{Ll}{15,}[^\p{L}]')")
_e2e("e2e_posix_class", "[[:upper:]][[:lower:]]{7} [[:lower:]]+ [[:upper:]]{2}", "regexp_matches(text, '[[:upper:]][[:lower:]]{7} [[:lower:]]+ [[:upper:]]{2}')")
_e2e("e2e_code_point", r"\x{4C}icense[d]", "contains(text, 'Licensed')")


@query("flt09_live_docs", f"WITH {_DOCS} SELECT key FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flt09(spark, sf):
    """Documents of an index after those with a toxic label left the corpus: the rest are live."""
    root, d = _fresh(spark), _t(spark, sf, "documents")
    update_index(spark, root, _corpus(spark, sf), strategy="trigram")
    left = d.join(_t(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    update_index(spark, root, table_corpus(left, document_keys(left), left["text"]))
    return Index(spark, root).table("docs").select(F.col("display_key").alias("key"))


@query("mat19_search_stats", f"WITH {_DOCS} SELECT sum((contains(text, 'Lic') AND contains(text, 'ice') AND contains(text, 'cen') AND contains(text, 'ens') AND contains(text, 'nse') AND contains(text, 'sed'))::INT)::BIGINT AS candidates, count(*) AS total, sum(contains(text, 'Licensed')::INT)::BIGINT AS hits FROM docs")
def mat19(spark, sf):
    stats = search_stats(_indexed(spark, sf), compile_patterns(["Licensed"]))
    return spark.createDataFrame([(stats["candidates"], stats["total"], stats["hits"])], "candidates long, total long, hits long")


_CHURN = """WITH docs AS (
  SELECT 'docs/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS key,
         CASE WHEN doc_id % 10 = 3 THEN 'CHANGED' || chr(10) ELSE '' END || coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 7)"""


@query("e2e_search_after_updates", f"{_CHURN} SELECT key FROM docs WHERE contains(text, 'CHANGED') OR contains(text, 'Licensed')")
def e2e_updates(spark, sf):
    return search(_churned(spark, sf), compile_patterns(["CHANGED", "Licensed"]), detail="documents")


@query("upd07_merged_segments", f"{_CHURN} SELECT key FROM docs WHERE contains(text, 'CHANGED') OR contains(text, 'Licensed')")
def upd07(spark, sf):
    return search(_churned(spark, sf, max_segments=1), compile_patterns(["CHANGED", "Licensed"]), detail="documents")


@query("snk10_files", f"{_CHURN} SELECT key FROM docs")
def snk10(spark, sf):
    return list_files(_churned(spark, sf))


@query("upd03_tombstones", "SELECT 'k' || doc_id AS source_key FROM documents WHERE doc_id % 10 IN (1, 2)")
def upd03(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"))
    kind = F.col("doc_id") % 10
    live = d.select("key", F.lit("1").alias("version"), F.lit(False).alias("retry"))
    listing = d.where(kind != 1).select("key", F.when(kind == 2, "2").otherwise("1").alias("version"))
    return diff_listing(listing, live).where("action <> 'add'").select(F.col("key").alias("source_key"))


@query("upd06_merge_choice", f"""WITH s AS (SELECT source, count(*) AS docs, sum(n_chars) AS bytes, row_number() OVER (ORDER BY source) - 1 AS k FROM documents WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT k, bytes + lead(bytes) OVER (ORDER BY k) AS pair_bytes, docs + lead(docs) OVER (ORDER BY k) AS n FROM s)
SELECT k::BIGINT AS one, (k + 1)::BIGINT AS two FROM p WHERE pair_bytes <= {MERGE_BYTES} AND n <= {MERGE_DOCS} ORDER BY pair_bytes, k LIMIT 1""")
def upd06(spark, sf):
    sums = _t(spark, sf, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("bytes")).orderBy("source")
    pair = pick_merge([r.asDict() for r in sums.collect()], 1)  # a row a segment
    return spark.createDataFrame([pair] if pair else [], "one long, two long")


@query("upd12_no_change", "SELECT 0 AS added, 0 AS removed, count(*) AS total_docs, true AS up_to_date FROM documents")
def upd12(spark, sf):
    root = _fresh(spark)
    update_index(spark, root, _corpus(spark, sf), strategy="trigram")
    report = update_index(spark, root, _corpus(spark, sf))
    return spark.createDataFrame([tuple(report[k] for k in ("added", "removed", "total_docs", "up_to_date"))], "added long, removed long, total_docs long, up_to_date boolean")


# ---------------------------------------------------------------- sinks


@query("snk04_paths", f"WITH {_LINES} SELECT DISTINCT key AS value FROM lines WHERE contains(text, 'token')")
def snk04(spark, sf):
    return L.document_hits(_docs(spark, sf), compile_patterns(["token"])).select(F.col("key").alias("value"))


@query("snk06_quiet", f"WITH {_DOCS} SELECT CASE WHEN count(*) > 0 THEN 0 ELSE 1 END AS code FROM docs WHERE contains(text, 'Licensed')")
def snk06(spark, sf):
    found = not L.document_hits(_docs(spark, sf), compile_patterns(["Licensed"])).limit(1).isEmpty()
    return spark.createDataFrame([(render.exit_code(found, False),)], "code int")


@query("snk08_windows")
def snk08(spark, sf):
    clips = L.match_windows(L.matching_lines(_docs(spark, sf), compile_patterns(["Licensed"]), spans=True), 40)
    mark = lambda c: F.when(F.col(c), "…").otherwise("")
    return clips.select(F.concat("key", F.lit(":"), F.col("line").cast("string"), F.lit(":"), mark("clipped_left"), F.decode("excerpt", "UTF-8"), mark("clipped_right")).alias("value"))


@query("snk11_stats", f"""WITH {_DOCS}, c AS (SELECT text, contains(text, 'Lic') AND contains(text, 'ice') AND contains(text, 'cen') AND contains(text, 'ens') AND contains(text, 'nse') AND contains(text, 'sed') AS c FROM docs)
SELECT format('{{:,}} hits, {{:,}} candidates of {{:,}} documents, {{:.1f}} MiB verified, 0 excluded', sum(contains(text, 'Licensed')::INT)::BIGINT, sum(c::INT)::BIGINT, count(*), sum(CASE WHEN c THEN strlen(text) ELSE 0 END) / 1048576.0) AS line FROM c""")
def snk11(spark, sf):
    return spark.createDataFrame([(render.stats_line(search_stats(_indexed(spark, sf), compile_patterns(["Licensed"]))),)], "line string")


# ---------------------------------------------------------------- corpora and figures


@query("aux12_percentiles", "SELECT source, max(n) FILTER (WHERE k = ceil(0.5 * c)) AS p50, max(n) FILTER (WHERE k = ceil(0.95 * c)) AS p95 FROM (SELECT source, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY source) AS c FROM documents) GROUP BY source")
def aux12(spark, sf):
    exact = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars)").cast("long")  # noqa: E731  nearest rank
    return _t(spark, sf, "documents").groupBy("source").agg(exact(0.5).alias("p50"), exact(0.95).alias("p95"))


#: A planted token is in each document whose number its step divides.
PLANTED = ((2, "needle"), (3, "longliteralbenchmarktoken"), (5, "alpha"), (7, "beta"), (11, "ANCHOR_START"))


def planted_corpus(spark: SparkSession, n: int, size: int = 4096) -> DataFrame:
    """(key, text): ``n`` documents of hexadecimal lines, with the planted tokens on lines of their own."""
    filler = F.repeat(F.md5(F.col("id").cast("string")), size // 32)
    lines = F.array_join(F.regexp_extract_all(filler, F.lit(".{1,80}"), F.lit(0)), "\n")
    tokens = F.concat(*(F.when(F.col("id") % step == 0, f"{token}\n").otherwise("") for step, token in PLANTED))
    return spark.range(n).select(F.format_string("doc-%08d.log", "id").alias("key"), F.concat(tokens, lines).alias("text"))


@query("aux13_planted_corpus", "SELECT * FROM (VALUES ('needle', 1250::BIGINT), ('longliteralbenchmarktoken', 834), ('alpha', 500), ('beta', 358), ('ANCHOR_START', 228)) v(token, n)")
def aux13(spark, sf):
    docs = planted_corpus(spark, 2500)
    program = compile_patterns([token for _, token in PLANTED])
    names = F.array(*(F.lit(token) for _, token in PLANTED))
    found = L.pattern_ids(L.matching_lines(docs, program), program).select("key", "pattern").distinct()
    return found.groupBy("pattern").agg(F.count("*").alias("n")).select(F.element_at(names, F.col("pattern") + 1).alias("token"), "n")


def zipf_corpus(spark: SparkSession, n: int, words: int = 200, vocabulary: int = 10_000) -> DataFrame:
    """(key, text): ``n`` documents of words whose k-th most frequent is about k times as rare as the first."""

    def word(doc: Column, k: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat_ws(":", doc.cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
        return F.concat(F.lit("w"), F.floor(F.pow(F.lit(float(vocabulary)), u)).cast("string"))

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: word(F.col("id"), k)), " ")
    return spark.range(n).select(F.format_string("prose-%08d.txt", "id").alias("key"), text.alias("text"))


@query("aux13_zipf_corpus", "SELECT 'w' || floor(pow(10000.0, ('0x' || substr(md5(d || ':' || k), 1, 8))::BIGINT / 4294967296.0))::BIGINT AS word, count(*) AS n FROM range(500) a(d), range(1, 201) b(k) GROUP BY word")
def aux13_zipf(spark, sf):
    return zipf_corpus(spark, 500).select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("snk09_collected", f"WITH {_LINES} SELECT count(*) AS lines, (SELECT count(DISTINCT key) FROM lines WHERE contains(text, 'Licensed')) AS hits, (SELECT count(DISTINCT key) FROM lines WHERE contains(text, 'Licensed')) AS counted FROM lines WHERE contains(text, 'Licensed')")
def snk09(spark, sf):
    index, program = _indexed(spark, sf), compile_patterns(["Licensed"])
    rows, stats = search_collect(index, program)
    return spark.createDataFrame([(len(rows), stats["hits"], search_null(index, program))], "lines long, hits long, counted long")


@query("snk13_progress", "SELECT * FROM (VALUES ('listed', 1::BIGINT), ('segment', 1), ('published', 1)) v(event, n)")
def snk13(spark, sf):
    events: list[dict] = []
    update_index(spark, _fresh(spark), _corpus(spark, sf), strategy="trigram", progress=events.append)
    return spark.createDataFrame([(e["event"],) for e in events], "event string").groupBy("event").agg(F.count("*").alias("n"))


@query("upd08_bounded_build", "SELECT count(*) AS documents, true AS within FROM documents")
def upd08(spark, sf):
    """An addition of more documents than a segment may have: several segments, each within the cap, all documents in them."""
    root, cap = _fresh(spark), 1 + _t(spark, sf, "documents").count() // 3
    update_index(spark, root, _corpus(spark, sf), strategy="trigram", doc_cap=cap)
    index = Index(spark, root)
    sizes = index.table("docs").groupBy("seg").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("documents"), ((F.max("n") <= cap) & (F.count("*") > 1)).alias("within"))


def churn(spark: SparkSession, root: str, texts: DataFrame, cycles: int, share: int = 100) -> list[dict]:
    """Reports of update cycles, with their seconds; each deletes one document (key, text) in ``share`` and adds as many. For benchmarks."""
    out = []
    numbered = texts.withColumn("nth", F.pmod(F.xxhash64("key"), F.lit(share)))
    for cycle in range(cycles):
        gone = F.col("nth") == cycle % share
        rows = numbered.select(F.when(gone, F.concat("key", F.lit(f".{cycle}"))).otherwise(F.col("key")).alias("key"), "text")
        corpus = rows.select("key", F.sha2("text", 256).alias("version"), F.octet_length("text").cast("long").alias("encoded_size"), F.col("text").cast("binary").alias("content"))
        start = time.perf_counter()
        out.append({**update_index(spark, root, corpus, strategy="trigram"), "seconds": time.perf_counter() - start})
    return out
