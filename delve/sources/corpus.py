"""Corpora: stored objects as rows (key, version, encoded_size, content), and their documents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decode import DecodeError, Limits, decode, sniff

#: Fixed value: bytes of a content block; blocks end at line ends.
BLOCK = 128 << 10


class StaleSource(RuntimeError):
    """An object changed between listing and reading."""


def list_objects(spark: SparkSession, root: str, prefix: str = "", exclude: str | None = None) -> DataFrame:
    """(key, version, encoded_size) below ``root``; contents are not read. ``prefix`` names a folder or a key. Symbolic links are skipped."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    key = relative_key(F.col("path"), root)
    out = without_links(files.select(key.alias("key"), _listed_version().alias("version"), F.col("length").alias("encoded_size")), root)
    if prefix:
        folder = prefix if prefix.endswith("/") else f"{prefix}/"
        out = out.where((F.col("key") == prefix) | F.col("key").startswith(folder))
    return outside(out, exclude) if exclude else out


def _listed_version() -> Column:
    """The version that a listing gives a file: when it was written, and its length."""
    return F.concat_ws("-", F.col("modificationTime").cast("double").cast("decimal(20,3)").cast("string"), F.col("length").cast("string"))


def without_links(rows: DataFrame, root: str) -> DataFrame:
    """Objects that are no symbolic links, nor below one; only folders of the machine itself have any."""
    scheme, mark, path = root.partition("://")
    if mark and scheme != "file":
        return rows
    folder, links = Path(path if mark else root.removeprefix("file:")), []
    for top, folders, files in os.walk(folder):
        links += [str(Path(top, name).relative_to(folder)) for name in (*folders, *files) if Path(top, name).is_symlink()]
    for link in links:
        rows = rows.where((F.col("key") != link) & ~F.col("key").startswith(f"{link}/"))
    return rows


def outside(rows: DataFrame, namespace: str) -> DataFrame:
    """Objects whose keys do not lie in ``namespace``, where an index keeps its own."""
    return rows.where(~F.col("key").startswith(namespace))


def listed(corpus: DataFrame, listing: DataFrame) -> DataFrame:
    """The objects that the listing names."""
    return corpus.join(listing.select("key"), "key", "left_semi")


def vanished(listing: DataFrame, corpus: DataFrame) -> DataFrame:
    """Listed objects that are gone."""
    return listing.join(corpus.select("key"), "key", "left_anti")


def stale(listing: DataFrame, corpus: DataFrame) -> DataFrame:
    """(key) of objects whose version is no longer the listed one."""
    old = listing.select("key", F.col("version").alias("listed"))
    return corpus.join(old, "key").where(F.col("version") != F.col("listed")).select("key")


def relative_key(path: Column, root: str) -> Column:
    """The part of a path URI after the root, whatever scheme either is written with."""
    bare = root.split("://", 1)[-1].removeprefix("file:")
    return F.substring(path, F.locate(bare, path) + len(bare) + 1, F.length(path))


def read_corpus(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """(key, version, encoded_size, content) below ``root``; with ``listing``, only the keys it names.

    The version is the SHA-256 of the content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/"))
    rows = without_links(files.select(relative_key(F.col("path"), root.rstrip("/")).alias("key"), F.col("length").alias("encoded_size"), "content"), root.rstrip("/"))
    if listing is not None:
        rows = listed(rows, listing)
    return rows.select("key", F.sha2("content", 256).alias("version"), "encoded_size", "content")


#: Objects that are read by name; more of them by a scan of the folder and a join.
NAMED = 5_000


def read_objects(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(key, version, encoded_size, content) of the objects of a listing (key, version) that are still there in their listed versions.

    An object that has changed since is left out, as one that is gone: the next update lists it anew. Up to NAMED objects are opened by name, so an update reads what has changed and nothing else.
    """
    root = root.rstrip("/")
    rows = wanted.select("key", "version").limit(NAMED + 1).collect()
    files = spark.read.format("binaryFile")
    none = spark.createDataFrame([], "key string, version string, encoded_size long, content binary")
    if not rows:
        return none
    if len(rows) <= NAMED:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f"{root}/{r['key']}") for r in rows]
        there = [p.toString() for p in paths if p.getFileSystem(conf).exists(p)]
        if not there:
            return none
        read = files.load(there)
        wanted = F.broadcast(spark.createDataFrame(rows, "key string, version string"))
    else:
        read = files.option("recursiveFileLookup", "true").load(root)
    rows = read.select(relative_key(F.col("path"), root).alias("key"), _listed_version().alias("version"), F.col("length").alias("encoded_size"), "content")
    return rows.join(wanted.select("key", "version"), ["key", "version"], "left_semi")


def memory_corpus(spark: SparkSession, objects: dict[str, bytes]) -> DataFrame:
    rows = [(k, bytearray(v)) for k, v in objects.items()]
    df = spark.createDataFrame(rows, "key string, content binary")
    return df.select("key", F.sha2("content", 256).alias("version"), F.octet_length("content").cast("long").alias("encoded_size"), "content")


def check_fresh(listing: DataFrame, corpus: DataFrame) -> None:
    """Raise if an object's version is no longer the listed one."""
    found = stale(listing, corpus).first()
    if found:
        raise StaleSource(f"{found['key']} changed while it was read")


def table_corpus(table: DataFrame, key: Column, text: Column) -> DataFrame:
    """Rows of a table as objects."""
    content = F.coalesce(text.cast("binary"), F.lit(b""))
    return table.select(key.alias("key"), F.sha2(content, 256).alias("version"), F.octet_length(content).cast("long").alias("encoded_size"), content.alias("content"))


def document_keys(documents: DataFrame) -> Column:
    return F.concat(F.lit("docs/"), documents["source"], F.lit("/"), documents["lang"], F.lit("/"), F.lpad(documents["doc_id"].cast("string"), 8, "0"), F.lit(".txt"))


def line_blocks(content: bytes, size: int = BLOCK) -> Iterator[tuple[int, int, int, bytes]]:
    """(block, first line, start, bytes): runs of whole lines of about ``size`` bytes; a longer line is a block of its own."""
    at = line = block = 0
    while at < len(content):
        end = len(content) if at + size >= len(content) else content.rfind(b"\n", at, at + size) + 1
        if end <= at:
            end = content.find(b"\n", at + size) + 1 or len(content)
        piece = content[at:end]
        yield block, line, at, piece
        at, line, block = end, line + piece.count(b"\n"), block + 1


#: Bytes of blocks that leave a worker at once.
SENT = 8 << 20


def longest_line(content: bytes) -> int:
    """Bytes of the longest line, without its line feed."""
    feeds = np.flatnonzero(np.frombuffer(content, dtype=np.uint8) == 10)
    return int(np.diff(np.r_[-1, feeds, len(content)]).max()) - 1 if content else 0


DECODED = "source_key string, version string, encoded_size long, encoding string, failed boolean, error string, display_key string, member_path string, decoded_size long, max_line_len long, block int, first_line long, start long, newlines int, bytes binary"


def decode_corpus(corpus: DataFrame, limits: Limits | None = None, block: int = BLOCK) -> DataFrame:
    """One row per content block of each document, and one without a document for each object.

    An object that cannot be decoded has its row with ``failed`` and no documents. Empty documents have a
    row with an empty block.
    """
    limits = limits or Limits()
    names = [c.split(" ")[0] for c in DECODED.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[c.split(" ")[1]]) for n, c in zip(names, DECODED.split(", "), strict=True)])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, version, size, content in zip(*(batch.column(c) for c in ("key", "version", "encoded_size", "content")), strict=True):
                raw, error, documents, kind = content.as_py() or b"", None, [], None
                try:
                    kind = sniff(key.as_py(), raw)
                    documents = decode(key.as_py(), raw, limits)
                except DecodeError as e:
                    error = str(e)
                head = (key.as_py(), version.as_py(), size.as_py(), kind, error is not None, error)
                rows, held = [(*head, None, None, None, None, None, None, None, None, None)], 0
                for d in documents:
                    longest = longest_line(d.content)
                    for number, line, start, piece in line_blocks(d.content, block) if d.content else [(0, 0, 0, b"")]:
                        rows.append((*head, d.display_key, d.member_path, len(d.content), longest, number, line, start, piece.count(b"\n"), piece))
                        held += len(piece)
                        if held >= SENT:  # a large object leaves in parts
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return corpus.select("key", "version", "encoded_size", "content").mapInArrow(run, DECODED)


def scan_documents(corpus: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(key, bytes) of every document, decoded in full and without an index: what an indexed search must equal."""
    rows = decode_corpus(corpus, limits, block=1 << 40).where("display_key is not null")
    return rows.select(F.col("display_key").alias("key"), "bytes")
