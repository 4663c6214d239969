"""The index: immutable segments of Parquet tables under a generation manifest.

``seg-<id>/`` holds sources, docs, content and postings (compressed lists of the places of each gram, by runs of neighbouring content); ``dead-<id>/`` the sources of older segments that
a generation dropped. Content lies in folders of neighbouring keys (``bucket=<n>``), each of about BUCKET_BYTES;
docs name the bucket of a document, so a search opens the folders of its candidates only. ``gen-<n>.json`` names the live segments; the highest is the root. A writer
publishes by creating the next one exclusively, so of two writers one fails and deletes nothing.
Document ids hash the key and version: segments merge without renumbering.
"""

from __future__ import annotations

import functools
import gc
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delve.functions.grams import POSTINGS, found_counts, found_postings, pick_strategy, stored_postings, strided
from delve.sources.corpus import decode_corpus, vanished
from delve.sources.decode import Limits

#: Share of dead documents or bytes that repacks a segment, segments before merging, and caps of a merge.
REPACK, MAX_SEGMENTS, MERGE_DOCS, MERGE_BYTES = 0.25, 8, 4_000_000, 256 << 20
FORMAT = 3
#: Bytes of a content folder, and how many a segment has at most.
BUCKET_BYTES, MAX_BUCKETS = 32 << 20, 4_096
#: Bytes of a row group: what a lookup reads at least, and what a task of a scan has at least.
ROW_GROUP = 8 << 20


class IndexConflict(RuntimeError):
    """Another writer published first."""


class IndexChanged(RuntimeError):
    """A newer generation was published while results of this one were on their way."""


class IndexMismatch(RuntimeError):
    """The index belongs to another source, or has another format."""


class _Store:
    """Files of an index folder, through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(""))] if self.fs.exists(self._path("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or self.fs.exists(self._path(name)):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass
class Manifest:
    generation: int = 0
    source: str = ""
    strategy: str = "trigram"
    segments: list[dict] = field(default_factory=list)
    dead: list[str] = field(default_factory=list)
    format: int = FORMAT

    def dirs(self) -> set[str]:
        return {f"seg-{s['id']}" for s in self.segments} | {f"dead-{d}" for d in self.dead}


def duplicate_keys(listing: DataFrame) -> DataFrame:
    return listing.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def diff_listing(listing: DataFrame, live: DataFrame) -> DataFrame:
    """(key, action): add for new keys, replace for changed or to-be-retried ones, remove for missing ones.

    ``listing`` has (key, version), ``live`` (key, version, retry).
    """
    old = live.select("key", F.col("version").alias("old"), F.col("retry"), F.lit(True).alias("had"))
    new = listing.select("key", F.col("version").alias("new"), F.lit(True).alias("has"))
    action = (
        F.when(F.col("had").isNull(), "add")
        .when(F.col("has").isNull(), "remove")
        .when(F.col("retry") | ~F.col("old").eqNullSafe(F.col("new")), "replace")
    )
    return new.join(old, "key", "full_outer").select("key", action.alias("action")).where("action is not null")


def newest_wins(entries: DataFrame, key: str = "key", order: str = "generation") -> DataFrame:
    """Of entries with one key, that of the highest ``order``."""
    return entries.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("rank = 1").drop("rank")


def should_repack(dead_docs: Column, docs: Column, dead_bytes: Column, size: Column, purge: bool = False) -> Column:
    share = (dead_docs >= REPACK * docs) | (dead_bytes >= REPACK * size)
    return (dead_docs > 0) & (F.lit(purge) | share)


def pick_merge(segments: list[dict], max_segments: int = MAX_SEGMENTS) -> tuple[int, int] | None:
    """The cheapest adjacent pair to merge, if there are too many segments and a pair is within the caps."""
    if len(segments) <= max_segments:
        return None
    pairs = [(a["bytes"] + b["bytes"], k) for k, (a, b) in enumerate(zip(segments, segments[1:], strict=False)) if a["bytes"] + b["bytes"] <= MERGE_BYTES and a["docs"] + b["docs"] <= MERGE_DOCS]
    return (min(pairs)[1], min(pairs)[1] + 1) if pairs else None


class Index:
    """A reader pinned to one generation."""

    def __init__(self, spark: SparkSession, root: str, source: str | None = None) -> None:
        self.spark, self.store = spark, _Store(spark, root)
        self._frames: dict[str, DataFrame] = {}
        self.manifest = load_manifest(self.store)
        if source is not None and self.manifest.generation and not source.startswith(self.manifest.source):
            raise IndexMismatch(f"the index is of {self.manifest.source!r}; it cannot answer for {source!r}")

    def changed(self) -> bool:
        return load_manifest(self.store).generation != self.manifest.generation

    def _read(self, table: str, segments: list[dict]) -> DataFrame | None:
        parts = []
        for s in segments:  # segments never change: their files are listed once
            path = f"{self.store.root}/seg-{s['id']}/{table}"
            if path not in self._frames:
                self._frames[path] = self.spark.read.schema(SCHEMAS[table]).parquet(path)
            parts.append(self._frames[path])
        return functools.reduce(DataFrame.unionAll, parts) if parts else None

    def dead(self) -> DataFrame:
        paths = [f"{self.store.root}/dead-{d}" for d in self.manifest.dead]
        return self.spark.read.parquet(*paths).distinct() if paths else self.spark.createDataFrame([], "seg string, source_key string")

    def table(self, table: str, prefix: str | None = None, segments: list[dict] | None = None) -> DataFrame:
        """Live rows of a table; segments whose keys can't have the prefix are not read."""
        chosen = self.manifest.segments if segments is None else segments
        if prefix:
            chosen = [s for s in chosen if s["min_key"] is not None and s["max_key"] >= prefix and s["min_key"][: len(prefix)] <= prefix]
        df = self._read(table, chosen)
        if df is None:
            df = self.spark.createDataFrame([], SCHEMAS[table])
        if table == "postings":  # of dead documents too: readers join candidates with docs
            return df
        return df.join(F.broadcast(self.dead()) if self._few_dead() else self.dead(), ["seg", "source_key"], "left_anti") if self.manifest.dead else df

    def postings(self, codes: list[int], prefix: str | None = None) -> DataFrame:
        """(gram, doc_id, block) of some packed grams, those of dead documents too."""
        return found_postings(self.table("postings", prefix), codes)

    def gram_counts(self, codes: list[int], prefix: str | None = None) -> DataFrame:
        """(gram, n): the places of some packed grams."""
        return found_counts(self.table("postings", prefix), codes).groupBy("gram").agg(F.sum("n").alias("n"))

    def _few_dead(self) -> bool:
        return sum(s.get("dead", 0) for s in self.manifest.segments) <= 100_000

    def check(self) -> None:
        """Raise if another generation has been published: results read so far may be of two."""
        if self.changed():
            raise IndexChanged(f"generation {self.manifest.generation} is no longer the newest")

    def excluded(self) -> int:
        """Live objects that could not be decoded."""
        return self.table("sources").where("failed").count()


SCHEMAS = {
    "sources": "seg string, source_key string, version string, encoded_size long, encoding string, doc_count long, failed boolean, retry boolean",
    "docs": "seg string, source_key string, doc_id long, display_key string, member_path string, decoded_size long, max_line_len long, blocks int, block_newlines array<int>, bucket int",
    "content": "seg string, source_key string, doc_id long, key string, block int, first_line long, start long, bytes binary, bucket int",
    "postings": POSTINGS,
}


def load_manifest(store: _Store) -> Manifest:
    found = [int(n[4:-5]) for n in store.names() if n.startswith("gen-") and n.endswith(".json")]
    if not found:
        return Manifest()
    manifest = Manifest(**json.loads(store.read(f"gen-{max(found):09d}.json")))
    if manifest.format != FORMAT:
        raise IndexMismatch(f"the index has format {manifest.format}, not {FORMAT}: rebuild it")
    return manifest


def _write_content(content: DataFrame, base: str) -> None:
    """Content by ranges of keys, each range a folder of its own, sorted."""
    weight = content.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(1, min(MAX_BUCKETS, -(-weight // BUCKET_BYTES)))
    dealt = content.repartitionByRange(buckets, "key").withColumn("bucket", F.spark_partition_id()).sortWithinPartitions("bucket", "key", "block")
    dealt.write.partitionBy("bucket").option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(f"{base}/content")


def _write_postings(spark: SparkSession, base: str, strategy: str) -> None:
    """Postings of the content that a segment has, each task those of what it reads: nothing is dealt out. Pages of few rows let a search skip the others."""
    content = spark.read.schema(SCHEMAS["content"]).parquet(f"{base}/content")
    stored_postings(content, strategy).write.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", 4).parquet(f"{base}/postings")


def _free(spark: SparkSession) -> None:
    """Shuffle files that nothing refers to any more go now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _write_docs(docs: DataFrame, base: str) -> None:
    """``docs`` with the buckets that their content went to."""
    spark = docs.sparkSession
    places = spark.read.schema(SCHEMAS["content"]).parquet(f"{base}/content").groupBy("doc_id").agg(F.max("bucket").alias("bucket"))
    docs.join(places, "doc_id").select(*(c.split(" ")[0] for c in SCHEMAS["docs"].split(", "))).repartitionByRange("display_key").sortWithinPartitions("display_key").write.parquet(f"{base}/docs")


def _write_segment(spark: SparkSession, store: _Store, corpus: DataFrame, strategy: str, lost: DataFrame | None, limits: Limits | None) -> dict | None:
    seg = uuid.uuid4().hex
    base = f"{store.root}/seg-{seg}"
    doc = F.xxhash64("display_key", "version")
    rows = decode_corpus(corpus, limits).withColumns({"seg": F.lit(seg), "doc_id": doc})
    staged = f"{store.root}/tmp-{seg}"
    rows.write.option("compression", "zstd").parquet(staged)
    rows = spark.read.parquet(staged)
    content = rows.where("display_key is not null").select("seg", "source_key", "doc_id", F.col("display_key").alias("key"), "block", "first_line", "start", "bytes")
    _write_content(content, base)
    docs = rows.where("display_key is not null").groupBy("seg", "source_key", "doc_id", "display_key", "member_path").agg(
        F.max("decoded_size").alias("decoded_size"), F.max("max_line_len").alias("max_line_len"), F.count("*").cast("int").alias("blocks"),
        F.transform(F.array_sort(F.collect_list(F.struct("block", "newlines"))), lambda x: x["newlines"]).alias("block_newlines"),
    )
    _write_docs(docs, base)
    sources = rows.groupBy("seg", "source_key", "version", "encoded_size").agg(F.max("encoding").alias("encoding"), F.countDistinct("display_key").alias("doc_count"), F.max("failed").alias("failed"), F.lit(False).alias("retry"))
    if lost is not None:
        gone = lost.select(F.lit(seg).alias("seg"), F.col("key").alias("source_key"), F.col("version"), F.lit(0).cast("long").alias("encoded_size"), F.lit(None).cast("string").alias("encoding"), F.lit(0).cast("long").alias("doc_count"), F.lit(False).alias("failed"), F.lit(True).alias("retry"))
        sources = sources.unionByName(gone)
    sources.repartitionByRange("source_key").write.parquet(f"{base}/sources")
    store.delete(f"tmp-{seg}")
    _free(spark)
    _write_postings(spark, base, strategy)
    return _describe(spark, store, seg)


def _write_bounded(spark: SparkSession, store: _Store, corpus: DataFrame, strategy: str, lost: DataFrame | None, limits: Limits | None, doc_cap: int) -> Iterator[dict]:
    """Segments of at most ``doc_cap`` documents: one that has more is halved by ranges of keys, and again. One object over the cap is refused."""
    made = _write_segment(spark, store, corpus, strategy, lost, limits)
    if not made or made["docs"] <= doc_cap:
        if made:
            yield made
        return
    sources = spark.read.schema(SCHEMAS["sources"]).parquet(f"{store.root}/seg-{made['id']}/sources").where("doc_count > 0")
    parts = -(-made["docs"] // doc_cap)
    if (sources.agg(F.max("doc_count")).first()[0] or 0) > doc_cap:
        store.delete(f"seg-{made['id']}")
        raise ValueError(f"one object has more than {doc_cap} documents")
    dealt = sources.select("source_key", "doc_count").repartitionByRange(max(2, parts), "source_key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("source_key").alias("low"), F.max("source_key").alias("high"))
    cuts = [r["low"] for r in dealt.orderBy("low").collect()]  # a row a segment
    if len(cuts) < 2:  # the ranges came out as one: halve by the first and the other keys
        low = cuts[0]
        cuts = [low, sources.where(F.col("source_key") > low).agg(F.min("source_key")).first()[0]]
    store.delete(f"seg-{made['id']}")
    for k, low in enumerate(cuts):
        inside = (F.col("key") >= low if k else F.lit(True)) & (F.col("key") < cuts[k + 1] if k + 1 < len(cuts) else F.lit(True))
        yield from _write_bounded(spark, store, corpus.where(inside), strategy, None if lost is None else lost.where(inside), limits, doc_cap)


def _describe(spark: SparkSession, store: _Store, seg: str) -> dict | None:
    base = f"{store.root}/seg-{seg}"
    s = spark.read.parquet(f"{base}/sources").agg(F.count("*"), F.sum(F.col("failed").cast("long")), F.min("source_key"), F.max("source_key")).first()
    d = spark.read.parquet(f"{base}/docs").agg(F.count("*"), F.coalesce(F.sum("decoded_size"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    if not s[0]:
        store.delete(f"seg-{seg}")
        return None
    return {"id": seg, "sources": s[0], "failed": s[1] or 0, "min_key": s[2], "max_key": s[3], "docs": d[0], "bytes": d[1], "blocks": d[2], "dead": 0}


def _rewrite(index: Index, segments: list[dict]) -> dict | None:
    """Merge the live rows of segments into a new one."""
    seg = uuid.uuid4().hex
    base = f"{index.store.root}/seg-{seg}"
    live = lambda table: index.table(table, segments=segments).withColumn("seg", F.lit(seg))
    _write_content(live("content").drop("bucket"), base)
    docs = live("docs").drop("bucket")
    _write_docs(docs, base)
    live("sources").repartitionByRange("source_key").sortWithinPartitions("source_key").write.parquet(f"{base}/sources")
    _free(index.spark)
    _write_postings(index.spark, base, index.manifest.strategy)
    return _describe(index.spark, index.store, seg)


def update_index(
    spark: SparkSession, root: str, corpus: DataFrame | None, source: str = "", strategy: str | None = None, rebuild: bool = False, purge: bool = False,
    listing: DataFrame | None = None, limits: Limits | None = None, max_segments: int = MAX_SEGMENTS, fetch: Callable[[DataFrame], DataFrame] | None = None,
    doc_cap: int = MERGE_DOCS, progress: Callable[[dict], None] | None = None,
) -> dict:
    """Bring the index in line with a corpus; returns (added, removed, total_docs, segments, compacted, ...).

    ``listing`` (key, version) defaults to the corpus; listed objects that the corpus lacks are noted and
    tried again by the next update. Without changes nothing is written. With a listing and ``fetch``, which gives the
    corpus of the keys it is asked for, only new and changed objects are read; ``corpus`` is not needed then.
    A segment has at most ``doc_cap`` documents: a larger addition becomes several. ``progress`` is told of each step.
    """
    tell = progress or (lambda event: None)
    store = _Store(spark, root)
    old = load_manifest(store)
    if old.generation and old.source != source and not rebuild:
        raise IndexMismatch(f"the index is of {old.source!r}, not {source!r}")
    own = listing is None
    listing = corpus.select("key", "version") if own else listing.select("key", "version")
    twice = duplicate_keys(listing).first()
    if twice:
        raise ValueError(f"the listing names {twice['key']!r} twice")
    fresh = rebuild or not old.generation or (strategy is not None and strategy != old.strategy)
    current = Manifest(old.generation) if fresh else old
    index = Index.__new__(Index)
    index.spark, index.store, index.manifest, index._frames = spark, store, current, {}
    live = index.table("sources").select(F.col("source_key").alias("key"), "version", "retry", "seg", "doc_count")
    changes = diff_listing(listing, live)
    changes.persist()
    written: list[str] = []
    published = False
    try:
        counts = {r["action"]: r["n"] for r in changes.groupBy("action").agg(F.count("*").alias("n")).collect()}
        if not counts and not fresh and not purge:
            return {"added": 0, "removed": 0, "total_docs": index.table("docs").count(), "segments": len(current.segments), "compacted": False, "up_to_date": True, "generation": current.generation}
        if fresh:
            if not strategy:
                sampled = corpus if fetch is None else fetch(strided(listing, "key"))
                strategy = pick_strategy(sampled.select("key", F.col("content").cast("string").alias("text")), "key", "text").first()["strategy"]
        else:
            strategy = current.strategy
        new = Manifest(old.generation + 1, source, strategy, list(current.segments), list(current.dead))
        dead = live.join(changes.where("action <> 'add'"), "key").select("seg", F.col("key").alias("source_key"))
        if counts.get("replace", 0) + counts.get("remove", 0):
            name = uuid.uuid4().hex
            written.append(f"dead-{name}")
            dead.write.parquet(f"{store.root}/dead-{name}")
            new.dead.append(name)
        add = changes.where("action <> 'remove'").select("key")
        if counts.get("add", 0) + counts.get("replace", 0):
            wanted = listing.join(add, "key", "left_semi")
            tell({"event": "listed", "objects": counts.get("add", 0) + counts.get("replace", 0), "removed": counts.get("remove", 0)})
            if fetch is not None:
                rows = fetch(wanted)
            else:  # where nothing is live and the corpus is its own listing, all of it is added, and a join would only move it
                rows = corpus.where("key is not null") if fresh and own else corpus.join(add, "key", "left_semi")
            gone = vanished(wanted, rows)
            for made in _write_bounded(spark, store, rows, strategy, gone, limits, doc_cap):
                new.segments.append(made)
                written.append(f"seg-{made['id']}")
                tell({"event": "segment", "documents": made["docs"], "bytes": made["bytes"]})
        index.manifest = new
        compacted = False
        if new.dead:
            n = {r["seg"]: r for r in index.table("docs").groupBy("seg").agg(F.count("*").alias("docs"), F.sum("decoded_size").alias("bytes")).collect()}
            left = {r["seg"] for r in index.table("sources").select("seg").distinct().collect()}
            kept = []
            for s in new.segments:
                if s["id"] not in left:
                    continue
                have = n.get(s["id"])
                lost, lost_bytes = s["docs"] - (have["docs"] if have else 0), s["bytes"] - (have["bytes"] if have else 0)
                if (purge and lost) or (s["docs"] and lost >= REPACK * s["docs"]) or (s["bytes"] and lost_bytes >= REPACK * s["bytes"]):
                    s = _rewrite(index, [s])
                    written += [f"seg-{s['id']}"] if s else []
                    compacted = True
                else:
                    s = {**s, "dead": lost}
                if s:
                    kept.append(s)
            new.segments = kept
        if pair := pick_merge(new.segments, max_segments):
            index.manifest = new
            merged = _rewrite(index, [new.segments[k] for k in pair])
            written += [f"seg-{merged['id']}"] if merged else []
            new.segments[pair[0] : pair[1] + 1] = [merged] if merged else []
            compacted = True
        if new.dead and not any(s.get("dead") for s in new.segments):  # no segment holds a dead source any more
            new.dead = []
        if not store.create(f"gen-{new.generation:09d}.json", json.dumps(new.__dict__)):
            raise IndexConflict("another writer published this generation first")
        published = True
        tell({"event": "published", "generation": new.generation, "segments": len(new.segments)})
        for name in store.names():  # what the last generation had and this one has not
            if (name in old.dirs() and name not in new.dirs()) or (name.startswith("gen-") and int(name[4:-5]) < new.generation - 1):
                store.delete(name)
        index.manifest = new
        return {"added": counts.get("add", 0) + counts.get("replace", 0), "removed": counts.get("remove", 0) + counts.get("replace", 0), "total_docs": index.table("docs").count(), "segments": len(new.segments), "compacted": compacted, "up_to_date": False, "generation": new.generation}
    finally:
        changes.unpersist()
        if not published:  # a loser, or a failure: nothing of it is named by any generation
            for name in written:
                store.delete(name)
