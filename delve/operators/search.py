"""Search an index: plan, candidates, verification, projection. The regex on content decides every result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from delve.functions.grams import pack
from delve.functions.patterns import Program, plan_kinds
from delve.plans.gramplan import plan, simplify

from .candidates import any_of, candidate_blocks, most_places, stored_counts
from .index import Index
from .lines import document_hits, first_lines, line_matches, match_windows, matches_any_line, may_match, submatches, with_context, with_starts
from .scope import Scope, candidate_prefix

KEEP = ("key",)


#: Candidates that the driver takes, so that only their folders are opened; bytes of a broadcast table of candidates; share of all
#: blocks from which on finding the candidates costs more than it saves.
FEW, BROADCAST_BYTES, PLACE_BYTES, SHARE = 2_000, 32 << 20, 32, 0.2


@dataclass
class Candidates:
    """Blocks (key, doc_id, block, first_line, start, bytes) to verify, the places (doc_id, block) the plan admits, and how it got there."""

    blocks: DataFrame
    places: DataFrame
    queries: list
    empty: bool


def candidates(index: Index, program: Program, scope: Scope, whole_documents: bool = False) -> Candidates:
    """Blocks that the gram queries admit. A query on an absent gram reads no content at all.

    The stored counts of the grams bound the number of candidates beforehand. FEW of them go through the driver, and
    only the content folders that hold them are opened. More are broadcast, if their bound fits BROADCAST_BYTES and is below
    SHARE of all blocks. If not, the grams hardly narrow the search, and all content is verified: the regular expression decides in any case.

    Blocks end at line ends and no match crosses a line, so each block is judged by itself; with
    ``whole_documents`` all blocks of a document with a candidate come along.
    """
    prefix = candidate_prefix(scope.target, scope.key_prefix)
    queries = plan(program, index.manifest.strategy)
    grams = set().union(*(q.grams() for q in queries))
    counts = stored_counts(index, grams, prefix)
    space = max(1, sum(s["blocks"] for s in index.manifest.segments))  # dead ones too: a gram that is in all live blocks is just not dropped
    queries = [simplify(q, counts, space, 64 if index.manifest.strategy == "trigram" else 8) for q in queries]
    content = index.table("content", prefix).where(scope.admits(F.col("key")))
    docs = index.table("docs", prefix).where(scope.admits(F.col("display_key")))
    if all(q.kind == "none" for q in queries):
        return Candidates(content.limit(0), index.spark.createDataFrame([], "doc_id long, block int"), queries, True)
    if any(q.kind == "all" for q in queries):
        return Candidates(content, docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), queries, False)
    postings = index.postings(sorted({pack(g) for q in queries for g in q.grams()}), prefix)
    found = candidate_blocks(postings, postings, queries).select("doc_id", "block")
    places = found.join(docs.select("doc_id", "display_key", "bucket"), "doc_id")
    on = ["doc_id"] if whole_documents else ["doc_id", "block"]
    most = sum(most_places(q, counts, space) for q in queries)
    if most <= FEW:
        rows = places.collect()
        buckets, keys = sorted({r["bucket"] for r in rows}), sorted({r["display_key"] for r in rows})
        chosen = index.spark.createDataFrame([(r["doc_id"], r["block"]) for r in rows], "doc_id long, block int")
        near = content.where(any_of(F.col("bucket"), buckets))
        near = near.where(any_of(F.col("key"), keys)) if len(keys) <= 100 else near
        return Candidates(near.join(F.broadcast(chosen.select(*on).distinct()), on, "left_semi"), chosen, queries, not rows)
    if most * PLACE_BYTES <= BROADCAST_BYTES and most < SHARE * space:
        return Candidates(content.join(F.broadcast(found.select(*on)), on, "left_semi"), places.select("doc_id", "block"), queries, False)
    return Candidates(content, places.select("doc_id", "block"), queries, False)


def block_lines(blocks: DataFrame) -> DataFrame:
    """(key, line, offset, text) of blocks of whole lines."""
    text = F.col("bytes").cast("string")
    raw = F.transform(F.split(F.decode("bytes", "ISO-8859-1"), "\n", -1), lambda x: F.encode(x, "ISO-8859-1").cast("string"))  # bytes as they are
    parts = F.when(F.is_valid_utf8(text), F.split(text, "\n", -1)).otherwise(raw)
    parts = F.when(F.octet_length(F.element_at(parts, -1)) == 0, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    lines = with_starts(blocks.select("key", "first_line", "start", parts.alias("parts_")), ("key", "first_line", "start"))
    return lines.select("key", (F.col("first_line") + F.col("pos") + 1).alias("line"), (F.col("start") + F.col("at")).cast("long").alias("offset"), "text")


def search(index: Index, program: Program, scope: Scope | None = None, detail: str = "lines", before: int = 0, after: int = 0, max_count: int | None = None, window: int = 0) -> DataFrame:
    """Results at one of five levels of detail.

    documents: (key). count_lines, count_matches: (key, n). lines: (key, line, kind, offset, text,
    submatches), with context lines if asked. windows: lines with clips of ``window`` bytes.
    """
    scope = scope or Scope()
    context = detail == "lines" and (before or after)
    if detail == "documents" and max_count != 0 and matches_any_line(program):  # content need not be read
        docs = index.table("docs", candidate_prefix(scope.target, scope.key_prefix)).where("decoded_size > 0").select(F.col("display_key").alias("key"))
        return docs.where(scope.admits(F.col("key")))
    found = candidates(index, program, scope, bool(context) or program.whole_document)
    blocks = found.blocks
    if detail == "documents" and max_count != 0:
        hits = document_hits(blocks.withColumn("text", F.col("bytes").cast("string")), program)
        one_block = all(s["blocks"] == s["docs"] for s in index.manifest.segments)
        return hits.select("key") if one_block else hits.select("key").distinct()
    lines = block_lines(blocks if context or program.can_be_empty or program.whole_document else blocks.where(may_match(F.col("bytes").cast("string"), program)))
    hit = line_matches(F.col("text"), program)
    if max_count == 0:
        lines = lines.limit(0)
    if context:
        events = with_context(lines, hit, before, after, max_count)
    else:
        events = lines.where(hit).withColumn("kind", F.lit("match"))
        if max_count is not None:
            events = first_lines(events, max_count)
    if detail == "count_lines":
        return events.groupBy("key").agg(F.count("*").alias("n"))
    events = events.withColumn("submatches", submatches(F.col("text"), program))
    if detail == "documents":
        return events.select("key")
    if detail == "count_matches":
        return events.groupBy("key").agg(F.sum(F.size("submatches").cast("long")).alias("n"))
    events = events.select("key", "line", "kind", "offset", "text", "submatches")
    return match_windows(events, window) if detail == "windows" else events


def list_files(index: Index, scope: Scope | None = None) -> DataFrame:
    """Keys of live documents in order; content is not read."""
    scope = scope or Scope()
    docs = index.table("docs", candidate_prefix(scope.target, scope.key_prefix)).select(F.col("display_key").alias("key"))
    return docs.where(scope.admits(F.col("key"))).orderBy("key")


def search_stats(index: Index, program: Program, scope: Scope | None = None) -> dict:
    """Candidates, live documents, hits, bytes read for verification, and how the patterns were planned."""
    scope = scope or Scope()
    found = candidates(index, program, scope)
    held = index.table("content").join(found.places.distinct(), ["doc_id", "block"], "left_semi")
    n = held.agg(F.countDistinct("key"), F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()
    hits = search(index, program, scope, "documents").count()
    return {"candidates": n[0], "total": index.table("docs").count(), "hits": hits, "bytes": n[1], "excluded": index.excluded(), **plan_kinds(program)}


def search_collect(index: Index, program: Program, scope: Scope | None = None) -> tuple[list, dict]:
    """All events, by key and line, and the figures of the search; for results that the driver can hold."""
    return search(index, program, scope).orderBy("key", "line").collect(), search_stats(index, program, scope)


def search_null(index: Index, program: Program, scope: Scope | None = None, detail: str = "documents") -> int:
    """Run a search and keep nothing but the number of its results."""
    seen = Observation()
    search(index, program, scope, detail).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]
