"""Parts of documents: chunks that overlap, ranges grown to whole lines, ranges that are read together, lines of offsets, whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from delve.functions.patterns import Program, search_extent
from delve.sources.corpus import decode_corpus
from delve.sources.decode import Limits

#: Characters of a chunk; ranges this near are read together; over so many, or this share of the document, it is read whole.
CHUNK, GAP, MOST, SHARE = 1 << 20, 1 << 20, 512, 0.5


def chunked_hits(docs: DataFrame, program: Program, size: int = CHUNK, text: str = "text", keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """Documents (keep...) with a match, tested in chunks of ``size`` characters that overlap by the longest match less one.

    For patterns whose matches are bounded and look at nothing around them; others raise ValueError. A
    match holds no line feed, so a chunk is tested line by line where the pattern could take one.
    """
    extents = [search_extent(t, program.insensitive) for t in program.trees]
    if program.word or any(kind != "bytes" for kind, _ in extents):
        raise ValueError("a pattern without a bound cannot be tested in chunks")
    overlap = max(n for _, n in extents) - 1
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.char_length(text) - 1) / size)).cast("int"))
    pieces = docs.select(*keep, F.explode(F.transform(starts, lambda k: F.substring(F.col(text), k * size + 1, F.lit(size + overlap)))).alias("piece"))
    hit = F.exists(F.split("piece", "\n", -1), lambda line: line.rlike(program.java)) if program.crosses_lines else F.col("piece").rlike("(?m)" + program.java)
    return pieces.where(hit).select(*keep).distinct()


def line_of_offset(blocks: DataFrame, offsets: DataFrame, key: str = "key") -> DataFrame:
    """(key, offset, line) of byte offsets (key, offset), by the lines before each block (key, first_line, start, bytes): only the block that holds an offset is counted."""
    inside = (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("start") + F.octet_length("bytes"))
    held = blocks.select(key, "first_line", "start", "bytes").join(offsets.select(key, "offset"), key).where(inside)
    head = F.substring("bytes", F.lit(1), (F.col("offset") - F.col("start")).cast("int"))
    feeds = F.size(F.split(F.decode(head, "ISO-8859-1"), "\n", -1)) - 1
    return held.select(key, "offset", (F.col("first_line") + feeds + 1).cast("long").alias("line"))


def whole_lines(blocks: DataFrame, ranges: DataFrame, before: int = 0, after: int = 0, key: str = "key") -> DataFrame:
    """Byte ranges (key, start, end) grown to the whole lines they touch and ``before`` and ``after`` lines around: adds from_byte, to_byte, from_line, to_line.

    ``blocks`` (key, first_line, start, newlines, bytes) end at line ends. Their counts of line feeds tell which of them hold
    the asked lines; only those are split. A line feed belongs to the line it ends.
    """
    spread = ranges.select(key, "start", "end").distinct().withColumn("last", F.greatest(F.col("end"), F.col("start") + 1) - 1)
    low = line_of_offset(blocks, spread.select(key, F.col("start").alias("offset"))).select(key, F.col("offset").alias("start"), F.col("line").alias("low")).distinct()
    high = line_of_offset(blocks, spread.select(key, F.col("last").alias("offset"))).select(key, F.col("offset").alias("last"), F.col("line").alias("high")).distinct()
    wide = spread.join(low, [key, "start"]).join(high, [key, "last"]).select(key, "start", "end", (F.col("low") - before).alias("low"), (F.col("high") + after).alias("high"))
    held = blocks.select(key, F.col("first_line").alias("first"), F.col("start").alias("at"), "newlines", "bytes")
    held = held.join(wide, key).where((F.col("first") < F.col("high")) & (F.col("first") + F.col("newlines") + 1 >= F.col("low")))
    parts = F.split(F.decode("bytes", "ISO-8859-1"), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    lines = held.select(key, "start", "end", "low", "high", "first", "at", (F.col("at") + F.octet_length("bytes")).alias("stop"), F.posexplode(parts).alias("pos", "text"))
    order = Window.partitionBy(key, "start", "end", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("at") + F.sum(F.char_length("text").cast("long") + 1).over(order)  # a byte is a character here
    lines = lines.withColumns({"upto": upto, "line": F.col("first") + F.col("pos") + 1}).where((F.col("line") >= F.col("low")) & (F.col("line") <= F.col("high")))
    start = F.min(F.col("upto") - F.char_length("text") - 1)
    return lines.groupBy(key, "start", "end").agg(start.alias("from_byte"), F.max(F.least("upto", "stop")).alias("to_byte"), F.min("line").alias("from_line"), F.max("line").alias("to_line"))


def coalesce_ranges(ranges: DataFrame, sizes: DataFrame, gap: int = GAP, most: int = MOST, share: float = SHARE, key: str = "doc_id") -> DataFrame:
    """What is read for byte ranges (key, start, end) of documents (key, size): ranges at most ``gap`` apart as one, and the whole
    document where over ``most`` are left or they cover ``share`` of it."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = ranges.select(key, "start", "end").withColumn("new", F.coalesce(F.col("start") > reach + gap, F.lit(True)).cast("int"))
    run = new.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = run.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    totals = merged.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("cover")).join(sizes.select(key, "size"), key)
    whole = totals.withColumn("whole", (F.col("n") > most) | (F.col("cover") >= F.col("size") * share)).select(key, "whole", "size")
    parts = merged.join(whole.where("not whole").select(key), key).select(key, "start", "end")
    return parts.unionByName(whole.where("whole").select(key, F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end")))


def fetch_documents(corpus: DataFrame, wanted: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(key, bytes) of the documents (source_key, version, key) that are asked for; each object is read and decoded once, and only if its version is the asked one."""
    objects = wanted.select(F.col("source_key").alias("key"), "version").distinct()
    rows = decode_corpus(corpus.join(objects, ["key", "version"], "left_semi"), limits, block=1 << 40).where("display_key is not null")
    asked = wanted.select("source_key", F.col("key").alias("display_key")).distinct()
    return rows.join(asked, ["source_key", "display_key"], "left_semi").select(F.col("display_key").alias("key"), "bytes")
