"""Lines, matches, spans, context, caps, counts and windows over documents (key, text)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from delve.functions.patterns import Program, find_spans, looks, plain_texts, required_texts, witnesses
from delve.functions.witness import find_witness

SPANS = "array<struct<start:bigint,end:bigint>>"


def explode_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """(keep..., line, offset, text): lines end at line feeds only, count from 1, and a line feed at the end
    starts no line. ``offset`` is the byte offset of the line's start. An empty text has no lines."""
    lines = with_starts(docs.select(*keep, _parts(F.col(text)).alias("parts_")), keep)
    return lines.select(*keep, (F.col("pos") + 1).cast("long").alias("line"), F.col("at").alias("offset"), "text")


def _parts(text: Column) -> Column:
    """The lines of a text as an array."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def _starts(parts: pa.Array) -> pa.Array:
    n = pc.list_value_length(parts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    size = pc.binary_length(parts.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    upto = np.cumsum(size)
    before = np.r_[0, upto][ends - n]  # of a row's first line
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(upto - size - np.repeat(before, n)))


def with_starts(rows: DataFrame, keep: tuple[str, ...], parts: str = "parts_") -> DataFrame:
    """(keep..., pos, text, at): the lines of an array ``parts``, each with the byte where it starts; no shuffle."""
    placed = rows.withColumn("at_", F.arrow_udf(_starts, "array<bigint>")(F.col(parts)))
    each = placed.select(*keep, F.posexplode(F.arrays_zip(F.col(parts).alias("text"), F.col("at_").alias("at"))).alias("pos", "line_"))
    return each.select(*keep, "pos", "line_.text", "line_.at")


def plain_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """(keep..., line, text) without offsets: no shuffle."""
    return docs.select(*keep, F.posexplode(_parts(F.col(text))).alias("pos", "text")).select(*keep, (F.col("pos") + 1).cast("long").alias("line"), "text")


def _holds(text: Column, texts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(F.lit(t)) for t in texts))


def line_matches(text: Column, program: Program) -> Column:
    """Whether a line matches; the engine of regular expressions is asked only where a text that matches hold is there."""
    if texts := plain_texts(program):
        return _holds(text, texts)
    texts = required_texts(program)
    return _holds(text, texts) & text.rlike(program.java) if texts else text.rlike(program.java)


def may_match(text: Column, program: Program) -> Column:
    """Whether some line of a text could match: exact unless the pattern could take a line feed."""
    if texts := plain_texts(program):
        return _holds(text, texts)
    whole = text.rlike("(?m)" + program.java)
    texts = required_texts(program)
    return _holds(text, texts) & whole if texts else whole


def submatches(text: Column, program: Program) -> Column:
    """Byte spans of the matches in a line, in order, never overlapping across patterns."""
    if program.can_be_empty:
        regex = program.python

        @F.pandas_udf(SPANS)
        def spans(lines: pd.Series) -> pd.Series:
            return pd.Series([[{"start": a, "end": b} for a, b in find_spans(regex, t.encode("utf-8", "surrogateescape"))] for t in lines], dtype=object)

        return spans(text)
    # bytes that are no UTF-8 would come back three times as long: such lines are matched byte by byte, as Latin-1
    valid = F.is_valid_utf8(text)
    text = F.when(valid, text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1"))
    return F.arrow_udf(_placed, SPANS)(F.split(text, program.java, -1), F.regexp_extract_all(text, F.lit(program.java), F.lit(0)), valid)


def _placed(gaps: pa.Array, found: pa.Array, valid: pa.Array) -> pa.Array:
    """Places of matches from their texts and the texts between them: running sums of their lengths, all rows at once."""
    n = pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    bytes_ = valid.to_numpy(zero_copy_only=False).astype(bool)

    def lengths(parts: pa.Array, of: np.ndarray) -> np.ndarray:
        flat = parts.flatten()
        one = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        return one if bytes_.all() else np.where(bytes_[of], one, pc.utf8_length(flat).to_numpy(zero_copy_only=False))

    matched = lengths(found, row)
    between = lengths(gaps, np.repeat(np.arange(len(n)), n + 1))[np.arange(len(row)) + row]  # without the text after the last match
    upto = np.cumsum(matched + between)
    before = np.r_[0, upto][ends - n]  # of a row's first match
    stop = upto - before[row]
    spans = pa.StructArray.from_arrays([pa.array(stop - matched), pa.array(stop)], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), spans)


def witness_spans(lines: DataFrame, program: Program) -> DataFrame:
    """Lines (with ``submatches``, of one pattern) with witness_start and witness_end: the shortest beginning or end of the first match that matches by itself."""
    witness = witnesses(program)[0] if len(program.trees) == 1 else None

    @F.pandas_udf("start long, end long")
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find_witness(witness, t) for t in texts], columns=["start", "end"])

    first = F.get("submatches", F.lit(0))
    part = F.substring(F.col("text").cast("binary"), (first["start"] + 1).cast("int"), (first["end"] - first["start"]).cast("int")).cast("string")
    out = lines.withColumn("found_", found(part))
    return out.withColumns({"witness_start": first["start"] + F.col("found_.start"), "witness_end": first["start"] + F.col("found_.end")}).drop("found_")


def matching_lines(docs: DataFrame, program: Program, text: str = "text", keep: tuple[str, ...] = ("key",), spans: bool = False, offsets: bool = False) -> DataFrame:
    """Lines with a match. The whole text is tested first, so documents without one are never split."""
    some = docs if program.can_be_empty or program.whole_document else docs.where(may_match(F.col(text), program))
    lines = (explode_lines if offsets else plain_lines)(some, text, keep).where(line_matches(F.col("text"), program))
    return lines.withColumn("submatches", submatches(F.col("text"), program)) if spans else lines


def with_context(lines: DataFrame, hit: Column, before: int, after: int, max_count: int | None = None, keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """Match and context lines, each once: (..., kind). At most ``max_count`` matches count per document;
    later hits inside the context of the last one are context."""
    order = Window.partitionBy(*keep).orderBy("line")
    marked = lines.withColumn("hit", hit)
    if max_count is not None:
        rank = F.sum(F.col("hit").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        marked = marked.withColumn("capped", F.col("hit") & (rank <= max_count))
    else:
        marked = marked.withColumn("capped", F.col("hit"))
    near = F.max(F.col("capped").cast("int")).over(order.rowsBetween(-after, before))
    return marked.withColumn("near", near).where("near = 1").withColumn("kind", F.when(F.col("capped"), "match").otherwise("context")).drop("near", "hit", "capped")


def matches_any_line(program: Program) -> bool:
    """The patterns match empty text anywhere, so each document with a line has a match."""
    return any(t.getwidth()[0] == 0 and not looks(t) for t in program.trees) and not program.word


def document_hits(docs: DataFrame, program: Program, text: str = "text") -> DataFrame:
    """Documents with a matching line: tested on the whole text, without splitting it, where that is the same."""
    if matches_any_line(program):
        return docs.where(F.octet_length(text) > 0)
    if program.crosses_lines or program.whole_document or program.can_be_empty:
        return docs.where(F.exists(_parts(F.col(text)), lambda line: line_matches(line, program)))
    return docs.where(may_match(F.col(text), program))


def count_lines(docs: DataFrame, program: Program, text: str = "text", keep: tuple[str, ...] = ("key",), max_count: int | None = None) -> DataFrame:
    """Matching lines per document that has one, at most ``max_count``."""
    n = F.count("*") if max_count is None else F.least(F.count("*"), F.lit(max_count))
    return matching_lines(docs, program, text, keep).groupBy(*keep).agg(n.cast("long").alias("n"))


def first_lines(lines: DataFrame, max_count: int, keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """The first ``max_count`` of the lines of each document; a line that came twice, of regions that overlap, counts once."""
    rank = F.dense_rank().over(Window.partitionBy(*keep).orderBy("line"))
    return lines.dropDuplicates([*keep, "line"]).withColumn("rank_", rank).where(F.col("rank_") <= max_count).drop("rank_")


def verified_lines(docs: DataFrame, places: DataFrame, program: Program, text: str = "text", keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """Whole lines (keep..., line, text) at places (keep..., line) that do match."""
    return plain_lines(docs, text, keep).join(places.select(*keep, "line").distinct(), [*keep, "line"], "left_semi").where(line_matches(F.col("text"), program))


def count_matches(docs: DataFrame, program: Program, text: str = "text", keep: tuple[str, ...] = ("key",), max_count: int | None = None) -> DataFrame:
    """Matches per document that has one; with ``max_count``, on its first matching lines."""
    lines = matching_lines(docs, program, text, keep)
    if max_count is not None:
        lines = first_lines(lines, max_count, keep)
    n = F.size(submatches(F.col("text"), program)) if program.can_be_empty else F.regexp_count("text", F.lit(program.java))
    return lines.select(*keep, n.cast("long").alias("m")).groupBy(*keep).agg(F.sum("m").alias("n"))


def match_windows(lines: DataFrame, size: int) -> DataFrame:
    """A clip of at most ``size`` bytes around the first match of each line (with ``submatches``).

    The clip is centred on the match; what one side of the line can't fill goes to the other. Adds
    clip_start, clip_end (bytes of the line), clipped_left, clipped_right and excerpt (binary).
    """
    n = F.octet_length("text").cast("long")
    first = F.get("submatches", F.lit(0))
    length = F.least(F.lit(size).cast("long"), n)
    width = F.least(first["end"] - first["start"], length)
    start = F.greatest(F.lit(0).cast("long"), F.least(first["start"] - F.floor((length - width) / 2).cast("long"), n - length))
    out = lines.withColumn("clip_start", start).withColumn("clip_end", F.col("clip_start") + length)
    excerpt = F.substring(F.col("text").cast("binary"), (F.col("clip_start") + 1).cast("int"), length.cast("int"))
    return out.withColumns({"clipped_left": F.col("clip_start") > 0, "clipped_right": F.col("clip_end") < n, "excerpt": excerpt})


def merge_events(events: DataFrame, keep: tuple[str, ...] = ("key",)) -> DataFrame:
    """One event per line of several regions' events: match beats context, spans unite."""
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("submatches"))))
    return events.groupBy(*keep, "line").agg(F.max((F.col("kind") == "match").cast("int")).alias("m"), spans.alias("submatches")).select(*keep, "line", F.when(F.col("m") == 1, "match").otherwise("context").alias("kind"), "submatches")


def pattern_ids(lines: DataFrame, program: Program, text: str = "text") -> DataFrame:
    """(..., pattern) for each pattern that matches a line on its own."""
    which = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(k)) for k, p in enumerate(program.java_each))))
    return lines.withColumn("pattern", F.explode(which))
