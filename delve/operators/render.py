"""Results as text: grep lines, JSON messages, counts, windows, and their exit code."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standard_column(numbers: bool = True) -> Column:
    """``key:line:text`` for matches, ``key-line-text`` for context."""
    mark = F.when(F.col("kind") == "match", ":").otherwise("-")
    return F.concat("key", mark, F.col("line").cast("string"), mark, "text") if numbers else F.concat("key", mark, "text")


def binary_notices(lines: DataFrame) -> DataFrame:
    """(key, offset) of the first NUL in the output lines of each document."""
    at = F.instr(F.col("text"), "\0")
    place = F.octet_length(F.substring_index("text", "\0", 1)).cast("long") + F.col("offset")
    return lines.where(at > 0).groupBy("key").agg(F.min(place).alias("offset"))


def json_text(text: Column) -> Column:
    """Valid UTF-8 as text, anything else as base64."""
    return F.when(F.is_valid_utf8(text), F.to_json(F.struct(text.alias("text")))).otherwise(F.to_json(F.struct(F.base64(text.cast("binary")).alias("bytes"))))


def json_events(events: DataFrame) -> DataFrame:
    """(key, line, message): one JSON message per event (key, line, kind, offset, text, submatches)."""
    path = F.struct(F.col("key").alias("text"))
    data = F.struct(path.alias("path"), F.struct(F.concat("text", F.lit("\n")).alias("text")).alias("lines"), F.col("line").alias("line_number"), F.col("offset").alias("absolute_offset"), "submatches")
    return events.select("key", "line", F.to_json(F.struct(F.col("kind").alias("type"), data.alias("data"))).alias("message"))


def json_lines(events: Iterable, searched: int = 0) -> Iterator[str]:
    """begin, match, context, end and summary messages of rows ordered by key and line."""

    def text(value: str) -> dict:
        try:
            value.encode()
            return {"text": value}
        except UnicodeEncodeError:
            return {"bytes": base64.b64encode(value.encode("utf-8", "surrogateescape")).decode()}

    last, matches, total, documents = None, 0, 0, 0
    for r in events:
        if r["key"] != last:
            if last is not None:
                yield json.dumps({"type": "end", "data": {"path": text(last), "stats": {"matched_lines": matches}}})
            yield json.dumps({"type": "begin", "data": {"path": text(r["key"])}})
            last, matches, documents = r["key"], 0, documents + 1
        if r["kind"] == "match":
            matches += 1
            total += 1
        raw = r["text"].encode("utf-8", "surrogateescape")
        spans = [{"match": text(raw[s["start"] : s["end"]].decode("utf-8", "surrogateescape")), "start": s["start"], "end": s["end"]} for s in r["submatches"]]
        yield json.dumps({"type": r["kind"], "data": {"path": text(r["key"]), "lines": text(r["text"] + "\n"), "line_number": r["line"], "absolute_offset": r["offset"], "submatches": spans}})
    if last is not None:
        yield json.dumps({"type": "end", "data": {"path": text(last), "stats": {"matched_lines": matches}}})
    yield json.dumps({"type": "summary", "data": {"documents": documents, "matched_lines": total, "searched": searched}})


def _painted(text: str, spans: list, color: bool) -> str:
    if not color or not spans:
        return text
    raw, out, at = text.encode("utf-8", "surrogateescape"), [], 0
    for s in spans:
        out += [raw[at : s["start"]], b"\x1b[1;31m", raw[s["start"] : s["end"]], b"\x1b[0m"]
        at = s["end"]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogateescape")


def standard_lines(events: Iterable, numbers: bool = True, column: bool = False, heading: bool = False, context: bool = False, color: bool = False, binary: bool = False) -> Iterator[str]:
    """Grep output of rows ordered by key and line; a document with a NUL in its output shows a notice instead."""
    last_key, last_line, muted = None, 0, None
    for r in events:
        key, line = r["key"], r["line"]
        if key == muted:
            continue
        if not binary and "\0" in r["text"]:
            muted = key
            yield f"{key}: binary content at offset {r['offset'] + len(r['text'].split(chr(0))[0].encode('utf-8', 'surrogateescape'))}, output suppressed"
            continue
        if heading and key != last_key:
            if last_key is not None:
                yield ""
            yield key
        if context and last_key is not None and (key != last_key and not heading or key == last_key and line > last_line + 1):
            yield "--"
        mark = ":" if r["kind"] == "match" else "-"
        parts = ([] if heading else [key]) + ([str(line)] if numbers else [])
        if column and r["kind"] == "match":
            parts.append(str(r["submatches"][0]["start"] + 1 if r["submatches"] else 1))
        yield mark.join([*parts, _painted(r["text"], r["submatches"] if r["kind"] == "match" else [], color)])
        last_key, last_line = key, line


def window_lines(windows: Iterable) -> Iterator[str]:
    """Clips with ``…`` where the line goes on."""
    for r in windows:
        text = bytes(r["excerpt"]).decode("utf-8", "replace")
        yield f"{r['key']}:{r['line']}:{'…' if r['clipped_left'] else ''}{text}{'…' if r['clipped_right'] else ''}"


def stats_line(stats: dict) -> str:
    return f"{stats['hits']:,} hits, {stats['candidates']:,} candidates of {stats['total']:,} documents, {stats['bytes'] / 2**20:,.1f} MiB verified, {stats['excluded']:,} excluded"


def exit_code(found: bool, failed: bool) -> int:
    """2 after an error, 0 if something was found, else 1."""
    return 2 if failed else 0 if found else 1
