"""Grams of byte strings: trigrams, blocks, sparse grams, and the choice between them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128 << 10
MAX_SPARSE = 64


def pack(gram: bytes) -> int:
    """A trigram as a 24-bit number, a longer gram as a 32-bit hash above all trigrams."""
    if len(gram) == 3:
        return int.from_bytes(gram, "big")
    return (1 << 32) | (_fnv(gram) & ((1 << 32) - 1))


def _fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 29
    return (h * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) ^ (h >> 32)


def trigrams_of(data: bytes) -> list[bytes]:
    """Distinct overlapping 3-byte windows, sorted; none below 3 bytes."""
    return sorted({data[i : i + 3] for i in range(len(data) - 2)})


def pair_weights() -> np.ndarray:
    """A pseudo-random 32-bit weight for each pair of bytes."""
    x = np.arange(65536, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.int64)


_WEIGHTS = pair_weights()


def _weights(data: bytes) -> list[int]:
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    return _WEIGHTS[raw[:-1] * 256 + raw[1:]].tolist()


def sparse_grams(data: bytes, limit: int = MAX_SPARSE) -> list[bytes]:
    """All sparse grams of an indexed text: every pair, and each longer stretch whose inner pairs weigh
    less than both of its end pairs."""
    if len(data) < 2:
        return []
    weight = _weights(data)
    out = set()
    for i in range(len(weight)):
        out.add(data[i : i + 2])
        inner = -1
        for j in range(i + 1, min(len(weight), i + limit - 1)):
            if weight[i] > inner and weight[j] > inner:
                out.add(data[i : j + 2])
            inner = max(inner, weight[j])
            if inner >= weight[i]:
                break
    return sorted(out)


def _hashed(h: np.ndarray) -> np.ndarray:
    """:func:`pack` of grams other than trigrams, from their running hashes."""
    h = h ^ (h >> np.uint64(29))
    h = (h * np.uint64(0xBF58476D1CE4E5B9)) ^ (h >> np.uint64(32))
    return ((h & np.uint64((1 << 32) - 1)) | np.uint64(1 << 32)).astype(np.int64)


def sparse_codes(data: bytes, limit: int = MAX_SPARSE) -> np.ndarray:
    """The packed :func:`sparse_grams`, distinct and sorted: all starts grow by a byte at a time."""
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw) - 1  # pairs
    if n < 1:
        return np.zeros(0, np.int64)
    wide, prime = raw.astype(np.uint64), np.uint64(0x100000001B3)
    weight = _WEIGHTS[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    at, h = np.arange(n), (np.uint64(0xCBF29CE484222325) ^ wide[:-1]) * prime
    h = (h ^ wide[1:]) * prime
    inner, out = np.full(n, -1, np.int64), [np.unique(_hashed(h))]
    for d in range(1, limit - 1):
        live = (at + d < n) & (inner < weight[at])
        at, h, inner = at[live], h[live], inner[live]
        if not len(at):
            break
        h = (h ^ wide[at + d + 1]) * prime
        last = weight[at + d]
        whole = last > inner
        if d == 1:
            i = at[whole]
            out.append((raw[i].astype(np.int64) << 16) | (raw[i + 1].astype(np.int64) << 8) | raw[i + 2])
        else:
            out.append(_hashed(h[whole]))
        inner = np.maximum(inner, last)
    return np.unique(np.concatenate(out))


def covering_grams(data: bytes, limit: int = MAX_SPARSE) -> list[bytes]:
    """Few sparse grams that cover a literal, each of them among :func:`sparse_grams` of any text around it."""
    if len(data) < 2:
        return []
    weight = _weights(data)
    out, at = set(), 0
    while at < len(weight):  # the longest stretch from here, then on from its last pair
        best, inner = at, -1
        for j in range(at + 1, min(len(weight), at + limit - 1)):
            if weight[at] > inner and weight[j] > inner:
                best = j
            inner = max(inner, weight[j])
            if inner >= weight[at]:
                break
        out.add(data[at : best + 2])
        if best + 1 >= len(weight):
            break
        at = best if best > at else at + 1
    return sorted(out)


def block_grams(blocks: DataFrame, strategy: str = "trigram", carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry..., gram, doc_id, block) of each distinct gram of rows (doc_id, block, bytes), by Arrow batches.

    ``carry`` names string columns to repeat, so that postings need no join to get them back."""
    schema = pa.schema([*((c, pa.string()) for c in carry), ("gram", pa.int64()), ("doc_id", pa.int64()), ("block", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = [batch.column(c) for c in carry]
            for k, (doc, block, data) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), batch.column("bytes"), strict=True)):
                raw = data.as_buffer()
                if strategy == "trigram":
                    b = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
                    gram = np.unique((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) if len(b) > 2 else b[:0]
                else:
                    gram = sparse_codes(raw)
                same = [pa.array([c[k].as_py()] * len(gram), pa.string()) for c in extra]
                yield pa.RecordBatch.from_arrays([*same, pa.array(gram), pa.array(np.full(len(gram), doc, np.int64)), pa.array(np.full(len(gram), block, np.int32))], schema=schema)

    names = "".join(f"{c} string, " for c in carry)
    return blocks.select(*carry, "doc_id", "block", "bytes").mapInArrow(run, f"{names}gram long, doc_id long, block int")


def _codes(texts: list[bytes], strategy: str) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) of the packed grams of texts laid end to end; one that repeats in a text comes again."""
    offs = np.r_[0, np.cumsum([len(t) for t in texts])]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offs))
    stop = (offs[1:].astype(np.int32) - 1)[row]  # of a start's pairs
    if strategy == "trigram":
        at, wide = np.flatnonzero(np.arange(1, len(raw) + 1) < stop), raw.astype(np.int64)
        return (wide[at] << 16) | (wide[at + 1] << 8) | wide[at + 2], row[at]
    wide, prime = raw.astype(np.uint64), np.uint64(0x100000001B3)
    weight = _WEIGHTS[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    at = np.flatnonzero(np.arange(len(raw), dtype=np.int32) < stop).astype(np.int32)
    h = (((np.uint64(0xCBF29CE484222325) ^ wide[at]) * prime) ^ wide[at + 1]) * prime
    first, inner, stop, grams, rows = weight[at], np.full(len(at), -1, np.int64), stop[at], [_hashed(h)], [row[at]]
    for d in range(1, MAX_SPARSE - 1):
        live = np.flatnonzero((at + d < stop) & (inner < first))
        if not len(live):
            break
        at, h, inner, first, stop = at[live], h[live], inner[live], first[live], stop[live]
        h = (h ^ wide[at + (d + 1)]) * prime
        last = weight[at + d]
        whole = np.flatnonzero(last > inner)
        i = at[whole]
        grams.append(((raw[i].astype(np.int64) << 16) | (raw[i + 1].astype(np.int64) << 8) | raw[i + 2]) if d == 1 else _hashed(h[whole]))
        rows.append(row[i])
        inner = np.maximum(inner, last)
    return np.concatenate(grams), np.concatenate(rows)


#: Fixed values of stored postings: bytes of text and number of blocks that end a run, bits of a place, bytes of text whose grams one step takes, grams of a chunk.
RUN_BYTES, RUN_PLACES, PLACE_BITS, RUN_STEP, CHUNK = 16 << 20, 1 << 18, 20, 1 << 18, 4_096


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    new = keys[1:] != keys[:-1]
    return keys if new.all() else keys[np.r_[True, new]]


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers by their lowest bytes, then their next ones, and so on, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1) if len(values) else b""


def _expand(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(size, -1) if data else np.zeros((size, 0), np.uint8)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def encode_chunk(gram: np.ndarray, n: np.ndarray, gaps: np.ndarray) -> bytes:
    """Sorted grams, how many places each has, and the gaps between its places; gaps of lists of about one length are kept together."""
    kind = np.frexp(n)[1]
    own = np.repeat(kind, n)
    parts = [_squeeze(np.diff(gram, prepend=0)), _squeeze(n.astype(np.uint32)), *(_squeeze(gaps[own == k]) for k in range(1, kind.max() + 1))]
    return np.array([len(parts), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def decode_chunk(data: bytes, codes: np.ndarray, places: bool = True) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """(gram, how many places, places) of those of ``codes`` that a chunk has."""
    head = np.frombuffer(data, np.uint32, 1 + int(np.frombuffer(data, np.uint32, 1)[0])).astype(np.int64)
    ends = 4 * len(head) + np.cumsum(head[1:])
    part = lambda k: data[ends[k] - head[k + 1] : ends[k]]
    gram, n = np.cumsum(_expand(part(0), np.int64)), _expand(part(1), np.uint32).astype(np.int64)
    kind, lists = np.frexp(n)[1], {}
    for k in np.flatnonzero(np.isin(gram, codes)).tolist():
        if not places:
            yield int(gram[k]), int(n[k]), None
            continue
        own = int(kind[k])
        if own not in lists:
            lists[own] = _expand(part(1 + own), np.uint32).astype(np.int64)
        start = int(n[:k][kind[:k] == own].sum())
        yield int(gram[k]), int(n[k]), np.cumsum(lists[own][start : start + n[k]] + 1) - 1


def encode_run(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """(lowest gram, highest gram, data) of chunks of sorted distinct keys, a gram above the ``bits`` bits of a place."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] >> bits) != (keys[:-1] >> bits)]) if len(keys) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(keys)]
    for at in range(0, len(starts), CHUNK):
        own, to = starts[at : at + CHUNK], ends[at : at + CHUNK]
        lo = own[0]
        place = keys[lo : to[-1]] & ((1 << bits) - 1)
        gaps = np.diff(place, prepend=-1) - 1
        gaps[own - lo] = place[own - lo]
        gram = keys[own] >> bits
        yield int(gram[0]), int(gram[-1]), encode_chunk(gram, to - own, gaps.astype(np.uint32))


POSTINGS = "run long, low long, high long, data binary, doc_ids array<long>, blocks array<int>"


def stored_postings(content: DataFrame, strategy: str) -> DataFrame:
    """Postings of rows (doc_id, block, bytes) as a segment keeps them, without a shuffle.

    The blocks that a worker reads one after the other form runs of RUN_BYTES. A run has a row with its places (``low`` is -1), then rows of up to
    CHUNK neighbouring grams with the numbers of their places."""
    schema = pa.schema([*((c, pa.int64()) for c in ("run", "low", "high")), ("data", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int32()))])

    def rows(values: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*values, strict=True), schema, strict=True)], schema=schema)

    def close(parts: list[np.ndarray], docs: list[int], blocks: list[int]) -> Iterator[pa.RecordBatch]:
        run, held, size = uuid.uuid4().int >> 65, [], 0
        yield rows([(run, -1, -1, None, docs, blocks)])
        keys = np.concatenate(parts)
        parts.clear()
        for chunk in encode_run(_distinct(keys), PLACE_BITS):
            held.append((run, *chunk, None, None))
            size += len(chunk[2])
            if size >= _STEP:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, blocks, size = [], [], [], 0
        texts, own, held = [], [], 0

        def step() -> None:
            gram, row = _codes(texts, strategy)
            parts.append(_distinct((gram << PLACE_BITS) | np.array(own, np.int64)[row]))
            texts.clear()
            own.clear()

        for batch in batches:
            for doc, block, data in zip(batch.column("doc_id").to_pylist(), batch.column("block").to_pylist(), batch.column("bytes"), strict=True):
                docs.append(doc)
                blocks.append(block)
                whole = data.as_py() or b""
                for at in range(0, len(whole), RUN_STEP):  # a gram lies in a piece, as pieces overlap by the longest one
                    texts.append(whole[at : at + RUN_STEP + MAX_SPARSE - 1])
                    own.append(len(docs) - 1)
                    held += len(texts[-1])
                    if held >= RUN_STEP:
                        step()
                        size, held = size + held, 0
                if size >= RUN_BYTES or len(docs) >= RUN_PLACES:
                    if texts:
                        step()
                    yield from close(parts, docs, blocks)
                    docs, blocks, size, held = [], [], 0, 0
        if texts:
            step()
        if parts:
            yield from close(parts, docs, blocks)

    return content.select("doc_id", "block", "bytes").mapInArrow(run, POSTINGS)


#: Ranges of grams that chunks are chosen by, at most.
_RANGES = 100


def _covered(stored: DataFrame, codes: np.ndarray) -> DataFrame:
    """Chunks that may hold one of the codes."""
    near = [(int(c[0]), int(c[-1])) for c in np.array_split(codes, min(len(codes), _RANGES))] if len(codes) else []
    return stored.where((F.col("low") >= 0) & reduce(lambda a, b: a | b, [(F.col("low") <= hi) & (F.col("high") >= lo) for lo, hi in near], F.lit(False)))


def found_counts(stored: DataFrame, codes: list[int]) -> DataFrame:
    """(gram, n): how many places each of the codes has, by run."""
    wanted = np.array(sorted(codes), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[:2] for data in batch.column("data") for x in decode_chunk(data.as_py(), wanted, False)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["gram", "n"])

    return _covered(stored, wanted).select("data").mapInArrow(run, "gram long, n long")


def found_postings(stored: DataFrame, codes: list[int]) -> DataFrame:
    """(gram, doc_id, block) of the codes."""
    schema = pa.schema([("run", pa.int64()), ("gram", pa.int64()), ("at", pa.list_(pa.int32()))])
    wanted = np.array(sorted(codes), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, data in zip(batch.column("run").to_pylist(), batch.column("data"), strict=True):
                found = list(decode_chunk(data.as_py(), wanted))
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[2] for x in found], schema.field("at").type)], schema=schema)

    hits = _covered(stored, wanted).select("run", "data").mapInArrow(run, "run long, gram long, at array<int>")
    places = stored.where("low = -1").select("run", "doc_ids", "blocks")
    each = F.transform("at", lambda k: F.struct(F.get("doc_ids", k).alias("doc_id"), F.get("blocks", k).alias("block")))
    return hits.join(places, "run").select("gram", F.explode(each).alias("place")).select("gram", "place.*")


#: Bytes of text whose sparse grams one step takes together, and of postings that leave a worker at once.
_STEP = 1 << 20


def _stretches(weight: np.ndarray, stop: np.ndarray, limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of all :func:`sparse_grams` of texts laid end to end; ``stop`` is the end of each start's pairs."""
    at = np.flatnonzero(np.arange(len(stop)) < stop)
    yield 2, at
    inner = np.full(len(at), -1, np.int64)
    for d in range(1, limit - 1):
        live = (at + d < stop[at]) & (inner < weight[at])
        at, inner = at[live], inner[live]
        if not len(at):
            return
        last = weight[at + d]
        yield d + 2, at[last > inner]
        inner = np.maximum(inner, last)


def _covering(stretches: Iterator[tuple[int, np.ndarray]], offs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Those of :func:`covering_grams`: the longest stretch from a start, then on from its last pair."""
    best = np.arange(offs[-1])
    for length, at in stretches:
        best[at] = at + length - 2
    on, taken = best.tolist(), []
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        at = lo
        while at < hi - 1:
            taken.append(at)
            if on[at] + 1 >= hi - 1:
                break
            at = on[at] if on[at] > at else at + 1
    starts = np.array(taken, np.int64)
    length = best[starts] - starts + 2
    for n in np.unique(length).tolist():
        yield n, starts[length == n]


def document_grams(docs: DataFrame, covering: bool = False, limit: int = MAX_SPARSE) -> DataFrame:
    """(doc_id, gram binary) of each distinct sparse gram, or covering gram, of rows (doc_id, text), many texts at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("gram", pa.binary())])

    def grams(ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        offs = np.r_[0, np.cumsum([len(t) for t in texts])]
        raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        row = np.repeat(np.arange(len(texts), dtype=np.uint32), np.diff(offs))
        weight = _WEIGHTS[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        found = _stretches(weight, (offs[1:] - 1)[row], limit)
        for length, at in _covering(found, offs) if covering else found:
            own = np.concatenate([row[at].view(np.uint8).reshape(-1, 4), raw[at[:, None] + np.arange(length)]], axis=1)
            each = pc.unique(pa.Array.from_buffers(pa.binary(4 + length), len(at), [None, pa.py_buffer(own)]))
            if len(each):
                own = np.frombuffer(each.buffers()[1], dtype=np.uint8)[: len(each) * (4 + length)].reshape(-1, 4 + length)
                ends = pa.py_buffer((np.arange(len(each) + 1) * length).astype(np.int32))
                gram = pa.Array.from_buffers(pa.binary(), len(each), [None, ends, pa.py_buffer(own[:, 4:].copy())])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[:, :4].copy().view(np.uint32).ravel())), gram], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size, first = batch.column("doc_id"), [], 0, 0
            for k, text in enumerate(batch.column("bytes")):
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= _STEP or k + 1 == len(ids):
                    if size:
                        yield from grams(ids.slice(first, len(texts)), texts)
                    texts, size, first = [], 0, k + 1

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("bytes")).mapInArrow(run, "doc_id long, gram binary")


def trigram_blocks(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows (doc_id, block, bytes) for :func:`block_grams` of (doc_id, text): a trigram belongs to the block of its first byte."""
    last = F.floor(F.greatest(F.octet_length("text") - 3, F.lit(0)) / size).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), F.explode(F.sequence(F.lit(0), last)).alias("block"), F.col("text").cast("binary").alias("bytes"))
    return rows.select("doc_id", "block", F.substring("bytes", F.col("block") * size + 1, F.lit(size + 2)).alias("bytes"))


def trigram_hex(data: Column) -> Column:
    """Distinct trigrams of a binary column as upper-case hex, by SQL functions."""
    windows = F.transform(F.sequence(F.lit(1), F.octet_length(data) - 2), lambda i: F.hex(F.substring(data, i, 3)))
    return F.when(F.octet_length(data) >= 3, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def block_trigram_hex(data: Column, size: int = BLOCK) -> Column:
    """Distinct (block, trigram) pairs; a trigram belongs to the block of its first byte."""
    at = F.sequence(F.lit(1), F.octet_length(data) - 2)
    pairs = F.transform(at, lambda i: F.struct(F.floor((i - 1) / F.lit(size)).cast("int").alias("block"), F.hex(F.substring(data, i, 3)).alias("gram")))
    return F.when(F.octet_length(data) >= 3, F.array_distinct(pairs)).otherwise(F.array().cast("array<struct<block:int,gram:string>>"))


#: The prose test (sample size; shares of letters and blanks, of structural signs, of digits; the signs).
PROSE_MIN, PROSE_TEXT, PROSE_SIGNS, PROSE_DIGITS = 256, 0.85, 0.04, 0.03
_SIGNS = r"[{}\[\]\":,=<>();_/\\]"


def prose_ratios(text: Column) -> dict[str, Column]:
    """Byte counts that decide whether a text is prose: ASCII letters and blanks, structural signs, digits, all."""

    def count(pattern: str) -> Column:
        return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))).cast("long")

    return {"text": count(r"[A-Za-z \t\r\n]"), "signs": count(_SIGNS), "digits": count("[0-9]"), "total": F.octet_length(text).cast("long")}


def is_prose(text: Column) -> Column:
    """Null for samples under PROSE_MIN bytes."""
    n = prose_ratios(text)
    share = lambda c: n[c] / n["total"]
    fits = (share("text") >= PROSE_TEXT) & (share("signs") <= PROSE_SIGNS) & (share("digits") <= PROSE_DIGITS)
    return F.when(n["total"] >= PROSE_MIN, fits)


def strided(docs: DataFrame, key: str, samples: int = 16) -> DataFrame:
    """``samples`` rows or so, evenly strided over the order of the keys: a distributed sort, ranks from the partitions' counts."""
    ordered = docs.orderBy(key).withColumn("at_", F.monotonically_increasing_id()).persist()
    part = F.shiftrightunsigned("at_", 33)
    counts = {r["p"]: r["n"] for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    stride = max(1, sum(counts.values()) // samples)
    base, chosen = 0, []
    for p in sorted(counts):
        chosen += [(p << 33) + at - base for at in range(-(-base // stride) * stride, base + counts[p], stride) if at < stride * samples]
        base += counts[p]
    out = ordered.where(F.col("at_").isin(chosen)).drop("at_")
    rows = docs.sparkSession.createDataFrame(out.collect(), out.schema)  # ``samples`` rows
    ordered.unpersist()
    return rows


def pick_strategy(docs: DataFrame, key: str, text: str, samples: int = 16) -> DataFrame:
    """One row (strategy, prose_bytes, sampled_bytes): sparse if two thirds of the sampled bytes are prose.

    The sample is evenly strided over the keys; only as many rows as ``samples`` leave the scan.
    """
    chosen = strided(docs.select(key), key, samples)
    sampled = docs.join(F.broadcast(chosen), key).select(F.substring(F.col(text), 1, 256 << 10).alias("t")).select(is_prose(F.col("t")).alias("prose"), F.octet_length("t").cast("long").alias("n"))
    sums = sampled.where("prose is not null").agg(F.coalesce(F.sum(F.when(F.col("prose"), F.col("n")).otherwise(0)), F.lit(0)).alias("prose_bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("sampled_bytes"))
    return sums.select(F.when((F.col("sampled_bytes") > 0) & (3 * F.col("prose_bytes") >= 2 * F.col("sampled_bytes")), "sparse").otherwise("trigram").alias("strategy"), "prose_bytes", "sampled_bytes")
