"""Removal of long repeated strings by a suffix array over the whole corpus.

A symbol (a byte, or a word) is removed when some ``window``-symbol string that covers it starts
anywhere else as well.

*Which suffixes.* In every window the leftmost smallest hash of its K-symbol grams names an anchor.
Equal windows have their anchors at the same place, so a window can only repeat if the K symbols
at its anchor do. Anchors (about one in 64 symbols) whose gram occurs once in the corpus are
dropped by a packed exchange of gram hashes; exact copies of a text take part once.

*Sorting.* The suffixes at the remaining anchors are range-partitioned by their leading 64 bytes
with sampled splitters. Each bucket is sorted by multikey quicksort (an 8-byte word is a
character), which gives the common prefix of neighbours; the bytes before the anchors, reversed,
are sorted the same way. A window that starts o symbols before its anchor equals another if both
share o symbols to the left and ``window`` - o to the right: a pair of class numbers read off the two
sorts, bytes compared throughout.

*Across boundaries.* Splitters never part suffixes with equal leading bytes, so buckets have no
common window. Grams of very many anchors could fill a task. Their equal contexts (by SHA-256) are
compared first, by a grouped count: all windows of such contexts repeat, and one stands for them
from there on. Where over GROUP contexts of a gram are left, their windows are halved by
where they start, each half keeps the longer prefix that its windows share, equal contexts
combine again, and so on, until the groups fit a bucket; no window is in two halves.

Documents are told apart by 128 bits of their SHA-256. As words, texts are compared by 32-bit codes
of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import byte_codes, chunks, hash_of, mix, powers, prefix_hash, prefix_sums, word_codes
from ._exchange import find_shared
from ._shared import bounded_batches, materialize, release, shuffle_partitions, text_of, trimmed

WINDOW, STEP = 400, 128
#: Words of a passage (over 50), and how many window starts an anchor of words may serve.
PASSAGE_WORDS, PASSAGE_STEP = 51, 16
#: Anchors of a gram that may meet in one bucket.
GROUP = 2_000
#: Bytes of suffixes that a task sorts.
BUCKET_BYTES = 16 << 20
#: Bytes of a row that names equal contexts, and of a table of them that is broadcast.
EQUAL_BYTES, BROADCAST_BYTES = 100, 16 << 20
#: Bytes of a symbol by what texts are made of.
UNITS = {"bytes": 1, "words": 4}
_META = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sha", pa.string())])
_EMPTY = hashlib.sha256(b"").hexdigest()


def symbols(data: np.ndarray, offs: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, prefix sums of their hash, offsets of the texts in symbols)."""
    if unit == "bytes":
        return data, prefix_hash(data, byte_codes(False)), offs
    codes, offs = word_codes(data, offs)
    return codes, prefix_sums(mix(codes.astype(np.uint64) + np.uint64(1))), offs


def anchors(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray, window: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each run of windows that have the same anchor."""
    none = np.zeros(0, np.int64)
    k = window - step + 1
    count = len(data) - window + 1
    if count <= 0:
        return none, none, none
    _, down = powers(len(data) + 1)
    grams = (prefix[k:] - prefix[:-k]) * down[: len(data) - k + 1]
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    mask = (np.uint64(1) << bits) - np.uint64(1)
    least = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width < step:
        by = min(width, step - width)
        least = np.minimum(least[:-by], least[by:])
        width += by
    lengths = np.diff(offs)
    long = lengths >= window
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, offs[:-1][long], 1)
    np.add.at(edge, offs[1:][long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge)[:count] > 0)
    if not len(starts):
        return none, none, none
    at = (least[starts] & mask).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[new[1:], len(starts)] - 1
    return at[new], starts[new], starts[last]


def _text_key(text: bytes) -> tuple[str, int, int]:
    digest = hashlib.sha256(text)
    raw = digest.digest()
    return digest.hexdigest(), int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:16], "little", signed=True)


def _extract(window: int, step: int, unit: str):
    k = window - step + 1

    def run(batch: pa.RecordBatch):
        for lo, hi, data, offs in chunks(batch.column(2)):
            raw = data.tobytes()
            keys = [_text_key(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            data, prefix, offs = symbols(data, offs, unit)
            ids = (batch.column(c).slice(lo, hi - lo) for c in (0, 1))
            meta = pa.RecordBatch.from_arrays([*ids, pa.array(np.diff(offs)), pa.array([x[1] for x in keys], pa.int64()), pa.array([x[2] for x in keys], pa.int64()), pa.array([x[0] for x in keys])], schema=_META)
            at, first, last = anchors(data, offs, prefix, window, step)
            doc = np.searchsorted(offs, at, side="right") - 1
            own = np.array([x[1] for x in keys], dtype=np.int64).view(np.uint64)[doc]
            ext = ((at - offs[doc]) << 16) | ((at - first) << 8) | (at - last)
            yield meta, hash_of(prefix, at, at + k), own, ext.astype(np.uint64)

    return run


_CONTEXT = pa.schema([("hi", pa.int64()), ("at", pa.int64()), ("far", pa.int32()), ("near", pa.int32()), ("hot", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])
_CONTEXT_SQL = "hi long, at long, far int, near int, hot boolean, left binary, right binary"


def _contexts(window: int, unit: str):
    """The symbols around each anchor: ``far`` to ``near`` symbols before it start its windows."""
    width = UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py().encode()
                _, hi, lo = _text_key(text)
                if (hi, lo) != (batch.column("hi")[k].as_py(), batch.column("lo")[k].as_py()):
                    continue
                if unit == "words":
                    text = word_codes(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))[0].tobytes()
                for ext in np.frombuffer(b"".join(batch.column("extras")[k].as_py()), dtype=np.uint64).tolist():
                    hot, at, far, near = bool(ext >> 63), (ext >> 16) & ((1 << 47) - 1), (ext >> 8) & 255, ext & 255
                    if at - far < 0 or (at - near + window) * width > len(text):
                        continue
                    held.append((hi, at, far, near, hot, text[(at - far) * width : at * width], text[at * width : (at - near + window) * width]))
                    size += window * width
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), _CONTEXT, strict=True)], schema=_CONTEXT)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), _CONTEXT, strict=True)], schema=_CONTEXT)

    return run


def as_words(strings: list[bytes], width: int) -> np.ndarray:
    """Strings of at most ``width`` bytes, a multiple of 8, as rows of big-endian 64-bit words, padded with zeros."""
    packed = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=">u8")
    return packed.reshape(len(strings), width // 8).astype(np.uint64)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and the common prefix in bytes of each row with the one before it.

    Multikey quicksort whose character is a 64-bit word: a group of rows equal so far is parted
    by its next word, and only rows that still share a group go on to the word after.
    """
    n, width = words.shape
    order = np.arange(n)
    common = np.full(n, 8 * width, dtype=np.int64)
    if n:
        common[0] = 0
    group = np.zeros(n, dtype=np.int64)  # first place of the group that stands at a place
    places = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for d in range(width):
        if not len(places):
            break
        by = np.lexsort((words[order[places], d], group[places]))
        order[places] = order[places][by]
        value, own = words[order[places], d], group[places]
        parted = np.zeros(len(places), dtype=bool)
        parted[1:] = (own[1:] == own[:-1]) & (value[1:] != value[:-1])
        if parted.any():
            where = np.flatnonzero(parted)
            differ = value[where] ^ value[where - 1]
            lead = np.zeros(len(where), dtype=np.int64)
            for byte in range(1, 8):
                lead += differ < np.uint64(1) << np.uint64(64 - 8 * byte)
            common[places[where]] = 8 * d + lead
        edge = np.r_[True, (own[1:] != own[:-1]) | parted[1:]]
        run = np.cumsum(edge) - 1
        group[places] = places[edge][run]
        places = places[(np.bincount(run) > 1)[run]]
    return order, common


def repeated_windows(left: list[bytes], right: list[bytes], far: np.ndarray, near: np.ndarray, window: int, step: int, width: int = 1, text: np.ndarray | None = None) -> np.ndarray:
    """For each anchor and o < step: does the window that starts o symbols before it occur at another anchor as well.

    A symbol has ``width`` bytes. With ``text`` (of each anchor; below 0 for several at once) only occurrences in other texts count.
    """
    n = len(left)
    order, common = multikey_sort(as_words(right, -(-window * width // 8) * 8))
    back, shared = multikey_sort(as_words([s[::-1] for s in left], -(-step * width // 8) * 8))
    common, shared = common // width, shared // width
    found = np.zeros((n, step), dtype=bool)
    left_class = np.zeros(n, dtype=np.int64)
    low, high = far[order], near[order]
    for o in range(step):
        here = np.flatnonzero((high <= o) & (o <= low))
        if len(here) < 2:
            continue
        left_class[back] = np.cumsum(shared < o)
        right_class = np.cumsum(common < window - o)
        rows = order[here]
        pair = right_class[here] * np.int64(n + 1) + left_class[rows]
        by = np.argsort(pair, kind="stable") if text is None else np.lexsort((text[rows], pair))
        edge = np.flatnonzero(np.r_[True, pair[by][1:] != pair[by][:-1]])
        last = np.r_[edge[1:], len(by)] - 1
        twice = last > edge
        if text is not None:
            own = text[rows[by]]
            twice &= (own[edge] != own[last]) | (own[edge] < 0)
        found[rows[by[np.repeat(twice, last - edge + 1)]], o] = True
    return found


_SPAN = pa.schema([("hi", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SPAN_SQL = "hi long, start long, end long"


def _bucket(window: int, step: int, width: int, across: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        hi, at, far, near, many = (table.column(c).to_numpy() for c in ("hi", "at", "far", "near", "many"))
        text = np.where(many, -1, np.unique(hi, return_inverse=True)[1]) if across else None
        found = repeated_windows(table.column("left").to_pylist(), table.column("right").to_pylist(), far, near, window, step, width, text)
        step_up = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(step_up == 1)
        _, high = np.nonzero(step_up == -1)
        yield pa.RecordBatch.from_arrays([pa.array(hi[row]), pa.array(at[row] - (high - 1)), pa.array(at[row] - low + window)], schema=_SPAN)

    return run


def _halved(hot: DataFrame, window: int, step: int, width: int, group: int, across: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts of frequent grams: (spans found by comparing whole contexts, contexts of groups that fit a bucket).

    Rows of a cell hold the windows that start ``low`` to ``high`` symbols before their anchors; all of
    them share the ``core``: the last ``low`` symbols before the anchor and the first ``window - high`` from it.
    """
    spans, fitting = [], []
    rows = hot.withColumns({"low": F.lit(0), "high": F.lit(step - 1), "many": F.lit(False)})
    place = F.struct("hi", "at")
    while True:
        keyed = rows.withColumn("same", F.sha2(F.concat("left", "right"), 256))
        # counts are tables of their own, so that Spark splits the hot keys of the joins with them
        groups = materialize(keyed.groupBy("same", "far", "near").agg(F.min(place).alias("first"), F.count("*").alias("n"), ((F.min("hi") != F.max("hi")) | F.max("many")).alias("texts")))
        again = groups.where(F.col("n") > 1).where("texts" if across else "true").select(F.col("same").alias("same_"), F.col("far").alias("far_"), F.col("near").alias("near_"))
        again = F.broadcast(again) if again.count() * EQUAL_BYTES <= BROADCAST_BYTES else again  # beyond, the join shuffles and Spark splits its hot keys
        equal = keyed.select("hi", "at", "far", "near", "same").join(again, (F.col("same") == F.col("same_")) & (F.col("far") == F.col("far_")) & (F.col("near") == F.col("near_")))
        spans.append(equal.select("hi", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + window).alias("end")))
        firsts = groups.select(F.col("first.hi").alias("hi"), F.col("first.at").alias("at"), "far", "near", "texts")
        core = F.sha2(F.concat(F.expr(f"substring(left, length(left) - low * {width} + 1, low * {width})"), F.expr(f"substring(right, 1, ({window} - high) * {width})")), 256)
        single = materialize(rows.join(firsts, ["hi", "at", "far", "near"]).select("hi", "at", "far", "near", "left", "right", "low", "high", F.col("texts").alias("many"), core.alias("core")))
        sizes = materialize(single.groupBy("core", "low", "high").agg(F.count("*").alias("c")).where("c > 1"))
        sized = materialize(single.join(sizes, ["core", "low", "high"]).drop("core"))
        release(single, sizes)
        fitting.append(sized.where(F.col("c") <= group).select("hi", "at", "far", "near", "many", "left", "right"))
        large = sized.where(F.col("c") > group)
        if large.isEmpty():
            return spans, fitting
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))
        parts = large.withColumn("cell", F.explode(halves)).withColumns({"low": F.col("cell.low"), "high": F.col("cell.high")})
        parts = parts.where((F.col("near") <= F.col("high")) & (F.col("far") >= F.col("low")))
        parts = parts.withColumns({"far": F.least("far", "high"), "near": F.greatest("near", "low")})
        rows = parts.select("hi", "at", "far", "near", F.expr(f"substring(left, length(left) - far * {width} + 1, far * {width})").alias("left"), F.expr(f"substring(right, 1, ({window} - near) * {width})").alias("right"), "low", "high", "many")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    edge = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[edge], reach[np.r_[edge[1:], len(starts)] - 1]


_CUT_SQL = "hi long, lo long, spans array<struct<start:long,end:long>>, sha string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged ranges of each text, and where its bytes came along, the hash of what is left of them."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("spans", span), ("sha", pa.string())])
    for batch in batches:
        out: list[tuple] = []
        for k in range(batch.num_rows):
            hi, lo, sha = batch.column("hi")[k].as_py(), batch.column("lo")[k].as_py(), None
            ranges = batch.column("ranges")[k].as_py()
            starts, ends = merged(np.array([r["start"] for r in ranges], dtype=np.int64), np.array([r["end"] for r in ranges], dtype=np.int64))
            if "text" in batch.schema.names:
                text = batch.column("text")[k].as_py().encode()
                if (hi, lo) != _text_key(text)[1:]:
                    continue
                kept, last = hashlib.sha256(), 0
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    kept.update(text[last:a])
                    last = b
                kept.update(text[last:])
                sha = kept.hexdigest()
            out.append((hi, lo, [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], sha))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _find(docs: DataFrame, id_col: str, text_col: str, window: int, step: int, group: int, unit: str, across: bool) -> DataFrame:
    """(doc_id, key, size, spans, sha) for every row; ``sha`` hashes what is left of the bytes (null for words)."""
    if not 1 <= step <= 128 or step >= window:
        raise ValueError("step must be from 1 to 128 and below window")
    spark, width = docs.sparkSession, UNITS[unit]
    bounded_batches(spark)
    text = text_of(docs[text_col])
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    found = materialize(find_shared(source, _extract(window, step, unit), _META, extras=True, group_limit=group))
    rows = found.where("owner is null").select("doc_id", "key", "size", "hi", "lo", "sha")
    # the row of a class that stands for it is found again by id and by hash: rows without an id share only the former
    classes = materialize(rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("key").alias("rep_key"), F.count("*").alias("copies"), F.max("size").alias("size")))
    same: Column = F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("rep_key") == F.col("key"))
    places = found.where("owner is not null").groupBy("owner").agg(F.collect_list("extras").alias("extras"))
    near = classes.join(places, classes.hi == places.owner).select("rep", "rep_key", "hi", "lo", "extras")
    texts = near.join(source, same).select("hi", "lo", "extras", "text")
    context = materialize(texts.mapInArrow(trimmed(_contexts(window, unit)), _CONTEXT_SQL))

    hot = context.where("hot")
    work = context.where("not hot").withColumn("many", F.lit(False)).select("hi", "at", "far", "near", "many", "left", "right")
    spans = []
    if not hot.isEmpty():
        spans, fitting = _halved(hot.drop("hot"), window, step, width, group, across)
        for part in fitting:
            work = work.unionByName(part)
    weight = work.agg(F.sum(F.length("left") + F.length("right"))).first()[0]
    parts = max(shuffle_partitions(spark), -(-int(weight or 0) // BUCKET_BYTES))
    lead = F.substring("right", 1, min(64, (window - step + 1) * width))
    each = work.repartitionByRange(parts, lead).mapInArrow(trimmed(_bucket(window, step, width, across)), _SPAN_SQL)
    for more in spans:
        each = each.unionByName(more)
    each = materialize(each)
    release(context)
    ranges = each.groupBy(F.col("hi").alias("at")).agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    partly = classes.where("copies = 1").join(ranges, F.col("hi") == F.col("at")).select("rep", "rep_key", "hi", "lo", "ranges")
    if unit == "bytes":
        partly = partly.join(source, same).select("hi", "lo", "ranges", "text")
    cut = partly.drop("rep", "rep_key").mapInArrow(trimmed(_cut), _CUT_SQL)
    full = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))
    gone = classes.where((F.col("copies") > 1) & (F.col("size") >= window)).select("hi", "lo", full.alias("spans"), F.lit(_EMPTY).alias("sha"))
    answer = materialize(cut.unionByName(gone))
    release(each, classes)
    answer = answer.select(F.col("hi").alias("hi_"), F.col("lo").alias("lo_"), "spans", F.col("sha").alias("rest"))
    joined = rows.join(answer, (F.col("hi") == F.col("hi_")) & (F.col("lo") == F.col("lo_")), "left")
    nothing = F.array().cast("array<struct<start:long,end:long>>")
    out = materialize(joined.select("doc_id", "key", "size", F.coalesce("spans", nothing).alias("spans"), F.coalesce("rest", "sha").alias("sha")))
    release(found)
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, step: int = STEP, group: int = GROUP) -> DataFrame:
    """(doc_id, key, n_bytes, spans, kept_sha256) for every row: its removed byte ranges and the hash of the rest; ``key`` hashes its text.

    ``spans`` lists maximal runs of removed bytes as half-open (start, end). ``step`` is how many
    window starts an anchor may serve (at most 128, below ``window``).

    - Null texts count as empty; texts shorter than ``window`` bytes lose nothing.
    - Texts that occur more than once (repeated rows included) are removed whole, if long enough.
    - Rows with null ids take part and get a row; other columns, whatever their names, are ignored.
    - An empty table gives an empty result.
    """
    found = _find(docs, id_col, text_col, window, step, group, "bytes", False)
    return found.select("doc_id", "key", F.col("size").alias("n_bytes"), "spans", F.col("sha").alias("kept_sha256"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS, step: int = PASSAGE_STEP, group: int = GROUP) -> DataFrame:
    """(doc_id, key, n_words, spans) for every row: its runs of words that lie in a ``words``-word string of another row too.

    The same suffix sort, with words (runs without white space, as they are) for symbols. ``spans`` are
    half-open ranges of word numbers. What is repeated in one text alone does not count; the rest is as in
    :func:`repeated_spans`.
    """
    found = _find(docs, id_col, text_col, words, step, group, "words", True)
    return found.select("doc_id", "key", F.col("size").alias("n_words"), "spans")
