"""Secret scan: named patterns, and a battery of randomness tests for strings without a name.

A candidate is a run of 20 or more of ``A-Z a-z 0-9 + / _ -`` that has both letters and digits.
Its encoding is the smallest alphabet that holds it. Over that alphabet's symbols, numbered by how
frequent they are in the corpus, three tests ask for random text: chi-squared uniformity, the number of runs above
and below the middle, and serial correlation. Fisher's method combines them to a score, which is
near 1 for a random string, and the smaller the more text-like a string is.

*False discoveries.* The hypothesis is "the string is text". Its distribution is the corpus's own: the
symbols of each document, those of candidates and other signs left out, are cut into windows of the lengths REFERENCE, given
a number of one to NUMBER digits at their end, as candidates have letters and digits, and
scored like them. A candidate's p-value is the share of windows of its encoding, of the
largest length within its own, that score as high or higher. Over all candidates a weighted
Benjamini-Hochberg step-up rejects the hypothesis, weights being length over mean length, as longer
strings say more; what is rejected is reported as random, with ``rate`` bounding the expected share
of text among it.

A run that mixes ``+ /`` with ``- _`` fits no encoding: its longest parts without
the one pair and those without the other are candidates, and two of them may overlap.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import chunks, mix, spans, table
from ._shared import bounded_batches, materialize, text_of

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api")
_HEX_CLASS = table(bytes(set(range(256)) - set(b"0123456789abcdef")))
_RUN_CLASS = table(bytes(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")))
_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: The encodings and their symbols in order.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UP + "234567"),
    ("base36", _DIGITS + _LOW),
    ("BASE36", _DIGITS + _UP),
    ("base62", _DIGITS + _UP + _LOW),
    ("base64", _UP + _LOW + _DIGITS + "+/"),
    ("base64url", _UP + _LOW + _DIGITS + "-_"),
)
MIN_RUN = 20
_PARTS = tuple(re.compile(f"[A-Za-z0-9{pair}]{{{MIN_RUN},}}") for pair in ("+/", "_-"))
#: Lengths of the windows of text that candidates are held against, and the fewest windows of an encoding; else all encodings count.
REFERENCE, ENOUGH, NUMBER = (20, 28, 40, 64), 1_000, 4
_BINS = 600  # of -log10 of a score or of p / weight, 0.05 wide
_HOLDS = np.zeros(256, dtype=np.uint8)  # a bit for each encoding that has the byte
for _k, (_, _symbols) in enumerate(ENCODINGS):
    _HOLDS[list(_symbols.encode())] |= 1 << _k
_FIRST = np.array([(v & -v).bit_length() - 1 for v in range(256)])  # the smallest alphabet, -1 for none


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points: leftmost non-overlapping matches of each kind, those too short dropped."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def encoding(run: str) -> int | None:
    """The place in ENCODINGS of the smallest alphabet that holds the run; none for runs without a letter or without a digit."""
    if not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
        return None
    found = int(_FIRST[np.bitwise_and.reduce(_HOLDS[np.frombuffer(run.encode(), dtype=np.uint8)])])
    return None if found < 0 else found


def ranks(counts: np.ndarray) -> list[np.ndarray]:
    """For each encoding, the number of each byte: its symbols by falling frequency."""
    out = []
    for _, text in ENCODINGS:
        members = np.frombuffer(text.encode(), dtype=np.uint8)
        table_ = np.zeros(256, dtype=np.int64)
        table_[members[np.argsort(-counts[members], kind="stable")]] = np.arange(len(members))
        out.append(table_)
    return out


def parts(run: str) -> list[tuple[int, int]]:
    """The run, or if it mixes ``+ /`` with ``- _``, its parts without the one or the other, those inside another dropped."""
    if not ({*"+/"} & set(run) and {*"-_"} & set(run)):
        return [(0, len(run))]
    out: list[tuple[int, int]] = []
    for start, end in sorted({m.span() for p in _PARTS for m in p.finditer(run)}, key=lambda x: (x[0], -x[1])):
        if not out or end > out[-1][1]:
            out.append((start, end))
    return out


def _erfc(z: np.ndarray) -> np.ndarray:
    """The complementary error function for z >= 0, to a relative error of 1e-6 (a rational fit)."""
    t = 1 / (1 + 0.5 * z)
    fit = (1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    return t * np.exp(-z * z - 1.26551223 + sum(c * t ** (k + 1) for k, c in enumerate(fit)))


def _tail(z: np.ndarray) -> np.ndarray:
    """P(a standard normal exceeds z)."""
    half = 0.5 * _erfc(np.abs(z) / math.sqrt(2))
    return np.where(z >= 0, half, 1 - half)


def battery(codes: np.ndarray, alphabet: int) -> np.ndarray:
    """Scores of rows of codes below ``alphabet``: p-values of "uniformly random", of the three tests by Fisher's method."""
    codes = np.atleast_2d(codes)
    rows, n = codes.shape
    groups = max(2, min(alphabet, n // 5))
    part = codes * groups // alphabet
    share = np.bincount(np.arange(alphabet) * groups // alphabet, minlength=groups) / alphabet
    seen = np.bincount((part + groups * np.arange(rows)[:, None]).ravel(), minlength=rows * groups).reshape(rows, groups)
    chi = ((seen - n * share) ** 2 / (n * share)).sum(axis=1)
    dof = groups - 1
    p = [_tail(((chi / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof)))]  # cube-root normal approximation
    above = codes >= alphabet / 2
    ups = above.sum(axis=1)
    mean = 2 * ups * (n - ups) / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(axis=1)
    p.append(np.where((ups == 0) | (ups == n), 2.0 ** (1 - n), _erfc(np.abs(runs - mean) / np.sqrt(2 * var))))
    centred = codes - codes.mean(axis=1, keepdims=True)
    total = (centred**2).sum(axis=1)
    serial = np.where(total > 0, (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.maximum(total, 1e-9), 1.0)
    p.append(_erfc(np.abs(serial) * math.sqrt(n / 2)))
    x = -sum(np.log(np.maximum(v, 1e-300)) for v in p)
    return np.exp(-x) * (1 + x + x * x / 2)


def score_bins(score: np.ndarray) -> np.ndarray:
    return np.minimum(_BINS, (-np.log10(np.maximum(score, 1e-31)) / 0.05).astype(np.int64)).clip(0)


def _windows(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of windows that cut texts of ``sizes`` symbols, laid end to end, in REFERENCE's lengths by turns."""
    ends = np.cumsum(sizes)
    first, cycle = ends - sizes, sum(REFERENCE)
    whole = sizes // cycle
    turns = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    base = np.repeat(first, whole) + turns * cycle
    rest, left = first + whole * cycle, sizes - whole * cycle
    for k, length in enumerate(REFERENCE):
        more = left >= length  # what is left of a text gives a window of each length that fits
        yield length, np.concatenate([base + sum(REFERENCE[:k]), rest[more]])
        rest, left = rest + length * more, left - length * more


def _numbered(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Windows whose last one to NUMBER symbols are digits; how many and which, their places decide."""
    drawn = mix(places.astype(np.uint64) + np.uint64(1))
    for k in range(NUMBER):
        with_ = drawn % np.uint64(NUMBER) >= k
        rows[with_, -1 - k] = 48 + (drawn[with_] >> np.uint64(8 * k + 8)) % np.uint64(10)
    return rows


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, dtype=np.int64)
    for batch in batches:
        for _, _, data, _ in chunks(batch.column("text")):
            total += np.bincount(data, minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.int32()), ("bin", pa.int32())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("candidates", pa.list_(_CANDIDATE)), ("slot", pa.int64()), ("n", pa.int64())])
_SQL = "doc_id long, base array<struct<kind:string,start:long,end:long>>, candidates array<struct<start:long,end:long,encoding:int,bin:int>>, slot long, n long"


def _names(raw: bytes) -> list[int]:
    """Places of what a named match cannot do without."""
    low, hits = raw.lower(), []
    for text, names in ((low, _NAMES), (raw, (b"AKIA",))):
        for name in names:
            at = text.find(name)
            while at >= 0:
                hits.append(at)
                at = text.find(name, at + 1)
    return hits


def _scan(order: list[np.ndarray]):
    """Rows of documents: named spans, candidates with their scores; and rows (slot, n): how many windows of text fell into a slot of :func:`_slot`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(REFERENCE) * len(ENCODINGS) * (_BINS + 1), dtype=np.int64)
        for batch in batches:
            for lo, hi, data, offs in chunks(batch.column("text")):
                raw = data.tobytes()
                hits = _names(raw)
                start, end = spans(data, offs, _HEX_CLASS)
                hits += start[end - start >= 32].tolist()
                start, end = spans(data, offs, _RUN_CLASS)
                long = end - start >= MIN_RUN
                start, end = start[long], end[long]
                base: list[list] = [[] for _ in range(hi - lo)]
                found: list[list] = [[] for _ in range(hi - lo)]
                for row in np.unique(np.searchsorted(offs, hits, side="right") - 1).tolist() if hits else []:
                    text = raw[offs[row] : offs[row + 1]].decode("utf-8", "surrogatepass")
                    base[row] = [{"kind": k, "start": a, "end": b} for k, a, b in base_spans(text)]
                outside = _RUN_CLASS[data] != 0  # of candidates
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)] if len(start) else None  # code points before a byte
                for row, a, b in zip((np.searchsorted(offs, start, side="right") - 1).tolist(), start.tolist(), end.tolist(), strict=True):
                    text, head = raw[a:b].decode("ascii"), int(points[a] - points[offs[row]])
                    for x, y in parts(text):
                        kind = encoding(text[x:y])
                        if kind is not None:
                            outside[a + x : a + y] = False
                        if kind is None or any(s["start"] < head + y and head + x < s["end"] for s in base[row]):
                            continue
                        score = battery(order[kind][data[a + x : a + y]], len(ENCODINGS[kind][1]))
                        found[row].append({"start": head + x, "end": head + y, "encoding": kind, "bin": int(score_bins(score)[0])})
                symbol = np.flatnonzero(outside)
                text = data[symbol]
                for k, (length, first) in enumerate(_windows(np.diff(np.searchsorted(symbol, offs)))):
                    rows = _numbered(text[first[:, None] + np.arange(length)], first)
                    kinds = _FIRST[np.bitwise_and.reduce(_HOLDS[rows], axis=1)] if len(rows) else first
                    for kind in np.unique(kinds[kinds >= 0]).tolist():
                        score = battery(order[kind][rows[kinds == kind]], len(ENCODINGS[kind][1]))
                        slot = (k * len(ENCODINGS) + kind) * (_BINS + 1)
                        seen[slot : slot + _BINS + 1] += np.bincount(score_bins(score), minlength=_BINS + 1)
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(base, _SCHEMA.field(1).type), pa.array(found, _SCHEMA.field(2).type), none, none], schema=_SCHEMA)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), f.type) for f in list(_SCHEMA)[:3]] + [pa.array(some), pa.array(seen[some])], schema=_SCHEMA)

    return run


def text_tails(seen: np.ndarray) -> np.ndarray:
    """P(a window of text scores in the bin or higher) by (length, encoding, bin), from counts; one window more counts as the candidate's own."""
    seen = seen.reshape(len(REFERENCE), len(ENCODINGS), _BINS + 1)
    few = seen.sum(axis=2) < ENOUGH
    pooled = np.where(few[:, :, None], seen.sum(axis=1, keepdims=True), seen)
    return (1 + np.cumsum(pooled, axis=2)) / (1 + pooled.sum(axis=2, keepdims=True))


def _judge(tails: np.ndarray, mean: float):
    """p over weight of each row (encoding, bin, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, bin_, n = (batch.column(c).to_numpy() for c in ("encoding", "bin", "n"))
            length = np.searchsorted(REFERENCE, n, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(tails[length, kind, bin_] * mean / n)], names=["p"])

    return run


def step_up(counts: dict[int, int], total: int, rate: float) -> float:
    """Largest p over weight that the step-up rejects, from counts by bin of -log10; 0 if none. A bin counts as its largest value."""
    seen = 0
    limit = 0.0
    for b in sorted(counts, reverse=True):  # small p first
        seen += counts[b]
        edge = 10.0 ** (-b * 0.05)
        if edge <= rate * seen / max(total, 1):
            limit = max(limit, edge)
    return limit


def _reporter(tails: np.ndarray, mean: float, limit: float):
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, candidates in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                for c in candidates:
                    n = c["end"] - c["start"]
                    if tails[np.searchsorted(REFERENCE, n, side="right") - 1, c["encoding"], c["bin"]] * mean / n <= limit:
                        base.append({"kind": "random", "start": c["start"], "end": c["end"]})
                out.append(sorted(base, key=lambda s: (s["start"], KINDS.index(s["kind"]), s["end"])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, schema.field(1).type)], schema=schema)

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(doc_id, spans) for every row: ``spans`` lists (kind, start, end) by start, then kind, in code points.

    - Null and empty texts have no spans. Whole texts are scanned, however long.
    - Matches of different kinds may overlap and all stay; a random string is only added where no
      named span stands.
    - Rows with null ids and repeated rows each get a row; an empty table gives an empty result.
    - Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs[text_col]).alias("text"))
    counts = np.zeros(256, dtype=np.int64)
    for r in source.select("text").mapInArrow(_byte_counts, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r["byte"]] = r["n"]
    scanned = materialize(source.mapInArrow(_scan(ranks(counts)), _SQL))
    seen = np.zeros(len(REFERENCE) * len(ENCODINGS) * (_BINS + 1), dtype=np.int64)
    for r in scanned.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # a row a slot: bounded
        seen[r["slot"]] = r["n"]
    tails = text_tails(seen)
    rows = scanned.where("slot is null")
    each = rows.select(F.explode("candidates").alias("c")).select("c.encoding", "c.bin", (F.col("c.end") - F.col("c.start")).alias("n"))
    total, mean = each.agg(F.count("*"), F.avg("n")).first()
    mean = float(mean or 1.0)
    bins = F.greatest(F.lit(0), F.least(F.lit(_BINS), F.floor(-F.log10("p") / 0.05)))
    tally = {int(r["b"]): r["c"] for r in each.mapInArrow(_judge(tails, mean), "p double").groupBy(bins.alias("b")).agg(F.count("*").alias("c")).collect()}
    limit = step_up(tally, total, rate)
    return rows.mapInArrow(_reporter(tails, mean, limit), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans_: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans_)


def digest(spans_: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans_).encode()).hexdigest()
