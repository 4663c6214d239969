"""Numpy kernels over the byte buffers of an Arrow string column: words, hashes, shingles.

All run on chunks of whole texts of about CHUNK_BYTES, so the memory of a worker does not
depend on the batch; one longer text forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_R = np.uint64(0x9E3779B97F4A7C15)  # odd, 5 modulo 8
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(lower: bool) -> np.ndarray:
    """A random 64-bit code for each byte; with ``lower``, A-Z take the codes of a-z."""
    key = f"codes{lower}"
    if key not in _cache:
        codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        if lower:
            codes[65:91] = codes[97:123]
        _cache[key] = codes
    return _cache[key]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i modulo 2**64 for i < n."""
    if "up" not in _cache or len(_cache["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _R), ("down", _R_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _cache[name] = np.cumprod(steps, dtype=np.uint64)
    return _cache["up"][:n], _cache["down"][:n]


def table(separators: bytes = b"", **classes: bytes) -> np.ndarray:
    """Class of each byte: 0 for separators; other bytes 1, unless a later class claims them."""
    out = np.ones(256, dtype=np.uint8)
    for k, members in enumerate(classes.values(), start=2):
        out[list(members)] = k
    out[list(separators)] = 0
    return out


SPACES = b" \t\n\x0b\x0c\r"
WORDS = table(SPACES)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    data, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one class (not 0); runs end with their text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes[data]
    before, after = np.zeros_like(cls), np.zeros_like(cls)
    before[1:], after[:-1] = cls[:-1], cls[1:]
    before[offs[:-1][offs[:-1] < len(data)]] = 0
    after[offs[1:][offs[1:] > 0] - 1] = 0
    real = cls != 0
    return np.flatnonzero(real & (cls != before)), np.flatnonzero(real & (cls != after)) + 1


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of 64-bit symbols; see :func:`hash_of`."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, dtype=np.uint64, out=out[1:])
    return out


def prefix_hash(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """:func:`prefix_sums` of bytes by their codes."""
    return prefix_sums(codes[data])


def word_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit code for each word (a run without SPACES), and the offsets of the texts in words."""
    starts, ends = spans(data, offs, WORDS)
    codes = hash_of(prefix_hash(data, byte_codes(False)), starts, ends) >> np.uint64(32)
    return codes.astype(np.uint32), np.searchsorted(starts, offs)


def hash_of(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def owners(offs: np.ndarray, counts_at: np.ndarray) -> np.ndarray:
    """Row of each item when row i has items counts_at[i]..counts_at[i+1]."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(counts_at))


_SHINGLE = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each text: (row of each, hash of each), rows ascending.

    Words are runs without SPACES, A-Z lowered; a text of fewer words, but not none, has its
    whole sequence as its one shingle.
    """
    starts, ends = spans(data, offs, WORDS)
    hashes = hash_of(prefix_hash(data, byte_codes(True)), starts, ends)
    first = np.searchsorted(starts, offs)
    count = np.diff(first)
    parts_row, parts_hash = [], []
    if len(hashes) >= size:
        total = len(hashes) - size + 1
        value = np.zeros(total, dtype=np.uint64)
        for k in range(size):
            value += hashes[k : k + total] * _SHINGLE[k]
        row = np.repeat(np.arange(len(count)), count)
        inside = row[:total] == row[size - 1 :]
        parts_row.append(row[:total][inside])
        parts_hash.append(mix(value[inside]))
    for words in range(1, size):
        rows = np.flatnonzero(count == words)
        if len(rows):
            value = np.full(len(rows), words, dtype=np.uint64)
            for k in range(words):
                value += hashes[first[rows] + k] * _SHINGLE[k]
            parts_row.append(rows)
            parts_hash.append(mix(mix(value)))
    if not parts_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(parts_row), np.concatenate(parts_hash)
    if len(parts_row) > 1:
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    ordered = np.sort(value)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, value), len(twice) - 1)
        maybe = np.flatnonzero(twice[at] == value)
        order = maybe[np.lexsort((value[maybe], row[maybe]))]
        again = order[1:][(row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])]
        keep = np.ones(len(row), dtype=bool)
        keep[again] = False
        row, value = row[keep], value[keep]
    return row, value


def set_sums(row: np.ndarray, value: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """A hash of each row's set of values, whatever their order."""
    out = np.zeros(rows, dtype=np.uint64)
    if len(row):
        edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[edge]] = np.add.reduceat(mix(value + np.uint64(salt)), edge)
    return out
