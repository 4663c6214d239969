"""Find tokens that occur more than once in a corpus, without a row per token.

Each task packs its (token, owner, extra) triples into binary blocks by token range, so the
shuffle carries 8 to 24 bytes a token. A reducer sorts the tokens of its range and reports the
owners of every token that has at least two distinct (owner, extra) pairs. Exact copies share
an owner (a hash of their content) and are combined before they are sent; a token that is very
frequent within one flush of one task is known to be shared, so only its name is sent. A
reducer therefore gets at most HOT rows of any token from each flush, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ._bytes import buffers
from ._shared import shuffle_partitions, trimmed

FLUSH = 1 << 19
HOT = 64

Extract = Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch | None, np.ndarray, np.ndarray, np.ndarray]]]

FOUND = pa.schema([("owner", pa.int64()), ("hits", pa.int64()), ("extras", pa.binary())])
_BLOCK = [("part", pa.int32()), ("tok", pa.binary()), ("own", pa.binary()), ("ext", pa.binary()), ("hot", pa.binary())]


def _nulls(schema: pa.Schema, n: int) -> list[pa.Array]:
    return [pa.nulls(n, f.type) for f in schema]


def _words(column: pa.Array) -> np.ndarray:
    data, _ = buffers(column)
    return np.frombuffer(data.tobytes(), dtype=np.uint64)


def _blocks(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer((bounds * 8).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def shared(tok: np.ndarray, own: np.ndarray, ext: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the distinct triples by token; for each its token's run number and the runs' sizes."""
    order = np.argsort(tok)
    t = tok[order]
    twice = np.zeros(len(t), dtype=bool)
    if len(t) > 1:
        same = t[1:] == t[:-1]
        twice[1:] |= same
        twice[:-1] |= same
    multi = order[twice]
    multi = multi[np.lexsort((ext[multi], own[multi], tok[multi]))]
    if len(multi):
        new = np.ones(len(multi), dtype=bool)
        new[1:] = (tok[multi][1:] != tok[multi][:-1]) | (own[multi][1:] != own[multi][:-1]) | (ext[multi][1:] != ext[multi][:-1])
        multi = multi[new]
    order = np.concatenate([order[~twice], multi])
    if not len(order):
        return order, order, order
    edge = np.r_[True, tok[order][1:] != tok[order][:-1]]
    run = np.cumsum(edge) - 1
    return order, run, np.bincount(run)


def _report(own: np.ndarray, ext: np.ndarray, meta: pa.Schema, extras: bool) -> pa.RecordBatch:
    """One row per owner: how many of its triples are shared, and their extras."""
    order = np.argsort(own, kind="stable")
    own, ext = own[order], ext[order]
    edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    bounds = np.r_[edge, len(own)]
    arrays = [pa.array(own[edge].view(np.int64)), pa.array(np.diff(bounds).astype(np.int64)), _blocks(ext, bounds) if extras else pa.nulls(len(edge), pa.binary())]
    return pa.RecordBatch.from_arrays([*_nulls(meta, len(edge)), *arrays], schema=pa.schema([*meta, *FOUND]))


def find_shared(df: DataFrame, extract: Extract, meta: pa.Schema, *, extras: bool, group_limit: int = 1 << 62) -> DataFrame:
    """Rows of ``meta`` as ``extract`` gives them, and rows (owner, hits, extras) of shared tokens.

    ``extract`` yields (meta rows or None, tokens, owners, extras) for a batch. With
    ``extras`` the report holds the extras of the shared triples as packed 64-bit words, whose
    top bit tells that the token has more than ``group_limit`` distinct triples.
    """
    ids = 8 * shuffle_partitions(df.sparkSession)
    mid = pa.schema([*_BLOCK, *meta, *FOUND])
    high = np.uint64(1 << 63)

    def pack(part: np.ndarray, hot_part: np.ndarray, cols: list[np.ndarray], hot: np.ndarray) -> pa.RecordBatch:
        by, hot_by = np.argsort(part, kind="stable"), np.argsort(hot_part, kind="stable")
        names = np.unique(np.concatenate([part, hot_part]))
        bounds = np.searchsorted(part[by], np.r_[names, ids])
        hot_bounds = np.searchsorted(hot_part[hot_by], np.r_[names, ids])
        arrays = [pa.array(names.astype(np.int32)), *(_blocks(c[by], bounds) for c in cols), _blocks(hot[hot_by], hot_bounds)]
        return pa.RecordBatch.from_arrays([*arrays, *_nulls(meta, len(names)), *_nulls(FOUND, len(names))], schema=mid)

    def send(tok: np.ndarray, own: np.ndarray, ext: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, run, sizes = shared(tok, own, ext)
        if not len(order):
            return
        hot = sizes[run] > HOT
        if hot.any():
            marked = ext[order[hot]] | (high if extras and group_limit < (1 << 62) else np.uint64(0))
            found = _report(own[order[hot]], marked, meta, extras)
            yield pa.RecordBatch.from_arrays([*_nulls(pa.schema(_BLOCK), found.num_rows), *found.columns], schema=mid)
        cold = order[~hot]
        names = np.unique(tok[order[hot]])
        part = lambda t: ((t >> np.uint64(20)) % np.uint64(ids)).astype(np.int64)
        yield pack(part(tok[cold]), part(names), [tok[cold], own[cold], ext[cold]], names)

    def mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = row = 0
        for batch in batches:
            for rows, tok, own, ext in extract(batch):
                if rows is not None and rows.num_rows:
                    n = rows.num_rows
                    part = pa.array(((np.arange(row, row + n)) % ids).astype(np.int32))
                    row += n
                    yield pa.RecordBatch.from_arrays([part, *_nulls(pa.schema(_BLOCK[1:]), n), *rows.columns, *_nulls(FOUND, n)], schema=mid)
                held.append((tok, own, ext))
                size += len(tok)
                if size >= FLUSH:
                    yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield from send(*(np.concatenate(x) for x in zip(*held, strict=True)))

    out = pa.schema([*meta, *FOUND])

    def reducer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for at, name in enumerate(("tok", "own", "ext", "hot")):
                held[at].append(_words(batch.column(name)))
            block = batch.column("tok").is_null()
            if pc.any(block).as_py():
                yield batch.filter(block).select(out.names)
        tok, own, ext, hot = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in held)
        order, run, sizes = shared(tok, own, ext)
        if len(order):
            known = np.isin(tok[order], np.unique(hot))
            found = known | (sizes[run] > 1)
            marked = ext[order] | np.where(known | (sizes[run] > group_limit), high, np.uint64(0)) if extras and group_limit < (1 << 62) else ext[order]
            if found.any():
                yield _report(own[order[found]], marked[found], meta, extras)

    sent = df.mapInArrow(trimmed(mapper), from_arrow_schema(mid))
    dealt = sent.repartition(shuffle_partitions(df.sparkSession), F.coalesce("part", F.pmod(F.hash("owner"), F.lit(ids))))
    return dealt.mapInArrow(trimmed(reducer), from_arrow_schema(out))
