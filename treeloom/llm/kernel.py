"""Vectorised text kernel shared by the operators.

A batch of texts is handled as one UTF-8 byte buffer with row offsets.  Words, their
64-bit hashes and byte spans come from a fixed number of numpy passes, without a Python
object per word.  Memory is about forty times the bytes handled at once; ``slices`` keeps
that at ``SLICE_BYTES`` or one row, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from treeloom.runtime import ship

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def _lowered(table: np.ndarray) -> np.ndarray:
    out = table.copy()
    out[65:91] = table[97:123]
    return out


LOWER = _lowered(np.arange(256, dtype=np.uint8))
_LOWER_HASH = _lowered(_TABLE)
#: True where a byte separates words: white space only, or all but ASCII letters, digits and other scripts.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _BASE_INVERSE):
            x = np.full(n, _U(base), np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 4 * SLICE_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def chain(*hashes: np.ndarray) -> np.ndarray:
    """Order-dependent hash of a sequence given position by position."""
    out = mix(hashes[0] + _U(len(hashes)))
    for h in hashes[1:]:
        out = mix(out * _U(0x9E3779B97F4A7C15) + h)
    return out


class Words:
    """Words of a batch: byte spans ``start``/``end``, hash ``h``, row ``row``; row r owns ``first[r]:first[r+1]``."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray, hashed: bool = True):
        n = len(buf)
        self.buf, self.offsets = buf, offsets
        solid = ~separator[buf]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < n]
        begins[edges] = solid[edges]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        inner = edges[edges > 0] - 1
        ends[inner] = solid[inner]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if hashed:
            up, down = _power(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LOWER_HASH[buf] * up[:n], out=sums[1:])
            self.sums, self.down = sums, down
            self.h = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word indices, hashes) of the first ``size`` bytes of the words that are longer."""
        at = np.flatnonzero(self.end - self.start > size)
        begin = self.start[at]
        return at, mix((self.sums[begin + size] - self.sums[begin]) * self.down[begin] + _U(size << 32))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return LOWER[self.buf[self.start[i] : self.end[i]]].tobytes()


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all k-word shingles; a row of fewer words, but not none, is one shingle."""
    counts, h = words.counts, words.h
    n = len(h)
    last = words.first[1:][words.row] if n else np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(n) + k <= last) if n else np.zeros(0, np.int64)
    rows = [words.row[at]]
    out = [chain(*(h[at + j] for j in range(k)))] if len(at) else [np.zeros(0, np.uint64)]
    for size in range(1, k):
        short = np.flatnonzero(counts == size)
        if len(short):
            begin = words.first[:-1][short]
            rows.append(short)
            out.append(chain(*(h[begin + j] for j in range(size))))
    return np.concatenate(rows), np.concatenate(out)


def distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row as (flat, first)."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
    return hashes, np.searchsorted(rows, np.arange(n + 1))


def byte_view(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string array as (bytes, row offsets); null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.chunk(0) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``limit`` bytes of text, or one row."""
    _, offsets = byte_view(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def code_points(buf: np.ndarray, begin: int, marks: np.ndarray) -> np.ndarray:
    """Byte positions as code point positions counted from ``begin``."""
    if not len(marks):
        return marks
    top = int(marks.max())
    lead = np.zeros(top - begin + 1, np.int64)
    np.cumsum((buf[begin:top] & 0xC0) != 0x80, out=lead[1:])
    return lead[marks - begin]


def lists(flat, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat, kind))


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict]) -> DataFrame:
    """Apply ``work(batch, bytes, offsets) -> {column: values}`` slice by slice, beside the kept columns.

    A kept column with the name of a new one is replaced by it.
    """
    ship(df.sparkSession)
    names = [f.name for f in fields]
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    need = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text):
                buf, offsets = byte_view(part.column(text))
                made = work(part, buf, offsets)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(x if isinstance(x := made[c], pa.Array) else pa.array(x) for c in names)], names=[*keep, *names])

    return df.select(*(f"`{c}`" for c in need)).mapInArrow(run, schema)


def flat_texts(df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], list]) -> DataFrame:
    """Like ``map_texts``, but ``work`` returns any number of rows as a list of columns."""
    ship(df.sparkSession)
    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text):
                buf, offsets = byte_view(part.column(text))
                made = work(part, buf, offsets)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=names)

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of each run of equal keys, from batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        at = 0
        for cut in np.flatnonzero(new):
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
