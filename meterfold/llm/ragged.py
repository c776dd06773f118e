"""Numpy helpers for lists of different lengths that lie end to end in one array."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that one slice of a batch may hold; bounds the memory of a step, not what is processed.
SLICE = 400_000
#: Distinct pieces whose codes a worker remembers; beyond it the half that came up least often goes.
REMEMBERED = 300_000


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, which gives memory that it no longer needs back to the system at its end: Spark keeps idle workers for a while."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose list column has about limit elements; a longer single row comes alone."""
    ends = batch.column(column).offsets.to_numpy()[1:] - batch.column(column).offsets[0].as_py()
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], ..., starts[i] + lengths[i] - 1 of every i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each list; 0 where it is empty."""
    total = np.concatenate([np.zeros(1, dtype=np.result_type(values.dtype, np.int64)), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their list column has limit elements: what is worked out once a distinct piece is shared by more rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).offsets[-1].as_py() - batch.column(column).offsets[0].as_py()
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass(frozen=True)
class Codes:
    """Codes of some pieces: lengths[k] values from starts[k] on in flat."""

    flat: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def table(self, width: int) -> np.ndarray:
        """Codes that all have so many values, a row each."""
        return self.flat.reshape(-1, width)[self.starts // width]


class Pieces:
    """The pieces of a slice: doc offsets, and for each piece its place among the distinct ones."""

    def __init__(self, lists: pa.ListArray):
        self.offsets = lists.offsets.to_numpy().astype(np.int64)
        self.offsets = self.offsets - self.offsets[0]
        words = lists.flatten().dictionary_encode()
        self.index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.distinct: pa.StringArray = words.dictionary.cast(pa.string())

    def part(self, at: int, n: int) -> Pieces:
        """Those of n documents from the one at at, with the same distinct pieces."""
        own = object.__new__(Pieces)
        own.offsets = self.offsets[at : at + n + 1]
        own.index, own.distinct = self.index[own.offsets[0] : own.offsets[-1]], self.distinct
        own.offsets = own.offsets - own.offsets[0]
        return own

    def coded(self, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all pieces in order, and each document's offsets into them; codes has those of each distinct piece."""
        per_piece = codes.lengths[self.index]
        values = codes.flat[spread(codes.starts[self.index], per_piece)] if len(per_piece) else codes.flat[:0]
        return values, offsets_of(per_piece)[self.offsets]


class Remembered:
    """Codes of distinct pieces, computed in bulk and kept up to a bound. Pieces and codes lie in Arrow and numpy arrays, not in Python objects.

    known: pieces whose codes are there from the beginning and stay.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], dtype: str = "<u4", limit: int = REMEMBERED, known: tuple[pa.StringArray, np.ndarray, np.ndarray] | None = None):
        self.encode, self.dtype, self.limit = encode, np.dtype(dtype), limit
        empty = pa.array([], pa.string()), np.empty(0, self.dtype), np.empty(0, np.int64)
        self.pieces, self.flat, self.lengths = known or empty
        self.stay = len(self.lengths)
        self.hits = np.zeros(self.stay, dtype=np.int64)

    def __call__(self, distinct: pa.StringArray) -> Codes:
        at = pc.index_in(distinct, value_set=self.pieces).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            words = distinct.take(pa.array(new))
            codes = self.encode(words.to_pylist())
            at[new] = len(self.lengths) + np.arange(len(new))
            self.pieces = pa.concat_arrays([self.pieces, words])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(codes), dtype=self.dtype)])
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // self.dtype.itemsize])
            self.hits = np.concatenate([self.hits, np.zeros(len(new), dtype=np.int64)])
        self.hits[at] += 1
        out = Codes(self.flat, offsets_of(self.lengths)[at], self.lengths[at])
        if len(self.lengths) - self.stay > self.limit:
            self._forget()
        return out

    def _forget(self) -> None:
        often = np.argsort(-self.hits[self.stay :], kind="stable")[: self.limit // 2]
        keep = np.concatenate([np.arange(self.stay), self.stay + np.sort(often)])
        starts = offsets_of(self.lengths)[keep]
        self.pieces, self.lengths, self.hits = self.pieces.take(pa.array(keep)), self.lengths[keep], self.hits[keep] // 2
        self.flat = self.flat[spread(starts, self.lengths)]
