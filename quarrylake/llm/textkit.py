"""Vectorised text kernels over Arrow string columns.

A *word* is a maximal run of characters that are not ASCII controls, spaces or
punctuation, after Unicode lower-casing; in a regular expression,
``[^\\x00-/:-@\\[-`{-\\x7f]+``. Every kernel treats a null text as the empty text
and handles whole texts: rows are taken in chunks of about ``CHUNK`` bytes, and a
longer row is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
WORD = r"[^\x00-/:-@\[-`{-\x7f]+"

_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
_IS_WORD[[*range(48, 58), *range(97, 123), *range(65, 91)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15
_Q = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads 64-bit keys; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, with eight spare zero bytes, and the rows' offsets in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = np.zeros(hi - lo + 8, np.uint8)
    if hi > lo:
        data[:-8] = np.frombuffer(texts.buffers()[2], np.uint8, hi - lo, lo)
    return data, offsets - lo


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span; data needs eight spare bytes at its end."""
    at8 = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = ends - starts
    out = mix((at8[starts] & _MASK[np.minimum(size, 8)]) + np.uint64(_GOLD) * size.astype(np.uint64))
    live, k = np.flatnonzero(size > 8), 8
    while len(live):
        out[live] = mix(out[live] * np.uint64(_Q) ^ (at8[starts[live] + k] & _MASK[np.minimum(size[live] - k, 8)]))
        k += 8
        live = live[size[live] > k]
    return out


@dataclass
class Words:
    """The words of some rows: spans in data; row k has the words ptr[k] to ptr[k + 1] - 1."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    @cached_property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def left(self) -> np.ndarray:
        """How many words the row has from each word on, itself included."""
        return np.repeat(self.ptr[1:], self.counts) - np.arange(len(self.starts))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words at which an n-gram inside one row begins, and the n-grams' hashes."""
        at = np.flatnonzero(self.left() >= n)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        return at, window_hashes(self.hashes, n)[at]


def powers(base: int, n: int) -> np.ndarray:
    key = (base, 1 << max(10, int(n - 1).bit_length()))
    if key not in _POWERS:
        p = np.full(key[1], base, np.uint64)
        p[0] = 1
        _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS[key][:n]


_POWERS: dict[tuple[int, int], np.ndarray] = {}
_QINV = pow(_Q, -1, 1 << 64)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of h[i : i + n] for each i; of what is left where fewer follow."""
    if n <= 6:
        out = h.copy()
        for j in range(1, min(n, len(h))):
            out[:-j] += h[j:] * np.uint64(pow(_Q, j, 1 << 64))
        return mix(out)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_Q, len(h)), out=sums[1:])
    to = np.minimum(np.arange(len(h)) + n, len(h))
    return mix((sums[to] - sums[:-1]) * powers(_QINV, len(h)))


def words(texts: pa.Array, lower: bool = True) -> Words:
    """The words of every row; not lower-cased if lower is off."""
    data, offsets = utf8(pc.utf8_lower(texts) if lower else texts)
    n = len(data) - 8
    inside = _IS_WORD[data[:n]]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begin[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", target: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about target bytes of text, small batches joined."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
        cum = np.cumsum(size)
        if held_bytes + cum[-1] <= target:
            held.append(batch)
            held_bytes += int(cum[-1])
            continue
        if held:
            yield join(held)
            held, held_bytes = [], 0
        at = 0
        while at < batch.num_rows:
            base = cum[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(cum, base + target, "right")))
            piece = batch.slice(at, to - at)
            if to == batch.num_rows and cum[-1] - base < target // 2:
                held, held_bytes = [piece], int(cum[-1] - base)
            else:
                yield piece
            at = to
    if held:
        yield join(held)


def join(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: each member's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
