"""Vectorised word access for Arrow text columns.

A block is a run of whole documents whose UTF-8 bytes sum to about ``BLOCK_BYTES`` (one document at least, whatever its
length), so memory in a Python worker is bounded by the longest document and not by the Arrow batch.  The 8-byte numbers that
hashing needs for each byte are made for ``BLOCK_BYTES`` at a time (or one longer span), and the table of powers never outgrows it.  Words are
``[^\\x20\\x09-\\x0D]+``; they never cross documents.  A word's 64-bit hash is a polynomial over randomised byte values,
computed for all words of a block by prefix sums, then mixed: no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_M = 0x9E3779B97F4A7C15 | 1
_M_INV = pow(_M, -1, 1 << 64)
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays (multiply and xor-shift)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class _Powers:
    up = down = np.ones(1, U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse; kept for a block, made anew and let go for a longer span."""
        if n > BLOCK_BYTES + 1:
            return _powers(_M, n), _powers(_M_INV, n)
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_M, BLOCK_BYTES + 1), _powers(_M_INV, BLOCK_BYTES + 1)
        return cls.up, cls.down


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, out=out)


class Block:
    """Bytes of documents ``first`` to ``last`` (exclusive) of a batch, with the spans and hashes of their words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, between: np.ndarray = _SPACE):
        """``between``: for each of the 256 bytes whether it stands between words."""
        self.data, self.bounds, self.first = data, bounds, first
        self.n_docs = len(bounds) - 1
        n = len(data)
        inside = np.take(~between, data)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before &= ~edge[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        # word_bounds[d]:word_bounds[d + 1] are the words of document d
        self.word_bounds = np.searchsorted(self.starts, bounds)

    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words())

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
        """64-bit hashes of byte spans, which come by rising starts; ``fold`` lower-cases A-Z first, another ``seed`` gives other hashes."""
        out, first, values = np.zeros(len(starts), U64), 0, _BYTE_FOLDED if fold else _BYTE
        if seed:
            values = mix64(values + U64(seed))
        while first < len(starts):
            base = int(starts[first])
            last = max(int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")), first + 1)
            a, b = starts[first:last] - base, ends[first:last] - base
            n = int(b[-1])
            up, down = _Powers.upto(n + 1)
            total = np.zeros(n + 1, U64)
            terms = np.take(values, self.data[base : base + n])
            terms *= up[:n]
            np.cumsum(terms, out=total[1:])
            out[first:last] = mix64((total[b] - total[a]) * down[a])
            first = last
        return out

    def word_hashes(self, fold: bool = False) -> np.ndarray:
        return self.hash_spans(self.starts, self.ends, fold)

    def windows(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` words inside documents, and their bounds by document."""
        per_doc = np.maximum(self.n_words() - size + 1, 0)
        bounds = np.concatenate(([0], np.cumsum(per_doc)))
        m = max(len(words) - size + 1, 0)
        mixed = np.zeros(m, U64)
        for k in range(size):
            mixed = mixed * U64(_M) + words[k : k + m]
        position = np.arange(bounds[-1]) + np.repeat(self.word_bounds[:-1] - bounds[:-1], per_doc)
        return mix64(mixed)[position] if m else np.zeros(0, U64), bounds


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def spans_of(bounds: np.ndarray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs (first, last) of whole documents of at most ``block_bytes``, or one document."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + block_bytes, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES, between: np.ndarray = _SPACE) -> Iterator[Block]:
    raw, bounds = column_bytes(column)
    for first, last in spans_of(bounds, block_bytes):
        yield Block(raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], first, between)


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
