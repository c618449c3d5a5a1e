"""Vectorised hashing of the words of many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` (runs without ASCII white space). All texts of a batch are laid end to end
in one byte buffer; a word's 64-bit hash is a difference of prefix sums of a polynomial in the bytes (arithmetic
modulo 2**64, the byte values replaced by fixed random numbers), put through a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_VALUES = {seed: _byte_values(seed) for seed in (1, 2)}
_POWERS: dict[int, np.ndarray] = {}
#: Bytes hashed at once.
_SLICE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, dtype=U64)
        have[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            while done < size:
                step = min(done, size - done)
                have[done : done + step] = have[:step] * U64(pow(base, done, 1 << 64))
                done += step
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x ^= x >> U64(33)
        x = x * U64(0xC4CEB9FE1A85EC53)
        x ^= x >> U64(33)
    return x


class Words:
    """The words of a batch: ``hashes`` in order, ``start``/``end`` byte bounds in ``buffer``, and ``offset``:
    document d has words offset[d]:offset[d+1]."""

    def __init__(self, texts: list[bytes], lower: bool, seed: int = 1):
        joined = b"\n".join([*texts, b""])
        self.raw = joined
        buffer = np.frombuffer(joined.translate(_LOWER) if lower else joined, dtype=np.uint8)
        self.buffer = buffer
        word = np.empty(len(buffer) + 1, dtype=bool)
        word[0] = False
        np.logical_not(_SPACE[buffer], out=word[1:])
        edges = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.offset = np.concatenate([[0], np.searchsorted(self.start, ends, side="left")]).astype(np.int64)
        self.hashes = self.hash(seed)

    def hash(self, seed: int = 1) -> np.ndarray:
        out = np.empty(len(self.start), dtype=U64)
        i = 0
        while i < len(out):  # slices of whole words keep the memory small, whatever the length of a text
            base = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, base + _SLICE, side="right")))
            start, end = self.start[i:j] - base, self.end[i:j] - base
            with np.errstate(over="ignore"):
                terms = _VALUES[seed][self.buffer[base : base + int(end[-1])]]
                terms *= _powers(_BASE, len(terms))
                np.cumsum(terms, out=terms)
                before = np.where(start > 0, terms[start - 1], U64(0))
                out[i:j] = (terms[end - 1] - before) * _powers(_INVERSE, len(terms))[start] + (end - start).astype(U64)
            i = j
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.offset)


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive entries; the result has max(0, len - n + 1) entries."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=U64)
    with np.errstate(over="ignore"):
        out = np.full(m, (n * 0xA0761D6478BD642F + seed * 0xE7037ED1A0B428DB) & 0xFFFFFFFFFFFFFFFF, dtype=U64)
        for i in range(n):
            out = out * U64(0x9FB21C651E98DF25) + hashes[i : m + i]
            out ^= out >> U64(29)
    return mix(out)


#: Rows that a chunk holds at most, however short their texts are.
CHUNK_ROWS = 1 << 14


def chunks(batches: Iterable, text_column: str, limit: int, rows: int = CHUNK_ROWS) -> Iterator:
    """Arrow record batches cut into tables of at most ``limit`` bytes of text (a longer text comes alone) and ``rows``
    rows, so that memory is bounded by these limits, the longest text and the size of the batches that arrive (see
    ``common.bounded_batches``)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size, count = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        i = batch.schema.get_field_index(text_column)
        lengths = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            total = np.cumsum(lengths[at:])
            take = min(int(np.searchsorted(total, limit - size, side="right")), rows - count)
            if take == 0 and not held:
                take = 1
            if take:
                held.append(batch.slice(at, take))
                size += int(total[take - 1])
                count += take
                at += take
            if at < batch.num_rows or size >= limit or count >= rows:
                if held:
                    yield pa.Table.from_batches(held)
                held, size, count = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def utf8(column) -> list[bytes]:
    """A string column's values as UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
