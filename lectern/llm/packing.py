"""Packing tokenised documents into fixed windows by minimum bin slack.

Documents are cut at multiples of the window, so each leaves full windows and at most one remainder. Only the number
of remainders of each length (at most ``capacity`` numbers, whatever the input) is needed to plan: while remainders
are left, the longest length opens a window, a bitset subset-sum programme over the remaining multiset finds the fill
closest to capacity, and backtracking gives the counts of each length. The pattern is used as often as the multiset
allows, which exhausts some length, so patterns are few. Pieces then find their window by rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .caches import tidy
from .common import CHUNK_BYTES, bounded_batches, materialize
from .words import chunks, utf8

CAPACITY = 4096


def best_fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset from ``counts`` (length: how many) with the largest sum up to ``target``; longer lengths first
    among those that the search sees, so it may stop at the first exact fill."""
    reach, steps = 1, []
    mask = (1 << (target + 1)) - 1
    for length in sorted((x for x in counts if x <= target), reverse=True):
        left, size = min(counts[length], target // length), 1
        while left:  # binary splitting: 1, 2, 4, ... copies at a time
            size = min(size, left)
            steps.append((length, size, reach))
            reach |= (reach << (length * size)) & mask
            left -= size
            size *= 2
        if reach >> target & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, size, before in reversed(steps):
        if not before >> at & 1:  # only reached with this step
            used[length] = used.get(length, 0) + size
            at -= length * size
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pattern, repeats): windows by minimum bin slack, until no length is left."""
    left = {x: n for x, n in counts.items() if n > 0}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        pattern = best_fill(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[x] // k for x, k in pattern.items())
        for x, k in pattern.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
        out.append((pattern, times))
    return out


def pieces(docs: DataFrame, encode, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, chunk, nth): the pieces of each document, without a place yet.

    ``encode``: makes the function bytes -> little-endian unsigned 32-bit ids, called in the Python worker; if that has a
    method ``many``, it gets the texts of a chunk together. ``chunk`` and ``nth`` number the pieces of one length within
    the task that cut them."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        to_ids, chunk, seen = encode(), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        many = getattr(to_ids, "many", lambda texts: map(to_ids, texts))
        for t in chunks(batches, "text", chunk_bytes):
            row, start, length, crc, total, nth = [], [], [], [], [], []
            for i, ids in enumerate(many(utf8(t["text"]))):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    k = min(capacity, n - s)
                    row.append(i)
                    start.append(s)
                    length.append(k)
                    crc.append(zlib.crc32(ids[4 * s : 4 * (s + k)]))
                    total.append(n)
                    nth.append(seen[k])
                    seen[k] += 1
            if row:
                yield pa.RecordBatch.from_arrays(
                    [t["id"].combine_chunks().take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, [chunk] * len(row), nth))],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "nth"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, "packing"), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, chunk long, nth long")


def pack(docs: DataFrame, encode, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: the end id alone. Rows that repeat a doc_id, or have none, are packed each. Windows hold no
    gap; window 0 up are the sequences. Other columns play no part; an empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    cut = materialize(pieces(docs, encode, capacity, end_id, id_col, text_col), "pieces")
    cells = materialize(cut.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    table = SlotTable(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(cells.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "piece-ranks")
    ranked = cut.join(first.hint("merge"), ["length", "chunk"])  # as large as the number of tasks: never broadcast

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            sequence, offset = table.place(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("rank"))
    out = out.mapInArrow(tidy(place), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


class SlotTable:
    """Finds the window and the offset of the r-th piece of a length. Its size follows the plan's patterns (bounded by
    the number of lengths and their exhaustions), not the number of pieces."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        self.of: dict[int, tuple] = {}
        base, slots = 0, {}
        for pattern, times in patterns:
            at = 0
            for length in sorted(pattern, reverse=True):
                slots.setdefault(length, []).append((pattern[length], times, base, at))
                at += length * pattern[length]
            base += times
        for length, rows in slots.items():
            each, times, first, at = np.array(rows, dtype=np.int64).T
            self.of[length] = (np.concatenate([[0], np.cumsum(each * times)]), each, first, at)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        order = np.argsort(length, kind="stable")
        kinds, starts = np.unique(length[order], return_index=True)
        for k, lo, hi in zip(kinds, starts, [*starts[1:], len(order)], strict=True):
            rows = order[lo:hi]
            ends, each, first, at = self.of[int(k)]
            i = np.searchsorted(ends, rank[rows], side="right") - 1
            r = rank[rows] - ends[i]
            sequence[rows] = first[i] + r // each[i]
            offset[rows] = at[i] + k * (r % each[i])
        return sequence, offset
