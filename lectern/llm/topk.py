"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are dealt to ``lists`` groups; a group's partial inner products are a query's local score list.
1. Every task takes a block of its rows, gathers the best k entries of each local list, and adds up their whole scores. The
   k-th best of all tasks is a safe cutoff: the final k-th score is no lower, whichever rows were seen.
2. The cutoff goes to all tasks with the queries. Blocks of rows, longest first, are passed over for the queries whose cutoff
   they can't reach by the lengths of their parts (Cauchy-Schwarz). In the rest an entry whose whole score reaches the
   cutoff has, in some list, at least the cutoff divided by the number of lists (whatever the signs), so each list yields the
   entries above that.
3. The missing parts of these entries' scores are resolved exactly. What a task has found raises its own cutoff, and of those
   that reach it the task sends its best k.

Rows are never shuffled: they stay where they are read, whatever their identifiers or values, and a repeated row
is no hot spot. What moves are queries and cutoffs, broadcast in groups of at most QUERY_BYTES (a size that is checked), a
pass over the rows for each group, and each task's best k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .caches import tidy
from .common import bounded_batches, materialize

QUERY_BYTES = 32 << 20
QUERY_BLOCK, ROW_BLOCK = 1024, 2048
LISTS = 4


def quantise(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, v array<long>): floor(scale * component), components as doubles. Vectors that are null, or hold null or
    non-finite components, or any that goes beyond a long, take no part; nor do rows without an identifier."""
    x = F.col(vector_col)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * F.lit(scale)) >= F.lit(2.0**63))  # noqa: E731  infinities too
    fine = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, bad)
    return rows.where(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale))).alias("v"))


def _vectors(column, width: int | None = None) -> np.ndarray:
    """Vectors as rows of one width; components that a shorter vector lacks are zero."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, int(size.max(initial=0))) if width is None else width
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))), dtype=np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out[:, :width]


def _exact_type(q: np.ndarray, r: np.ndarray):
    """The fastest number type in which all partial sums are exact; Python's whole numbers where 64 bits don't do."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(r.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def _partial_scores(q: np.ndarray, r: np.ndarray, lists: int) -> list[np.ndarray]:
    kind = _exact_type(q, r)
    q, r = q.astype(kind), r.astype(kind)
    return [q[:, c] @ r[:, c].T for c in np.array_split(np.arange(q.shape[1]), min(lists, max(1, q.shape[1])))]


def _long(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; beyond their range, its ends."""
    return np.clip(scores, -(2**63) + 1, 2**63 - 1).astype(np.int64) if scores.dtype == object else scores.astype(np.int64)


def _lengths(x: np.ndarray, lists: int) -> np.ndarray:
    """Lengths of the parts of vectors, rounded up."""
    parts = np.array_split(np.arange(x.shape[1]), min(lists, max(1, x.shape[1])))
    return np.column_stack([np.sqrt((x[:, c].astype(np.float64) ** 2).sum(1)) for c in parts]) * (1 + 1e-9)


class _Best:
    """Entries found by a task; of each query no more than its best k are kept once there are many."""

    def __init__(self, n: int, k: int, cutoff: np.ndarray):
        self.k, self.cutoff, self.many = k, cutoff.copy(), 1 << 20
        self.held = [np.empty(0, dtype=np.int64)] * 3
        self.waiting: list[tuple] = []
        self.count = 0

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        if len(query):
            self.waiting.append((query, row, score))
            self.count += len(query)
            if self.count > self.many:
                self.settle()

    def settle(self) -> None:
        q, r, s = (np.concatenate([h, *(w[i] for w in self.waiting)]) for i, h in enumerate(self.held))
        self.waiting, self.count = [], 0
        order = np.lexsort((r, -s, q))
        q, r, s = q[order], r[order], s[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < self.k
        last = np.arange(len(q)) - first == self.k - 1
        self.cutoff[q[last]] = np.maximum(self.cutoff[q[last]], s[last])
        self.held = [q[keep], r[keep], s[keep]]


def _found(queries: np.ndarray, best: _Best):
    import pyarrow as pa

    best.settle()
    q, r, s = best.held
    return pa.RecordBatch.from_arrays([pa.array(queries[q], pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])


_LOWEST = np.iinfo(np.int64).min


def _gather(sent, k: int, lists: int):
    """Phase 1: of the first block of a task's rows, the best k of each local list, with whole scores."""

    def run(batches: Iterator) -> Iterator:
        ids, q, _ = sent.value
        best, block = _Best(len(ids), k, np.full(len(ids), _LOWEST)), None
        for b in batches:  # the rest is read and left
            if block is None and b.num_rows:
                block = b.slice(0, ROW_BLOCK)
        if block is not None:
            rid, r = block.column(0).to_numpy(), _vectors(block.column(1))
            width = max(q.shape[1], r.shape[1])
            r = np.pad(r, ((0, 0), (0, width - r.shape[1])))
            n = min(k + 1, len(rid))  # one more, as the query's own row may be among them
            for lo in range(0, len(ids), QUERY_BLOCK):
                parts = _partial_scores(np.pad(q[lo : lo + QUERY_BLOCK], ((0, 0), (0, width - q.shape[1]))), r, lists)
                seen = np.concatenate([np.argpartition(p, len(rid) - n, axis=1)[:, len(rid) - n :] for p in parts], axis=1)
                seen = np.sort(seen, axis=1)
                new = np.ones(seen.shape, dtype=bool)
                new[:, 1:] = seen[:, 1:] != seen[:, :-1]
                i, j = np.nonzero(new)
                j = seen[i, j]
                other = ids[lo + i] != rid[j]
                i, j = i[other], j[other]
                best.add(lo + i, rid[j], _long(sum(p[i, j] for p in parts)))
        yield _found(ids, best)

    return run


def _resolve(sent, k: int, lists: int):
    """Phases 2 and 3 over all rows of a task."""

    def run(batches: Iterator) -> Iterator:
        ids, q, cutoff = sent.value
        best, q_length = _Best(len(ids), k, cutoff), {}
        for b in batches:
            rid, r = b.column(0).to_numpy(), _vectors(b.column(1))
            width = max(q.shape[1], r.shape[1])
            if width not in q_length:
                wide = np.pad(q, ((0, 0), (0, width - q.shape[1])))
                q_length = {width: (wide, _lengths(wide, lists))}
            wide, lengths = q_length[width]
            r = np.pad(r, ((0, 0), (0, width - r.shape[1])))
            long_ = _lengths(r, lists)
            order = np.argsort(-long_.sum(1), kind="stable")
            for at in range(0, len(rid), ROW_BLOCK):
                rows = order[at : at + ROW_BLOCK]
                reach = lengths @ long_[rows].max(0)
                some = np.flatnonzero(reach >= best.cutoff.astype(np.float64))
                for lo in range(0, len(some), QUERY_BLOCK):
                    _block(best, some[lo : lo + QUERY_BLOCK], ids, wide, rid[rows], r[rows], lists)
        yield _found(ids, best)

    return run


def _block(best: _Best, of: np.ndarray, ids: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, lists: int) -> None:
    parts = _partial_scores(q[of], r, lists)
    cutoff = best.cutoff[of]
    share = np.where(cutoff == _LOWEST, -np.inf, cutoff.astype(np.float64) / len(parts))
    share = (share - np.abs(np.where(np.isfinite(share), share, 0)) * 1e-9)[:, None]  # rounding never raises it
    enough = parts[0] >= share
    for p in parts[1:]:
        enough |= p >= share
    i, j = np.nonzero(enough)
    score = _long(sum(p[i, j] for p in parts))
    keep = (score >= cutoff[i]) & (ids[of[i]] != rid[j])
    best.add(of[i[keep]], rid[j[keep]], score[keep])


def top_k(queries: DataFrame, rows: DataFrame, k: int = 20, lists: int = LISTS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with the rows but its own (those with
    its identifier), ties to the smaller vec_id; all, if fewer.

    ``queries`` and ``rows``: (id long, v array<long>) as of quantise(); where lengths differ, missing components count as
    zero. Scores are exact; one beyond a long is given as the end of its range. A query identifier that is repeated
    counts once (the smallest of its vectors, if they differ); repeated rows are each a candidate. No queries or no rows: no
    result. What is read at once grows with neither queries nor rows: queries come in groups of ``query_bytes``."""
    spark = rows.sparkSession
    bounded_batches(spark)
    schema = "query_id long, vec_id long, score long"
    rows = materialize(rows.select("id", "v"), "vectors")
    one = materialize(queries.groupBy("id").agg(F.min("v").alias("v")), "queries")
    size = one.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not size[0] or rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = math.ceil(size[0] * 8 * (max(1, size[1]) + 2) / query_bytes)
    found = None
    for g in range(groups):
        some = one.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g).toArrow()
        if not some.num_rows:
            continue
        ids, q = some["id"].to_numpy(), _vectors(some["v"])
        if q.nbytes > 4 * query_bytes and len(ids) > 1:
            raise ValueError("vectors too long for a group of queries: raise query_bytes")
        sent = spark.sparkContext.broadcast((ids, q, None))
        seen = rows.mapInArrow(tidy(_gather(sent, k, lists)), schema)
        place = Window.partitionBy("query_id").orderBy(F.desc("score"))
        at = seen.withColumn("n", F.row_number().over(place)).where(F.col("n") == k).select("query_id", "score").toArrow()  # a row for each query of the group
        sent.destroy()
        cutoff = np.full(len(ids), _LOWEST)
        by_id = np.argsort(ids)
        cutoff[by_id[np.searchsorted(ids[by_id], at["query_id"].to_numpy())]] = at["score"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, q, cutoff))
        part = materialize(rows.mapInArrow(tidy(_resolve(sent, k, lists)), schema), "found")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
