"""Substring dedup with difference-cover anchors.

A window is ``window`` (13) consecutive words of one document; a word is removed if a window that covers it also starts
in a document with a smaller identifier. Hashing every window would shuffle more than the input, so:

1. Anchors. Positions p with p mod 7 in {0, 1, 3} are a difference cover: for any two positions i, j some shift below 7
   puts both on the cover. So two equal windows share an equal 7-word anchor at the same place inside them, and only
   3/7 of the positions are hashed. An anchor found in two documents is shared. False hits cost time, never rows.
2. Extension. Only windows around a shared anchor are hashed whole (64 bits, beside those of the bucket that they
   meet in). The smallest identifier of each window wins; windows of other documents are marked.
3. Marked windows go back to their documents, whose words are joined again without them.

What meets is compact: hashes go in blocks by bucket, with the places in a chunk of documents as small gaps. Within a
chunk equal hashes are settled at once and only one of them is sent on, so a passage in a third of all documents puts
one entry a chunk into its bucket, not one a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import tidy
from .common import CHUNK_BYTES, bounded_batches, buckets_for, materialize, text_bytes, text_bytes_col
from .words import U64, Words, chunks, grams, utf8

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
#: log2 of the bits of the filter of documents with shared anchors, eight for each, between these bounds (32 MB when sent).
FILTER_BITS = (16, 28)
#: Bytes of text for each bucket in which hashes meet; what a bucket holds is a small multiple less.
BUCKET_BYTES = 2 << 20
_NO_ID = np.iinfo(np.int64).max  # a null identifier is larger than any other

MEET = "bucket int, chunk long, kind int, keys binary, at binary, ids binary, runs binary"
BACK = "chunk long, kind int, at binary, ids binary, runs binary"
ENTRIES, KNOWN, TABLE = 0, 1, 2


def _gaps(at: np.ndarray) -> bytes:
    """Ascending places as differences, two bytes each where they fit."""
    d = np.diff(at, prepend=0)
    return d.astype("<u2").tobytes() if not len(d) or d.max() < 1 << 16 else d.astype("<u4").tobytes()


def _places(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype="<u4" if n and len(data) == 4 * n else "<u2").astype(np.int64))


def _batch(rows: list[tuple], names: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = [x.strip().split() for x in names.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)], [c for c, _ in columns])


def _blocks(chunk: int, bucket: np.ndarray, keys: np.ndarray, at: np.ndarray, ids: np.ndarray | None, n_buckets: int) -> list[tuple]:
    """One row for each bucket: its keys, places and (run-length coded) identifiers, in order of place."""
    order = np.argsort(at, kind="stable")
    order = order[np.argsort(bucket[order].astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32), kind="stable")]
    bucket, keys, at = bucket[order], keys[order], at[order]
    out = []
    for lo, hi in _spans(bucket):
        one, runs = b"", b""
        if ids is not None:
            mine = ids[order[lo:hi]]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            one, runs = mine[first].tobytes(), np.diff(first, append=hi - lo).astype("<u4").tobytes()
        out.append((int(bucket[lo]), chunk, ENTRIES, keys[lo:hi].tobytes(), _gaps(at[lo:hi]), one, runs))
    return out


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(values)], strict=True)) if cuts else []


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by key, first index of each run of equal keys, and the run of each ordered entry."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


class _Chunk:
    """Documents of one chunk: words, identifiers and text hashes."""

    def __init__(self, table):
        self.texts = utf8(table["text"])
        self.words = Words(self.texts, lower=False)
        import pyarrow.compute as pc

        self.ids = pc.fill_null(table["id"], _NO_ID).to_numpy()
        self.hashes = table["th"].to_numpy()
        self.count = self.words.counts()
        self.doc = np.repeat(np.arange(len(self.texts)), self.count)
        self.place = np.arange(len(self.doc)) - self.words.offset[self.doc]  # of a word in its document

    def table_row(self, chunk: int, n_buckets: int) -> tuple:
        runs = self.count.astype("<u4").tobytes()
        return (chunk % n_buckets, chunk, TABLE, b"", b"", np.column_stack([self.ids, self.hashes]).tobytes(), runs)


def _chunk_number(task: int, nth: int) -> int:
    return task << 24 | nth


def _anchors(n_buckets: int, window: int, chunk_bytes: int):
    """Documents to blocks of anchor hashes."""
    length = window - PERIOD + 1

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for nth, t in enumerate(chunks(batches, "text", chunk_bytes)):
            c, chunk = _Chunk(t), _chunk_number(task, nth)
            rows = [c.table_row(chunk, n_buckets)]
            at = np.flatnonzero(np.isin(c.place % PERIOD, COVER) & (c.place + length <= c.count[c.doc]) & (c.count[c.doc] >= window))
            if len(at):
                h = grams(c.words.hashes, length)[at]
                order, first, of = _runs(h)
                doc = c.ids[c.doc[at[order]]]
                low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
                several = (low != high)[of]
                sent = ~several
                sent[first] = True  # one entry stands for a run that is settled here
                known = np.sort(at[order[several]])
                h, at = h[order[sent]], at[order[sent]]
                rows += _blocks(chunk, ((h >> U64(32)) % U64(n_buckets)).astype(np.int64), (h & U64(0xFFFFFFFF)).astype("<u4"), at, None, n_buckets)
                rows.append((chunk % n_buckets, chunk, KNOWN, b"", known.astype("<u4").tobytes(), b"", b""))
            yield _batch(rows, MEET)

    return run


def _windows(n_buckets: int, window: int, chunk_bytes: int):
    """Documents with their shared anchors to blocks of window hashes."""

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for nth, t in enumerate(chunks(batches, "text", chunk_bytes)):
            c, chunk = _Chunk(t), _chunk_number(task, nth)
            rows = [c.table_row(chunk, n_buckets)]
            edge = np.zeros(len(c.doc) + 1, dtype=np.int32)
            for i, data in enumerate(t["at"].to_pylist()):
                a = np.frombuffer(data, dtype="<u4").astype(np.int64)
                start, most = c.words.offset[i], c.count[i] - window
                np.add.at(edge, start + np.maximum(a - (PERIOD - 1), 0), 1)
                np.add.at(edge, start + np.minimum(a, most) + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if len(at):
                h, other = grams(c.words.hashes, window)[at], grams(c.words.hashes, window, 1)[at]
                ids = c.ids[c.doc[at]]
                order, first, of = _runs(h)
                low = np.minimum.reduceat(ids[order], first)[of]
                later = ids[order] > low
                known = np.sort(at[order[later]])
                keep = order[~later]
                rows += _blocks(chunk, (other[keep] % U64(n_buckets)).astype(np.int64), h[keep], at[keep], ids[keep], n_buckets)
                rows.append((chunk % n_buckets, chunk, KNOWN, b"", known.astype("<u4").tobytes(), b"", b""))
            yield _batch(rows, MEET)

    return run


def _meet(by_id: bool):
    """A bucket's blocks to the places, in each chunk, of the entries that count: anchors in several chunks, or
    windows whose smallest identifier is another's. Rows of the other kinds pass."""

    def run(table):
        import pyarrow as pa

        rows = table.to_pylist()
        out = [(r["chunk"], r["kind"], r["at"], r["ids"], r["runs"]) for r in rows if r["kind"] != ENTRIES]
        rows = [r for r in rows if r["kind"] == ENTRIES]
        if rows:
            width = "<u8" if by_id else "<u4"
            keys = [np.frombuffer(r["keys"], dtype=width) for r in rows]
            n = [len(k) for k in keys]
            at = np.concatenate([_places(r["at"], k) for r, k in zip(rows, n, strict=True)])
            row = np.repeat(np.arange(len(rows)), n)
            if by_id:
                who = np.concatenate([np.repeat(np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["runs"], dtype="<u4")) for r in rows])
            else:
                who = row
            order, first, of = _runs(np.concatenate(keys))
            who = who[order]
            low = np.minimum.reduceat(who, first)
            hit = who > low[of] if by_id else (np.maximum.reduceat(who, first) != low)[of]
            row, at = row[order[hit]], at[order[hit]]
            order = np.argsort(row, kind="stable")
            row, at = row[order], at[order]
            for lo, hi in _spans(row):
                out.append((rows[row[lo]]["chunk"], KNOWN, at[lo:hi].astype("<u4").tobytes(), b"", b""))
        return pa.Table.from_batches([_batch(out, BACK)])

    return run


def _home(table):
    """A chunk's places to (id, th, at): the places in each document that has any."""
    import pyarrow as pa

    rows = table.to_pylist()
    made = [r for r in rows if r["kind"] == TABLE][0]
    who = np.frombuffer(made["ids"], dtype=np.int64).reshape(-1, 2)
    offset = np.concatenate([[0], np.cumsum(np.frombuffer(made["runs"], dtype="<u4").astype(np.int64))])
    at = np.unique(np.concatenate([np.frombuffer(r["at"], dtype="<u4").astype(np.int64) for r in rows if r["kind"] == KNOWN] or [np.empty(0, np.int64)]))
    cut = np.searchsorted(at, offset)
    docs = np.flatnonzero(np.diff(cut))
    ids = [None if who[d, 0] == _NO_ID else int(who[d, 0]) for d in docs]
    places = [(at[cut[d] : cut[d + 1]] - offset[d]).astype("<u4").tobytes() for d in docs]
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(who[docs, 1], pa.int64()), pa.array(places, pa.binary())], ["id", "th", "at"])


def _marked(rows: DataFrame, start, by_id: bool, name: str) -> DataFrame:
    """(id, th, at): one row for each document with places, through the meeting of equal hashes."""
    met = rows.mapInArrow(tidy(start), MEET).groupBy("bucket").applyInArrow(_meet(by_id), BACK)
    home = met.groupBy("chunk").applyInArrow(_home, "id long, th long, at binary")
    return materialize(home.dropDuplicates(["id", "th"]), name)


def _coded(rows: DataFrame, bits: int) -> DataFrame:
    """With the place (w) and the bit (m) of each document in the filter."""
    bit = f"pmod(xxhash64(id, th), {1 << bits})"
    return rows.withColumn("w", F.expr(f"shiftright({bit}, 6)")).withColumn("m", F.expr(f"shiftleft(1L, int({bit} % 64))"))


def _split(rows: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may be marked, and those that certainly are not, by a bitmap of bounded size in 64-bit words. It only
    saves shuffling texts that need no work; a false hit costs time alone."""
    low, high = FILTER_BITS
    bits_ = min(high, max(low, (8 * marked.count()).bit_length()))
    bits = _coded(marked.select("id", "th"), bits_).groupBy("w").agg(F.bit_or("m").alias("bits"))
    both = _coded(rows, bits_).join(F.broadcast(bits), "w", "left").withColumn("hit", F.coalesce(F.col("m").bitwiseAND(F.col("bits")) != 0, F.lit(False)))
    return both.where("hit").select(rows.columns), both.where("not hit").select(rows.columns)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, with_text: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space and, with
    ``with_text``, kept_text (those words; where none is removed, the text itself, unchanged). ``carry``: further columns
    of the input to return.

    Null text has no words. Documents shorter than a window lose nothing. Rows that repeat an identifier never remove
    from each other; a null identifier counts as larger than any other. Identifiers are whole numbers. Other columns
    play no part. An empty table gives an empty result."""
    if window < PERIOD:
        raise ValueError(f"window: at least {PERIOD}")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes_col(F.col(text_col).cast("string")).alias("text"), F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in carry)).alias("rest"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    n_buckets = buckets_for(spark, text_bytes(rows), BUCKET_BYTES)
    rest_type = rows.schema["rest"].dataType.simpleString()
    shared = _marked(rows.select("id", "th", "text"), _anchors(n_buckets, window, chunk_bytes), False, "shared-anchors")
    open_, settled = _split(rows, shared)
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
    with_anchors = open_.select("id", "th", "text").join(shared, same(open_, shared)).select(open_["id"], open_["th"], "text", "at")
    later = _marked(with_anchors, _windows(n_buckets, window, chunk_bytes), True, "marked-windows")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in chunks(batches, "text", chunk_bytes):
            n, gone, sha, kept = [], [], [], []
            for x, at in zip(utf8(t["text"]), t["at"].to_pylist(), strict=True):
                words = x.split()
                if not at:
                    n.append(len(words))
                    gone.append(0)
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    kept.append(x if with_text else None)
                    continue
                drop = np.zeros(len(words) + 1, dtype=np.int32)
                a = np.frombuffer(at, dtype="<u4").astype(np.int64)
                drop[a] += 1
                np.subtract.at(drop, a + window, 1)
                stay = np.cumsum(drop[:-1]) == 0
                left = b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s])
                n.append(len(words))
                gone.append(int(len(words) - stay.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [t["id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string()), t["rest"].combine_chunks()],
                ["id", "n_words", "n_removed", "kept_sha256", "kept_text", "rest"],
            )

    opened = open_.join(later, same(open_, later), "left").select(open_["id"], "text", "at", "rest")
    opened = opened.unionByName(settled.select("id", "text", F.lit(None).cast("binary").alias("at"), "rest"))
    out = opened.mapInArrow(tidy(cut), f"id long, n_words long, n_removed long, kept_sha256 string, kept_text string, rest {rest_type}")
    made = [F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    return out.select(*made, *(F.col("rest").getField(c).alias(c) for c in carry))
