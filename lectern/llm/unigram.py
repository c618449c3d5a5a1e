"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

A model file gives pieces and log scores. White space becomes the marker U+2581, with one in front of the text, and the
best path of pieces is found over UTF-8 bytes. Characters that no piece covers cost less than the worst piece minus 10
and are written as byte pieces. Where no piece has a marker after another character or holds a line end (checked), the
best path of a text is that of its runs (markers and the characters after them), so each distinct run is solved once in
a Python worker and kept in a cache of bounded size.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import TwoAges, kept, tidy
from .common import CHUNK_BYTES, bounded_batches
from .words import chunks, utf8

MARK = "▁"
PENALTY = 10.0


class DoubleArray:
    """A trie over bytes in two arrays: from node s by byte c to t = base[s] + c, if check[t] == s. ``value[s]`` is the
    number of the key that ends at s, or -1."""

    def __init__(self, keys: list[bytes]):
        order = sorted((k, i) for i, k in enumerate(keys) if k)
        size = 1024
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        stack, free, dense = [(0, 0, len(order), 0)], 256, 256  # so a base is never below 1
        while stack:
            node, lo, hi, depth = stack.pop()
            if lo < hi and len(order[lo][0]) == depth:
                self.value[node] = order[lo][1]
                lo += 1
            if lo == hi:
                continue
            kids, at = [], lo
            while at < hi:  # children by their next byte
                c, start = order[at][0][depth], at
                while at < hi and order[at][0][depth] == c:
                    at += 1
                kids.append((c, start, at))
            first = kids[0][0]
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            place = begun = free if len(kids) == 1 else max(free, dense)
            while True:
                base = place - first
                while base + 256 >= len(self.check):
                    self.base += [0] * len(self.base)
                    self.value += [-1] * len(self.value)
                    self.check += [-1] * len(self.check)
                if all(self.check[base + c] < 0 for c, _, _ in kids):
                    break
                place += 1
            if len(kids) > 1 and place - begun > 32:  # the cells before are nearly full: later families begin here
                dense = max(dense, place - 32)
            self.base[node] = base
            for c, start, end in kids:
                self.check[base + c] = node
                stack.append((base + c, start, end, depth + 1))

    def prefixes(self, data: bytes, at: int) -> list[tuple[int, int]]:
        """(end, key number) of every key that starts at ``at``."""
        base, check, value, node, out = self.base, self.check, self.value, 0, []
        for end in range(at, len(data)):
            to = base[node] + data[end]
            if check[to] != node or to == 0:
                break
            node = to
            if value[node] >= 0:
                out.append((end + 1, value[node]))
        return out


class Unigram:
    """pieces: (text, score, kind) in order of id; kind "normal", "byte", "control" or "unknown"."""

    def __init__(self, pieces: list[tuple[str, float, str]], cache_bytes: int = 64 << 20):
        self.scores = [p[1] for p in pieces]
        normal = [i for i, p in enumerate(pieces) if p[2] == "normal"]
        self.ids = normal
        self.trie = DoubleArray([pieces[i][0].encode() for i in normal])
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        self.byte_id = {int(p[0][3:5], 16): i for i, p in enumerate(pieces) if p[2] == "byte"}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown_score = min([self.scores[i] for i in normal], default=0.0) - PENALTY
        self.written = [p[0].encode() if p[2] == "normal" else bytes([self.byte_of[i]]) if p[2] == "byte" else b"" for i, p in enumerate(pieces)]
        texts = [pieces[i][0] for i in normal]
        apart = not any(MARK in t.lstrip(MARK) or ("\n" in t and t != "\n") for t in texts)
        self.runs = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if apart else r"(?s).+").findall
        self.cache = TwoAges(cache_bytes)

    @classmethod
    def load(cls, path: str) -> Unigram:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unused(i) else "unknown" if m.is_unknown(i) else "normal"
        return cls([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])

    def best_path(self, data: bytes) -> list[int]:
        """Ids of the best path over UTF-8 bytes; of equal scores the one found first, from the left."""
        n = len(data)
        best, come, via = [None] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            if here is None:
                continue
            one = at + 1  # the end of the character
            while one < n and data[one] & 0xC0 == 0x80:
                one += 1
            single = False
            for end, k in self.trie.prefixes(data, at):
                i = self.ids[k]
                score = here + self.scores[i]
                if best[end] is None or score > best[end]:
                    best[end], come[end], via[end] = score, at, i
                single |= end == one
            if not single:
                score = here + self.unknown_score
                if best[one] is None or score > best[one]:
                    best[one], come[one], via[one] = score, at, -1
        out: list[int] = []
        at = n
        while at:
            start = come[at]
            if via[at] >= 0:
                out.append(via[at])
            elif self.byte_id:
                out += [self.byte_id[b] for b in reversed(data[start:at])]
            else:
                out.append(self.unknown)
            at = start
        return out[::-1]

    def run(self, run: str) -> bytes:
        ids = self.best_path(run.encode())
        value = struct.pack(f"<{len(ids)}I", *ids)
        self.cache.put(run, value)
        return value

    def encode(self, text: str) -> bytes:
        """Ids, four little-endian bytes each; an empty text has none."""
        if not text:
            return b""
        runs = self.runs(MARK + text.replace(" ", MARK))
        out = list(map(self.cache.get, runs))
        if None in out:
            for i, known in enumerate(out):
                if known is None:
                    try:
                        out[i] = self.cache[runs[i]]
                    except KeyError:
                        out[i] = self.run(runs[i])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text again: markers are spaces, the first is dropped; bytes that are no UTF-8 become U+FFFD."""
        written = self.written
        text = b"".join([written[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def unigram(path: str) -> Unigram:
    """One for each path in a Python worker: the cache lasts over the tasks of an encoding stage."""
    return kept("unigram", path, lambda: Unigram.load(path))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: id, n_ids, n_byte_pieces, ids_crc32 (of the little-endian ids), round_trip (decoding gives
    the text again) and, with ``with_ids``, ids as binary.

    Texts are taken as they are: a normaliser that the model file names is not applied. Null text is empty: no ids. A text that holds the marker character itself comes back with a space for it, which
    round_trip tells. Rows that repeat an identifier are encoded each. Other columns play no part."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = unigram(path)
        is_byte = np.zeros(len(m.scores), dtype=bool)
        is_byte[list(m.byte_of)] = True
        for t in chunks(batches, "text", chunk_bytes):
            n, fallback, crc, same, out = [], [], [], [], []
            for data in utf8(t["text"]):
                text = data.decode()
                ids = m.encode(text)
                n.append(len(ids) // 4)
                fallback.append(int(is_byte[np.frombuffer(ids, dtype="<u4")].sum()))
                crc.append(zlib.crc32(ids))
                same.append(m.decode(ids) == text)
                out.append(ids if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [t["id"].combine_chunks(), *(pa.array(x, pa.int64()) for x in (n, fallback, crc)), pa.array(same), pa.array(out, pa.binary())],
                ["id", "n_ids", "n_byte_pieces", "ids_crc32", "round_trip", "ids"],
            )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(tidy(run, "unigram"), f"id {kind}, n_ids long, n_byte_pieces long, ids_crc32 long, round_trip boolean, ids binary").withColumnRenamed("id", id_col)
    return out if with_ids else out.drop("ids")


def decode_documents(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of (id, ids binary) rows; null ids give null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = unigram(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(run, "unigram"), f"id {kind}, text string").withColumnRenamed("id", id_col)
