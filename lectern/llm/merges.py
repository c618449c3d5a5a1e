"""Byte-pair merges of many pieces at once.

The pieces of about one length are the columns of a matrix of symbols. In each step every piece that can still be merged
merges its pair of the lowest rank, the leftmost of equal ones, and so gets one symbol shorter: the order in which the
``tokenizers`` library merges a piece. The ranks of pairs lie in a table with open addresses.
"""

from __future__ import annotations

import numpy as np

#: The longest piece (in bytes) of each matrix; shorter ones are filled up.
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64)
#: Pieces of a matrix.
BLOCK = 1 << 13
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Merges:
    #: Bytes of the longest piece that is merged here: steps and symbols both grow with its length.
    longest = WIDTHS[-1]

    def __init__(self, model: dict, letters: list[str]):
        """``model``: that part of the vocabulary's file; ``letters``: what it writes for each byte. ValueError: a model
        that merges by other rules."""
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        known = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges"))
        if not known or not all(x in vocab and x + suffix in vocab for x in letters) or len({a + b for a, b in pairs}) < len(pairs):
            raise ValueError("not a model of plain merges, one for each symbol that is made")
        self.inner = np.array([vocab[x] for x in letters], dtype=np.int32)
        self.last = np.array([vocab[x + suffix] for x in letters], dtype=np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.none, self.fill = len(pairs), max(vocab.values()) + 1
        keys = self._key(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.table = np.full(1 << bits, self.none, dtype=np.int32)
        todo, at = np.arange(len(pairs)), self._slot(keys)
        while len(todo):
            free = self.table[at] == self.none
            self.table[at[free]] = todo[free]
            lost = self.table[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask
        self.keys = np.append(keys, ~np.uint64(0))

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * _FACTOR >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``none`` if it is never merged."""
        key = self._key(left, right)
        at = self._slot(key)
        out = self.table[at]
        off = np.flatnonzero((self.keys[out] != key) & (out != self.none))
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            out[off] = now = self.table[at[off]]
            off = off[(self.keys[now] != key[off]) & (now != self.none)]
        return out

    def merge(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many symbols each piece symbols[start : start + length] has in the end; they are written at its start.
        No piece may be longer than ``longest``."""
        count, low = length.copy(), 1
        if not len(start):
            return count
        first = np.append(self.rank(symbols[:-1], symbols[1:]), np.int32(self.none))
        for width in WIDTHS:
            these = np.flatnonzero((length > low) & (length <= width))
            low = width
            for i in range(0, len(these), BLOCK):
                self._block(symbols, first, start, count, these[i : i + BLOCK], width)
        return count

    def _block(self, symbols, first, start, count, these, width) -> None:
        column = np.arange(width, dtype=np.int32)[:, None]
        at = np.minimum(start[these] + column, len(symbols) - 1)
        s = np.where(column < count[these], symbols[at], np.int32(self.fill))
        r = np.where(column < count[these] - 1, first[at], np.int32(self.none))[:-1]
        bits = (width - 1).bit_length()  # rank and place in one number: the least is the leftmost of the lowest rank
        while True:
            best = (r << bits | column[: len(r)]).min(axis=0) if len(r) else np.full(len(these), self.none << bits)
            going = best < self.none << bits
            if not going.all():
                over = np.flatnonzero(~going)
                n = count[these[over]]
                for j in range(min(len(s), int(n.max()))):
                    some = over[n > j]
                    symbols[start[these[some]] + j] = s[j, some]
                stay = np.flatnonzero(going)
                if not len(stay):
                    return
                these, s, r, best = these[stay], s[:, stay], r[:, stay], best[stay]
            rank, p = best >> bits, best & (1 << bits) - 1
            i = np.arange(len(these))
            s = np.where(column[: len(s) - 1] <= p, s[:-1], s[1:])
            s[p, i] = new = self.made[rank]
            r = np.where(column[: len(r) - 1] <= p, r[:-1], r[1:])
            some = np.flatnonzero(p + 1 < len(s))
            r[p[some], some] = self.rank(new[some], s[p[some] + 1, some])
            some = np.flatnonzero(p)
            r[p[some] - 1, some] = self.rank(s[p[some] - 1, some], new[some])
            count[these] -= 1
