"""Token ids of whole texts by a vocabulary of the ``tokenizers`` library, word by word with a cache.

For vocabularies that drop white space and never join across it (``splits_on_space``), a text's ids are the joined ids
of its ASCII-white-space words, so each distinct word is encoded once and kept as little-endian unsigned 32-bit ids.
New words of a chunk are encoded together: those within Latin-1 (normal form C leaves them alone) are split and merged in
arrays (``merges``), long pieces by the library's merge model; any other word goes through the library's whole encoding. All
give the ids of the library's own encode().
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections import defaultdict
from itertools import count, islice

import numpy as np

from .caches import OVERHEAD, TwoAges, kept
from .merges import Merges

#: The split pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: New words that are encoded together, and the longest of them (with a line feed) in bytes; longer ones go alone.
TOGETHER, LONGEST = 1 << 14, 256
_LATIN = [chr(c) for c in range(256)]
_LOWER = np.array([ord(c.lower()) for c in _LATIN], dtype=np.uint8)
#: 0: line feed, which ends a word; 1: letters; 2: numbers; 3: others.
_CLASS = np.array([0 if c == "\n" else 1 if c.isalpha() else 2 if unicodedata.category(c)[0] == "N" else 3 for c in _LATIN], dtype=np.uint8)
#: Bytes that the arrays leave to the library: control characters, '<' (it may begin a special token), characters beyond Latin-1.
_OTHER = np.array([b >= 0xC4 or b == 0x7F or b == ord("<") or (b < 32 and b != 10) for b in range(256)])


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next free one
    from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def _four(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Words get numbers as they are met; ``ids`` holds what each is encoded to. Both are forgotten after a chunk that brings
    them over ``limit`` bytes."""

    def __init__(self, path: str, cache_bytes: int = 48 << 20):
        import regex
        from tokenizers import Tokenizer

        self.made_from = path, cache_bytes
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = [p for p in made["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        self.direct = bool(split) and split[0]["pattern"].get("Regex") == PATTERN and [n["type"] for n in made["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        if not self.direct:
            raise ValueError(f"{path}: not a vocabulary that drops white space")
        self.tokenize = self.tokenizer.model.tokenize
        self.pieces = regex.compile(PATTERN).findall
        self.letters = dict(enumerate(byte_letters()))
        self.limit, self.parts = 2 * cache_bytes, TwoAges(cache_bytes // 2)
        self.forget()
        try:
            self.merges = Merges(made["model"], byte_letters())
        except ValueError:  # every word by the library
            self.merges = None

    def __reduce__(self):
        return WordIds, self.made_from  # a copy begins with nothing kept

    def part(self, text: str) -> bytes:
        try:
            return self.parts[text]
        except KeyError:
            letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            value = _four([t.id for t in self.tokenize(letters)])
            self.parts.put(text, value)
            return value

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha() and max(text) < "\u0100":
            value = self.part(text.lower())
        elif text.isprintable() and "<" not in text and max(text) < "\u0100":  # '<' may begin a special token
            value = b"".join([self.part(p) for p in self.pieces(text.lower())])
        else:
            value = _four(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return value

    def together(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (without white space)."""
        if not self.merges:
            return [self.word(w) for w in words]
        joined = b"\n".join([*words, b""])
        raw = np.frombuffer(joined, dtype=np.uint8)
        other = _OTHER[raw]
        second = raw[1:]
        other[1:] |= (raw[:-1] == 0xC2) & ((second <= 0xA0) | (second == 0xAD))  # control characters, no-break space, soft hyphen
        ends = np.flatnonzero(raw == 10)
        odd = {*np.searchsorted(ends, np.flatnonzero(other)).tolist(), *np.flatnonzero(np.diff(ends, prepend=-1) > LONGEST).tolist()}
        if odd:
            plain = iter(self.together([w for i, w in enumerate(words) if i not in odd]) if len(odd) < len(words) else ())
            return [self.word(w) if i in odd else next(plain) for i, w in enumerate(words)]
        chars = _LOWER[np.frombuffer(joined.decode().encode("latin-1"), dtype=np.uint8)]
        bounds = np.flatnonzero(self.starts(chars))
        text = chars.tobytes().decode("latin-1").encode()
        raw = np.frombuffer(text, dtype=np.uint8)
        if len(raw) > len(chars):
            bounds = (np.cumsum(1 + (chars > 127)) - 1 - (chars > 127))[bounds]
        inside = raw[bounds] != 10
        start, length = bounds[inside], np.diff(bounds, append=len(raw))[inside]
        symbols = self.merges.inner[raw]
        symbols[start + length - 1] = self.merges.last[raw[start + length - 1]]
        count, short = length.copy(), length <= self.merges.longest
        count[short] = self.merges.merge(symbols, start[short], length[short])
        for i in np.flatnonzero(~short):
            ids = self.part(text[start[i] : start[i] + length[i]].decode())
            count[i] = len(ids) // 4
            symbols[start[i] : start[i] + count[i]] = np.frombuffer(ids, dtype="<u4")
        # a piece keeps its first symbols
        keep = np.zeros(len(raw) + 1, dtype=np.int32)
        keep[start] = 1
        keep[start + count] -= 1  # where the next piece begins, if nothing was merged
        keep = np.cumsum(keep[:-1])
        ids = symbols[keep > 0].astype("<u4").tobytes()
        ends = (4 * np.cumsum(keep)[raw == 10]).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def starts(self, chars: np.ndarray) -> np.ndarray:
        """Where the pieces of PATTERN begin in lower-case words that end in line feeds; line feeds count as pieces."""
        kind = _CLASS[chars]
        start = np.ones(len(chars), dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (kind[1:] == 0)
        at = np.flatnonzero((chars == ord("'")) & start)
        at = at[kind[at + 1] == 1]  # a line feed is last, so there is a next one, and one after a letter
        a, b = chars[at + 1], chars[at + 2]
        two = np.isin(a, list(b"stmd"))
        three = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[at[two | three] + 1] = False
        after = np.concatenate([at[two] + 2, at[three] + 3])
        start[after] = True
        return start

    def many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole UTF-8 texts, four bytes each."""
        known = len(self.ids)
        if known < len(self.number):  # an earlier call failed
            self.forget()
            known = 0
        texts = [list(map(self.number.__getitem__, t.split())) for t in texts]
        new = list(islice(self.number, known, None))
        for i in range(0, len(new), TOGETHER):
            self.ids += self.together(new[i : i + TOGETHER])
        self.size += len(new) * (OVERHEAD + 40) + sum(map(len, new)) + sum(map(len, self.ids[known:]))
        out = [b"".join(map(self.ids.__getitem__, t)) for t in texts]
        if self.size > self.limit:
            self.forget()
        return out

    def forget(self) -> None:
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[bytes] = []
        self.size = 0

    def encode(self, text: bytes) -> bytes:
        return self.many([text])[0]

    __call__ = encode


def word_ids(path: str) -> WordIds:
    """One for each path in a Python worker: the cache lasts over the tasks of a packing stage."""
    return kept("packing", path, lambda: WordIds(path))
