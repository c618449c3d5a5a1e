"""MD5 whose state can leave a process: a digest begun in one task goes on in another."""

from __future__ import annotations

import ctypes
import struct
from functools import cache
from math import floor, sin


@cache
def _native():
    """The C library that Python's own hashes are linked to; None where it isn't to be had. It is held against a known digest."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        lib.MD5_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.MD5_Init.argtypes, lib.MD5_Final.argtypes = [ctypes.c_char_p], [ctypes.c_char_p, ctypes.c_char_p]
        context = ctypes.create_string_buffer(256)
        if lib.MD5_Init(context) != 1 or context.raw[:16] != struct.pack("<4I", *_BEGIN) or any(context.raw[92:]):
            return None
        lib.MD5_Update(context, b"abc", 3)
        return lib if context.raw[16:27] == struct.pack("<2I", 24, 0) + b"abc" and context.raw[88:92] == struct.pack("<I", 3) else None
    except (ImportError, OSError, AttributeError):
        return None


_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [floor(abs(sin(i + 1)) * 2**32) for i in range(64)]
_PLACES = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]


def _block(a0: int, b0: int, c0: int, d0: int, block: bytes) -> tuple[int, int, int, int]:
    a, b, c, d, words = a0, b0, c0, d0, struct.unpack("<16I", block)
    for i in range(64):
        f = (b & c) | (~b & d) if i < 16 else (d & b) | (~d & c) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | (~d & 0xFFFFFFFF))
        f = (f + a + _SINES[i] + words[_PLACES[i]]) & 0xFFFFFFFF
        a, d, c, b = d, c, b, (b + ((f << _SHIFTS[i] | f >> (32 - _SHIFTS[i])))) & 0xFFFFFFFF
    return (a0 + a) & 0xFFFFFFFF, (b0 + b) & 0xFFFFFFFF, (c0 + c) & 0xFFFFFFFF, (d0 + d) & 0xFFFFFFFF


class Md5:
    """As hashlib.md5, from a state or from the beginning. A state is four words, the number of bits and what is left of a block:
    4 + 4 + 4 + 4 + 8 + 64 + 4 bytes, in C (of low byte order) as here. Without the C library it is the same in Python, at about a hundredth of the
    speed."""

    def __init__(self, state: bytes | None = None, native: bool = True):
        self.lib = _native() if native else None
        self.now = state or struct.pack("<4IQ64sI", *_BEGIN, 0, b"", 0)
        if self.lib:
            self.context = ctypes.create_string_buffer(self.now, 256)

    def update(self, data: bytes) -> None:
        if self.lib:
            self.lib.MD5_Update(self.context, data, len(data))
            return
        *words, bits, rest, held = struct.unpack("<4IQ64sI", self.now)
        data, bits = rest[:held] + data, bits + 8 * len(data)
        whole = len(data) - len(data) % 64
        for i in range(0, whole, 64):
            words = _block(*words, data[i : i + 64])
        self.now = struct.pack("<4IQ64sI", *words, bits, data[whole:], len(data) - whole)

    def state(self) -> bytes:
        return self.context.raw[:92] if self.lib else self.now

    def hexdigest(self) -> str:
        *_, bits, _, held = struct.unpack("<4IQ64sI", self.state())
        end = Md5(self.state(), native=self.lib is not None)
        end.update(b"\x80" + bytes((55 - held) % 64) + struct.pack("<Q", bits & (2**64 - 1)))
        return end.state()[:16].hex()
