"""What Python workers keep: dictionaries of bounded bytes, models that last over the tasks of one kind of stage, and
memory that goes back at a task's end."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

#: Bytes that an entry takes beside its key and its value.
OVERHEAD = 180


def _length(x) -> int:
    """The length of texts and bytes; of what has none, the size of the object."""
    return len(x) if hasattr(x, "__len__") else sys.getsizeof(x)


class TwoAges(dict):
    """The young entries; ``old`` holds those of the age before. When the young take ``limit`` bytes they become the old,
    and the former old are forgotten: at most 2 * limit bytes are held. Keys or values over ``longest`` bytes are not
    kept at all, so one long word or text can't fill the cache."""

    def __init__(self, limit: int, longest: int = 256):
        super().__init__()
        self.limit, self.longest, self.size, self.old = limit, longest, 0, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError: not known
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        k, v = _length(key), _length(value)
        if k > self.longest or v > 4 * self.longest:
            return
        if self.size >= self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0
        self[key] = value
        self.size += OVERHEAD + k + v


_KEPT: dict[tuple, object] = {}


def kept(kind: str, name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a worker for (kind, name) while it runs stages of this kind."""
    key = (kind, name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Free memory goes back to the system: that of Arrow's pool and, where the C library can, its heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def tidy(run: Callable[[Iterator], Iterator], kind: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` (Arrow batches to Arrow batches), which begins without what stages of other kinds have kept in this worker
    and gives its free memory back at the end."""

    def tidied(batches: Iterator) -> Iterator:
        for key in [k for k in _KEPT if k[0] != kind]:
            del _KEPT[key]
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
