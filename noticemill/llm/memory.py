"""What Python workers keep from task to task, and how freed memory goes back to the machine.

Spark reuses Python workers, so what a module remembers outlives its stage. A worker keeps one such object
at a time: asking for another drops the one before. Importing this module also makes the C library
return large freed blocks at once, and lets Arrow allocate through it, so that the size of a worker
follows what its task holds instead of the most that any task before it held.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable

import pyarrow as pa

#: Blocks of at least so many bytes are mapped on their own and go back when they are freed.
LARGE_BLOCK = 4 << 20

_kept: tuple[Hashable, object] | None = None


def keep(key: Hashable, make: Callable[[], object]):
    """The object of a key, made if the worker does not keep it; any other it keeps is dropped first."""
    global _kept
    if _kept is None or _kept[0] != key:
        _kept = None
        _kept = (key, make())
    return _kept[1]


def _return_freed_blocks() -> None:
    library = ctypes.CDLL(None)
    if hasattr(library, "mallopt"):
        m_trim_threshold, m_mmap_threshold = -1, -3
        library.mallopt(m_mmap_threshold, LARGE_BLOCK)
        library.mallopt(m_trim_threshold, LARGE_BLOCK)
    pa.set_memory_pool(pa.system_memory_pool())


_return_freed_blocks()
