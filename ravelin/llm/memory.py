"""What Python workers keep: they are used again by stage after stage, so each keeps one large object and gives memory back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """The object that this worker keeps under ``name``; whatever it kept under another name goes first."""
    if name not in _kept:
        _kept.clear()
        give_back()
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Free memory goes from the worker's allocators to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(rows: Callable, keeps: bool = False) -> Callable:
    """A function over Arrow batches that gives memory back when its task ends, and first drops what others kept, unless it ``keeps``."""

    def leaner(batches):
        if not keeps and _kept:
            _kept.clear()
            give_back()
        yield from rows(batches)
        give_back()

    return leaner


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
