"""Memory of Python workers. They are kept between tasks, and with them what Arrow and the C library hold on to."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import Any

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(batches: Iterator[Any]) -> Iterator[Any]:
    """Arrow data, batch by batch; what a batch took goes back to the system before the next."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()
    give_back()
