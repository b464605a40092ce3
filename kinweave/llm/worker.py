"""Small helpers of the tasks: a cache per worker process, texts of a batch in slices."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

from kinweave.session import ship_functions

ship_functions(__name__)


def cached(name: str, make: Callable[[], Any]) -> Any:
    """A value made once per worker process; shipped functions have no lasting globals of their own."""
    home = sys.modules.setdefault("_kinweave_worker", types.ModuleType("_kinweave_worker")).__dict__
    if name not in home:
        home[name] = make()
    return home[name]


def sliced(column: pa.Array, size: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of consecutive rows with about `size` bytes: a batch never stands in memory as strings."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset: column.offset + len(column) + 1] if len(column) else []
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, int(offsets[first]) + size, "right")) - 1)
        yield first, column.slice(first, last - first).to_pylist()
        first = last
