"""Sets of small whole numbers as sparse bitmaps, intersected for whole Arrow batches.

A set is an array of (w, m): m has bit b set if 64 w + b is a member; words stand in
order and none is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kinweave.session import ship_functions

ship_functions(__name__)

BITMAP = "array<struct<w:int,m:long>>"
#: Words whose bits are counted at a time.
WORDS = 100_000


def _words(column: pa.Array, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number and mask of every word of the batch."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    w, m = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return np.repeat(np.arange(len(sizes)), sizes), w.astype(np.int64), m.astype(np.int64).view(np.uint64)


def common(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number and mask of the members that both sets of a row have."""
    row, w, m = _words(left)
    row_b, w_b, m_b = _words(right)
    key, key_b = row << 32 | w, row_b << 32 | w_b
    if not len(key):
        return key, key, m
    at = np.minimum(np.searchsorted(key, key_b), len(key) - 1)
    met = key[at] == key_b
    both = m[at[met]] & m_b[met]
    some = both != 0
    return row_b[met][some], w_b[met][some], both[some]


def members(group: np.ndarray, w: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, member, times): how often each number is in the sets of a group, from their words."""
    groups, names, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    order = np.lexsort((w, group))
    group, w, m = group[order], w[order], m[order]
    for first in range(0, len(w), WORDS):
        g, x = group[first: first + WORDS], w[first: first + WORDS]
        begin = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(x, prepend=-1) != 0))
        bits = np.unpackbits(m[first: first + WORDS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        cell, bit = np.nonzero(sums)
        groups.append(g[begin[cell]])
        names.append(x[begin[cell]] * 64 + bit)
        times.append(sums[cell, bit])
    return np.concatenate(groups), np.concatenate(names), np.concatenate(times)
