"""Jaro-Winkler similarity of columns of strings, all rows of an Arrow batch at once.

Equal letters of a pair are bit masks, one word for each letter of the first
string, so that a step of the matching is a few operations on vectors of rows.
`jaro_winkler` is the measure for one pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.session import ship_functions

ship_functions(__name__)

# Fixed values of the measure.
PREFIX_WEIGHT, PREFIX_LENGTH, BOOST_FROM = 0.1, 4, 0.7
#: Cells (letters of one string by letters of the other, over the rows) compared at a time.
CELLS = 500_000


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two strings; 0 when either is empty."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                left.append(ch)
                break
    m = len(left)
    if m == 0:
        return 0.0
    right = [ch for ch, unused in zip(b, free) if not unused]
    half = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    if jaro <= BOOST_FROM:
        return jaro
    prefix = 0
    for x, y in zip(a[:PREFIX_LENGTH], b[:PREFIX_LENGTH]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * PREFIX_WEIGHT * (1 - jaro)


def letters(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all strings in a row, where each begins, and their lengths; null counts as empty."""
    strings = pc.fill_null(strings, "")
    sizes = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = strings.cast(pa.large_string()).buffers()
    at = np.frombuffer(offsets, np.int64)[strings.offset: strings.offset + len(strings) + 1] if len(strings) else [0]
    text = bytes(memoryview(data)[at[0]: at[-1]]) if data is not None else b""
    points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.cumsum(sizes) - sizes, sizes


def _matrix(points: np.ndarray, begin: np.ndarray, sizes: np.ndarray, width: int, fill: int) -> np.ndarray:
    out = np.full((len(sizes), width), fill, np.uint32)
    inside = np.arange(width) < sizes[:, None]
    row, col = np.nonzero(inside)
    out[row, col] = points[begin[row] + col]
    return out


def _bits(same: np.ndarray) -> np.ndarray:
    """(rows, i, j) truth -> (rows, i) words whose bit j is set; j below 64."""
    packed = np.packbits(same, axis=2, bitorder="little")
    words = np.zeros((*packed.shape[:2], 8), np.uint8)
    words[:, :, : packed.shape[2]] = packed
    return words.view("<u8")[:, :, 0]


def _matches(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which letters of each row of `a` and of `b` match: each takes the first free equal one within reach."""
    n, width = a.shape
    if max(width, b.shape[1]) <= 64:
        same = _bits(a[:, :, None] == b[:, None, :])
        free = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        one, places = np.uint64(1), np.arange(64, dtype=np.uint64)
        near = np.abs(np.arange(width)[:, None, None] - np.arange(64)) <= np.arange(int(reach.max()) + 1)[:, None]
        window = _bits(near)  # by place and reach
        left = np.zeros((width, n), bool)
        same = np.ascontiguousarray(same.T)
        for i in range(width):
            found = same[i] & free & window[i][reach]
            first = found & (~found + one)
            free ^= first
            left[i] = first != 0
        left = left.T
        return left, ((~free[:, None] >> places[: b.shape[1]]) & one).astype(bool)
    free = np.ones(b.shape, bool)
    left = np.zeros((n, width), bool)
    at, rows = np.arange(b.shape[1]), np.arange(n)
    for i in range(width):
        found = (b == a[:, i: i + 1]) & free & (np.abs(at - i) <= reach[:, None])
        first = found.argmax(axis=1)
        left[:, i] = found[rows, first]
        free[rows[left[:, i]], first[left[:, i]]] = False
    return left, ~free


def _in_order(letters_of: np.ndarray, chosen: np.ndarray, fill: int) -> np.ndarray:
    """The chosen letters of each row moved to its front."""
    out = np.full(letters_of.shape, fill, np.uint32)
    row, col = np.nonzero(chosen)
    out[row, (np.cumsum(chosen, axis=1) - 1)[row, col]] = letters_of[row, col]
    return out


def _scores(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    reach = np.maximum(np.maximum(size_a, size_b) // 2 - 1, 0)
    left, right = _matches(a, b, reach)
    m = left.sum(axis=1)
    width = min(a.shape[1], b.shape[1])
    x, y = _in_order(a, left, 0)[:, :width], _in_order(b, right, 0)[:, :width]
    half = (x != y).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / size_a + m / size_b + (m - half) / m) / 3
    head = min(PREFIX_LENGTH, width)
    prefix = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1)
    score = np.where(jaro <= BOOST_FROM, jaro, jaro + prefix * PREFIX_WEIGHT * (1 - jaro))
    return np.where(m == 0, 0.0, score)


def jaro_winkler_rows(a: pa.Array, b: pa.Array) -> np.ndarray:
    """`jaro_winkler` of each row of two string arrays, for slices of rows of about one length at once."""
    (points_a, from_a, size_a), (points_b, from_b, size_b) = letters(a), letters(b)
    out = np.zeros(len(size_a))
    longest = np.maximum(size_a, size_b)
    order = np.argsort(longest, kind="stable")
    order = order[(size_a[order] > 0) & (size_b[order] > 0)]
    at = 0
    while at < len(order):
        last = at + 1
        # As many rows as fit, of up to twice the first one's length.
        reach = np.searchsorted(longest[order], max(8, 2 * longest[order[at]]), "right")
        width = int(longest[order[min(reach, len(order)) - 1]])
        last = max(last, min(reach, at + max(1, CELLS // (width * width))))
        rows = order[at:last]
        wide_a, wide_b = int(size_a[rows].max()), int(size_b[rows].max())
        # The fills differ from each other and from all letters.
        x = _matrix(points_a, from_a[rows], size_a[rows], wide_a, 0xFFFFFFFF)
        y = _matrix(points_b, from_b[rows], size_b[rows], wide_b, 0xFFFFFFFE)
        out[rows] = _scores(x, y, size_a[rows], size_b[rows])
        at = last
    return out


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(jaro_winkler_rows(a, b))


def segments_agree(a: str, b: str, least: float = 0.8) -> bool:
    """False only for two two-word names whose first or last words differ too much."""
    x, y = a.split(" "), b.split(" ")
    if len(x) != 2 or len(y) != 2:
        return True
    return jaro_winkler(x[0], y[0]) >= least and jaro_winkler(x[1], y[1]) >= least


def segments_agree_rows(a: pa.Array, b: pa.Array, least: float = 0.8) -> np.ndarray:
    """`segments_agree` of each row of two string arrays."""
    two = [pc.equal(pc.count_substring(x, " "), 1).to_numpy(zero_copy_only=False) for x in (a, b)]
    rows = np.flatnonzero(two[0] & two[1])
    out = np.ones(len(a), bool)
    words = [pc.split_pattern(x.take(pa.array(rows)), " ") for x in (a, b)]
    for k in (0, 1):
        out[rows] &= jaro_winkler_rows(*[pc.list_element(w, k) for w in words]) >= least
    return out


@F.arrow_udf(T.BooleanType())
def segment_compatible(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(segments_agree_rows(a, b))
