"""Cutting texts into the words of a byte-level BPE, for whole Arrow slices at once.

The words are the matches of `PATTERN`.  Its alternatives look at the class of
code points only, so that numpy finds the starts of all words of a slice from
runs of equal class: no regular expression runs per word.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kinweave.llm.worker import cached
from kinweave.session import ship_functions

ship_functions(__name__)

#: The pattern whose matches `words` finds (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Code points with the Unicode property White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Bytes or code points handled at a time; a longer text is cut between words.
SLICE = 3_000_000
CUT = re.compile(r"(?<=[a-zA-Z]) (?=[a-zA-Z])")


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
                        np.uint8, sys.maxunicode + 1)
    table[SPACES] = SPACE
    return table


def pieces(texts: list[str | None], size: int = SLICE) -> Iterator[tuple[list[int], list[str]]]:
    """Slices of about `size` code points: (row of each piece, pieces).

    A text longer than `size` comes in pieces that end before a space between
    two letters, which is always a border of words; one without any stays whole.
    """
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            cut = CUT.search(text, at + size) if len(text) - at > size else None
            end = cut.start() if cut else len(text)
            if parts and held + end - at > size:
                yield rows, parts
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(text[at:end] if at or end < len(text) else text)
            held += end - at
            at = end
            if not cut:
                break
    if parts:
        yield rows, parts


def words(parts: list[str]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All words of the pieces in a row, and the number of words before each piece (with the total at the end)."""
    table = cached("word classes", _classes)
    whole = "".join(parts)
    n = len(whole)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    first = np.concatenate([[0], ends])
    data = whole.encode("utf-8")
    if n == 0:
        return pa.array([], pa.binary()), np.zeros(len(parts) + 1, np.int64)
    if len(data) == n:
        code: np.ndarray = np.frombuffer(data, np.uint8)
        byte_at = None
    else:
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(data, np.uint8)
        byte_at = np.flatnonzero((raw & 0xC0) != 0x80)
    kind = table[code]
    begins = np.zeros(n + 1, bool)
    begins[first] = True  # of texts
    run = begins[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(run)
    run_end = np.append(runs[1:], n)
    start = run  # of words
    # A run of white space before something else in its text gives its last character away.
    space = (kind[runs] == SPACE) & ~begins[run_end]
    last = run_end[space] - 1
    start[last] = True
    start[run_end[space][code[last] == 0x20]] = False
    # Contractions: an apostrophe alone, at the start of a word, before certain letters of the same text.
    lone = runs[(code[runs] == 0x27) & (run_end - runs == 1) & (run_end < n)]
    lone = lone[start[lone] & ~begins[lone + 1]]
    if len(lone):
        one = code[lone + 1]
        after = np.minimum(lone + 2, n - 1)
        two = np.where((lone + 2 < n) & ~begins[np.minimum(lone + 2, n)], code[after], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((two == ord("l")) & (one == ord("l")))
        for at, size in ((lone[short], 2), (lone[long], 3)):
            start[at + 1] = False
            after = at + size
            start[after[after < n]] = True
    at = np.flatnonzero(start)
    counts = np.searchsorted(at, first)
    offsets = np.append(at if byte_at is None else byte_at[at], len(data)).astype(np.int32)
    array = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return array, counts


def encode_words(array: pa.BinaryArray, known: dict[bytes, bytes], encode, most: int = 400_000) -> pa.BinaryArray:
    """The ids of every word as bytes; `encode` turns a list of distinct new words into a list of id bytes.

    `known` is what the process has met so far; at `most` words it starts anew.
    """
    coded = array.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    new = [w for w in distinct if w not in known]
    if new:
        if len(known) + len(new) > most:
            known.clear()
            new = distinct
        known.update(zip(new, encode(new)))
    ids = pa.array([known[w] for w in distinct], pa.binary())
    return ids.take(coded.indices)


def stream(array: pa.BinaryArray) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of the concatenated values."""
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset: array.offset + len(array) + 1]
    return at, memoryview(data) if data is not None else memoryview(b"")
