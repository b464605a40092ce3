"""Alignment of the tokens of two tokenizers by lockstep vectorised merging.

Both token sequences of a text cover the same bytes.  One state vector holds a
pointer into the A tokens and one into the B tokens for every lane, a lane being a
run of up to `LANE` A tokens of a document; each step emits one link per lane,
cuts where both tokens end at one byte, and advances the pointers whose token ends
first.  Lanes that are done leave the vector, so a document of any length costs a
bounded number of steps.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.bpe import load_blob
from kinweave.llm.worker import cached, sliced
from kinweave.llm.words import encode_words, pieces, stream, words
from kinweave.operators.skew import lookup
from kinweave.session import settle, ship_functions

ship_functions(__name__)

#: A tokens of a lane, and bytes of text aligned at a time.
LANE, SLICE = 192, 1_500_000
#: Pairs of ids that a task counts before it passes them on, and that are broadcast at most (17 bytes each).
COUNTED, BROADCAST_PAIRS = 2_000_000, 2_000_000


def byte_letters() -> dict[str, int]:
    """Letter of byte-level vocabularies -> byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    """The bytes of a sentencepiece piece: U+2581 is a space, <0xHH> a byte."""
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def _pack(found: list[list[int]]) -> list[bytes]:
    return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]


class ByteLevel:
    """A byte-level BPE of the tokenizers library; its special tokens in a text are ordinary text."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True
        parts = json.loads(spec)
        cutter = parts["pre_tokenizer"] or {}
        if parts["normalizer"] or cutter.get("type") != "ByteLevel" or not cutter.get("use_regex") or cutter.get("add_prefix_space"):
            raise ValueError("the tokenizer must cut words by the byte-level pattern and nothing else")
        letters = byte_letters()
        self.tokens = [b""] * self.tok.get_vocab_size()
        for token, i in self.tok.get_vocab().items():
            self.tokens[i] = bytes(letters[c] for c in token)
        self.known: dict[bytes, bytes] = {}

    def new(self, some: list[bytes]) -> list[bytes]:
        return _pack([e.ids for e in self.tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (with the total at the end)."""
        blobs: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        for rows, parts in pieces(texts):
            found, counts = words(parts)
            at, data = stream(encode_words(found, self.known, self.new))
            at = at[counts]
            blobs.append(np.frombuffer(data, "<u4")[at[0] // 4: at[-1] // 4])
            np.add.at(sizes, rows, np.diff(at) // 4)
        return np.concatenate([np.zeros(0, "<u4"), *blobs]), np.concatenate([[0], np.cumsum(sizes)])


class Pieces:
    """A sentencepiece BPE.  Texts are cut before each run of spaces: no piece has a space after another character (checked)."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.tok.id_to_piece(i) for i in range(self.tok.get_piece_size())]
        self.whole = any(re.search("[^▁]▁", name) for name in names)
        probe = "x  y "  # a normalizer that touches spaces forbids the cuts too
        self.whole |= b"".join(piece_bytes(names[i]) for i in self.tok.encode(probe)) != f" {probe}".encode()
        self.tokens = [piece_bytes(name) for name in names]
        self.known: dict[bytes, bytes] = {}

    def new(self, some: list[bytes]) -> list[bytes]:
        found = self.tok.encode([w[1:].decode() for w in some], num_threads=1)
        # The model adds no space to nothing: a space at the end of a text is what stands after the x of this probe.
        return _pack([ids or self.tok.encode("x ")[1:] for ids in found])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `ByteLevel.encode`; `texts` begin with the space that the model adds to them."""
        if self.whole:
            blobs = self.new([t.encode() for t in texts])
            at = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])])
            return np.frombuffer(b"".join(blobs), "<u4"), at
        data = "".join(texts).encode()
        first = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        byte = np.frombuffer(data, np.uint8)
        space = byte == 0x20
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[first[:-1]] = True
        at = np.flatnonzero(begin)
        counts = np.searchsorted(at, first)
        offsets = np.append(at, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        ends, ids = stream(encode_words(found, self.known, self.new))
        return np.frombuffer(ids, "<u4")[: ends[-1] // 4], ends[counts] // 4


def merge_lanes(a_end: np.ndarray, b_end: np.ndarray, a_lane: np.ndarray, b_lane: np.ndarray, a_stop: np.ndarray):
    """Links and cuts of many lanes in lockstep: (A index of each link, its B index, A index and B index at each cut).

    `a_end` and `b_end` are the byte ends of all tokens, documents one after the
    other; a lane runs from its A and B pointer until its A pointer is at `a_stop`.
    """
    i, j, stop = a_lane.copy(), b_lane.copy(), a_stop
    left, right, a_cut, b_cut = [], [], [], []
    while len(i):
        left.append(i)
        right.append(j)
        ea, eb = a_end[i], b_end[j]
        both = ea == eb
        a_cut.append(i[both])
        b_cut.append(j[both])
        i, j = i + (ea <= eb), j + (eb <= ea)
        on = i < stop
        if not on.all():
            i, j, stop = i[on], j[on], stop[on]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(none + x) for x in (left, right, a_cut, b_cut))


def lanes_of(a_first: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, lane: int = LANE):
    """First A token, first B token and A stop of each lane: every document is cut each `lane` A tokens.

    The B token of a lane is the one that covers the first byte of its A token, so
    the lane's first link is the one that the lane before would emit next.
    """
    sizes = np.diff(a_first)
    count = -(-sizes // lane)
    of = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    a = a_first[of] + place * lane
    stop = np.minimum(a + lane, a_first[of + 1])
    begin = np.where(a > 0, a_end[a - 1], 0)
    return a, np.searchsorted(b_end, begin, side="right"), stop


def _ends(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths[ids])


def _joined(ids: np.ndarray, tokens: pa.BinaryArray) -> bytes:
    at, data = stream(tokens.take(pa.array(ids)))
    return bytes(data[at[0]: at[-1]])


class Aligner:
    """Both tokenizers with their tables, as a worker process keeps them."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.a_tokens, self.b_tokens = pa.array(a.tokens, pa.binary()), pa.array(b.tokens, pa.binary())
        self.a_len, self.b_len = (np.array([len(t) for t in x.tokens], np.int64) for x in (a, b))
        self.bits = max(1, (len(b.tokens) - 1).bit_length())
        marks = (",", "|", ";", "")
        most = max(len(a.tokens), len(b.tokens))
        self.text = pa.array([f"{i}{m}".encode() for i in range(most) for m in marks], pa.binary())

    def align(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """The columns of `align`, but the id, for the texts of a slice."""
        n = len(texts)
        spaced = [f" {t}" if t else "" for t in texts]
        some = np.flatnonzero([bool(t) for t in spaced])
        whole = [spaced[k] for k in some]
        a_ids, a_first = self.a.encode(whole)
        b_ids, b_first = self.b.encode(whole)
        a_end, b_end = _ends(a_ids, self.a_len), _ends(b_ids, self.b_len)
        data = "".join(whole).encode()
        if not (data == _joined(a_ids, self.a_tokens) == _joined(b_ids, self.b_tokens)):
            # Which texts differ: those are left out and the others begin anew.
            same = np.array([_joined(a_ids[a_first[k]: a_first[k + 1]], self.a_tokens) == t.encode()
                             == _joined(b_ids[b_first[k]: b_first[k + 1]], self.b_tokens) for k, t in enumerate(whole)])
            keep_a, keep_b = np.repeat(same, np.diff(a_first)), np.repeat(same, np.diff(b_first))
            a_ids, b_ids = a_ids[keep_a], b_ids[keep_b]
            a_first = np.concatenate([[0], np.cumsum(np.diff(a_first)[same])])
            b_first = np.concatenate([[0], np.cumsum(np.diff(b_first)[same])])
            a_end, b_end = _ends(a_ids, self.a_len), _ends(b_ids, self.b_len)
            some = some[same]
        left, right, a_cut, b_cut = merge_lanes(a_end, b_end, *lanes_of(a_first, a_end, b_end))
        a_cut, b_cut = np.sort(a_cut), np.sort(b_cut)
        zero = np.zeros(n, np.int64)
        n_a, n_b, n_groups = zero.copy(), zero.copy(), zero.copy()
        n_a[some], n_b[some] = np.diff(a_first), np.diff(b_first)
        n_groups[some] = np.diff(np.searchsorted(a_cut, a_first))
        # Links of a document as distinct pairs of ids and how often each stands there.
        doc = np.searchsorted(a_first, left, side="right") - 1
        if len(some) > 1 << (63 - 2 * max(16, self.bits)):
            raise ValueError("too many texts in a slice")
        bits = max(16, self.bits)
        key = np.sort((doc << 2 * bits) | (a_ids[left].astype(np.int64) << bits) | b_ids[right])
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(np.append(begin, len(key)))
        key = key[begin]
        doc = key >> 2 * bits
        pair = ((key >> bits & (1 << bits) - 1) << 32) | (key & (1 << bits) - 1)
        at = np.zeros(n + 1, np.int64)
        at[some + 1] = np.bincount(doc, minlength=len(some))
        at = np.cumsum(at)
        n_links = zero.copy()
        n_links[some] = np.bincount(doc, times, len(some)).astype(np.int64)
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups), "n_links": pa.array(n_links),
            "groups": self._groups(n, some, a_ids, b_ids, a_first, b_first, a_cut, b_cut),
            "pairs": _binary(at * 8, pair.astype("<i8").tobytes()), "times": _binary(at * 4, times.astype("<u4").tobytes())}

    def _groups(self, n, some, a_ids, b_ids, a_first, b_first, a_cut, b_cut) -> pa.Array:
        """`a1,a2|b1;a3|b2,b3` of each text: every token has its place among both kinds, its decimal and the mark after it."""
        a_mark, b_mark = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        a_mark[a_cut], b_mark[b_cut] = 1, 2
        b_mark[b_first[1:] - 1] = 3
        a_group = np.cumsum(a_mark == 1) - (a_mark == 1)
        b_group = np.cumsum(b_mark >= 2) - (b_mark >= 2)
        a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=len(a_cut)))])
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=len(a_cut)))])
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        order[np.arange(len(a_ids)) + b_before[a_group]] = a_ids.astype(np.int64) * 4 + a_mark
        order[np.arange(len(b_ids)) + a_before[b_group + 1]] = b_ids.astype(np.int64) * 4 + b_mark
        ends, data = stream(self.text.take(pa.array(order)))
        offsets = np.zeros(n + 1, np.int64)
        sizes = ends[(a_first + b_first)]
        offsets[some + 1] = np.diff(sizes)
        return _binary(np.cumsum(offsets), data[: ends[-1]] if len(order) else b"").cast(pa.string())


def _binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each whole text, as a narrow map.

    `a_path` is a byte-level BPE that reads a space and the text, `b_path` a
    sentencepiece BPE that adds that space itself.  `groups` names the ids between
    cuts as `a1,a2|b1;a3|b2,b3`.  `pairs` holds the distinct linked ids of the text as
    little-endian signed 64-bit integers, A in the upper half, `times` as unsigned
    32-bit integers how often each is linked.  Texts that are null or empty, or
    whose tokens of either kind do not spell them, have no tokens: zeros and empty
    strings.  Null ids and repeated rows are kept; other columns are left out; an
    empty table gives an empty one.
    """
    sc = docs.sparkSession.sparkContext
    a_blob, b_blob = sc.broadcast(load_blob(a_path)), sc.broadcast(load_blob(b_path))
    schema = (f"doc_id {dict(docs.dtypes)[id_col]}, n_a long, n_b long, n_groups long, n_links long, "
              "groups string, pairs binary, times binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = cached(f"aligner {a_path} {b_path}", lambda: Aligner(ByteLevel(a_blob.value.decode()), Pieces(b_blob.value)))
        for batch in batches:
            for first, texts in sliced(batch.column(1), SLICE):
                columns = aligner.align(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *columns.values()], names=["doc_id", *columns])

    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(run, schema)


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n_docs, best): in how many rows of `align` each pair of ids is linked; `best` if no pair of its A id is in more.

    Tasks sum up before anything is shuffled, at most `COUNTED` pairs at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def summed() -> None:
            nonlocal pairs, counts, held, size
            every = np.concatenate([pairs, *held])
            weight = np.concatenate([counts, np.ones(len(every) - len(pairs), np.int64)])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            begin = np.flatnonzero(np.diff(every, prepend=-1))
            pairs, counts = every[begin], np.add.reduceat(weight, begin) if len(begin) else weight
            held, size = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            some = [x.as_buffer() for x in batch.column(0)]
            held += [np.frombuffer(x, "<i8") for x in some if x.size]
            size += sum(x.size // 8 for x in some)
            if size > COUNTED:
                summed()
            if len(pairs) > COUNTED:
                yield batch_of()
                pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        summed()
        yield batch_of()

    sums = settle(aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n_docs")))
    a_id = F.shiftright("pair", 32).alias("a_id")
    top = sums.groupBy(a_id).agg(F.max("n_docs").alias("top"))
    named = sums.select("pair", a_id, F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n_docs")
    return named.join(top, "a_id").select("pair", "a_id", "b_id", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def rate_links(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The rows of `align` with n_best, the links whose pair is its A id's most frequent (ties included), and count_sum, the sum of their counts.

    `pairs` and `times` are left out.  The counts are broadcast up to
    `broadcast_pairs` distinct pairs; beyond, rows of pairs meet them in a join
    that spreads pairs which many documents hold.
    """
    held = settle(aligned.withColumn("_kw_row", F.monotonically_increasing_id()))
    rest = [c for c in held.columns if c not in ("pairs", "times", "_kw_row")]
    counts = settle(count_pairs(held))
    if counts.count() <= broadcast_pairs:
        table = counts.select("pair", "n_docs", "best").toArrow().sort_by("pair")
        shared = held.sparkSession.sparkContext.broadcast(
            tuple(table.column(c).to_numpy() for c in ("pair", "n_docs", "best")))
        kinds = dict(held.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", n_best long, count_sum long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n_docs, best = shared.value
            for batch in batches:
                n_best, total = [], []
                for some, often in zip(batch.column(len(rest)), batch.column(len(rest) + 1)):
                    at = np.searchsorted(pair, np.frombuffer(some.as_buffer(), "<i8"))
                    times = np.frombuffer(often.as_buffer(), "<u4").astype(np.int64)
                    n_best.append(int(times[best[at]].sum()))
                    total.append(int((times * n_docs[at]).sum()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(rest)], pa.array(n_best, pa.int64()), pa.array(total, pa.int64())],
                    names=[*rest, "n_best", "count_sum"])

        return held.select(*rest, "pairs", "times").mapInArrow(run, schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer()) // 8 for x in batch.column(1)]
            pair, times = (np.frombuffer(b"".join(batch.column(k).to_pylist()), kind) for k, kind in ((1, "<i8"), (2, "<u4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(pair), pa.array(times.astype(np.int64))],
                names=["_kw_row", "pair", "times"])

    links = held.select("_kw_row", "pairs", "times").mapInArrow(rows, "_kw_row long, pair long, times long")
    met = lookup(links, counts.select("pair", "n_docs", "best", F.col("n_docs").alias("weight")), ["pair"], "weight")
    sums = met.groupBy("_kw_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    return held.select(*rest, "_kw_row").join(sums, "_kw_row", "left").select(
        *rest, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"))
