"""Token ids in files with Elias-Fano encoded document boundaries.

A file row (shard) holds the concatenated ids of consecutive documents, two or
four bytes each, and the document ends as an Elias-Fano sequence: low bits packed,
high bits as unary gaps, and the places of every 256th one for `select`.  Shards
stand in Parquet files, ordered by (part, seq); `before` counts the ids of
earlier shards of a part, so no 64-bit offset is kept per document.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.bpe import load_blob
from kinweave.llm.worker import cached, sliced
from kinweave.llm.words import SLICE, encode_words, pieces, stream, words
from kinweave.session import settle, ship_functions

ship_functions(__name__)

#: Ids after which a shard ends.
SHARD_IDS = 1 << 18
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(top / n) bits a value, with `select`."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        width = max(0, int(values[-1]) // n).bit_length() - 1
        width = max(0, width)
        bits = (values[:, None] >> np.arange(width)) & 1
        ones = (values >> width) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, width, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, i: int) -> int:
        at = i * self.width
        chunk = int.from_bytes(self.low[at // 8: (at + self.width + 7) // 8], "little")
        return (chunk >> (at % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The i-th value, found from the nearest sample by counting ones."""
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = at // 8, at % 8
        word = self.high[byte] >> skip << skip
        while left >= (ones := word.bit_count()):
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return ((one - i) << self.width) | self._low(i)

    def select_block(self, block: int) -> np.ndarray:
        """The values from `block * SAMPLE` on, up to `SAMPLE` of them, from the bits between two samples."""
        first = block * SAMPLE
        last = min(self.n, first + SAMPLE)
        samples = np.frombuffer(self.samples, "<u4")
        begin = int(samples[block])
        end = int(samples[block + 1]) if block + 1 < len(samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[begin // 8: -(-end // 8)], bitorder="little")
        ones = np.flatnonzero(bits) + begin // 8 * 8
        ones = ones[ones >= begin][: last - first]
        at = first * self.width
        low = np.unpackbits(np.frombuffer(self.low, np.uint8)[at // 8: -(-last * self.width // 8)], bitorder="little")
        low = low[at % 8: at % 8 + (last - first) * self.width].reshape(last - first, self.width).astype(np.int64)
        return ((ones - np.arange(first, last)) << self.width) | (low @ (1 << np.arange(self.width, dtype=np.int64)))


SHARD = ("part int, seq long, before long, n_docs long, n_ids long, id_bytes int, "
         "ef_width int, ef_low binary, ef_high binary, ef_samples binary, ids binary")


def write_shards(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text: str = "text",
                 end_id: int | None = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every whole text and write the ids below `folder`, in ascending `id_col` order; returns the shards.

    The tokenizers library encodes the distinct words of each slice; that equals
    encoding whole texts because the tokenizer has no normalizer and cuts texts
    by the pattern of `words` first (checked).  Texts that hold the string of a
    special token are given to the library whole, and the token is one id.  Null ids come first; rows with one id are ordered by a hash
    of their text.  Null and empty texts have only the end id.  Other columns are
    left out; an empty table gives an empty file.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_blob(tokenizer))
    schema = T.StructType.fromDDL(SHARD).add("doc_ids", T.ArrayType(docs.schema[id_col].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load():
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(shared.value.decode())
            import json

            spec = json.loads(shared.value)
            cutter = spec["pre_tokenizer"] or {}
            if spec["normalizer"] or cutter.get("type") != "ByteLevel" or not cutter.get("use_regex") or cutter.get("add_prefix_space"):
                raise ValueError("the tokenizer must cut words by the byte-level pattern and nothing else")
            # A special token that stands in a text is one id, as the library has it by default.
            special = [t["content"] for t in spec.get("added_tokens") or []]
            return tok, {}, re.compile("|".join(map(re.escape, special))) if special else None

        tok, known, special = cached(f"tokenizer {tokenizer}", load)

        def apart(texts: list[str | None]) -> tuple[list[str | None], dict[int, np.ndarray]]:
            """The texts without those that hold a special token, and the ids of these, by place."""
            found = {k: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4")
                     for k, t in enumerate(texts) if t and special and special.search(t)}
            return [None if k in found else t for k, t in enumerate(texts)], found

        def new_words(new: list[bytes]) -> list[bytes]:
            found = tok.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

        part = TaskContext.get().partitionId()
        width = 2 if tok.get_vocab_size() <= 1 << 16 else 4
        kind = "<u2" if width == 2 else "<u4"
        end = [] if end_id is None else [end_id]
        seq = before = 0
        held_docs: list = []
        held: list[np.ndarray] = []
        ends: list[int] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ef = EliasFano.of(np.array(ends, np.int64))
            ids = np.concatenate(held).astype(kind).tobytes() if held else b""
            row = {"part": part, "seq": seq, "before": before, "n_docs": len(held_docs), "n_ids": size, "id_bytes": width,
                   "ef_width": ef.width, "ef_low": ef.low, "ef_high": ef.high, "ef_samples": ef.samples, "ids": ids,
                   "doc_ids": list(held_docs)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            names = batch.column(0).to_pylist()
            open_row = -1
            whole: dict[int, np.ndarray] = {}

            def slices() -> Iterator[tuple[np.ndarray, list[str]]]:
                for first, texts in sliced(batch.column(1), SLICE):
                    texts, found = apart(texts)
                    whole.clear()
                    whole.update({first + k: ids for k, ids in found.items()})
                    for r, p in pieces(texts):
                        yield np.array(r) + first, p

            for rows, parts in slices():
                found, counts = words(parts)
                at, data = stream(encode_words(found, known, new_words))
                at = at[counts] // 4
                ids = np.frombuffer(data, "<u4")
                for k, row in enumerate(rows.tolist()):
                    if row != open_row:
                        if open_row >= 0:  # the row before is whole
                            held.append(np.array(end, "<u4"))
                            size += len(end)
                            ends.append(size)
                            held_docs.append(names[open_row])
                            if size >= shard_ids:
                                yield shard()
                                seq, before = seq + 1, before + size
                                held_docs, held, ends, size = [], [], [], 0
                        open_row = row
                    held.append(whole[row] if row in whole else ids[at[k]: at[k + 1]])
                    size += len(held[-1])
            if open_row >= 0:
                held.append(np.array(end, "<u4"))
                size += len(end)
                ends.append(size)
                held_docs.append(names[open_row])
                if size >= shard_ids:
                    yield shard()
                    seq, before = seq + 1, before + size
                    held_docs, held, ends, size = [], [], [], 0
        if held_docs:
            yield shard()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(text).alias("_kw_tie")
    ordered = docs.select(F.col(id_col).alias("_kw_id"), F.col(text).alias("_kw_text"), tie).repartitionByRange(
        parts, "_kw_id", "_kw_tie").sortWithinPartitions("_kw_id", "_kw_tie")
    ordered.select("_kw_id", "_kw_text").mapInArrow(run, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: `start` counts the ids of all documents before.

    `ids` are little-endian unsigned 32-bit integers, with the end id.
    """
    id_type = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                get = lambda name: row[name].as_py()
                ends = EliasFano(get("n_docs"), get("ef_width"), get("ef_low"), get("ef_high"), get("ef_samples"))
                kind, base, ids = "<u2" if get("id_bytes") == 2 else "<u4", get("base"), row["ids"].as_buffer()
                before = 0
                for block in range(-(-ends.n // SAMPLE)):
                    # The ends of a block of documents come from the select structure; the shard's are never a table.
                    some = ends.select_block(block)
                    starts = np.concatenate([[before], some[:-1]])
                    held = np.frombuffer(ids, kind)[before: some[-1]].astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays([
                        row["doc_ids"].values.slice(block * SAMPLE, len(some)), pa.array(starts + base, pa.int64()),
                        pa.array(some - starts, pa.int64()),
                        pa.array([held[4 * (a - before): 4 * (b - before)] for a, b in zip(starts, some)], pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])
                    before = int(some[-1])

    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("_kw_n"))  # one row per part file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Settled, so that Catalyst knows how small it is and leaves the shards where they are.
    parts = settle(parts.select("part", F.coalesce(F.sum("_kw_n").over(earlier), F.lit(0)).alias("_kw_base")))
    based = shards.join(parts, "part").withColumn("base", F.col("_kw_base") + F.col("before"))
    return based.select("n_docs", "id_bytes", "ef_width", "ef_low", "ef_high", "ef_samples", "ids", "doc_ids", "base").mapInArrow(run, schema)
