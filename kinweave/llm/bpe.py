"""Byte-level BPE: a fold of ranked merges over the bytes of distinct words, and back.

`fold_words` is the fold as Spark higher-order functions over a table of distinct
words with a literal rank map.  `encode` applies the same fold inside map tasks to
the distinct words of each Arrow slice, so that the words of a document need no
join to come back to it; see the README for the figures behind that choice.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.worker import cached, sliced
from kinweave.llm.words import SLICE, encode_words, pieces, stream, words
from kinweave.session import ship_functions

ship_functions(__name__)

#: Bytes of a rank file up to which it is broadcast.
RANK_FILE_BYTES = 64_000_000
#: Buckets of the literal rank map.
BUCKETS = 1 << 16
#: Words up to this many bytes are folded over a list, longer ones over a heap.
SHORT = 64


def read_ranks(blob: bytes) -> dict[bytes, int]:
    """token -> rank, of a file with a base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


def load_blob(path: str, most: int = RANK_FILE_BYTES) -> bytes:
    with open(path, "rb") as f:
        blob = f.read(most + 1)
    if len(blob) > most:
        raise ValueError(f"{path} is larger than {most} bytes")
    return blob


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold over a linked list with a heap of pairs: n log n for words of any length."""
    n = len(word)
    parts: list[bytes | None] = [word[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            both = parts[i] + parts[k]
            if (r := ranks.get(both)) is not None:
                heapq.heappush(heap, (r, i, len(both)))
        h = before[i]
        if h >= 0:
            both = parts[h] + parts[i]
            if (r := ranks.get(both)) is not None:
                heapq.heappush(heap, (r, h, len(both)))
    return [ranks[p] for p in parts if p is not None]


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: again and again the leftmost adjacent pair of lowest rank is merged."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > SHORT:
        return _fold_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    none = 1 << 60
    get = ranks.get
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i] += parts.pop(i + 1)
        pair.pop(i)
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each whole text, as a narrow map.

    `ids` is a binary of little-endian unsigned 32-bit integers.  The digests are
    those of `ids` and of the decoded bytes.  A null or empty text has no ids;
    repeated rows and null ids are kept as they are; other columns are left out;
    an empty table gives an empty one.  Very long texts are encoded in pieces cut
    at borders of words, their digests go on from piece to piece.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_blob(path))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tables():
            ranks = read_ranks(shared.value)
            vocabulary: list[bytes | None] = [None] * (max(ranks.values()) + 1)
            for token, rank in ranks.items():
                vocabulary[rank] = token
            return ranks, pa.array(vocabulary, pa.binary()), {}

        ranks, vocabulary, known = cached(f"ranks {path}", tables)

        def new_words(new: list[bytes]) -> list[bytes]:
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in (fold(w, ranks) for w in new)]

        for batch in batches:
            n = batch.num_rows
            tokens = [0] * n
            of_ids, of_bytes = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            ids: list[list[bytes]] = [[] for _ in range(n)]
            for first, texts in sliced(batch.column(1), SLICE):
                for rows, parts in pieces(texts):
                    found, before = words(parts)
                    at, data = stream(encode_words(found, known, new_words))
                    at = at[before]
                    got, back = stream(vocabulary.take(pa.array(np.frombuffer(data, "<u4")[: at[-1] // 4])))
                    for k, row in enumerate(rows):
                        a, b = int(at[k]), int(at[k + 1])
                        row += first
                        tokens[row] += (b - a) // 4
                        of_ids[row].update(data[a:b])
                        of_bytes[row].update(back[got[a // 4]: got[b // 4]])
                        ids[row].append(data[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(tokens, pa.int64()), pa.array([h.hexdigest() for h in of_ids]),
                pa.array([h.hexdigest() for h in of_bytes]), pa.array([b"".join(x) for x in ids], pa.binary()),
            ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(run, schema)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded): the concatenated pieces of binary ids as `encode` returns them; null ids give null."""
    shared = ids.sparkSession.sparkContext.broadcast(load_blob(path))
    schema = T.StructType([T.StructField("doc_id", ids.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: t for t, rank in read_ranks(shared.value).items()}
        vocabulary = pa.array([token.get(r) for r in range(max(token) + 1)], pa.binary())
        for batch in batches:
            out = []
            for blob in batch.column(1).to_pylist():
                at, data = stream(vocabulary.take(pa.array(np.frombuffer(blob or b"", "<u4"))))
                out.append(None if blob is None else bytes(data[at[0]: at[-1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return ids.select(F.col(id_col).alias("doc_id"), ids_col).mapInArrow(run, schema)


def _rank_of(spark: SparkSession, ranks: dict[bytes, int], buckets: int):
    """A function from the hex text of a token to its rank: one literal array of small maps, by hash."""
    rows = spark.createDataFrame([(t.hex(), r) for t, r in ranks.items()], "t string, r int").select(
        F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int").alias("b"), "t", "r").collect()
    slots: list[dict[str, int]] = [{} for _ in range(buckets)]
    for b, t, r in rows:
        slots[b][t] = r
    literal = F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")

    def rank(token: Column) -> Column:
        slot = F.element_at(literal, (F.pmod(F.xxhash64(token), F.lit(buckets)) + 1).cast("int"))
        return F.element_at(slot, token)

    return rank


def fold_words(distinct: DataFrame, path: str, word: str = "word", buckets: int = BUCKETS) -> DataFrame:
    """`distinct` with `ids`: the fold as higher-order functions, for words up to some hundred bytes.

    The state is the word as hex text with its pieces in angle brackets; a round
    looks up the rank of every adjacent pair and merges the leftmost pair of the
    lowest rank.  Null words have null ids.
    """
    rank = _rank_of(distinct.sparkSession, read_ranks(load_blob(path)), buckets)
    none = F.lit(2**31 - 1)

    def merge(state: Column, _: Column) -> Column:
        ranks = F.transform(F.sequence(F.lit(0), F.size(state) - 2), lambda i: F.coalesce(
            rank(F.concat(F.get(state, i), F.get(state, i + 1))), none))
        ranks = F.when(F.size(state) < 2, F.array(none)).otherwise(ranks)
        low = F.array_min(ranks)
        i = F.array_position(ranks, low).cast("int")
        merged = F.concat(
            F.slice(state, F.lit(1), i - 1), F.array(F.concat(F.get(state, i - 1), F.get(state, i))),
            F.slice(state, i + 2, F.size(state)))
        return F.when(low == none, state).otherwise(merged)

    code = F.hex(F.encode(F.col(word), "utf-8"))
    pairs = F.length(code) / 2
    letters = F.transform(F.sequence(F.lit(0), pairs.cast("int") - 1), lambda i: F.lower(F.substring(code, i * 2 + 1, 2)))
    state = F.when(pairs < 1, F.array().cast("array<string>")).otherwise(letters)
    rounds = F.when(pairs < 2, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), pairs.cast("int") - 1))
    ids = F.transform(F.aggregate(rounds, state, merge), rank)
    return distinct.withColumn("ids", F.when(F.col(word).isNotNull(), ids))
