"""SimHash near-dedup by a segment-popcount embedding.

Fingerprints are embedded as the bit counts of their 32 two-bit segments, kept in
unary, so that the Manhattan distance of two embeddings is the bit count of their
exclusive or.  It never exceeds the Hamming distance of the fingerprints.  The
embedding is cut into `BLOCKS` blocks of segments: at a distance of at most `BITS`,
`BLOCKS - BITS` blocks are equal, so every choice of that many blocks spans a grid
whose cells meet all linked pairs.  Members of a cell are compared by Manhattan
distance, then exactly, and only links that connect the cell are returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.worker import sliced
from kinweave.operators.components import star_rounds
from kinweave.session import drop_table, settle, ship_functions

ship_functions(__name__)

#: Words of a shingle, seed of its hash, and the bits two linked fingerprints differ in at most.
WORDS, SEED, BITS = 4, 42, 4
BLOCKS = 8
#: Members of a cell compared directly; the pairs of larger cells meet at common midpoints.
CELL_ROWS = 50_000
#: Bytes of text and shingles handled at a time.
SLICE, SHINGLES = 4_000_000, 400_000
#: Shingles longer than this many bytes are hashed one by one.
LONG = 512

# The primes of XXH64.
P1, P2, P3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
P4, P5 = 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
MASK = (1 << 64) - 1


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _mix(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * np.uint64(P2), 31) * np.uint64(P1)


def xxh64(data: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many windows of `data`; windows of one length are hashed together."""
    out = np.empty(len(starts), np.uint64)
    raw = data + bytes(8)
    n = len(raw)
    byte = np.frombuffer(raw, np.uint8)
    four = np.ndarray((n - 3,), "<u4", raw, strides=(1,))
    eight = np.ndarray((n - 7,), "<u8", raw, strides=(1,))
    order = np.argsort(sizes, kind="stable")
    borders = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    u = np.uint64
    for a, b in itertools.pairwise([*borders.tolist(), len(order)]):
        rows = order[a:b]
        at, size = starts[rows], int(sizes[rows[0]])
        if size > LONG:
            out[rows] = [xxhash.xxh64_intdigest(data[i:i + size], seed) for i in at.tolist()]
            continue
        done = 0
        if size >= 32:
            acc = [np.full(len(at), v & MASK, u) for v in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while done + 32 <= size:
                acc = [_mix(v, eight[at + (done + 8 * k)]) for k, v in enumerate(acc)]
                done += 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for v in acc:
                h = (h ^ _mix(np.zeros_like(v), v)) * u(P1) + u(P4)
        else:
            h = np.full(len(at), (seed + P5) & MASK, u)
        h = h + u(size)
        while done + 8 <= size:
            lane = eight[at + done]
            h = _rotl(h ^ _mix(np.zeros_like(lane), lane), 27) * u(P1) + u(P4)
            done += 8
        if done + 4 <= size:
            h = _rotl(h ^ (four[at + done].astype(u) * u(P1)), 23) * u(P2) + u(P3)
            done += 4
        while done < size:
            h = _rotl(h ^ (byte[at + done].astype(u) * u(P5)), 11) * u(P1)
            done += 1
        h = (h ^ (h >> u(33))) * u(P2)
        h = (h ^ (h >> u(29))) * u(P3)
        out[rows] = h ^ (h >> u(32))
    return out


def fingerprints_of(texts: list[str | None], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if over half the shingle hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    first = 0
    while first < len(texts):
        norms, rows, held = [], [], 0
        while first < len(texts) and held < SLICE:
            norm = b" ".join((texts[first] or "").encode().lower().split())
            if norm:
                norms.append(norm)
                rows.append(first)
                held += len(norm)
            first += 1
        if norms:
            out[rows] = _slice_fingerprints(norms, words, seed)
    return out


def shingles_of(norms: list[bytes], words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one, starts and sizes of their word shingles, the text of each shingle, shingles per text."""
    data = b" ".join(norms)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
    begin = np.concatenate([[0], gaps + 1])
    end = np.append(gaps, len(data))
    ends = np.cumsum([len(x) + 1 for x in norms])
    text_at = np.concatenate([[0], ends])
    word_at = np.searchsorted(begin, text_at)  # of each text
    counts = np.diff(word_at)
    shingles = np.maximum(counts - words + 1, 1)
    shingle_at = np.concatenate([[0], np.cumsum(shingles)])
    text_of = np.repeat(np.arange(len(norms)), shingles)
    from_word = np.arange(shingle_at[-1]) - shingle_at[text_of] + word_at[text_of]
    to_word = np.minimum(from_word + words, word_at[text_of + 1]) - 1
    return data, begin[from_word], end[to_word] - begin[from_word], text_of, shingles


def _slice_fingerprints(norms: list[bytes], words: int, seed: int) -> np.ndarray:
    data, starts, sizes, text_of, shingles = shingles_of(norms, words)
    ones = np.zeros((len(norms), 64), np.int64)
    for a in range(0, len(starts), SHINGLES):
        h = xxh64(data, starts[a:a + SHINGLES], sizes[a:a + SHINGLES], seed)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = text_of[a:a + SHINGLES]
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        ones[of[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    over = (2 * ones > shingles[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").reshape(-1).view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed long; null, empty or blank texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(texts, words, seed).view(np.int64) for _, texts in sliced(batch.column(1), SLICE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, fp long")


def embedding(fp: Column) -> Column:
    """The bit counts of the two-bit segments in unary: the bits of each segment, sorted."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    low = fp.bitwiseAND(odd)
    both, any_ = low.bitwiseAND(high), low.bitwiseOR(high)
    return any_.bitwiseOR(F.shiftleft(both, 1))


def cell_masks(blocks: int, bits: int) -> list[int]:
    """The masks of all choices of `blocks - bits` blocks, as signed longs."""
    size = 64 // blocks
    out = []
    for chosen in itertools.combinations(range(blocks), blocks - bits):
        mask = sum(((1 << size) - 1) << (size * b) for b in chosen)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _unary(x: np.ndarray) -> np.ndarray:
    odd = np.uint64(0x5555555555555555)
    high, low = (x >> np.uint64(1)) & odd, x & odd
    return (low | high) | ((low & high) << np.uint64(1))


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Pairs within `bits`: the lower bound first, then the exact distance."""
    close = np.bitwise_count(_unary(x) ^ _unary(y)) <= bits
    return close & (np.bitwise_count(x ^ y) <= bits)


def _spanning(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Index pairs that connect the members of a cell as all its links would."""
    left, out = np.arange(len(fp)), []
    while len(left):
        open_, left = [int(left[0])], left[1:]
        while open_ and len(left):
            i = open_.pop()
            near = _near(fp[left], fp[i], bits)
            found = left[near].tolist()
            out += [(i, j) for j in found]
            open_ += found
            left = left[~near]
    return out


def links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(src, dst): links between distinct fingerprints `fp` that connect all pairs within `bits`."""
    masks = cell_masks(blocks, bits)
    size = 64 // blocks
    block_masks = np.array([((1 << size) - 1) << (size * b) for b in range(blocks)], np.uint64)
    first_choice = {c: i for i, c in enumerate(itertools.combinations(range(blocks), blocks - bits))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

        def rows(src, dst) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(src).view(np.int64)), dst], schema=schema)

        def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return rows(a, pa.array(b.view(np.int64)))

        def canonical(a: np.ndarray, b: np.ndarray, choice: np.ndarray) -> np.ndarray:
            """Whether a pair's first equal blocks are those of its cell: two members alone are linked there only."""
            equal = ((_unary(a) ^ _unary(b))[:, None] & block_masks) == 0
            rank = [first_choice[tuple(np.flatnonzero(e)[: blocks - bits].tolist())] for e in equal]
            return np.array(rank, np.int64) == choice

        def cells(choice, cell, fp):
            """Links of whole cells, which stand in a row."""
            border = np.flatnonzero((np.diff(choice, prepend=-1) != 0) | (np.diff(cell, prepend=cell[0]) != 0))
            counts = np.diff(np.append(border, len(fp)))
            two = border[counts == 2]
            a, b = fp[two], fp[two + 1]
            near = _near(a, b, bits)
            a, b, two = a[near], b[near], two[near]
            if len(a):
                only = canonical(a, b, choice[two])
                yield linked(a[only], b[only])
            for at, n in zip(border[counts > 2].tolist(), counts[counts > 2].tolist()):
                members = fp[at: at + n]
                found = _spanning(members, bits)
                if found:
                    i, j = np.array(found).T
                    yield linked(members[i], members[j])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the cell that may go on in the next batch
        spilled = None  # the cell that has grown too large
        for batch in batches:
            if not batch.num_rows:
                continue
            choice, cell, fp = (np.asarray(batch.column(i)) for i in range(3))
            fp = fp.view(np.uint64)
            if spilled is not None:
                same = (choice == spilled[0]) & (cell == spilled[1])
                if same.any():
                    yield rows(fp[same], pa.nulls(int(same.sum()), pa.int64()))
                    choice, cell, fp = choice[~same], cell[~same], fp[~same]
                if not len(fp):
                    continue
                spilled = None
            if held:
                choice, cell, fp = (np.concatenate([*[h[k] for h in held], x]) for k, x in enumerate((choice, cell, fp)))
            last = int(np.flatnonzero((choice != choice[-1]) | (cell != cell[-1]))[-1]) + 1 if (
                (choice[0] != choice[-1]) or (cell[0] != cell[-1])) else 0
            if last:
                yield from cells(choice[:last], cell[:last], fp[:last])
            if len(fp) - last > cell_rows:
                spilled = (choice[-1], cell[-1])
                yield rows(fp[last:], pa.nulls(len(fp) - last, pa.int64()))
                held = []
            else:
                held = [(choice[last:], cell[last:], fp[last:])]
        if held and len(held[0][2]):
            yield from cells(*held[0])

    e = embedding(F.col("fp"))
    cut = fps.select("fp", F.posexplode(F.array(*[e.bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "cell"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut.select("choice", "cell", "fp").repartition(parts, "choice", "cell").sortWithinPartitions("choice", "cell")
    found = settle(met.mapInArrow(run, "src long, dst long"))
    direct = found.where("dst IS NOT NULL")
    spilled = found.where("dst IS NULL").select(F.col("src").alias("fp")).distinct()
    if not spilled.isEmpty():
        direct = direct.unionByName(midpoint_links(spilled, bits))
    return direct.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def midpoint_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links of cells of any size: two values within `bits` have a common value within half of it.

    Every value is written under all its midpoints, and each midpoint links its
    values to the lowest: as many rows as values times midpoints, no pairs.
    """
    reach = (bits + 1) // 2
    masks = [0]
    for k in range(1, reach + 1):
        masks += [sum(1 << b for b in chosen) for chosen in itertools.combinations(range(64), k)]
    signed = ",".join(str(m - (1 << 64) if m >> 63 else m) for m in masks)
    all_masks = F.from_json(F.lit(f"[{signed}]"), "array<bigint>")
    at = fps.select("fp", F.explode(F.transform(all_masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("middle"))
    low = at.groupBy("middle").agg(F.min("fp").alias("low"))
    pairs = at.join(low, "middle").where("fp <> low").select(F.col("low").alias("src"), F.col("fp").alias("dst")).distinct()
    return pairs if bits % 2 == 0 else pairs.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED,
            bits: int = BITS, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of `docs`.

    Documents are linked if their fingerprints differ in at most `bits` bits; the
    component is the smallest id reachable (null ids count only where there is no
    other).  Null, empty and blank texts have fingerprint 0 and are linked like
    any other.  Repeated rows stay; other columns are left out; an empty table
    gives an empty one.  Equal fingerprints are one node, so copies make no pairs.
    """
    rows = settle(fingerprints(docs, id_col, text, words, seed))
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = settle(links(nodes.select("fp"), bits, blocks, cell_rows))
    if found.isEmpty():
        return rows.join(nodes, "fp").select("doc_id", "fp", F.col("low").alias("component_id"))
    parts = settle(star_rounds(found, []))
    drop_table(found)
    reach = parts.join(nodes, parts["node"] == nodes["fp"]).groupBy("component").agg(F.min("low").alias("least"))
    named = settle(parts.join(reach, "component").select(F.col("node").alias("fp"), "least"))
    label = nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id"))
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each class, that of the smallest id; all columns kept."""
    stay = classes(docs, id_col, text).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = settle(stay.select(F.col("doc_id").alias("_kw_stay")).distinct())
    return docs.join(stay.hint("merge"), docs[id_col].eqNullSafe(stay["_kw_stay"]), "left_semi")
