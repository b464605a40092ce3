"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

An item is in a document if some passage of the document has an edit distance of
at most (1 - similarity) times the item's length, over lower-cased words joined by
single spaces.  Windows of an item's size are taken where enough runs of characters
of the item stand on about one diagonal, whether words, spaces or neither part them.
Short items are cut into one piece more than they may have edits, so that one piece
is left for certain, and need no more than that to be verified.  For the others every
window and every item walks through the same random bits (Chakraborty, Goldenberg
and Koucky, STOC 2016), which turns edits into differing positions; tables of
sampled positions then bring windows and items together.  What meets is verified
by Myers' bit-parallel search of the item in the window and its surroundings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.worker import sliced
from kinweave.session import ship_functions

ship_functions(__name__)

#: Characters of items broadcast at a time; larger item tables are searched in several blocks.
BLOCK_CHARS = 4_000_000
SIMILARITY = 0.8
#: Share of the weight of an item's grams that must stand on about one diagonal.
GRAM_SHARE = 0.1
#: Characters of a gram; of those of items up to `MIDDLE` characters.
GRAM, MIDDLE_GRAM, MIDDLE = 8, 7, 128
#: Items of up to so many characters are verified at each of their grams.
DIRECT = 64
#: Bits of a gram by which most of the text is passed over; grams met with items at a time.
KNOWN_BITS, HITS = 21, 2_000_000
#: Tables and sampled positions per table.  Measured recall of items with 15 % of their single
#: characters edited 0.9975, with 19 % 1.0 (400 planted each, the 200 items of sf0.1 twice).
TABLES, SAMPLED = 192, 2
#: Ratio of the lengths of neighbouring size classes; windows of one class share their tables.
STEP = 1.25
SEED = 20_231
#: Bytes of text searched at a time.
SLICE = 1_000_000
#: Bands of diagonals per gram up to which their weights are added up without sorting.
DENSE = 32
WORD = re.compile(r"\w+")
MATCHES = "array<struct<item_id:{},start:int,distance:int,similarity:double>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def size_class(chars: int) -> int:
    return int(math.log(max(chars, 1)) / math.log(STEP) + 0.5)


def _draw(a: int, b: np.ndarray) -> np.ndarray:
    """Random 64-bit numbers, the same in every process (SplitMix64)."""
    x = np.uint64((SEED + a) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) ^ b.astype(np.uint64)
    for shift, prime in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(prime)
    return x ^ (x >> np.uint64(31))


def sampled(kind: int, tables: int = TABLES, bits: int = SAMPLED) -> np.ndarray:
    """The sampled embedding positions of a size class, one row per table.

    A walk over n characters has about 2 n steps before its padding; sampled are
    those that no window of the class has left behind.
    """
    length = max(1, round(1.6 * STEP ** kind))
    picks = _draw(1_000_003 + kind, np.arange(tables * bits, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    return (picks % np.uint64(length)).astype(np.int64).reshape(tables, bits)


def walk_bits(kind: int, steps: int) -> np.ndarray:
    """The random bits of a walk: for every step, one per character (modulo 255, from 1); padding stays where it is."""
    draws = _draw(kind, np.arange(steps * 256, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    out = (draws >> np.uint64(40) & np.uint64(1)).astype(np.int64).reshape(steps, 256)
    out[:, 0] = 0
    return out


def cgk_keys(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int,
             tables: int = TABLES, bits: int = SAMPLED) -> np.ndarray:
    """(window, table) -> key: the embedding of the windows `code[start:end]` at the sampled positions.

    The walk copies the character under its pointer at every step and moves on if
    the step's random bit for that character says so; past the end it copies 0.
    """
    places = sampled(kind, tables, bits)
    steps = int(places.max()) + 1
    walk = walk_bits(kind, steps)
    width = int((ends - starts).max(initial=0)) + 1
    at = starts[:, None] + np.arange(width)
    inside = at < ends[:, None]
    board = np.where(inside, code[np.minimum(at, len(code) - 1)] % 255 + 1, 0).astype(np.uint8).ravel()
    needed = np.unique(places)
    row_of = dict(zip(needed.tolist(), range(len(needed))))
    kept = np.zeros((len(needed), len(starts)), np.uint8)
    at = np.arange(len(starts)) * width
    for j in range(steps):
        here = board.take(at)
        if j in row_of:
            kept[row_of[j]] = here
        at += walk[j].take(here)
    where = np.searchsorted(needed, places)
    keys = np.zeros((tables, len(starts)), np.uint64)
    for b in range(bits):
        keys = keys * np.uint64(257) + kept[where[:, b]]
    return keys.T


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words joined by spaces, and where each word starts (with the end, past a last space)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.frombuffer(" ".join(words).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def infix_distance(item: str, text: str) -> int:
    """The least edit distance between `item` and any passage of `text` (Myers, JACM 1999)."""
    n = len(item)
    if not n:
        return 0
    full, top = (1 << n) - 1, 1 << (n - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | (1 << i)
    pv, mv, score = full, 0, n
    best = n
    for c in text:
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best


def infix_distances(pairs: list[tuple[str, str]], together: int = 256) -> list[int]:
    """`infix_distance` of many (item, text) pairs: their bit vectors, as rows of 64-bit words, go through each step together."""
    out = [0] * len(pairs)
    order = sorted((x for x in range(len(pairs)) if pairs[x][0]), key=lambda x: len(pairs[x][1]))
    for a in range(0, len(order), together):
        rows = order[a: a + together]
        for x, d in zip(rows, _infix_batch([pairs[x] for x in rows]).tolist()):
            out[x] = d
    return out


def _infix_batch(pairs: list[tuple[str, str]]) -> np.ndarray:
    u = np.uint64
    n = np.array([len(item) for item, _ in pairs])
    sizes = np.array([len(text) for _, text in pairs])
    width = (int(n.max()) + 63) // 64
    every = np.arange(len(pairs))
    symbols, masks, first = np.zeros((len(pairs), int(sizes.max(initial=0)) + 1), np.int64), [], 0
    for x, (item, text) in enumerate(pairs):
        codes = np.frombuffer(item.encode("utf-32-le"), np.uint32)
        known = np.unique(codes)
        bits = np.zeros((len(known) + 1, width * 64), np.uint8)  # row 0: characters that the item has not
        bits[1:, : len(codes)] = known[:, None] == codes
        masks.append(np.packbits(bits, axis=1, bitorder="little").view(u))
        found = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        symbols[x, : len(found)] = first + np.where(known[at] == found, at + 1, 0)
        first += len(known) + 1
    masks = np.concatenate(masks)
    full = np.packbits(np.arange(width * 64) < n[:, None], axis=1, bitorder="little").view(u)
    word, bit = (n - 1) // 64, ((n - 1) % 64).astype(u)
    pv, mv, score, best = full.copy(), np.zeros_like(full), n.copy(), n.copy()

    def up(x: np.ndarray) -> np.ndarray:
        out = x << u(1)
        out[:, 1:] |= x[:, :-1] >> u(63)
        return out & full

    for j in range(int(sizes.max(initial=0))):
        eq = masks[symbols[:, j]]
        xv = eq | mv
        both = eq & pv
        total = both + pv
        carry = np.zeros(total.shape, bool)
        carry[:, 1:] = (total < both)[:, :-1]
        while carry.any():
            over = carry & (total == u(0xFFFFFFFFFFFFFFFF))
            total = total + carry.astype(u)
            carry = np.zeros_like(carry)
            carry[:, 1:] = over[:, :-1]
        xh = (total ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score = score + ((ph[every, word] >> bit) & u(1)).astype(np.int64) - ((mh[every, word] >> bit) & u(1)).astype(np.int64)
        best = np.where(j < sizes, np.minimum(best, score), best)
        ph, mh = up(ph), up(mh)
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return best


def grams_of(code: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the `q` characters from each place on."""
    out = np.zeros(max(len(code) - q + 1, 0), np.uint64)
    for j in range(q):
        out *= np.uint64(0x9E3779B185EBCA87)
        out += code[j: j + len(out)]
        out += np.uint64(1)
    return out


class Seeds:
    """The grams of one length of some items: where each stands, and its weight."""

    def __init__(self, q: int, codes: dict[int, np.ndarray], share: float | None, total: int):
        self.q = q
        item = np.concatenate([np.full(max(len(c) - q + 1, 0), k) for k, c in codes.items()])
        place = np.concatenate([np.arange(max(len(c) - q + 1, 0)) for c in codes.values()])
        gram = np.concatenate([grams_of(c, q) for c in codes.values()])
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        self.gram, self.first, of, self.times = np.unique(gram[order], return_index=True, return_inverse=True, return_counts=True)
        # A gram weighs the more, the rarer it is among the grams of all items.
        self.weight = np.log((len(gram) + 1) / self.times)[of]
        # Any one gram will do where the budget of edits leaves one for certain.
        self.least = np.zeros(total) if share is None else share * np.bincount(self.item, self.weight, total)
        self.longest = max(map(len, codes.values()))
        self.known = np.zeros(1 << KNOWN_BITS, bool)
        self.known[(self.gram >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)] = True

    def found(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, gram) of the grams of a text that items have."""
        gram = grams_of(code, self.q)
        place = np.flatnonzero(self.known[(gram >> np.uint64(64 - KNOWN_BITS)).astype(np.int64)])
        gram = gram[place]
        at = np.minimum(np.searchsorted(self.gram, gram), len(self.gram) - 1)
        same = self.gram[at] == gram
        return place[same], at[same]


class Items:
    """The items of a block with the seeds of their windows and their LSH tables."""

    def __init__(self, rows: list[tuple[object, str]], similarity: float, share: float):
        self.similarity = similarity
        kept = [(i, " ".join(w)) for i, t in rows if (w := words_of(t))]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in self.texts]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.direct = self.size <= DIRECT
        groups: dict[tuple[int, bool], dict[int, np.ndarray]] = {}
        for k, c in enumerate(codes):
            # Pieces, one more than the edits allowed: one of them stands unchanged in the passage.
            piece = len(c) // (int((1 - similarity) * len(c) + 1e-9) + 1)
            q = min(piece, GRAM) if self.direct[k] else MIDDLE_GRAM if len(c) <= MIDDLE else GRAM
            groups.setdefault((q, bool(self.direct[k])), {})[k] = c
        self.seeds = [Seeds(q, of, None if direct else share, len(kept)) for (q, direct), of in groups.items()]
        self.kind = np.array([size_class(len(t)) for t in self.texts])
        self.keys = np.zeros((len(kept), TABLES), np.uint64)
        for kind in set(self.kind.tolist()):
            of = np.flatnonzero(self.kind == kind).tolist()
            code, at = codes_of([self.texts[k] for k in of])
            self.keys[of] = cgk_keys(code, at[:-1], at[1:] - 1, kind)

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of the windows of a batch: places where enough grams of an item stand on about one diagonal."""
        out = [np.zeros(0, np.int64)]
        for seeds in self.seeds:
            place, at = seeds.found(code)
            self._banded(seeds, place, at, out)
        both = np.unique(np.concatenate(out))
        return both >> 40, (both & (1 << 40) - 1) - (1 << 39)

    def _banded(self, seeds: Seeds, place: np.ndarray, at: np.ndarray, out: list[np.ndarray]) -> None:
        n = seeds.times[at]
        if not len(n):
            return
        reach = 2 * seeds.longest
        if n.sum() > HITS and int(place[-1] - place[0]) > 4 * reach:  # halves that overlap by a window
            middle = int(place[0] + place[-1]) // 2
            for a, b in ((0, np.searchsorted(place, middle + reach)), (np.searchsorted(place, middle - reach), len(place))):
                self._banded(seeds, place[a:b], at[a:b], out)
            return
        seed = np.repeat(seeds.first[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, start, weight = seeds.item[seed], np.repeat(place, n) - seeds.place[seed], seeds.weight[seed]
        band = np.maximum(2, self.size[item] // 4)
        for half in (0, 1):  # bands overlap by half, so that no cluster is cut
            slot = (start + half * (band // 2)) // band
            low = int(slot.min())
            span = int(slot.max()) - low + 1
            key = item * span + (slot - low)
            if len(self.ids) * span <= DENSE * len(key):  # few enough bands to add up in place
                enough = np.bincount(key, weight)[key] >= seeds.least[item]
            else:
                _, of = np.unique(key, return_inverse=True)
                enough = np.bincount(of, weight)[of] >= seeds.least[item]
            out.append(np.unique(item[enough] << 40 | start[enough] + (1 << 39)))


Asked = list[tuple[int, int, int]]


def candidates(texts: list[str | None], items: Items, first_row: int = 0) -> tuple[Asked, list[tuple[str, str]]]:
    """(text, item, start word) of what the tables bring together, and the (item, passage) pairs to be verified."""
    asked: Asked = []
    pairs: list[tuple[str, str]] = []
    if not items.ids:
        return asked, pairs
    docs = [" ".join(words_of(t)) for t in texts]
    whole = "\n".join(docs)  # no item has a line end: no gram spans two texts
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0] + [len(d) + 1 for d in docs])
    item, start = items.hits(code)
    if not len(item):
        return asked, pairs
    size = items.size[item]
    doc = np.clip(np.searchsorted(starts, start + size // 2, "right") - 1, 0, len(docs) - 1)
    begin = np.clip(start, starts[doc], starts[doc + 1] - 1)
    end = np.clip(start + size, starts[doc], starts[doc + 1] - 1)
    direct, kind = items.direct[item], items.kind[item]
    met = direct.copy()
    for k in np.unique(kind[~direct]).tolist():
        of = np.flatnonzero((kind == k) & ~direct)
        for some in np.array_split(of, max(1, len(of) // 4096)):
            keys = cgk_keys(code, begin[some], end[some], k)
            met[some] = (keys == items.keys[item[some]]).any(axis=1)
    passed: dict[tuple[int, int], set[int]] = {}
    for x in np.flatnonzero(met).tolist():
        passed.setdefault((int(doc[x]), int(item[x])), set()).add(int(start[x] - starts[doc[x]]))
    for (d, k), places in passed.items():
        n = int(items.size[k])
        slack, spans = n // 4 + 1, []
        for a in sorted(places):  # windows that touch are verified as one
            lo, hi = max(0, a - slack), max(0, a + n + slack)
            if spans and lo <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]), spans[-1][2])
            else:
                spans.append((lo, hi, a))
        for lo, hi, a in spans:
            asked.append((first_row + d, k, docs[d].count(" ", 0, max(a, 0))))
            pairs.append((items.texts[k], docs[d][lo:hi]))
    return asked, pairs


def verified(asked: Asked, pairs: list[tuple[str, str]], items: Items) -> dict[int, list[tuple[object, int, int, float]]]:
    """For each text the (item id, start word, distance, similarity) of every item that is in it."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for (d, k, a), distance in zip(asked, infix_distances(pairs)):
        most = int((1 - items.similarity) * len(items.texts[k]) + 1e-9)
        if distance <= most and ((d, k) not in best or distance < best[d, k][1]):
            best[d, k] = (a, distance)
    out: dict[int, list[tuple[object, int, int, float]]] = {}
    for (d, k), (a, distance) in best.items():
        out.setdefault(d, []).append((items.ids[k], a, distance, 1 - distance / len(items.texts[k])))
    return out


def find_in(texts: list[str | None], items: Items) -> list[list[tuple[object, int, int, float]]]:
    """`verified` of the candidates of some texts, one list per text."""
    found = verified(*candidates(texts, items), items)
    return [found.get(d, []) for d in range(len(texts))]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
            similarity: float = SIMILARITY, share: float = GRAM_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs` with `matches`: item_id, start (in words), distance and similarity of every item found in each whole text.

    Items without words, with a null text, and null or empty documents match
    nothing; equal items are all reported; repeated rows stay; a column of `docs`
    named matches is replaced; empty tables give no matches.  Items are broadcast
    in blocks of bounded size, and every document is searched for every block.
    """
    docs = docs.drop("matches")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    chars = items.agg(F.sum(F.length("t") + 16)).head()[0] or 0
    blocks = max(1, math.ceil(1.5 * chars / block_chars)) if chars > block_chars else 1
    kind = benchmark.schema[item_id].dataType
    result = MATCHES.format(kind.simpleString())
    found: Column = F.array().cast(result)
    columns = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.orderBy("i").collect()])  # about `block_chars` characters
        columns.append(F.arrow_udf(_search(shared, similarity, share, kind), result)(F.col(text)))
    names = [f"_kw_m{b}" for b in range(blocks)]
    return docs.withColumns(dict(zip(names, columns))).select(*docs.columns, F.concat(found, *names).alias("matches"))


def _search(shared, similarity: float, share: float, kind):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("start", pa.int32()),
                                ("distance", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(shared.value, similarity, share)
        for batch in batches:
            asked: Asked = []
            pairs: list[tuple[str, str]] = []
            for first, texts in sliced(batch, SLICE):
                more = candidates(texts, items, first)
                asked += more[0]
                pairs += more[1]
            found = verified(asked, pairs, items)  # those of a batch go together
            out = [[{"item_id": i, "start": s, "distance": d, "similarity": m} for i, s, d, m in found.get(row, ())]
                   for row in range(len(batch))]
            yield pa.array(out, arrow)

    return run


def pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """(doc_id, item_id, start, distance, similarity): one row per document and item found in it."""
    found = matches(docs, benchmark, **settings).select(F.col(id_col).alias("doc_id"), F.explode("matches").alias("m"))
    return found.select("doc_id", "m.item_id", "m.start", "m.distance", "m.similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """`docs` without those that hold an item; all columns kept."""
    name = "matches"
    columns = [f"`{c}`" for c in docs.columns]
    renamed = docs.select(F.struct(*columns).alias("_kw_row"), F.col(settings.pop("text", "text")).alias("_kw_text"))
    found = matches(renamed, benchmark, text="_kw_text", **settings)
    return found.where(F.size(name) == 0).select("_kw_row.*")
