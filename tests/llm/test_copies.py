"""Exact dedup, line dedup and SimHash classes against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import exact_dedup, line_dedup, simhash
from kinweave.operators.components import star_rounds


def exact_brute(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,primes", [(1 << 18, exact_dedup.PRIMES), (7, exact_dedup.PRIMES), (1 << 18, (3, 2)), (1000, (3, 2))])
def test_exact_groups(spark, odd, rows, chunk, primes):
    """With tiny primes nearly all fingerprints collide; the comparison parts the texts again."""
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["ab", "ba", "ab", "bb", "cc", "cc", "ba"])], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    if chunk == 7:
        docs = docs.where("coalesce(length(text), 0) < 4000")
    want = exact_brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert rows(exact_dedup.exact_groups(docs, chunk=chunk, primes=primes)) == want


def test_chunk_hashes_compose(spark):
    data = bytes(random.Random(2).randrange(256) for _ in range(500))
    for cuts in ([250], [1, 2, 3], [], [499], [0]):
        ends = [0, *cuts, 500]
        parts = [exact_dedup.chunk_hash(data[a:b]) for a, b in zip(ends, ends[1:])]
        df = spark.createDataFrame([(parts,)], "p array<struct<h0:long,h1:long,s0:long,s1:long>>")
        got = df.select(exact_dedup.compose(F.col("p")).alias("f")).head()["f"]
        assert tuple(got) == exact_dedup.chunk_hash(data)[:2]


def test_drop_copies_keeps_columns(odd, empty):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in odd.collect()})
    assert exact_dedup.drop_copies(empty).count() == 0 == exact_dedup.exact_groups(empty).count()


def lines_brute(texts, min_docs, min_chars):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    counts = Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or counts[key(x)] < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs,min_chars,batches,fan_in", [(3, 1, 5, 2), (2, 3, 1, 2), (1, 0, 3, 3)])
def test_lines(spark, odd, rows, min_docs, min_chars, batches, fan_in):
    draw = random.Random(4)
    pool = ["Same line", " same LINE\t", "é", "É", "", " ", "x", "other", "rare one", "rare two\r"]
    texts = [(1000 + i, "\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 8)))) for i in range(60)]
    docs = odd.select("doc_id", "text", F.lit("old").alias("kept_text")).unionByName(
        spark.createDataFrame([(*t, "old") for t in texts], "doc_id long, text string, kept_text string"))
    want = lines_brute([(r["doc_id"], r["text"]) for r in docs.collect()], min_docs, min_chars)
    got = line_dedup.drop_frequent_lines(docs, min_docs=min_docs, min_chars=min_chars, batches=batches, fan_in=fan_in)
    assert rows(got, "doc_id", "kept_text", "n_lines", "n_dropped") == want


def test_runs_are_levelled(spark, empty):
    runs = line_dedup.LineRuns(spark, settled=1, fan_in=2)
    for k in range(5):
        part = spark.createDataFrame([(f"line {i}\nshared",) for i in range(3 * k, 3 * k + 3)], "text string")
        counts = line_dedup.count_lines(part)
        assert runs.fresh(counts).count() == (4 if k == 0 else 3)  # the shared line is known from the first batch on
        runs.add(counts)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.merged().count() == 16
    runs.drop()
    assert line_dedup.drop_frequent_lines(empty).count() == 0


def fingerprint_brute(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    draw = random.Random(0)
    texts = [" ".join("".join(draw.choice("abÉcD中") for _ in range(draw.choice([1, 2, 5, 9, 300]))) for _ in range(draw.randrange(12)))
             for _ in range(200)] + ["", None, "  \t\n", "a" * 5000 + " b", "a\x0bb\u00a0c"]
    assert simhash.fingerprints_of(texts).tolist() == [fingerprint_brute(t) for t in texts]
    small = simhash.SHINGLES
    try:
        simhash.SHINGLES = 7
        assert simhash.fingerprints_of(texts).tolist() == [fingerprint_brute(t) for t in texts]
    finally:
        simhash.SHINGLES = small


def components_brute(fps, bits):
    label = {x: x for x in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    fps = sorted(label)
    for i, x in enumerate(fps):
        for y in fps[i + 1:]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= bits:
                a, b = find(x), find(y)
                label[max(a, b)] = min(a, b)
    return {x: find(x) for x in fps}


def test_popcounts_bound_the_distance(spark):
    draw = np.random.default_rng(1)
    x = draw.integers(-(2**63), 2**63 - 1, 300)
    df = spark.createDataFrame([(int(v),) for v in x], "fp long")
    got = {r[0]: r[1] for r in df.select("fp", simhash.embedding(F.col("fp"))).collect()}
    assert [got[int(v)] for v in x] == simhash._unary(x.view(np.uint64)).view(np.int64).tolist()
    a, b = x[:150].view(np.uint64), x[150:].view(np.uint64)
    low = np.bitwise_count(simhash._unary(a) ^ simhash._unary(b))
    assert (low <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("cell_rows", [50_000, 3, 1])
def test_links(spark, cell_rows):
    draw = random.Random(7)
    fps = set()
    for _ in range(40):
        x = base = draw.getrandbits(64)
        for _ in range(8):
            for b in draw.sample(range(64), draw.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x - (1 << 64) if x >> 63 else x)
            x = draw.choice([x, base])
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["component"] for r in star_rounds(simhash.links(df, cell_rows=cell_rows), []).collect()}
    assert {x: got.get(x, x) for x in fps} == components_brute(fps, 4)


def test_classes(spark, odd, empty):
    base = " ".join(f"w{i % 50}" for i in range(200))
    near = spark.createDataFrame([(50, base), (51, base + " more"), (52, base.upper())], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(near)
    rows = docs.collect()
    fps = {(r["doc_id"], r["text"]): fingerprint_brute(r["text"]) for r in rows}
    signed = {k: v - (1 << 64) if v >> 63 else v for k, v in fps.items()}
    part = components_brute(set(signed.values()), 4)
    low = {}
    for (i, _), v in signed.items():
        if i is not None:
            low[part[v]] = min(low.get(part[v], i), i)
    got = sorted(((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.classes(docs).collect()), key=repr)
    assert got == sorted(((r["doc_id"], signed[r["doc_id"], r["text"]], low.get(part[signed[r["doc_id"], r["text"]]])) for r in rows), key=repr)
    kept = simhash.drop_near_copies(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} <= {r["doc_id"] for r in rows}
    assert simhash.classes(empty).count() == 0
