"""BPE and token files against the tokenizer libraries."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from kinweave.llm import bpe, token_files, words
from kinweave.session import work_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(bpe.load_blob(RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    draw = random.Random(1)
    letters = "ab  \n\t's're'll'd'm12½é中\u00a0\u3000.!?-’日本\U0001F600 \r\n'tveS"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("size", [40, 1_000_000])
def test_words_are_the_matches_of_the_pattern(size):
    assert words.PATTERN == public_tokenizers.PATTERN
    texts = random_texts(2000) + ["", "don't we'll 's ''s 's's '", "   ", " \n x", "word " * 50]
    got = [[] for _ in texts]
    for rows, parts in words.pieces(texts, size):
        found, before = words.words(parts)
        found = found.to_pylist()
        for k, row in enumerate(rows):
            got[row] += [w.decode() for w in found[before[k]: before[k + 1]]]
    assert got == [regex.findall(words.PATTERN, t) for t in texts]


def test_fold(encoding):
    ranks = bpe.read_ranks(bpe.load_blob(RANKS))
    for text in [*random_texts(300), "a" * 500, "=" * 77, "abc" * 200]:
        for w in regex.findall(words.PATTERN, text):
            assert bpe.fold(w.encode(), ranks) == bpe._fold_long(w.encode(), ranks) or w.encode() in ranks
            assert bpe.fold(w.encode(), ranks) == encoding.encode_ordinary(w)


def test_fold_as_higher_order_functions(spark, encoding):
    found = sorted({w for t in random_texts(60) for w in regex.findall(words.PATTERN, t)} | {" tokenization", "x", "éé"})
    df = spark.createDataFrame([(w,) for w in found] + [(None,)], "word string")
    got = {r["word"]: r["ids"] for r in bpe.fold_words(df, RANKS, buckets=4096).collect()}
    assert got == {w: encoding.encode_ordinary(w) for w in found} | {None: None}


def test_encode_and_decode(odd, empty, encoding, rows):
    def want(text):
        ids = struct.pack(f"<{len(i)}I", *i) if (i := encoding.encode_ordinary(text or "")) else b""
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = bpe.encode(odd, RANKS)
    assert rows(got.drop("ids")) == sorted([(i, *want(t)) for i, t in texts], key=repr)
    back = bpe.decode(got, RANKS)
    assert rows(back) == sorted([(i, bytearray((t or "").encode())) for i, t in texts], key=repr)
    assert bpe.encode(empty, RANKS).count() == 0


def test_elias_fano():
    draw = np.random.default_rng(3)
    for top, n in [(0, 1), (5, 3), (10, 700), (10**9, 1000), (10**6, 5)]:
        values = np.sort(draw.integers(0, top + 1, n))
        ef = token_files.EliasFano.of(values)
        blocks = [v for b in range(-(-n // token_files.SAMPLE)) for v in ef.select_block(b).tolist()]
        assert blocks == values.tolist() == [ef.select(i) for i in range(n)]
        assert 8 * (len(ef.low) + len(ef.high)) <= n * (2 + max(0, int(np.log2(top / n + 1e-9)) + 1)) + 24
    assert token_files.EliasFano.of(np.zeros(0)).n == 0


@pytest.mark.parametrize("shard_ids", [50, 1 << 18])
def test_token_files(spark, odd, empty, shard_ids):
    tok = Tokenizer.from_file(JSON)
    special = spark.createDataFrame([(50, "a <|endoftext|> b"), (51, "<|endoftext|><|endoftext|>"), (52, "<|endoftext|")], "doc_id long, text string")
    odd = odd.unionByName(special, allowMissingColumns=True)
    assert tok.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    shards = token_files.write_shards(odd, JSON, work_path(spark, "tokens"), shard_ids=shard_ids)
    got = token_files.read_shards(shards).orderBy("start").collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in got] == [i for i, _ in texts]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append(struct.pack(f"<{len(x)}I", *x) if (x := [*tok.encode(t or "", add_special_tokens=False).ids, 0]) else b"")
    for i in ids:
        assert sorted(zlib.crc32(r["ids"]) for r in got if r["doc_id"] == i) == sorted(map(zlib.crc32, ids[i]))
    assert token_files.read_shards(token_files.write_shards(empty, JSON, work_path(spark, "tokens"))).count() == 0
