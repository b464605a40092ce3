"""Alignment of two tokenizers against a byte-by-byte comparison."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kinweave.llm import QUERIES, alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens_of(text, libraries):
    """(A ids with their bytes, B ids with their bytes), empty where the tokens do not spell the text."""
    if not text:
        return [], []
    tok, sp = libraries
    letters = alignment.byte_letters()
    a = [(i, bytes(letters[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode())
         for i, p in ((i, sp.id_to_piece(i)) for i in sp.encode(text))]
    want = (" " + text).encode()
    return (a, b) if want == b"".join(x for _, x in a) == b"".join(x for _, x in b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(texts, libraries):
    """Rows of the query by intersecting byte ranges and comparing sets of ends."""
    docs = []
    for text in texts:
        a, b = (spans(t) for t in tokens_of(text, libraries))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        starts = [[s for _, s, _ in side] for side in (a, b)]
        cuts = [[bisect.bisect_left(x, e) for e in [0, *ends]] for x in starts]
        groups = ["|".join(",".join(str(i) for i, *_ in side[cut[k]: cut[k + 1]]) for side, cut in zip((a, b), cuts))
                  for k in range(len(ends))]
        links, first = [], 0
        for i, s, e in a:
            while first < len(b) and b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        docs.append((len(a), len(b), groups, links))
    count = Counter(p for *_, links in docs for p in set(links))
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    return [(na, nb, len(g), len(ls), ";".join(g), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls))
            for na, nb, g, ls in docs]


def hard_texts():
    draw = random.Random(4)
    letters = "ab  \n\té中▁<0x41>'s日本\U0001F600 　 theing12.,!"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(120)] + [
        "a <|endoftext|> b", "<s> </s> <unk>", "   leading", "trailing   ", "▁", " ", "x" * 700, "\x00\x01", "ﬁ Ａ é",
        "word " * 400, "一" * 300]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_against_byte_ranges(spark, libraries, odd, most):
    texts = [*hard_texts(), *(r["text"] for r in odd.collect())]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, times int")
    got = alignment.rate_links(alignment.align(docs.repartition(3), A, B), most).orderBy("doc_id").select(COLUMNS).collect()
    want = brute(texts, libraries)
    assert [tuple(r) for r in got] == [(i, *w) for i, w in enumerate(want)]
    assert sum(w[0] == 0 for w in want) > 5 and max(w[0] for w in want) > 1000


@pytest.mark.parametrize("lane", [1, 3, 10_000])
def test_lanes_of_any_length_are_equal(lane):
    draw = np.random.default_rng(2)
    size = 4000
    cuts = [np.unique(np.append(draw.integers(1, size, size // k), size)) for k in (3, 4)]
    a_end, b_end = cuts[0], cuts[1]
    first = np.array([0, len(a_end)])
    got = alignment.merge_lanes(a_end, b_end, *alignment.lanes_of(first, a_end, b_end, lane))
    a, b = (list(zip([0, *x[:-1]], x)) for x in (a_end, b_end))
    links = {(i, j) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if max(s, t) < min(e, f)}
    assert sorted(zip(*got[:2])) == sorted(links)
    assert {(a_end[i], b_end[j]) for i, j in zip(*got[2:])} == {(e, e) for e in set(a_end) & set(b_end)}


def test_pairs_are_counted_in_rounds(spark, monkeypatch):
    texts = [f"the cat number {i} sat on the mat" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    aligned = alignment.align(docs, A, B)
    want = sorted(map(tuple, alignment.count_pairs(aligned).collect()))
    monkeypatch.setattr(alignment, "COUNTED", 3)
    assert sorted(map(tuple, alignment.count_pairs(aligned).collect())) == want
    assert max(n for *_, n, _ in want) == 40


def test_whole_texts_where_pieces_cross_spaces(libraries):
    """A model whose pieces might cross spaces is asked for whole texts; the ids are the same for this one."""
    pieces = alignment.Pieces(open(B, "rb").read())
    texts = [" " + t for t in hard_texts() if t and "▁" not in t]
    cut = pieces.encode(texts)
    pieces.whole = True
    assert [x.tolist() for x in pieces.encode(texts)] == [x.tolist() for x in cut]
    assert not alignment.Pieces(open(B, "rb").read()).whole


def test_odd_rows(spark, odd, empty):
    rated = alignment.rate_links(alignment.align(odd, A, B))
    assert rated.count() == odd.count() and rated.where("doc_id is null").count() == 2
    blank = rated.where("n_a = 0").select("n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").distinct().collect()
    assert [tuple(r) for r in blank] == [(0, 0, 0, "", 0, 0)]
    for most in (10, 0):
        assert alignment.rate_links(alignment.align(empty, A, B), most).count() == 0


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: w for i, w in zip(texts, brute(texts.values(), libraries))}
    got = {r["doc_id"]: r for r in QUERIES["op11_cross_alignment"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for i, (na, nb, ng, nl, groups, best, total) in want.items():
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert tuple(got[i])[1:] == (na, nb, ng, nl, best, total, digest)
