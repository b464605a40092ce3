"""Benchmark items in documents: planted with and without edits, against an exact search."""

import random

import pytest

from kinweave.llm import decontamination as dec


def infix_brute(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_infix_distance():
    draw = random.Random(1)
    for _ in range(300):
        a = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 12)))
        b = "".join(draw.choice("abc") for _ in range(draw.randrange(20)))
        assert dec.infix_distance(a, b) == infix_brute(a, b)


def test_infix_distances_together():
    """Items of up to several words of 64 bits, texts of any length, empty ones too."""
    draw = random.Random(6)
    pairs = [("", "abc"), ("abc", "")]
    for _ in range(300):
        a = "".join(draw.choice("abcé\U0001F600") for _ in range(draw.choice([1, 5, 63, 64, 65, 130, 200])))
        b = list(a)
        for _ in range(draw.randrange(30)):
            at = draw.randrange(len(b) + 1)
            b[at:at + draw.randrange(2)] = [draw.choice("abcx")] * draw.randrange(2)
        pairs.append((a, "".join(draw.choice("abcx") for _ in range(draw.randrange(90))) + "".join(b) + "b" * draw.randrange(50)))
    want = [dec.infix_distance(a, b) for a, b in pairs]
    assert dec.infix_distances(pairs) == want == dec.infix_distances(pairs, together=7)


def language(draw, n):
    parts = ["ka", "ti", "mo", "re", "shu", "lin", "ed", "on", "va", "qu"]
    common = ["the", "of", "and", "to", "in"]
    return [draw.choice(common) if draw.random() < 0.35 else "".join(draw.choice(parts) for _ in range(draw.randrange(1, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    """Items, and documents with (document, item) planted under word edits of up to a sixth of the characters."""
    draw = random.Random(9)
    items = [(i, " ".join(language(draw, draw.randrange(15, 60))).capitalize() + ".") for i in range(60)]
    docs, truth = [], set()
    for d in range(400):
        words = language(draw, draw.randrange(50, 400))
        if d % 4 == 0:
            k = draw.randrange(len(items))
            passage = items[k][1].split()
            budget = draw.choice([0, 0.1, 0.16]) * len(items[k][1])
            while True:
                at = draw.randrange(len(passage))
                if len(passage[at]) + 1 > budget:
                    break
                budget -= len(passage[at]) + 1
                if draw.random() < 0.5:
                    del passage[at]
                else:
                    passage[at] = "x" * len(passage[at])
            at = draw.randrange(len(words))
            words[at:at] = passage
            truth.add((d, k))
        docs.append((d, "\n".join([" ".join(words[:20]).upper(), " ".join(words[20:])])))
    return items, docs, truth


def test_recall_and_precision(spark, planted):
    items, docs, truth = planted
    table, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dec.pairs(table, benchmark).collect()}
    assert len(set(got) & truth) >= 0.97 * len(truth)
    normal = {i: " ".join(dec.words_of(t)) for i, t in items}
    texts = {d: " ".join(dec.words_of(t)) for d, t in docs}
    for (d, k), r in got.items():
        assert r["similarity"] >= 0.8 and r["distance"] >= infix_brute(normal[k], texts[d])
        assert infix_brute(normal[k], texts[d]) <= 0.2 * len(normal[k])
    exact = {(d, k) for d in texts for k in normal if normal[k] in texts[d]}
    assert exact <= set(got)
    blocks = dec.pairs(table, benchmark, block_chars=4000).collect()
    assert exact <= {(r["doc_id"], r["item_id"]) for r in blocks}


def test_odd_rows(spark, odd, empty):
    benchmark = spark.createDataFrame(
        [(1, "The cat sat on the mat. A second line."), (2, None), (3, ""), (4, "!!!"), (5, "plage"), (None, "demain été à la plage 12½ km"),
         (1, "The cat sat on the mat. A second line.")], "item_id long, text string")
    got = dec.matches(odd, benchmark)
    assert got.columns == [c for c in odd.columns if c != "matches"] + ["matches"] and got.count() == odd.count()
    found = {(r["doc_id"], m["item_id"]) for r in got.collect() for m in r["matches"]}
    assert {(0, 1), (4, 1), (6, 5)} <= found and not {1, 2, 3, 7, 9} & {d for d, _ in found}
    kept = dec.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and {0, 4, 6}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert dec.matches(odd, benchmark.limit(0)).where("size(matches) > 0").count() == 0
    assert dec.pairs(empty, benchmark).count() == 0


def test_windows_of_equal_texts_have_equal_keys():
    code, at = dec.codes_of(["alpha beta", "gamma", "alpha beta", "delta"])
    keys = dec.cgk_keys(code, at[:-1], at[1:] - 1, dec.size_class(10))
    assert (keys[0] == keys[2]).all() and not (keys[0] == keys[1]).all()


def found(text, *items):
    return [{i for i, *_ in found} for found in dec.find_in([text], dec.Items(list(enumerate(items)), dec.SIMILARITY, dec.GRAM_SHARE))][0]


def test_passages_glued_to_other_text():
    """Without spaces a clause is one word: items inside longer clauses are found, exact or edited."""
    draw = random.Random(4)
    glyphs = [chr(0x4E00 + draw.randrange(3000)) for _ in range(400)]
    for size in (6, 20, 50, 90, 200):
        item = "".join(draw.choice(glyphs) for _ in range(size))
        edited = list(item)
        for at in draw.sample(range(size), size // 8):
            edited[at] = "x"
        around = ["".join(draw.choice(glyphs) for _ in range(60)) for _ in range(2)]
        assert found(around[0] + item + around[1], item, "never there at all") == {0}
        assert found(around[0] + "".join(edited) + around[1], item) == {0}
    clauses = ["".join(draw.choice(glyphs) for _ in range(9)) for _ in range(3)]
    assert found(glyphs[0] * 5 + "\u3002".join(clauses) + glyphs[1] * 5, "\u3001".join(clauses)) == {0}


def test_short_items_with_edits():
    """Items of one and two words with an edit in any word."""
    text = "some other text before photosynthesys and then quantam mechanixs, not more"
    assert found(text, "photosynthesis", "quantum mechanics", "kinetic energy", "mitochondrion") == {0, 1}


def test_recall_of_edited_characters():
    """Edits of 15 and 19 % of the single characters, spaces too, of items of every length."""
    draw = random.Random(12)
    items = [(i, " ".join(language(draw, draw.randrange(6, 60)))) for i in range(80)]
    table = dec.Items(items, dec.SIMILARITY, dec.GRAM_SHARE)
    for rate in (0.15, 0.19):
        docs = []
        for _, text in items:
            s = list(text)
            for _ in range(int(rate * len(s))):
                at = draw.randrange(len(s))
                s[at:at + draw.randrange(2)] = [draw.choice("abcdefgh ")] * draw.randrange(2)
            docs.append(" ".join([*language(draw, 80), "".join(s), *language(draw, 80)]))
        true = [d for d, (_, t) in enumerate(items) if dec.infix_distance(t, " ".join(dec.words_of(docs[d]))) <= 0.2 * len(t)]
        got = dec.find_in(docs, table)
        assert len(true) > 60 and sum(any(i == d for i, *_ in got[d]) for d in true) >= 0.97 * len(true)


def test_repeated_characters_stay_within_memory(monkeypatch):
    """A gram that stands everywhere in item and text is met in overlapping parts of the text."""
    monkeypatch.setattr(dec, "HITS", 10_000)
    assert found("b " + "a" * 5000 + " c", "a" * 150, "a" * 12, "z" * 100) == {0, 1}
