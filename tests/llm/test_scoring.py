"""Toxicity and language: the scans against brute force, the models on planted words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import language, toxicity


def segments_brute(scores):
    """The best subarray, then the same to its left and right."""
    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 0 and (top is None or total > top[2] + 1e-12):
                    top = (i, j + 1, total)
        return [] if top is None else [*best(lo, top[0]), top, *best(top[1], hi)]

    return best(0, len(scores))


def test_maximal_segments():
    draw = random.Random(0)
    for _ in range(1500):
        scores = [draw.choice([-3, -2, -1, 1, 2, 3, 5]) + draw.random() * 0.01 for _ in range(draw.randrange(14))]
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.maximal_segments(scores)]
        assert got == [(a, b, round(s, 6)) for a, b, s in segments_brute(scores)]


def test_segments_are_linear():
    scores = [1.0 if i % 2 else -0.999 for i in range(200_000)]
    assert len(toxicity.maximal_segments(scores)) >= 1


def corpus(spark, n=600):
    draw = random.Random(3)
    plain = [f"word{i}" for i in range(300)]
    bad = ["grim", "vile", "rotten", "foul"]
    rows, labels = [], []
    for i in range(n):
        words = [draw.choice(plain) for _ in range(draw.randrange(20, 90))]
        toxic = i % 8 == 0
        if toxic:
            at = draw.randrange(len(words))
            words[at:at] = [draw.choice(bad).upper() if draw.random() < 0.3 else draw.choice(bad) for _ in range(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if draw.random() > 0.02 else 1))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"),
            {i for i in range(n) if i % 8 == 0})


def test_toxic_documents_are_found(spark):
    docs, labels, toxic = corpus(spark)
    model = toxicity.fit(docs, labels, learn=F.col("doc_id") % 5 != 0)
    assert {"grim", "vile", "rotten", "foul"} <= set(model.scores)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert {i for i, r in got.items() if r["toxicity"] >= 0.5} == toxic
    for i in toxic:
        words = toxicity.tokens(docs.where(F.col("doc_id") == i).head()["text"])
        assert any(set(words[p["start"]: p["end"]]) & set(model.scores) for p in got[i]["passages"])


def test_equal_passages_are_all_found(spark):
    """Six equal toxic passages far from each other are six passages, and each is found by the plain odds of its words."""
    docs, labels, _ = corpus(spark)
    model = toxicity.fit(docs, labels)
    plain = sum(model.scores[w] for w in ("grim", "vile", "foul"))
    far = int(2 * plain / -model.rest) + 10  # neutral words that cost more than a passage scores
    words = [f"word{i % 300}" for i in range(6 * far)]
    for k in range(6):
        words[far * k + 5: far * k + 8] = ["grim", "vile", "foul"]
    row = toxicity.score(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), model).first()
    assert [(p["start"], p["end"]) for p in row["passages"]] == [(far * k + 5, far * k + 8) for k in range(6)]
    assert all(p["score"] == pytest.approx(plain) for p in row["passages"]) and row["toxicity"] >= 0.5


def test_toxicity_of_odd_documents(spark, odd, empty):
    docs, labels, _ = corpus(spark, 200)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model)
    assert got.count() == odd.count() and got.where("toxicity IS NULL OR toxicity < 0 OR toxicity > 1").count() == 0
    assert got.where("text IS NULL").select("toxicity").distinct().count() == 1
    assert toxicity.score(empty, model).count() == 0
    strange = spark.createDataFrame([(None, 1), (3, None), (4, 7), (99999, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    none = toxicity.fit(docs, strange)
    assert not none.scores and 0 < none.probability([], 0) < 1
    assert not toxicity.fit(empty, labels).scores


def test_ngrams_do_not_cross_texts():
    texts = ["ab", "", None, "xyz é!", "a" * 50]
    found, starts, letters = language.ngrams(texts)
    ends = [*starts[1:].tolist(), len(found)]
    for t, a, b, n in zip(texts, starts.tolist(), ends, letters.tolist()):
        alone, _, one = language.ngrams([t])
        assert found[a:b].tolist() == alone.tolist() and n == one[0] == sum(c.isalpha() for c in t or "")


def test_ftrl_is_sparse_and_separates():
    draw = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(draw.integers(2))
        at = np.array([y, 2 + int(draw.integers(50))])
        rows.append((at, np.ones(2), y))
    w = language.ftrl(rows, 2, 60)
    assert all((x @ w[at]).argmax() == y for at, x, y in rows)
    assert (w[52:] == 0).all()


def test_temperature():
    draw = np.random.default_rng(1)
    logits = draw.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = np.array([draw.choice(3, p=q) for q in p])
    assert language.temperature(4 * logits, y) == pytest.approx(4, rel=0.15)
    assert language.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_languages(spark, odd, empty):
    draw = random.Random(2)
    sounds = {"aa": ["ka", "ti", "mo"], "bb": ["sch", "lu", "öß"], "cc": ["ée", "oux", "ti"]}
    rows = [(i, " ".join("".join(draw.choice(sounds[k]) for _ in range(3)) for _ in range(draw.randrange(3, 60))), k)
            for i, k in enumerate(draw.choices(["aa", "bb", "cc"], [8, 3, 1], k=500))]
    docs = spark.createDataFrame(rows + [(None, None, "aa"), (1, "x", None), (2, "", "bb")], "doc_id long, text string, lang string")
    model = language.fit(docs, learn=F.expr("doc_id % 5 <> 0"))
    got = language.predict(docs, model).where("length(text) > 1")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()
    strange = language.predict(odd, model).collect()
    assert len(strange) == odd.count()
    for r in strange:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["lang_score"] <= 1
    assert language.predict(empty, model).count() == 0
    assert language.predict(docs, language.fit(empty)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_a_language_of_long_texts_is_learned(spark):
    """All texts of cc are beyond the preferred length; one language has a single row."""
    draw = random.Random(9)
    sounds = {"aa": ["ka", "ti", "mo"], "bb": ["sch", "lu", "öß"], "cc": ["ée", "oux", "zi"], "dd": ["wry", "gwn"]}

    def text(k, words):
        return " ".join("".join(draw.choice(sounds[k]) for _ in range(3)) for _ in range(words))

    rows = [(i, text("ab"[i % 2] * 2, 30), "ab"[i % 2] * 2) for i in range(120)]
    rows += [(200 + i, text("cc", 500), "cc") for i in range(40)] + [(300, text("dd", 40), "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, most=80, max_chars=1000)
    assert model["names"] == ["aa", "bb", "cc", "dd"]
    got = language.predict(docs, model)
    assert got.where("lang = lang_pred").count() == 161
