import itertools
import random

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.functions.similarity import jaro_winkler, jaro_winkler_rows, segments_agree, segments_agree_rows
from kinweave.operators import identity
from kinweave.schemas import Logs

DB = duckdb.connect()


@settings(max_examples=300, deadline=None)
@given(st.text("abAB c", max_size=14), st.text("abAB c", max_size=14))
def test_measure(a, b):
    want = DB.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
    assert jaro_winkler(a, b) == pytest.approx(want, abs=1e-12)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abAB cé\U0001F600", max_size=20) | st.text("ab", min_size=55, max_size=150), st.text("abAB cé\U0001F600", max_size=20) | st.text("ab", max_size=90)), max_size=30))
def test_rows_at_once_equal_one_by_one(pairs):
    a, b = (pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1))
    assert jaro_winkler_rows(a, b).tolist() == [jaro_winkler(*p) for p in pairs]
    assert segments_agree_rows(a, b).tolist() == [segments_agree(*p) for p in pairs]


def test_measure_edges():
    assert jaro_winkler("", "") == 0 and jaro_winkler("a", "") == 0 and jaro_winkler("a", "a") == 1
    assert segments_agree("robert yates", "robert yats") and not segments_agree("robert yates", "robert butts")
    assert segments_agree("robert", "robert butts")


def names(rng, n):
    stems = ["ann lee", "robert yates", "maria garcia lopez", "kim", "jo", "xavier quentin", "anna leigh"]
    out = set()
    while len(out) < n:
        s = list(rng.choice(stems))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s))
            what = rng.randrange(3)
            if what == 0 and len(s) > 1:
                del s[i]
            elif what == 1:
                s.insert(i, rng.choice("abeilnorsz "))
            else:
                s[i] = rng.choice("abeilnorszAB")
        out.add("".join(s))
    return sorted(out)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(11)
    people = [(f"p{k}", n) for k in range(2) for n in names(rng, 140)]
    df = spark.createDataFrame(people, "project string, name string")
    keyed = {(p, "".join(c for c in n if c.isalpha() or c == " ").strip()) for p, n in people}
    for least in (0.9, 0.84, 0.95):
        want = set()
        for (p, a), (q, b) in itertools.combinations(sorted(keyed), 2):
            if p == q and a and b and jaro_winkler(a, b) > least and segments_agree(a, b):
                want.add((p, min(a, b), max(a, b)))
        got = [(r["project"], r["a"], r["b"]) for r in identity.similar_pairs(df, least).collect()]
        assert len(got) == len(set(got))
        assert set(got) == want
    with pytest.raises(ValueError):
        identity.similar_pairs(df, 0.5)


def test_whole_chain(spark, rows):
    people = ["gerrie myburgh", "gerriem", "gerrie myburg", "Gerrie Myburgh (x)", "zed", "ann lee", "12345", "678"]
    df = spark.createDataFrame([("p", n) for n in people], "project string, name string")
    clusters = identity.alias_components(df, identity.similar_pairs(df))
    assert {r["name"] for r in clusters.collect()} >= {"gerrie myburgh", "gerrie myburg", "gerriem"}
    kept = identity.refine_clusters(clusters)
    names_kept = {r["name"] for r in kept.collect()}
    assert {"gerrie myburgh", "gerrie myburg"} <= names_kept and "zed" not in names_kept
    full = {r["full_name"] for r in identity.canonical_name(kept).collect()}
    assert full == {"Gerrie Myburgh"}
    tech = df.selectExpr("project", "name AS sender", "0 AS is_bot", "1 AS is_coding")
    out = identity.apply_aliases(Logs(tech, tech.drop("is_coding")), identity.alias_map(kept))
    got = {r["sender"]: r["dev"] for r in out.tech.collect()}
    assert got["gerrie myburg"] == "Gerrie Myburgh" and got["ann lee"] == "Ann Lee"


def test_refine_rules(spark):
    schema = "project string, cluster string, name string, key string, names long"
    same = [("p", "a", f"ann lee {i}", "ann lee", 6) for i in range(6)]           # too many
    odd = [("p", "b", n, n, 3) for n in ("john smithson", "john smithsom", "qqqq")]  # one does not fit
    wide = [("p", "c", n, n, 2) for n in ("x y", "x z")]                           # first and last words differ
    got = identity.refine_clusters(spark.createDataFrame(same + odd + wide, schema)).collect()
    assert sorted(r["name"] for r in got) == ["john smithsom", "john smithson"]


def refine_brute(names, least=0.9, sizes=(2, 5)):
    names = sorted(names)
    mean = {}
    while len(names) >= 2:
        mean = {n: sum(jaro_winkler(k, names[m][1]) for m in range(len(names)) if m != i) / (len(names) - 1)
                for i, (n, k) in enumerate(names)}
        low = min(mean.values())
        if low >= least - 1e-12:
            break
        worst = next(n for n, _ in names if mean[n] <= low + 1e-12)
        names = [x for x in names if x[0] != worst]
    drop = set()
    for (a, x), (b, y) in itertools.combinations(names, 2):
        if not segments_agree(x, y):
            drop |= {a} if mean[a] < mean[b] - 1e-12 else {b} if mean[b] < mean[a] - 1e-12 else {a, b}
    kept = [n for n, _ in names if n not in drop]
    return kept if sizes[0] <= len(kept) <= sizes[1] else []


def test_refine_equals_brute_force():
    import pandas as pd
    rng = random.Random(2)
    for _ in range(150):
        cluster = [(n, "".join(c for c in n if c.isalpha() or c == " ").strip()) for n in names(rng, rng.randrange(2, 14))]
        got = identity._refine(pd.DataFrame(cluster, columns=["name", "key"]), 0.9, (2, 5))
        assert sorted(got["name"]) == sorted(refine_brute(cluster))


def test_no_cluster_is_too_large(spark):
    """6100 names that leave the cluster one after the other, until two are left."""
    rows = [("p", "a", f"{'bcdfghjklm'[i % 10] * 6} {i}", "bcdfghjklm"[i % 10] * 6, 6102) for i in range(6100)]
    rows += [("p", "a", n, n, 6102) for n in ("john smithson", "john smithsom")]
    got = identity.refine_clusters(spark.createDataFrame(rows, "project string, cluster string, name string, key string, names long"))
    assert got.count() <= 5
    two = [r for r in rows if r[3] == "bbbbbb"][:2] + [("p", "a", f"x{i}", "qqq www", 0) for i in range(1)]
    assert identity.refine_clusters(spark.createDataFrame(two, "project string, cluster string, name string, key string, names long")).count() == 2


@pytest.mark.parametrize("same", [False, True])
def test_joined_rows_stay_few(spark, same):
    """Random two-word names of one project: what meets is a small part of all pairs."""
    rng = random.Random(4)
    letters = "etaoinshrdlucmfwypvbgkjqxz"

    def word(n):
        return "".join(rng.choices(letters, range(27, 1, -1), k=n))

    n = 3000
    people = [("p", f"{word(6 if same else rng.randrange(3, 10))} {word(7 if same else rng.randrange(4, 11))}") for _ in range(n)]
    pairs = identity.candidate_pairs(spark.createDataFrame(people, "project string, name string"))
    assert pairs.count() < 0.01 * n * (n - 1) / 2


def test_few_random_pairs_leave_the_join(spark):
    """Names of one length from few letters: no more pairs are scored than share enough letters in key and words."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    n = 1500
    people = [("p", f"{word(6)} {word(7)}") for _ in range(n)]
    people += [("p", f"{name[:-1]}{'q' if i % 2 else ''}") for i, (_, name) in enumerate(people[:50])]
    pairs = {(r["a"], r["b"]) for r in identity.candidate_pairs(spark.createDataFrame(people, "project string, name string")).collect()}
    assert len(pairs) < 0.0004 * n * (n - 1) / 2
    for (_, a), (_, b) in zip(people[:50], people[n:]):
        assert (min(a, b), max(a, b)) in pairs


def test_bits_count_what_keys_share():
    count = lambda a, b, uses: sum((x & y).bit_count() for x, y in zip(a[:uses], b[:uses])) + min(a[uses], b[uses])
    for a, b, shared in (("aab c", "abb c", 4), ("aaaaaa", "aaaaab", 5), ("", "a", 0), ("Zz", "zZ", 2)):
        x, y = identity._letters(a), identity._letters(b)
        assert len(set(x) & set(y)) == shared == count(identity._bits(x, 3), identity._bits(y, 3), 3)


def test_universe(spark, rows):
    tech = spark.createDataFrame(
        [("p", "ann", 0, 1), ("p", "none", 0, 1), ("p", "bot", 1, 1), ("p", "doc", 0, 0), ("q", "only", 0, 1), ("p", None, 0, 1)],
        "project string, sender string, is_bot int, is_coding int")
    social = spark.createDataFrame([("p", "bob", 0), ("r", "x", 0)], "project string, sender string, is_bot int")
    assert rows(identity.person_universe(tech, social)) == [("p", "ann"), ("p", "bob")]
