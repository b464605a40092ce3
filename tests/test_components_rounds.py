"""Rounds for large graphs against a brute force, one graph per call or many at once."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components, contract, star_rounds


def brute(edges):
    label = {n: n for e in edges for n in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            for n in (a, b):
                if label[n] != low:
                    label[n], moved = low, True
    return label


def found(df):
    got = [(r["node"], r["component"]) for r in df.collect()]
    assert len(got) == len({n for n, _ in got}), "a node came twice"
    return dict(got)


def test_known_path(spark):
    edges = [("1", "5"), ("2", "3"), ("3", "4"), ("4", "5")]
    df = spark.createDataFrame([("g", a, b) for a, b in edges], "g string, src string, dst string")
    assert found(connected_components(df, ["g"], small=0)) == brute(edges)


def test_paths_of_five_in_one_call(spark):
    rows, want = [], {}
    for k, names in enumerate(itertools.permutations("12345")):
        edges = list(zip(names, names[1:]))
        rows += [(k, a, b) for a, b in edges]
        want[k] = brute(edges)
    df = spark.createDataFrame(rows, "g long, src string, dst string")
    got = {}
    for r in star_rounds(df, ["g"]).collect():
        assert r["node"] not in got.setdefault(r["g"], {})
        got[r["g"]][r["node"]] = r["component"]
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_sparse_graph_alone(spark, seed):
    draw = random.Random(seed)
    n = 30
    edges = [(draw.randrange(n), draw.randrange(n)) for _ in range(n)]
    chain = draw.sample(range(100, 140), 40)
    edges += list(zip(chain, chain[1:]))
    df = spark.createDataFrame(edges, "src long, dst long")
    assert found(star_rounds(df, [])) == brute(edges)


@pytest.mark.parametrize("held", [4, 50, 10**6])
def test_tasks_pass_on_stars(spark, held):
    """Contracted in any number of steps, edges have the same components and no task passes on more rows than it has nodes."""
    draw = random.Random(7)
    rows = [(draw.choice("ab") if draw.random() < 0.95 else None, draw.randrange(3), f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, m int, src string, dst string").repartition(3)
    stars = contract(df, ["g", "m"], held).collect()
    for g, m in {r[:2] for r in rows}:
        mine = [(r["src"], r["dst"]) for r in stars if (r["g"], r["m"]) == (g, m)]
        assert brute(mine) == brute([r[2:] for r in rows if r[:2] == (g, m)])
        assert all(a >= b for a, b in mine)
    if held == 10**6:
        assert len(stars) <= 3 * len({(r[0], r[1], n) for r in rows for n in r[2:]})


def test_many_edges_of_one_graph_are_few_rows(spark):
    """Two million edges among 3000 people: what meets in the graph is a star per task."""
    n = spark.range(2_000_000)
    name = lambda seed: F.concat(F.lit("n"), (F.xxhash64("id", F.lit(seed)) % 1500).cast("string"))
    df = n.select(F.lit("p").alias("g"), name(1).alias("src"), name(2).alias("dst"))
    stars = contract(df, ["g"])
    assert stars.count() <= 4 * 3000
    got = connected_components(df, ["g"]).groupBy("component").count().collect()
    assert [tuple(r) for r in got] == [("n-1", 2999)]
