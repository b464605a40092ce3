"""Stars of tasks meet without rounds where nothing is left to do."""

import random

from pyspark.sql import functions as F

from kinweave.operators import components


def test_stars_go_through_no_rounds(spark, monkeypatch):
    """What tasks contracted to stars is written once, a row per node; only nodes linked twice go on."""
    chains = [("g", f"n{c}-{i}", f"n{c}-{i + 1}") for c in range(40) for i in range(20)]
    edges = spark.createDataFrame(chains, "g string, src string, dst string").coalesce(1)
    written = []
    settle = components.settle
    monkeypatch.setattr(components, "settle", lambda df: written.append(settle(df)) or written[-1])
    got = components.star_rounds(components.contract(edges, ["g"]), ["g"])
    assert got.count() == 40 * 21 and got.select("component").distinct().count() == 40
    assert sum(t.count() for t in written) == 40 * 21


def test_links_of_several_tasks_meet(spark):
    """Chains cut over tasks, with copies of links, loops and lone nodes, in three graphs."""
    draw = random.Random(3)
    rows = []
    for g in "abc":
        for c in range(15):
            names = [f"{draw.randrange(10**6)}-{c}-{i}" for i in range(12)]
            rows += [(g, x, y) for x, y in zip(names, names[1:])] + [(g, names[3], names[2]), (g, names[0], names[0])]
        rows.append((g, f"z{g}", f"z{g}"))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, src string, dst string").repartition(4)
    for edges in (df, components.contract(df, ["g"])):
        sizes = components.star_rounds(edges, ["g"], hot_rows=3).groupBy("g", "component").agg(
            F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).collect()
        assert sorted(r["n"] for r in sizes) == [1] * 3 + [12] * 45
        assert all(r["low"] == r["component"] for r in sizes)
