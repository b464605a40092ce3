"""The paths taken by hot keys and large groups give the same rows as the plain ones."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.operators import cleaning, features, ordering, skew, statistics
from kinweave.operators.components import connected_components


@pytest.mark.parametrize("hot_rows", [0, 50, 10**6])
def test_lookup(spark, rows, hot_rows):
    data = [("hot", i) for i in range(400)] + [(f"k{i % 30}", i) for i in range(300)] + [("lost", 1), (None, 2)]
    big = spark.createDataFrame(data, "k string, v int")
    table = big.where("k <> 'lost'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    want = sorted(
        ((k, v, {"hot": 399}.get(k, max([x for y, x in data if y == k])) if k not in ("lost", None) else None) for k, v in data),
        key=repr)
    assert rows(skew.lookup(big, table, ["k"], "n", hot_rows)) == want


def test_ordered_slices(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", rng.randrange(50), i, rng.randrange(9)) for i in range(600)]
    df = spark.createDataFrame(data, "g string, t int, id int, v long")
    pdf = pd.DataFrame(data, columns=["g", "t", "id", "v"]).sort_values(["g", "t", "id"])
    pdf["rank"] = pdf.groupby("g").cumcount() + 1
    pdf["before"] = pdf.groupby("g")["id"].shift(1)
    pdf["run"] = pdf.groupby("g")["v"].cumsum()
    by_id = pdf.set_index("id")
    for r in ordering.row_numbers(df, ["g"], ["t", "id"], slices=9).collect():
        assert r["rank"] == by_id.loc[r["id"], "rank"]
    for r in ordering.previous(df, ["g"], ["t", "id"], "id", "before", slices=9).collect():
        want = by_id.loc[r["id"], "before"]
        assert r["before"] == (None if pd.isna(want) else want)
    for r in ordering.running_sum(df, ["g"], ["t", "id"], "v", "run", slices=9).collect():
        assert r["run"] == by_id.loc[r["id"], "run"]
    whole = ordering.row_numbers(df, [], ["id"], slices=5)
    assert whole.where(F.col("rank") != F.col("id") + 1).count() == 0


def random_graphs(rng):
    data = []
    for g in range(6):
        n = rng.randrange(2, 40)
        names = [f"n{i:03d}" for i in range(n)]
        data += [(g, a, a) for a in names]
        data += [(g, *rng.sample(names, 2)) for _ in range(rng.randrange(n + 1))]
    chain = [f"c{i:03d}" for i in range(90)]
    data += [(99, a, b) for a, b in zip(chain, chain[1:])]
    data += [(98, "hub", f"s{i:03d}") for i in range(120)]
    return data


def brute(data):
    label = {}
    for g, a, b in data:
        label.setdefault((g, a), a)
        label.setdefault((g, b), b)
    changed = True
    while changed:
        changed = False
        for g, a, b in data:
            low = min(label[g, a], label[g, b])
            for x in (a, b):
                if label[g, x] != low:
                    label[g, x] = low
                    changed = True
    return sorted((g, n, c) for (g, n), c in label.items())


@pytest.mark.parametrize("small,hot_rows", [(10**6, 10**6), (0, 10**6), (30, 20)])
def test_components(spark, small, hot_rows):
    data = random_graphs(random.Random(3))
    df = spark.createDataFrame(data, "g int, src string, dst string")
    got = connected_components(df, ["g"], small, hot_rows)
    assert sorted((r["g"], r["node"], r["component"]) for r in got.collect()) == brute(data)


def test_triangles(spark):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(18)]
    links = {tuple(sorted(rng.sample(names, 2))) for _ in range(50)} | {("hub", n) if "hub" < n else (n, "hub") for n in names}
    data = [("p", 0, a, b, 1) for a, b in links] + [("p", 0, b, a, 1) for a, b in links]
    df = spark.createDataFrame(data, "project string, month int, src string, dst string, weight long")
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {n: sum(1 for a in near[n] for b in near[n] if a < b and b in near[a]) for n in near}
    for hot in (3, 10**6):
        got = {r["node"]: (r["degree"], r["triangles"]) for r in features.node_triangles(df, hot).collect()}
        assert got == {n: (len(near[n]), t) for n, t in want.items()}


def test_a_dense_month_makes_no_row_per_triangle(spark):
    """A clique of 900 people has 121 million triangles; the tasks pass on sums only."""
    n = 900
    names = spark.range(n).select(F.format_string("n%04d", "id").alias("src"))
    pairs = names.join(names.withColumnRenamed("src", "dst"), F.col("src") != F.col("dst"))
    df = pairs.select(F.lit("p").alias("project"), F.lit(3).alias("month"), "src", "dst", F.lit(1).cast("long").alias("weight"))
    df = df.unionByName(spark.createDataFrame([("q", 3, "a", "b", 1), ("q", 3, "b", "a", 1)], df.schema))
    got = features.node_triangles(df).groupBy("project", "degree", "triangles").count().collect()
    assert {tuple(r) for r in got} == {("p", n - 1, (n - 1) * (n - 2) // 2, n), ("q", 1, 0, 2)}
    plan = features.node_triangles(df)._jdf.queryExecution().toString()
    assert "array_intersect" not in plan and "explode" not in plan.split("MapInArrow")[0]


def test_exact_quantiles(spark):
    rng = random.Random(7)
    data = [(rng.choice([0.0, 1.0, rng.random()]), float(rng.randrange(4))) for _ in range(301)]
    df = spark.createDataFrame(data, "a double, b double")
    pdf = pd.DataFrame(data, columns=["a", "b"])
    for r in statistics.exact_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.95, 1.0]).collect():
        assert r["value"] == pytest.approx(pdf[r["feature"]].quantile(r["prob"]))


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_of_brackets(spark, accuracy):
    """Groups of one row to thousands; ties, nulls, constants; few values are looked at one by one."""
    rng = random.Random(3)
    data = [(g, rng.choice([None, 1.0, rng.random(), float(rng.randrange(5))]), 7.0, None) for g, n in (("a", 1), ("b", 2), ("c", 37), ("d", 4000))
            for _ in range(n)]
    df = spark.createDataFrame(data, "g string, x double, y double, z double")
    pdf = pd.DataFrame(data, columns=["g", "x", "y", "z"]).astype({"x": float, "z": float})
    probs = [0.0, 0.03, 0.25, 0.5, 0.95, 1.0]
    got = {(r["g"], r["feature"], r["prob"]): r["value"] for r in statistics.exact_quantiles(df, ["x", "y", "z"], probs, ["g"], accuracy).collect()}
    want = {(g, c, p): part[c].quantile(p) for g, part in pdf.groupby("g") for c in "xy" for p in probs if part[c].notna().any()}
    assert got == pytest.approx(want)
    got = {(r["feature"], r["prob"]): r["value"] for r in statistics.exact_quantiles(df, ["x", "y", "z"], probs, accuracy=accuracy).collect()}
    assert got == pytest.approx({(c, p): pdf[c].quantile(p) for c in "xy" for p in probs})


def test_hot_thread(spark):
    """One thread holds nearly all messages, many at the same time."""
    data = [("p", "main", i // 40, f"<{i:05d}>") for i in range(500)] + [("p", "side", 1, "<x>"), ("q", None, 1, "<y>"), ("q", None, 2, "<z>")]
    df = spark.createDataFrame(data, "project string, subject string, t int, message_id string").withColumn(
        "ts", F.timestamp_seconds("t")).withColumn("month", F.lit(0))
    got = {r["message_id"]: r["in_reply_to"] for r in cleaning.infer_replies(df, guarded=False).collect()}
    for i in range(1, 500):
        assert got[f"<{i:05d}>"] == f"<{i - 1:05d}>"
    assert got["<00000>"] is None and got["<x>"] is None and got["<z>"] is None
