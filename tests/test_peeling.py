"""Large clusters of names, refined in rounds: the result of the plain order."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinweave.operators import identity, peeling

SCHEMA = "project string, cluster string, name string, key string"


def chained(rng, n, letters="abcdehilmnorst"):
    """Names one edit apart from an earlier one, some with several spellings of one key."""
    keys = ["maren holst"]
    while len(keys) < n:
        base = list(rng.choice(keys[-40:]))
        at = rng.randrange(len(base))
        if base[at] != " ":
            base[at:at + rng.choice([0, 1, 1])] = [rng.choice(letters)]
        key = "".join(base)
        if key not in keys and 4 < len(key) < 20:
            keys.append(key)
    return [(k if i == 0 else f"{k} {i}", k) for k in keys for i in range(rng.choice([1, 1, 1, 3]))]


def plain(cluster, least, sizes):
    got = identity._refine(pd.DataFrame(cluster, columns=["name", "key"]), least, sizes)
    return sorted(zip(got["name"], got["key"]))


@pytest.mark.parametrize("least, sizes, batch", [(0.9, (2, 5), 60), (0.8, (2, 1000), 40)])
def test_rounds_equal_the_plain_order(spark, least, sizes, batch):
    rng = random.Random(8)
    clusters = {c: chained(rng, n) for c, n in (("a", 130), ("b", 60), ("c", 7))}
    rows = [("p", c, n, k) for c, names in clusters.items() for n, k in names]
    got = peeling.refine_large(spark.createDataFrame(rows, SCHEMA), least, sizes, block=32, batch=batch)
    found = {c: sorted((r["name"], r["key"]) for r in got.where(F.col("cluster") == c).collect()) for c in clusters}
    assert found == {c: plain(names, least, sizes) for c, names in clusters.items()}


def test_ties_and_repeated_keys(spark):
    """Keys with nothing in common have equal sums: they leave by name, whatever the choice."""
    rows = [("p", "a", f"{c * 6} {i}", c * 6) for c in "bcdfghjklm" for i in range(5)]
    rows += [("p", "a", n, n) for n in ("john smithson", "john smithsom")]
    got = peeling.refine_large(spark.createDataFrame(rows, SCHEMA), 0.9, (2, 5), block=4, batch=8).collect()
    assert sorted((r["name"], r["key"]) for r in got) == plain([r[2:] for r in rows], 0.9, (2, 5))


def test_large_and_small_clusters_together(spark):
    rng = random.Random(3)
    clusters = {("p", "a"): chained(rng, 50), ("p", "b"): [("ann lee", "ann lee"), ("ann leee", "ann leee")], ("q", "a"): chained(rng, 5)}
    rows = spark.createDataFrame([(*c, n, k) for c, names in clusters.items() for n, k in names], SCHEMA)
    few = identity.refine_clusters(rows, 0.85, (2, 30), large=10)
    whole = identity.refine_clusters(rows, 0.85, (2, 30))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect())) != []
    assert identity.refine_clusters(rows.limit(0), large=0).count() == 0


def test_sums_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([("p", "a", n, k) for n, k in chained(rng, 80)], SCHEMA)
    cells = rows.groupBy("project", "cluster", "key").agg(F.collect_list("name").alias("left")).withColumn("total", F.lit(0).cast("long"))
    totals = [sorted((r["key"], r["total"]) for r in peeling._cells(peeling._with_totals(peeling._blocks(cells, size))).collect())
              for size in (5, 1000)]
    assert totals[0] == totals[1]
