"""Neighbours by the pruned graph against all inner products."""

import math

import numpy as np
import pytest

from kinweave.llm import QUERIES, graph_index, neighbours


def exact(ids, vectors, q, k):
    score = vectors @ vectors[q]
    order = sorted((-s, i) for s, i in zip(score, ids) if i != ids[q])
    return [(i, -s) for s, i in order[:k]]


def recall(got, ids, vectors, queries, k):
    hits = total = 0
    for q in queries:
        want = exact(ids, vectors, q, k)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == ids[q])
        assert [r for r, *_ in mine] == list(range(1, len(want) + 1))
        assert [s for *_, s in mine] == sorted((s for *_, s in mine), reverse=True)
        for _, i, s in mine:
            assert s == pytest.approx(vectors[ids.index(i)] @ vectors[q], abs=1e-12) and i != ids[q]
        hits += len({i for _, i, _ in mine} & {i for i, _ in want})
        total += len(want)
    return hits / total


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")


def test_query_finds_the_nearest(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    got = QUERIES["op12_neighbours"](spark, sf).collect()
    queries = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert {r["query_id"] for r in got} == {ids[q] for q in queries}
    assert recall(got, ids, vectors, queries, 20) >= 0.98


@pytest.mark.parametrize("shape", ["even", "norms", "groups"])
def test_recall_with_a_small_beam(spark, shape):
    """Shards much larger than the beam: unit vectors, vectors of all lengths, dense groups of half the rows."""
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(3000, 24))
    if shape == "norms":
        vectors *= draw.lognormal(0, 0.3, size=(3000, 1))
    if shape == "groups":
        vectors[:1000] = vectors[0] + 0.01 * draw.normal(size=(1000, 24))
        vectors[1000:1500] = vectors[1000] + 0.3 * draw.normal(size=(500, 24))
    if shape != "norms":
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = list(range(3000))
    rows = frame(spark, ids, vectors)
    index = neighbours.build_index(rows, k=10, shard_rows=1500)
    assert {r["shard"]: r["count"] for r in index.groupBy("shard").count().collect()}.keys() == {0, 1}
    got = neighbours.search(index, rows.where("vec_id % 50 = 0"), k=10, beam=80, block_rows=25).collect()
    assert recall(got, ids, vectors, range(0, 3000, 50), 10) >= 0.9


def test_graph_is_pruned_and_directed():
    draw = np.random.default_rng(6)
    points = draw.normal(size=(700, 6)).astype(np.float32)
    graph = graph_index.build(points, degree=12, beam=30)
    assert graph.edges.shape == (700, 12) and (graph.edges != graph_index.NONE).any(axis=1).all()
    for node in (0, 99, 400):
        near = graph.edges[node][graph.edges[node] != graph_index.NONE]
        assert node not in near and len(set(near)) == len(near)
    candidates = np.arange(1, 300, dtype=np.int32)[None, :]
    kept = graph_index.robust_prune(points, np.array([0]), candidates, 20)[0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    want, alive = [], sorted(range(1, 300), key=lambda c: far[c])
    while alive and len(want) < 20:
        best = alive.pop(0)
        want.append(best)
        alive = [c for c in alive if graph_index.RELAXED * ((points[c] - points[best]) ** 2).sum() > far[c]]
    assert [c for c in kept if c != graph_index.NONE] == want
    ids, _ = graph_index.beam_search(graph, points[:50], 60)
    top = [set(np.argsort(((points - p) ** 2).sum(axis=1))[:10]) for p in points[:50]]
    assert np.mean([len(t & set(i[:10])) / 10 for t, i in zip(top, ids)]) > 0.95


def test_copies_and_ties(spark):
    """One vector holds a third of the rows: its smallest ids come first, the query's own is left out."""
    base = np.eye(4)
    rows = [(i, base[0]) for i in range(300)] + [(300 + i, base[1] + i * 1e-3 * base[2]) for i in range(600)]
    df = frame(spark, *zip(*rows)).repartition(5)
    index = neighbours.build_index(df.unionByName(df.limit(50)), k=7, shard_rows=200)
    got = neighbours.search(index, df.where("vec_id in (2, 100, 450)"), k=7).collect()
    of = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (2, 100, 450)}
    assert of[2] == [(i, 1.0) for i in (0, 1, 3, 4, 5, 6, 7)]
    assert of[100] == [(i, 1.0) for i in range(7)]
    assert [i for i, _ in of[450]] == [899, 898, 897, 896, 895, 894, 893]


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.5, 0.5], None), (3, None, "b"), (4, [0.0, 0.0], "c"), (5, [math.nan, 1.0], "d"),
            (6, [None, 1.0], "e"), (7, [math.inf, 1.0], "f"), (8, [], "g"), (None, [1.0, 1.0], "h"), (9, [1.0, 2.0, 3.0], "i"),
            (1, [1.0, 0.0], "a"), (10, [-0.0, 1e300], "j"), (11, [1e-300, 0.0], "k")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    index = neighbours.build_index(df)
    got = {}
    for r in neighbours.search(index, df).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {1: [2, 11, 10], 2: [10, 1, 11], 10: [2, 1, 11], 11: [1, 2, 10]}
    none = df.where("false")
    assert neighbours.search(neighbours.build_index(none), none).count() == 0
    assert neighbours.search(index, none).count() == 0
