"""Whitening against numpy's decompositions and exact whole numbers."""

import math

import numpy as np
import pytest

from kinweave.llm import QUERIES, whitening


def matrices():
    draw = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        b = draw.normal(size=(n, 2 * n))
        yield f"random {n}", b @ b.T
    yield "identity", np.eye(10)
    yield "blocks", np.diag([5.0, 5, 5, 1, 1, 0, 0])
    yield "rank one", np.ones((20, 20))
    b = draw.normal(size=(30, 5))
    yield "rank five", b @ b.T
    q, _ = np.linalg.qr(draw.normal(size=(64, 64)))
    yield "two values", q * np.r_[np.full(40, 3.0), np.ones(24)] @ q.T
    yield "pairs almost equal", np.diag(np.abs(np.arange(21) - 10.0)) + np.eye(21, k=1) + np.eye(21, k=-1)
    yield "zero", np.zeros((4, 4))
    yield "small", b @ b.T * 1e-200


@pytest.mark.parametrize("name, a", matrices(), ids=lambda x: x if isinstance(x, str) else "")
def test_leading_components(name, a):
    k = min(32, len(a))
    values, vectors = whitening.leading_components(a, k)
    scale = max(np.abs(a).max(), np.finfo(float).tiny)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-12 * scale * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale * len(a)


def test_sturm_counts():
    diag, off = np.array([2.0, -1, 3, 0]), np.array([1.0, 0, 2])
    t = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
    at = np.linspace(-4, 6, 41) + 0.013
    assert whitening.sturm_counts(diag, off, at).tolist() == [(np.linalg.eigvalsh(t) < x).sum() for x in at]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.floor(64 * np.array([r["embedding"] for r in rows], float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = centred @ vectors / np.sqrt(values)
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op13_whitening"](spark, sf).collect()}
    assert len(got) == 32 * n
    mine = np.array([[got[i, k + 1]["whitened"] for k in range(32)] for i in ids])
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-9
    for row, i in enumerate(ids):
        r = got[i, 5]
        assert r["n"] == n and r["deviation"] == sum(int(v) ** 2 for v in n * x[row] - sums)
        assert r["explained"] == pytest.approx(values[4] / np.trace(centred.T @ centred / n), rel=1e-10)
    assert {r["identity_error"] for r in got.values()} == {r["identity_error"]} and r["identity_error"] < 1e-12


def test_large_deviations_are_exact(spark):
    model = whitening.Whitening(2, 3_000_000_000, np.array([3, 4]), np.array([2.0]), np.array([[1.0], [0.0]]), 2.0)
    df = spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<double>")
    r = whitening.whiten(df, model).first()
    assert int(r["deviation"]) == sum((3_000_000_000 * x - s) ** 2 for x, s in ((1_000_032, 3), (1_000_016, 4)))


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.5, 0.5], None), (3, None, "b"), (4, [0.0, 0.0], "c"), (5, [math.nan, 1.0], "d"),
            (6, [None, 1.0], "e"), (7, [-math.inf, 1.0], "f"), (8, [], "g"), (None, [1.0, 1.0], "h"), (9, [1.0, 2.0, 3.0], "i"), (1, [1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, deviation string")
    model = whitening.fit(df)
    assert (model.dim, model.n, len(model.values)) == (2, 5, 2) and model.error < 1e-12
    got = whitening.whiten(df, model).collect()
    assert sorted((r["vec_id"] for r in got), key=str) == [1, 1, 2, 4, None]
    assert {len(r["whitened"]) for r in got} == {2}
    flat = df.where("vec_id = 1")
    assert whitening.fit(flat).values.tolist() == [] and whitening.whiten(flat, whitening.fit(flat)).first()["whitened"] == []
    none = df.where("false")
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    with pytest.raises(Exception, match="or more"):
        whitening.fit(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))
