"""Whitening against numpy's eigenvectors of the covariance that is formed in whole."""

import math

import numpy as np
import pytest

from tidemark.llm import whiten


def plain(vectors, components=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    off = n * x - s
    c = off.astype(float) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, (off**2).sum(1), c @ u / np.sqrt(e), e / np.trace(v)


def held(got, ids, vectors, gap=1e-7):
    n, deviation, white, explained = plain(vectors)
    table = {(r["vec_id"], r["component"]): r for r in got.collect()}
    k = white.shape[1]
    assert len(table) == n * k
    for j in range(k):
        own = np.array([table[i, j + 1]["whitened"] for i in ids])
        assert np.abs(own - white[:, j] * np.sign(own @ white[:, j])).max() < gap
        assert abs(table[ids[0], j + 1]["explained"] / explained[j] - 1) < 1e-9
    for a, i in enumerate(ids):
        assert table[i, 1]["n"] == n and table[i, 1]["deviation"] == deviation[a]
    assert {r["identity_error"] for r in table.values()} == {table[ids[0], 1]["identity_error"]} and table[ids[0], 1]["identity_error"] < 1e-9


def test_driver_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    have = sorted(rows.select("vec_id", "embedding").collect())
    held(whiten.whitened(rows), [r[0] for r in have], [r[1] for r in have])


@pytest.mark.parametrize(("size", "wanted", "block"), [(300, 32, 16), (64, 32, 4), (40, 40, 16), (5, 32, 16), (1, 1, 1)])
def test_pairs_of_known_matrices(size, wanted, block):
    """Subspaces that are far from the whole space, that reach it, and eigenvalues that repeat."""
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    values = np.sort(np.concatenate([np.geomspace(1e4, 1, size - size // 4), np.repeat(3.0, size // 4)]))[::-1]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    times = []
    e, u = whiten.eigenpairs(lambda w: times.append(w.shape[1]) or a @ w, size, wanted, block)
    k = min(size, wanted)
    assert np.allclose(e, values[:k], rtol=1e-10)
    assert np.linalg.norm(a @ u - u * e, axis=0).max() <= 2e-13 * values[0]
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12


def test_minres_solves_an_indefinite_system():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    a = (q * np.concatenate([-np.arange(1, 11), np.arange(1, 21)])) @ q.T
    b = np.column_stack([rng.standard_normal((30, 3)), np.zeros(30)])
    assert np.abs(a @ whiten.minres(lambda t: a @ t, b, 60, 1e-12) - b).max() < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(x) for x in v] for v in rng.standard_normal((40, 6))]
    rows = [(i, v, "x") for i, v in enumerate(good)]
    odd = [(100, None, "x"), (101, [], "x"), (102, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (103, [float("nan")] * 6, "x"), (104, [float("inf")] * 6, "x"), (105, [1.0, 2.0], "x")]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, whitened string").repartition(4)
    held(whiten.whitened(table), list(range(40)), good)


def test_no_variance_constant_dimensions_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, id string, vector string"
    assert whiten.whitened(spark.createDataFrame([], schema)).collect() == []
    assert whiten.whitened(spark.createDataFrame([(1, [1.0, 2.0], "a", "b")] * 3, schema)).collect() == []
    some = spark.createDataFrame([(None, [1.0, float(k % 5)], "a", "b") for k in range(20)], schema)
    got = whiten.whitened(some).collect()
    assert len(got) == 20 and {r["component"] for r in got} == {1} and abs(np.var([r["whitened"] for r in got]) - 1) < 1e-9


def test_deviations_of_any_size(spark):
    """What does not fit a long is null, and entries of any size neither overflow nor raise."""
    table = spark.createDataFrame([(k, [1e300 * (k % 2), float(k)]) for k in range(8)], "vec_id long, embedding array<double>")
    got = whiten.whitened(table).collect()
    assert {r["deviation"] for r in got} == {None} and all(math.isfinite(r["whitened"]) for r in got)
