"""Searches and joins with triangle bounds against numpy's scan of everything, and how much of it they read."""

import numpy as np
import pytest

from tidemark.operators import metric


def clustered(seed, clusters, per, dim=16, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    v = np.repeat(centres, per, 0) + spread * rng.standard_normal((clusters * per, dim))
    v[1], v[2] = v[0], v[0] * 3  # equal directions
    return v


def table(spark, v, **more):
    rows = [(k, [float(x) for x in u], *[f[k] for f in more.values()]) for k, u in enumerate(v)]
    odd = [(len(v), None, *[None] * len(more)), (len(v) + 1, [0.0] * v.shape[1], *[0] * len(more)), (len(v) + 2, [1.0], *[0] * len(more))]
    return spark.createDataFrame(rows + odd, ", ".join(["id long, vector array<double>", *[f"{c} int" for c in more]])).repartition(4)


def cosines(v):
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    return np.round(unit @ unit.T, 9)


@pytest.mark.parametrize(("clusters", "per"), [(40, 30), (1, 60)])
def test_nearest_is_the_scan_and_reads_less(spark, tmp_path, clusters, per):
    v = clustered(1, clusters, per)
    index = metric.VectorIndex.write(table(spark, v), str(tmp_path / "i"), most=64)
    near = cosines(v)
    for q in (0, 7, len(v) - 1):
        got, told = index.nearest(v[q], 10)
        want = sorted(range(len(v)), key=lambda i: (-near[q, i], i))[:10]
        assert [r["id"] for r in got.collect()] == want
        assert told["rows"] == len(v) and (clusters == 1 or told["read"] < len(v) // 4 and told["cells_read"] < told["cells"] // 2)
    got, _ = index.nearest(np.ones(16), 5000)
    assert got.count() == len(v)


def test_nearest_of_vectors_that_are_spread_evenly(spark, tmp_path):
    """Little can be left out; the rows are the same."""
    v = np.random.default_rng(2).standard_normal((300, 32))
    index = metric.VectorIndex.write(table(spark, v), str(tmp_path / "i"), most=16)
    near = cosines(v)
    assert [r["id"] for r in index.nearest(v[5], 20)[0].collect()] == sorted(range(300), key=lambda i: (-near[5, i], i))[:20]


def test_nothing_to_search(spark, tmp_path):
    none = spark.createDataFrame([], "id long, vector array<double>")
    index = metric.VectorIndex.write(none, str(tmp_path / "i"))
    assert index.nearest([1.0, 2.0], 3)[0].collect() == []
    some = metric.VectorIndex.write(spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>"), str(tmp_path / "j"))
    assert some.nearest([0.0, 0.0], 3)[0].collect() == [] and some.nearest([1.0], 3)[0].collect() == []
    assert metric.near_pairs(none, 0.9)[0].collect() == []


@pytest.mark.parametrize(("threshold", "most", "block"), [(0.9, 64, 2048), (0.97, 40, 8), (0.35, 10, 16)])
def test_pairs_are_those_of_all_products(spark, monkeypatch, threshold, most, block):
    monkeypatch.setattr(metric, "BLOCK_ROWS", block)
    v = clustered(3, 30, 12)
    side = [k % 2 for k in range(len(v))]
    near = cosines(v)
    for by in ((), ("side",)):
        want = {(i, j): near[i, j] for i in range(len(v)) for j in range(i + 1, len(v)) if near[i, j] >= threshold and (not by or side[i] == side[j])}
        found, told = metric.near_pairs(table(spark, v, side=side), threshold, by, most)
        got = found.collect()
        assert len(got) == len(want) and {(r["id_a"], r["id_b"]): r["cosine"] for r in got} == pytest.approx(want, abs=1e-8)
        assert threshold < 0.9 or told["products"] < told["all"] / 4


def test_one_cell_with_many_equal_vectors_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(metric, "BLOCK_ROWS", 10)
    v = np.ones((45, 3))
    found, _ = metric.near_pairs(table(spark, v), 0.99, most=4)
    assert found.distinct().count() == found.count() == 45 * 44 // 2
