"""Tests of the fifth round's changes: searches, trees and simulated clouds in less time, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import density, graph, neighbors, nulls


def _cloud(kind: str) -> np.ndarray:
    r = np.random.default_rng(5)
    if kind == "far groups":
        return np.concatenate([r.normal(size=(400, 3)) + 40 * g for g in range(4)])
    if kind == "copies":
        return np.concatenate([r.normal(size=(600, 3)), np.repeat(r.normal(size=(3, 3)) + 9, 40, axis=0)])
    if kind == "grid":
        return np.stack(np.meshgrid(*[np.arange(11.0)] * 3), axis=-1).reshape(-1, 3)
    return r.standard_exponential((1500, 6))


def _prim(z: np.ndarray) -> list[float]:
    best, outside, out = ((z - z[0]) ** 2).sum(axis=1), np.arange(len(z)) > 0, []
    while outside.any():
        j = int(np.where(outside, best, np.inf).argmin())
        outside[j] = False
        out.append(best[j])
        best = np.minimum(best, ((z - z[j]) ** 2).sum(axis=1))
    return sorted(np.sqrt(out) + 1e-9)


@pytest.mark.parametrize("kind", ["far groups", "copies", "grid", "smooth"])
def test_trees_of_simulated_clouds_are_whole(kind):
    z = _cloud(kind)
    edges = nulls.tree_edges(z)
    root = list(range(len(z)))

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for _, u, v in edges:
        assert top(u) != top(v)
        root[top(u)] = top(v)
    assert len(edges) == len(z) - 1 and np.allclose(sorted(w for w, _, _ in edges), _prim(z))
    near, radius = nulls.nearest(z, 15)
    d = np.sort(neighbors.square(z, z), axis=1)
    assert np.allclose(radius, d[:, 15] + 1e-9) and np.allclose(np.sort(np.linalg.norm(z[near] - z[:, None], axis=2)), d[:, :16])


def test_simulated_clouds_look_at_a_part_of_the_pairs(monkeypatch):
    """In few dimensions only cells in reach are multiplied; before, each point's distances to all others were made twice."""
    pairs = []
    whole = np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, **out: pairs.append(len(a) * b.shape[1]) or whole(a, b, **out))
    z = np.random.default_rng(1).random((20_000, 3))
    assert nulls.largest_gap(z) > 0 and sum(pairs) < 0.4 * len(z) ** 2


@pytest.mark.parametrize("kind", ["far groups", "copies", "grid", "smooth"])
def test_searches_multiply_in_single_precision_and_miss_nothing(kind, monkeypatch):
    z = _cloud(kind)
    seen = []
    whole = np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, **out: seen.append(a.dtype) or whole(a, b, **out))
    a, b = z[::2], z[1::2]
    i, j, d = neighbors.closest(a, b, 7)
    far = neighbors.square(a, b)
    order = np.argsort(far, axis=1, kind="stable")[:, :7]
    assert (j.reshape(-1, 7) == order).all() and (d.reshape(-1, 7) == np.take_along_axis(far, order, 1)).all()
    assert seen and set(seen) == {np.dtype(np.float32)}


@pytest.mark.parametrize("kind", ["far groups", "copies", "grid"])
def test_trees_come_from_neighbour_lists(spark, kind, monkeypatch):
    """No tree for each pair of blocks, whose number and edges grew with the square of the points; far groups and copies need searches of their own."""
    monkeypatch.setattr(graph, "block_trees", lambda *_: pytest.fail("trees of block pairs"))
    z = _cloud(kind)[::3]
    cloud = spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(z)], "set_id string, id long, z array<double>")
    got = [(r.w, r.u, r.v) for r in graph.minimum_spanning_tree(cloud, block=100).collect()]
    d = neighbors.square(z, z) + neighbors.OFFSET
    pairs = sorted((d[u, v], u, v) for u in range(len(z)) for v in range(u + 1, len(z)))
    root, want = list(range(len(z))), []
    for w, u, v in pairs:
        if root[u] != root[v]:
            want.append((w, u, v))
            old, new = root[v], root[u]
            root = [new if r == old else r for r in root]
    assert sorted(got) == want


def test_a_point_at_no_distance_ends_the_tree(spark):
    z = [[float(i), 0.0] for i in range(40)] + [[float("inf"), 0.0]]
    cloud = spark.createDataFrame([("s", i, x) for i, x in enumerate(z)], "set_id string, id long, z array<double>")
    assert sorted((r.u, r.v) for r in graph.minimum_spanning_tree(cloud, block=10).collect()) == [(i, i + 1) for i in range(39)]


def test_modes_of_few_sets_are_sought_in_a_task_each(spark):
    """Ten sets are few bytes and much work; before, all were in one task."""
    z = np.random.default_rng(2).normal(size=(10, 60, 2))
    rows = [(f"s{s}", i, x.tolist()) for s, part in enumerate(z) for i, x in enumerate(part)]
    cloud = spark.createDataFrame(rows, "set_id string, id long, z array<double>")
    sets = cloud.select("set_id").distinct()
    placed = density._by_set(cloud, sets).applyInPandas(lambda rows: rows[["set_id"]].head(1), "set_id string").select("set_id", F.spark_partition_id().alias("p")).collect()
    assert len(placed) == 10 and len({r.p for r in placed}) >= 5
    widths = cloud.select("set_id", F.lit(0.3).alias("h")).distinct()
    got = {r.set_id: r.many for r in density._many_modes(cloud, widths, sets).collect()}
    assert got == {f"s{s}": density.modes(part, 0.3) for s, part in enumerate(z)}


def test_kernel_means_are_those_of_all_pairs():
    r = np.random.default_rng(3)
    z, ends = r.normal(size=(700, 2)) + 5, np.concatenate([r.normal(size=(90, 2)) + 5, [[60.0, -40.0]]])
    for h in (0.02, 0.4, 3.0):
        power = -((ends[:, None] - z[None]) ** 2).sum(axis=2) / (2 * h * h)
        weight = np.exp(power - power.max(axis=1, keepdims=True))
        assert np.allclose(density.kernel_means(ends, z, h), weight @ z / weight.sum(axis=1, keepdims=True), atol=1e-7)
        assert np.allclose(density.partial_sums(ends, z, h)[0], power.max(axis=1))
