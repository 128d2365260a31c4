"""Tests of the seventh round's changes to searches: by streams, in order of place, and parts without points asked for."""

import numpy as np
import pandas as pd
import pytest

from lacuna.operators import geometry, graph, neighbors


def _points(spark, z):
    return spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(z)], "set_id string, id long, z array<double>")


@pytest.mark.parametrize("d", [2, 7])
def test_searches_pass_on_only_the_result(spark, d, monkeypatch):
    """Before, each pair of blocks passed k rows a point on, which were ranked after."""
    monkeypatch.setattr(neighbors, "block_pairs", lambda *_, **__: pytest.fail("pairs of blocks"))
    monkeypatch.setattr(neighbors, "LEAF", 16)
    z = np.random.default_rng(d).normal(size=(500, d)).round(1)
    z[:60] = z[0]
    away = neighbors.square(z, z)
    np.fill_diagonal(away, np.inf)
    near = np.argsort(away, axis=1, kind="stable")[:, :9]
    want = {(i, r + 1): (j, away[i, j]) for i, row in enumerate(near.tolist()) for r, j in enumerate(row)}
    assert {(r.i, r.rank): (r.j, r.d) for r in neighbors.knn(_points(spark, z), 9, 90).collect()} == want


def test_few_dimensions_are_searched_in_order_of_place(monkeypatch):
    """Before, every pair of points was looked at; now work grows with the points."""
    seen, real = [], neighbors.few_true
    monkeypatch.setattr(neighbors, "few_true", lambda near, *rest: seen.append(near.size) or real(near, *rest))
    z = np.random.default_rng(2).normal(size=(20000, 2))
    search = neighbors.Nearest(np.arange(20000), z, 1, True)
    order = neighbors.by_place(z, neighbors.LEAF)
    search.see(order, z[order])
    assert sum(seen) < 20000**2 / 8
    some = search.found().head(300)
    away = neighbors.square(z[:300], z)
    away[np.arange(300), np.arange(300)] = np.inf
    assert some["j"].tolist() == away.argmin(axis=1).tolist() and some["d"].tolist() == away.min(axis=1).tolist()


def test_points_drawn_for_hopkins_are_searched_by_streams(spark, monkeypatch):
    """Before, drawn points met the set's in all pairs of blocks."""
    monkeypatch.setattr(neighbors, "block_pairs", lambda *_, **__: pytest.fail("pairs of blocks"))
    monkeypatch.setattr(geometry, "block_pairs", neighbors.block_pairs, raising=False)
    z = np.random.default_rng(3).random((600, 2))
    assert 0.4 < geometry.hopkins_test(_points(spark, z), repeats=5).first().hopkins < 0.6


def test_all_pairs_come_once_and_without_pairs_of_blocks(spark, monkeypatch):
    """Before, a point travelled to all blocks of 1024, twice, and half of the distances were thrown away."""
    monkeypatch.setattr(neighbors, "block_pairs", lambda *_, **__: pytest.fail("pairs of blocks"))
    z = np.random.default_rng(4).normal(size=(150, 3))
    away = neighbors.square(z, z)
    for block in (150, 40, 25):  # 1, 4 and 6 parts
        found = [(r.i, r.j, r.d) for r in neighbors.pairwise(_points(spark, z), block).collect()]
        assert sorted(found) == [(i, j, away[i, j]) for i in range(150) for j in range(i + 1, 150)]


def test_a_block_without_points_asked_for_has_no_edges():
    """Before, it was an error, by which trees by label failed where a block had none."""
    rows = pd.DataFrame({"id": [1, 2], "z": [[0.0, 1.0], [1.0, 0.0]], "comp": [1, 2], "asked": [0, 0]})
    assert not len(graph.outward(rows, rows))
