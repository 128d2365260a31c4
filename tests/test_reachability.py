"""Core distances and trees over mutual reachability without lists of neighbours."""

import numpy as np
import pandas as pd
import pytest

from lacuna.operators import graph, neighbors, reachability


def _points(spark, z):
    return spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(z)], "set_id string, id long, z array<double>")


@pytest.mark.parametrize("kind", ["smooth", "copies"])
def test_core_distances_and_trees_come_without_lists(spark, kind, monkeypatch):
    """Before, a hundredth of all points was listed for each point and the tree was made from all pairs of blocks."""
    monkeypatch.setattr(reachability, "knn", lambda *_: pytest.fail("lists of neighbours"))
    monkeypatch.setattr(graph, "block_trees", lambda *_: pytest.fail("trees of block pairs"))
    monkeypatch.setattr(reachability, "SAMPLE", 200)
    r = np.random.default_rng(4)
    z = r.normal(size=(900, 3))
    z[450:] += 30
    if kind == "copies":
        z[:120] = z[0]
    k = 40
    cloud = _points(spark, z)
    core = reachability.core_distances(cloud, k).cache()
    want = np.sort(neighbors.square(z, z), axis=1)[:, k]
    assert {row.id: row.core for row in core.collect()} == dict(enumerate(want))
    got = {(row.w, row.u, row.v) for row in reachability.reachability_tree(cloud.join(core, ["set_id", "id"]), block=300).collect()}
    tree = graph.small_tree(pd.DataFrame({"id": range(len(z)), "z": list(z), "core": want}), "core")
    assert got == set(zip(tree["w"], tree["u"], tree["v"], strict=True))
