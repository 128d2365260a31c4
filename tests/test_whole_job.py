"""The registered queries do the whole job of their operators."""

import numpy as np
import pytest

from lacuna import catalog
from lacuna.operators import clusters, sequence
from lacuna.operators import gate as gates


@pytest.mark.parametrize("name", ["gate", "gate_many_sets", "gate_known_clusters"])
def test_gates_use_the_full_calibration(spark, sf, name, monkeypatch):
    seen = {}

    def spy(session, cells, n_null, *rest):
        seen.update(cells=cells, n_null=n_null)
        return made(session, cells, 5, *rest)

    made = gates.null_table
    monkeypatch.setattr(gates, "null_table", spy)
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert seen["n_null"] == 200 and rows
    if name == "gate_many_sets":
        assert all(r.d_hat > 10 for r in rows) and {d for _, d in seen["cells"]} == {10}
    if name == "gate_known_clusters":
        n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
        assert {m for m, _ in seen["cells"]} == {n} == {r.n for r in rows}


def test_null_table_has_all_replicates(spark, sf):
    counts = catalog.QUERIES["null_table"](spark, sf).groupBy("n", "dim", "shape").count().collect()
    assert len(counts) == 6 and {r["count"] for r in counts} == {200}


def test_one_gaussian_is_one_cluster(spark):
    z = np.random.default_rng(3).normal(size=(300, 2)) @ np.array([[2.0, 0.5], [0.0, 1.0]])
    found, tried = clusters.mixture_by_bic(spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(z)], "set_id string, id long, z array<double>"), most=3)
    c = z - z.mean(axis=0)
    s = c.T @ c / 300
    log_p = -0.5 * (np.einsum("ij,jk,ik->i", c, np.linalg.inv(s), c) + np.log(np.linalg.det(s)) + 2 * np.log(2 * np.pi))
    assert [k for k, _ in tried] == [1, 2, 3] and np.isclose(tried[0][1], -2 * log_p.sum() + 5 * np.log(300))
    assert {r.cluster for r in found.collect()} == {0} and found.count() == 300


def test_mixture_query_searches_all_of_ten_components(spark, sf, monkeypatch):
    seen = {}

    def spy(cloud, most=15, seed=0):
        seen.update(most=most, d=cloud.selectExpr("size(z) d").first().d)
        return cloud, []

    monkeypatch.setattr(clusters, "mixture_by_bic", spy)
    catalog.QUERIES["gmm_bic"](spark, sf)
    assert seen == {"most": 15, "d": 10}


def test_context_query_tests_all_variables(spark, sf):
    rows = catalog.QUERIES["context_tests"](spark, sf).collect()
    assert {r["var"] for r in rows} == {"run_pos", "prev", "pos_bin", "recording"}
    assert all(np.isclose(r.p_bonf, min(1.0, r.p * len(rows))) for r in rows)


def test_quartiles_in_pieces(spark):
    df = spark.createDataFrame([(k * 7 % 23, k) for k in range(50)], "ts int, event_id int")
    whole = sequence.rank_quartile(df, [], ["ts", "event_id"])
    pieces = sequence.rank_quartile(df, [], ["ts", "event_id"], piece=(df.ts / 5).cast("int"))
    assert pieces.columns == whole.columns and sorted(pieces.collect()) == sorted(whole.collect())
