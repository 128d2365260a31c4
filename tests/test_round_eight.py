"""Tests of the eighth round's changes: simulated clouds list few neighbours, and no more than are needed."""

import numpy as np
import pytest

from lacuna import queries_reports
from lacuna.operators import density, nulls, signal, synth
from lacuna.plans import detection


def _plain(z, k=15, min_group=10):
    """The largest gap from the k nearest of all points."""
    cloud = nulls._Cells(z)
    near, square = cloud.nearest(k)
    d2, u, v = cloud.tree(*nulls.listed(near, square))
    order = np.argsort(d2, kind="stable")
    w, u, v, radius = np.sqrt(d2[order]) + nulls.OFFSET, u[order], v[order], np.sqrt(square[:, -1]) + nulls.OFFSET
    large = np.flatnonzero(nulls.smaller_sides(u.tolist(), v.tolist(), len(z)) >= min_group)
    return max(w[e] / np.median(radius[np.union1d(near[u[e]], near[v[e]])]) for e in large)


@pytest.mark.parametrize("shape, dim", [("uniform", 1), ("gauss", 3), ("exponential", 5), ("gauss", 10)])
def test_large_simulated_clouds_have_the_same_gap(shape, dim):
    z = nulls.null_cloud(shape, 6000, dim, np.random.default_rng(dim))
    assert len(z) > nulls.WHOLE and nulls.largest_gap(z) == _plain(z)


def test_clouds_with_copies_and_far_groups_have_the_same_gap():
    r = np.random.default_rng(4)
    z = np.concatenate([r.random((2500, 4)), r.random((2500, 4)) * 1e-3 + 50, np.repeat(r.random((20, 4)) - 9, 20, axis=0)])
    assert len(z) > nulls.WHOLE and nulls.largest_gap(z) == _plain(z)


def test_simulated_clouds_of_ten_dimensions_look_at_a_part_of_the_pairs(monkeypatch):
    """Before, nearly every pair was multiplied for the 15 nearest of all points."""
    pairs, whole = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, **out: pairs.append(len(a) * b.shape[1]) or whole(a, b, **out))
    z = np.random.default_rng(1).standard_normal((20_000, 10))
    assert nulls.largest_gap(z) > 0 and sum(pairs) < 0.6 * len(z) ** 2


def test_clouds_are_dealt_evenly(spark):
    """Before, a hash dealt them, so that some tasks got several and others none."""
    nulls_ = nulls.null_table(spark, [(nulls.WHOLE + 1, 1)], 3)
    assert nulls_.rdd.getNumPartitions() == 9
    assert nulls_.rdd.glom().map(len).collect() == [1] * 9


def _lumpy(n, seed=0):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=(n - n // 4, 2)), r.normal(size=(n // 4, 2)) * 0.6 + [2.5, 0.5]])


@pytest.mark.parametrize("h", [0.15, 0.6, 2.0])
def test_means_from_a_table_are_those_of_all_points(h):
    z = _lumpy(1500)
    assert np.abs(density.MeanTable(z, h)(z) - density.kernel_means(z, z, h)).max() < 1e-8 * h


def test_critical_bandwidth_is_the_same_from_tables(monkeypatch):
    z = _lumpy(1000)
    found = density.critical_bandwidth(z)
    monkeypatch.setattr(density, "TABLED", 10**9)
    assert found == density.critical_bandwidth(z) and found > 0.1


def test_large_sets_in_the_plane_meet_no_pairs_of_points(spark, monkeypatch):
    """Before, sets of more than 4000 points went through rounds of jobs, and smaller ones weighed all their pairs in each round."""
    monkeypatch.setattr(density, "critical_bandwidths_in_blocks", lambda *_: pytest.fail("rounds of jobs"))
    monkeypatch.setattr(density, "kernel_means", lambda *_: pytest.fail("all pairs"))
    z = _lumpy(density.LARGEST + 100)
    assert density.critical_bandwidth(z) > 0.1
    cloud = spark.createDataFrame([("s", i, x) for i, x in enumerate(z.tolist())], "set_id string, id long, z array<double>")
    monkeypatch.setattr(density, "critical_bandwidth", lambda z: 0.9)
    out = density.peak_and_mode_tests(cloud, n_null=3).collect()
    assert len(out) == 1 and out[0].h_crit == 0.9 and 0 <= out[0].p_modes <= 1


@pytest.mark.parametrize("query", ["clean_calls", "aligned_spectra"])
def test_samples_stay_in_the_task_that_makes_them(spark, sf, query):
    """Before, each recording of 400 kB went to the JVM and back to another worker."""
    plan = getattr(queries_reports, query)(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and ", x#" not in plan


def test_calls_of_active_frames_are_those_of_the_recordings(spark):
    users = spark.range(12)
    made = detection.detect(synth.bursts(users, "id", seconds=0.1)).collect()
    found = detection.events_of(synth.bursts(users, "id", seconds=0.1, work=detection.active_frames, schema=signal.FRAME)).collect()
    assert made and sorted(map(tuple, made)) == sorted(map(tuple, found))


@pytest.mark.parametrize("axis", [0, 1])
def test_tables_are_interpolated_as_lines_are(axis):
    r = np.random.default_rng(3)
    values, at = r.random((7, 7)), np.cumsum(r.random(7))
    new = np.concatenate([[at[0] - 1], at, r.uniform(at[0], at[-1], 20), [at[-1] + 1]])
    assert np.array_equal(signal.resampled(values, at, new, axis), np.apply_along_axis(lambda line: np.interp(new, at, line), axis, values))
    one = r.random((1, 4))
    assert np.array_equal(signal.resampled(one, np.zeros(1), np.arange(3.0), 0), np.repeat(one, 3, axis=0))
