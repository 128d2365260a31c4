"""Values of the detector, images, synthetic calls, density peaks, trees in parts and reports, against plain numpy and Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import clusters, density, gaps, graph, neighbors, nulls, scores, signal, synth
from lacuna.plans import detection, reports
from lacuna.sources import tables
from tests.test_core import cloud_of, plain_tree


def plain_calls(x, fs):
    """The detector frame by frame."""
    f, t, p = signal.spectrogram(x, fs, 512, 384)
    inside = (f >= 30e3) & (f <= 110e3)
    level = 10 * np.log10(p[inside] + 1e-20)
    tonal, peak = level.max(axis=0) - np.median(level, axis=0), f[inside][level.argmax(axis=0)]
    loud = [k for k in range(len(t)) if tonal[k] >= 15]
    gap = max(1, int(0.010 / (t[1] - t[0])))
    runs = []
    for k in loud:
        if runs and k - runs[-1][-1] <= gap:
            runs[-1].append(k)
        else:
            runs.append([k])
    out = []
    for run in runs:
        span = 1000 * (run[-1] - run[0] + 1) * (t[1] - t[0])
        steps = np.abs(np.diff(peak[run]))
        if 5 <= span <= 300 and len(steps) and np.median(steps) <= 6000:
            on, off = max(t[run[0]] - 256 / fs, 0), min(t[run[-1]] + 256 / fs, len(x) / fs)
            out.append((on, off, 1000 * (off - on), np.median(peak[run]) / 1000, np.median(tonal[run])))
    return out


def test_detector_values(spark):
    fs, r = 250_000, np.random.default_rng(0)
    rows, want = [], {}
    for name in "abc":
        x = 0.001 * r.normal(size=fs // 2)
        for _ in range(5):
            n, a, hz = int(fs * r.uniform(0.002, 0.06)), int(r.integers(0, fs // 2 - fs // 10)), r.uniform(35e3, 100e3)
            x[a : a + n] += r.uniform(0.01, 1) * np.sin(2 * np.pi * (hz + 4e4 * np.arange(n) / fs) * np.arange(n) / fs)
        rows.append((name, fs, x.tolist()))
        want[name] = plain_calls(x, fs)
    assert sum(map(len, want.values())) > 6
    out = detection.detect(spark.createDataFrame(rows, "file string, fs int, x array<double>")).orderBy("file", "onset_s").collect()
    got = {name: [tuple(e)[2:] for e in out if e.file == name] for name in want}
    for name, calls in want.items():
        assert len(got[name]) == len(calls) and np.allclose(got[name], calls)


@pytest.mark.parametrize("full", [False, True])
def test_image_pixels(full):
    fs, r = 250_000, np.random.default_rng(1)
    x = np.sin(2 * np.pi * 60e3 * np.arange(5000) / fs) + 0.1 * r.normal(size=5000)
    image = signal.call_pixels(x, fs, None if full else 20.0, 100.0, 30e3, 110e3, 512, 448, 1e-20, full_width=full).reshape(32, 32)
    f, _, p = signal.spectrogram(x, fs, 512, 448)
    inside = (f >= 30e3) & (f <= 110e3)
    level = np.log10(p[inside] + 1e-20)
    hz = [30e3 * (110 / 30) ** (k / 31) for k in range(32)]
    table = np.array([[np.interp(h, f[inside], level[:, c]) for c in range(level.shape[1])] for h in hz])
    table = np.clip((table - table.max() + 4) / 4, 0, 1)
    w = 32.0 if full else 32 * math.log(21) / math.log(101)
    for row in (0, 13, 31):
        for j in range(32):
            at = min((j + 0.5) / w, 1) * (level.shape[1] - 1)
            assert math.isclose(image[row, j], np.interp(at, range(level.shape[1]), table[row]) * min(max(w - j, 0), 1), abs_tol=1e-9)


def test_short_calls_are_padded():
    image = signal.call_pixels(np.ones(100), 44_100, None, 200.0, 500.0, 8000.0)
    w = max(32 * math.log1p(1000 * 256 / 44_100) / math.log1p(200.0), 2)
    assert image.shape == (1024,) and not image.reshape(32, 32)[:, math.ceil(w) :].any()


def test_aligned_spectrum_is_empty_outside():
    x = np.random.default_rng(2).normal(size=44_100)
    grid = np.array([-50.0, -10.0, 0.0, 10.0, 200.0])
    out = signal.aligned_spectrum(x, 44_100, 10_000, 2000, grid, 500.0, 8000.0)
    assert np.isnan(out[:, [0, 4]]).all() and not np.isnan(out[:, 1:4]).any() and out[:, 1:4].min() >= 0 and out[:, 1:4].max() <= 1


def test_synthetic_calls(spark):
    protos = synth.prototypes()
    unit = (protos - synth.LOW) / (synth.HIGH - synth.LOW)
    pool = np.random.default_rng(123).random((4000, 4))
    for k in range(1, 8):
        away = np.array([min(np.linalg.norm(p - q) for q in unit[:k]) for p in pool])
        assert np.allclose(pool[away.argmax()], unit[k])
    for kind in synth.KINDS:
        theta, label = synth.parameters(kind, np.random.default_rng(5), protos)
        assert ((theta >= synth.LOW) & (theta <= synth.HIGH)).all() and (label == 0 or kind.startswith("discrete"))
    t = np.random.default_rng(5).random()
    theta, _ = synth.parameters("graded_1d", np.random.default_rng(5), protos)
    assert abs(theta[0] - (0.2 + 0.6 * t)) < 0.05 and abs(theta[3] - (0.65 + 0.3 * t)) < 0.05
    assert synth.parameters("graded_1d_fixeddur", np.random.default_rng(5), protos)[0][3] == 0.8
    smooth, stepped = (synth.outline(np.array([0.2, 0.9, 0.25, 0.7]), s) for s in (True, False))
    assert np.count_nonzero(smooth.any(axis=0)) == 23 and np.count_nonzero(stepped.any(axis=0)) == 22
    for j in (0, 9, 22):
        s = min((j + 0.5) / 22.4, 1)
        height = 31 * min(max(0.2 + 0.7 * s + s * (1 - s), 0.03), 0.97)
        assert np.allclose(smooth[:, j], min(22.4 - j, 1) * np.exp(-((np.arange(32) - height) ** 2) / 1.28))
    image = synth.repertoire(spark, "discrete_loose", 3).first().image
    assert len(image) == 1024 and max(image) == 1.0


def test_peaks_below_the_main_one(spark):
    line = {1: 5.0, 2: 1.0, 3: 4.0, 4: 0.5, 5: 3.0}
    assert sorted(density.merge_peaks(line, {1: [2], 2: [1, 3], 3: [2], 4: [], 5: []})) == [(3, 3.0), (4, 0.0), (5, 2.5)]
    r = np.random.default_rng(1)
    z = np.concatenate([r.normal(size=(60, 2)), r.normal(size=(60, 2)) + 9])
    cloud = cloud_of(spark, z)
    peaks = density.prominences(neighbors.knn(cloud)).cache()
    assert math.isclose(density.top_prominence(peaks, cloud).first().top, density.largest_prominence(z), rel_tol=1e-6)
    both = cloud.unionByName(cloud_of(spark, r.normal(size=(80, 2)), "one"))
    out = {x.set_id: x for x in density.peak_and_mode_tests(both, n_null=19).collect()}
    assert out["s"].h_crit > out["one"].h_crit and out["s"].n_types_peaks >= 1 and 0 < out["s"].p_peaks <= 1 and 0 <= out["s"].p_modes <= 1
    with pytest.raises(ValueError):
        density.peak_and_mode_tests(cloud.limit(10))


def test_trees_in_parts(spark, monkeypatch):
    z = np.random.default_rng(6).normal(size=(90, 3))
    cloud = cloud_of(spark, z)
    want = [(u, v) for _, u, v in plain_tree(z)[1]]
    for most in (1000, 60, 20):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        tree = graph.minimum_spanning_tree(cloud, block=16).cache()
        assert [(r.u, r.v) for r in tree.orderBy("w", "u", "v").collect()] == want
        labels = graph.components(cloud.select("set_id", "id"), tree.where("w < 0.6"))
        whole = {r.id: r.comp for r in labels.collect()}
        parent = list(range(90))
        for u, v in ((r.u, r.v) for r in tree.where("w < 0.6").collect()):
            low, high = sorted((parent[u], parent[v]))
            parent = [low if p == high else p for p in parent]
        assert whole == dict(enumerate(parent))


def test_reachability_tree(spark):
    z = np.random.default_rng(8).normal(size=(50, 2))
    cloud = cloud_of(spark, z)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 9]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    inside, total = {0}, 0.0
    while len(inside) < 50:
        w, j = min((reach[i, j], j) for i in inside for j in range(50) if j not in inside)
        inside.add(j)
        total += w
    cores = spark.createDataFrame([("s", i, float(c)) for i, c in enumerate(core)], "set_id string, id long, core double")
    edges = graph.spanning_tree_of_edges(cloud, graph.block_trees(cloud.join(cores, ["set_id", "id"]), 16, "core"))
    assert math.isclose(edges.agg(F.sum("w")).first()[0], total, rel_tol=1e-9)
    assert clusters.hdbscan(cloud, neighbors.knn(cloud), 10, 16).count() == 50


def test_simulated_clouds_without_a_matrix():
    z = np.random.default_rng(9).normal(size=(300, 4))
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    near, radius = nulls.nearest(z, 15)
    assert np.allclose(radius, np.sort(d, axis=1)[:, 15] + 1e-9) and all(set(a) == set(np.argsort(b)[:16]) for a, b in zip(near, d, strict=True))
    assert np.isclose(sum(w for w, _, _ in nulls.tree_edges(z)), sum(w for w, _, _ in plain_tree(z)[1]))


def test_group_gaps_use_all_members(spark):
    r = np.random.default_rng(3)
    z = np.concatenate([r.normal(size=(20, 2)), r.normal(size=(15, 2)) + 7])
    cloud = cloud_of(spark, z)
    near = neighbors.knn(cloud)
    found = gaps.gap_tree(graph.minimum_spanning_tree(cloud), near, norm="group").orderBy("w").collect()
    rk = np.sort(np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)), axis=1)[:, 15] + 1e-9
    last = found[-1]
    assert math.isclose(last.gap, last.w / np.median(rk), rel_tol=1e-9)


def test_adjusted_information_by_sizes(spark):
    df = spark.createDataFrame([(i % 3, i % 5 if i < 40 else 0) for i in range(60)], "a int, b int")
    got = scores.adjusted_information(df, "a", "b").first().ami
    row = scores.mutual_information(df, "a", "b").first()
    chance = scores.expected_information([20, 20, 20], [28, 8, 8, 8, 8])
    assert math.isclose(got, (row.mi - chance) / ((row.h_a + row.h_b) / 2 - chance), rel_tol=1e-9)
    assert scores.adjusted_information(df.where("a = 0"), "a", "a").first().ami == 1.0


def test_pca_takes_one_set(spark):
    with pytest.raises(ValueError):
        clusters.pca(cloud_of(spark, np.eye(3)).unionByName(cloud_of(spark, np.eye(3), "t")), 2)


def test_footers_and_reports(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    info = '{"info": {"features": {"kind": {"names": ["a", "b"]}}}}'
    table = pa.table({"kind": [0, 1, 1]}).replace_schema_metadata({"huggingface": info})
    pq.write_table(table, tmp_path / "x.parquet")
    row = tables.footers(spark, [str(tmp_path)]).first()
    assert (row.rows, row.row_groups, row.info) == (3, 1, info) and row.bytes == (tmp_path / "x.parquet").stat().st_size
    assert tables.class_names(row.info, "kind") == ["a", "b"]
    runs = spark.createDataFrame([(0.01, 8, 8, 0.9), (0.2, 1, 8, 0.1), (None, None, 8, None)], "p double, n_types int, n_categories int, ari double")
    got = [tuple(r)[-3:] for r in reports.control_verdicts(runs).collect()]
    assert got == [(True, True, True), (False, False, False), (None, None, None)]
    assert reports.share_meeting(runs, F.col("p") < 0.05, []).first().met == 1
