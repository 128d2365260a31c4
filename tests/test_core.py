"""The library's operators against plain Python and numpy, the self-test's known cases, and SQL."""

import math
import random

import numpy as np
import pytest

from lacuna import catalog
from lacuna.operators import clusters, density, gaps, graph, neighbors, nulls, scores, sequence, signal, synth, tracks
from lacuna.operators.gate import gap_test
from tests.compare import compared, views


def cloud_of(spark, z, set_id="s"):
    return spark.createDataFrame([(set_id, i, [float(x) for x in row]) for i, row in enumerate(z)], "set_id string, id long, z array<double>")


@pytest.fixture(scope="module")
def z():
    r = np.random.default_rng(4)
    return np.concatenate([r.normal(size=(30, 3)), r.normal(size=(25, 3)) + 8, r.normal(size=(5, 3)) - 20])


def plain_tree(z):
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)) + 1e-9
    inside, edges = {0}, []
    while len(inside) < len(z):
        w, i, j = min((d[i, j], i, j) for i in inside for j in range(len(z)) if j not in inside)
        edges.append((w, min(i, j), max(i, j)))
        inside.add(j)
    return d, sorted(edges)


def plain_gaps(z, k=15, least=10):
    d, edges = plain_tree(z)
    np.fill_diagonal(d, 0)
    near = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
    rk = np.take_along_axis(d, near, 1).max(axis=1)
    group = {i: {i} for i in range(len(z))}
    out = {}
    for w, u, v in edges:
        a, b = group[u], group[v]
        if len(a) >= least and len(b) >= least:
            out[u, v] = w / np.median(rk[np.union1d(near[u], near[v])])
        both = a | b
        for i in both:
            group[i] = both
    return edges, out


def test_tree_gaps_and_groups(spark, z):
    cloud = cloud_of(spark, z).unionByName(cloud_of(spark, z[:20], "t"))
    tree = graph.minimum_spanning_tree(cloud, block=16).cache()
    edges, want = plain_gaps(z)
    got = sorted((r.w, r.u, r.v) for r in tree.where("set_id = 's'").collect())
    assert [(u, v) for _, u, v in got] == [(u, v) for _, u, v in edges] and np.allclose([w for w, *_ in got], [w for w, *_ in edges])
    assert tree.where("set_id = 't'").count() == 19
    near = neighbors.knn(cloud, block=16).cache()
    found = gaps.gap_tree(tree, near).cache()
    assert {(r.u, r.v): round(r.gap, 9) for r in found.where("set_id = 's'").collect()} == {k: round(g, 9) for k, g in want.items()}
    groups = gaps.cut_groups(cloud, tree, found, spark.createDataFrame([("s", 2.0), ("t", 2.0)], "set_id string, thr double"))
    sizes = {r.grp: r["count"] for r in groups.where("set_id = 's'").groupBy("grp").count().collect()}
    assert sum(sizes.values()) == 60 and len(sizes) == 1 + sum(g > 2 for g in want.values())
    assert math.isclose(max(want.values(), default=0.0), nulls.largest_gap(z), rel_tol=1e-9)
    older = gaps.gap_tree(tree, near, norm="group").where("set_id = 's'").collect()
    assert len(older) == len(want)


def test_knn_and_dimension(spark, z):
    cloud = cloud_of(spark, z)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    for block in (7, 1000):
        near = neighbors.knn(cloud, 5, block).collect()
        assert {(r.i, r["rank"], r.j) for r in near} == {(i, k, int(j)) for i in range(60) for k, j in enumerate(np.argsort(d[i], kind="stable")) if 1 <= k <= 5}
    t = np.sort(d, axis=1)[:, 1:6] + 1e-12
    want = 1 / np.mean(np.log(t[:, -1:] / t[:, :-1]).sum(axis=1) / 4)
    assert math.isclose(neighbors.intrinsic_dim(neighbors.knn(cloud, 5), 5).first().d_hat, want, rel_tol=1e-9)


def test_gate_on_known_cases(spark):
    cloud = synth.known_case(spark, "clusters", 160).unionByName(synth.known_case(spark, "uniform", 160))
    gate = gap_test(cloud, n_null=20)
    got = {r.set_id: r for r in gate.result.collect()}
    assert got["clusters"].is_discrete and got["clusters"].n_types == 8
    assert not got["uniform"].is_discrete and got["uniform"].p > 0.05
    assert gate.groups.where("set_id = 'clusters'").select("grp").distinct().count() == 8
    with pytest.raises(ValueError):
        gap_test(cloud.where("id < 15"), n_null=5)


def test_scores():
    assert math.isclose(scores.chi_square_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(scores.chi_square_tail(11.070497693516351, 5), 0.05, rel_tol=1e-9)
    assert math.isclose(scores.chi_square_tail(9.487729036781154, 4), 0.05, rel_tol=1e-9)
    r = random.Random(0)
    a = [r.randrange(3) for _ in range(12)]
    b = [r.randrange(2) for _ in range(12)]
    total = []
    for _ in range(4000):
        r.shuffle(b)
        n = len(a)
        total.append(sum((c := sum(x == i and y == j for x, y in zip(a, b, strict=True))) and c / n * math.log(n * c / (a.count(i) * b.count(j))) for i in range(3) for j in range(2)))
    assert abs(scores.expected_information([a.count(i) for i in range(3)], [b.count(j) for j in range(2)]) - np.mean(total)) < 0.01


def test_adjusted_scores_of_equal_labels(spark):
    df = spark.createDataFrame([(i % 4, (i % 4) * 10) for i in range(40)], "a int, b int")
    assert scores.adjusted_rand(df, "a", "b").first().ari == 1.0
    assert math.isclose(scores.adjusted_information(df, "a", "b").first().ami, 1.0, rel_tol=1e-9)


def test_tracks():
    x = np.zeros(30)
    x[11] = 3.0
    assert 11 not in tracks.despike(x) and len(tracks.despike(x)) == 29
    t = np.arange(40) * 0.01
    lf = np.where(np.arange(40) % 8 == 3, 9.0, 5.0 + t)
    path = tracks.trace(t, lf, np.full(40, 0.9))
    assert all(i % 8 != 3 for i in path) and len(path) == 35


def test_clean_tracks(spark):
    t = [0.01 * k for k in range(20)]
    f = [1000.0 * 2 ** (0.1 * k / 20) for k in range(20)]
    f[7] = 9000.0
    rows = [(1, t[::-1], f[::-1], None, 0.4), (2, t[:3], f[:3], None, 1.0), (3, None, None, None, 1.0), (4, t, [float("nan")] * 20, [1.0] * 20, 0.0)]
    out = tracks.clean_tracks(spark.createDataFrame(rows, "id int, t array<double>, f array<double>, conf array<double>, duration double")).collect()
    assert [r.id for r in out] == [1] and len(out[0].t) == 19 and out[0].t[0] == 0.0
    assert math.isclose(out[0].kept_point_frac, 0.95) and math.isclose(out[0].span_frac, 0.19 / 0.4)


def test_spectrum_of_a_tone():
    fs = 250_000
    x = np.sin(2 * np.pi * 60_000 * np.arange(fs // 10) / fs)
    f, t, p = signal.spectrogram(x, fs, 512, 384)
    assert abs(f[p.mean(axis=1).argmax()] - 60_000) <= fs / 512
    assert math.isclose(p.sum(axis=0).mean() * fs / 512, 0.5, rel_tol=0.02)
    image = signal.call_pixels(x, fs, 50.0, 100.0, 30e3, 110e3)
    assert image.shape == (1024,) and 0 <= image.min() and image.max() <= 1


def test_detector(spark):
    from lacuna.plans.detection import detect

    fs = 250_000
    r = np.random.default_rng(0)
    x = 0.001 * r.normal(size=fs // 2)
    for start, ms in ((0.05, 1), (0.1, 50), (0.156, 40), (0.25, 20)):
        n = int(fs * ms / 1000)
        x[int(start * fs) : int(start * fs) + n] += np.sin(2 * np.pi * 60_000 * np.arange(n) / fs)
    rows = spark.createDataFrame([("a.wav", fs, x.tolist())], "file string, fs int, x array<double>")
    out = sorted(detect(rows).collect(), key=lambda e: e.onset_s)
    assert [round(e.dur_ms) // 10 for e in out] == [9, 2] and all(abs(e.peak_khz - 60) < 1 for e in out)


def test_sounds_and_annotations(spark, tmp_path):
    import io
    import wave

    from lacuna.sources import sounds

    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[1, 9], [-2, 9], [3, 9]], "<i2").tobytes())
    (tmp_path / "a.wav").write_bytes(buffer.getvalue())
    row = sounds.read_wavs(spark, str(tmp_path)).first()
    assert row.fs == 8000 and row.x == [1.0, -2.0, 3.0]
    notes = "".join(f"<Note><Position>{10 * k}</Position><Length>5</Length><Label>{x}</Label></Note>" for k, x in enumerate("aaaaab"))
    one = "<Note><Position>0</Position><Length>50</Length><Label>c</Label></Note>"
    (tmp_path / "n.xml").write_text(f"<S><Sequence><WaveFileName>1.wav</WaveFileName><Position>100</Position><Length>60</Length>{notes}</Sequence><Sequence><WaveFileName>2.wav</WaveFileName><Position>7</Position><Length>40</Length>{one}</Sequence></S>")
    out = sounds.read_annotations(spark, str(tmp_path / "n.xml")).cache()
    assert out.where("overruns").count() == 1
    rows = sorted(sounds.with_context(out).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == [100 + 10 * k for k in range(6)]
    assert [r.run_pos for r in rows] == ["1st", "2nd", "3rd", "4th+", "4th+", "1st"]
    assert [r.prev for r in rows] == ["START", "a", "a", "a", "a", "a"] and rows[0].pos_bin == "early" and rows[-1].pos_bin == "late"


def test_density_and_clusters(spark):
    assert sorted(density.merge_peaks({1: 5.0, 2: 1.0, 3: 4.0}, {1: [2], 2: [1, 3], 3: [2]})) == [(3, 3.0)]
    r = np.random.default_rng(1)
    z = np.concatenate([r.normal(size=(40, 2)), r.normal(size=(40, 2)) + 9])
    assert density.modes(z, 0.5) and not density.modes(z, 50.0)
    cloud = cloud_of(spark, z)
    found = {row.cluster for row in clusters.hdbscan(cloud, neighbors.knn(cloud), 10).collect()} - {-1}
    assert len(found) == 2
    noise = clusters.dbscan(cloud, 1.2, 3).where("cluster >= 0").select("cluster").distinct().count()
    assert noise >= 2


def test_stream_gives_the_batch_sessions(spark, tmp_path):
    from lacuna.streaming.sessions import session_events

    rows = [(1, f"2024-01-01 00:{m:02d}:00", float(m)) for m in (0, 4, 9, 30)] + [(2, "2024-01-02 00:00:00", 1.0)]
    df = spark.createDataFrame(rows, "user_id long, t string, value double").selectExpr("user_id", "cast(t as timestamp) as ts", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = session_events(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("got").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    late = {(r.user_id, r.n_frames) for r in spark.table("got").collect()}
    assert {(r.user_id, r.n_frames) for r in session_events(df).collect()} == {(1, 3), (1, 1), (2, 1)} and late <= {(1, 3), (1, 1), (2, 1)}


QUICK = [n for n in catalog.ORACLE_SQL if n not in ("hopkins_given_points",)]


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_their_sql(spark, sf, name):
    assert compared(spark, views(sf), name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf) == ""
