"""Layouts, dendrograms, range medians, exact quantiles, folds and hulls against their definitions."""

import io
import math
import random
import statistics
import struct
import wave
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import queries_cloud
from lacuna.sources import sounds, tables
from lacuna.operators import clusters, dendrogram, density, geometry, graph, neighbors, ordering, quantiles, ranges, sequence, synth, umap
from lacuna.operators.gate import gap_test


def cloud_of(spark, z, set_id="s"):
    return spark.createDataFrame([(set_id, i, [float(x) for x in p]) for i, p in enumerate(z)], "set_id string, id long, z array<double>")


def test_fuzzy_weights_by_definition(spark):
    z = np.random.default_rng(1).normal(size=(40, 3))
    z[7] = z[8] = z[9]
    got = {(r.i, r.j): r.w for r in umap.fuzzy_graph(neighbors.knn(cloud_of(spark, z), 5), 6).collect()}
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    one = np.zeros((40, 40))
    for i in range(40):
        near = [j for j in sorted(range(40), key=lambda j: (d[i, j], j)) if j != i][:5]
        rho = min(d[i, j] for j in near)
        low, high = 1e-9, 1e6
        for _ in range(200):
            middle = math.sqrt(low * high)
            mass = sum(math.exp(-max(0, d[i, j] - rho) / middle) for j in near)
            low, high = (low, middle) if mass > math.log2(6) else (middle, high)
        for j in near:
            one[i, j] = math.exp(-max(0, d[i, j] - rho) / low)
    want = one + one.T - one * one.T
    assert set(got) == {(i, j) for i in range(40) for j in range(i + 1, 40) if want[i, j] > 0 or one[i, j] or one[j, i]}
    assert all(math.isclose(w, want[k], abs_tol=1e-6) for k, w in got.items())


def test_curve_falls_as_asked():
    a, b = umap.curve()
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01


def test_layout_keeps_neighbours_of_a_curved_sheet(spark):
    r = np.random.default_rng(4)
    t, h = r.uniform(0, 3 * math.pi, 300), r.uniform(0, 4, 300)
    z = np.stack([(t + 3) * np.cos(t), (t + 3) * np.sin(t), 3 * h, 0.1 * r.normal(size=300)], axis=1)
    cloud = cloud_of(spark, z).cache()
    near = neighbors.knn(cloud).cache()
    kept = lambda x: umap.neighbours_kept(near, neighbors.knn(x)).first().kept
    start = umap.start_from_components(cloud)
    whole = umap.umap(cloud, neighbors=near).cache()
    assert kept(whole) > 0.6 and kept(whole) > kept(start) + 0.1
    assert whole.collect() == umap.umap(cloud, neighbors=near).collect()
    blocks = umap.umap(cloud, neighbors=near, block=100, rounds=20)
    assert blocks.count() == 300 and kept(blocks) > kept(start) + 0.05


def test_layout_of_odd_clouds(spark):
    same = cloud_of(spark, np.ones((20, 3)))
    out = umap.umap(same).collect()
    assert len(out) == 20 and all(math.isfinite(x) for r in out for x in r.z)
    few = cloud_of(spark, [[0.0, 1.0], [2.0, 0.0], [0.5, 0.5]])
    assert umap.umap(few).count() == 3
    none = spark.createDataFrame([], "set_id string, i long, j long, d double, rank int")
    start = cloud_of(spark, [[0.0, 1.0]])
    assert umap.layout(umap.fuzzy_graph(none), start).first().z == [0.0, 1.0]
    assert umap.layout(umap.fuzzy_graph(none), start.limit(0)).count() == 0


def joins_of(edges):
    """(u, v, w, first, size_a, size_b, members of both sides) in order, for the edges of one set."""
    group, of, out = {}, {}, []
    for u, v, w in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        a, b = sorted((of.get(u, u), of.get(v, v)))
        group.setdefault(a, [a])
        group.setdefault(b, [b])
        out.append((u, v, w, a, len(group[a]), len(group[b]), set(group[a]), set(group[b])))
        group[a] += group.pop(b)
        of.update(dict.fromkeys(group[a], a))
    return out


@pytest.mark.parametrize("part", [10, 1000])
def test_dendrograms_in_blocks(spark, part):
    r = random.Random(1)
    sets = {}
    for s, n in (("a", 90), ("b", 7), ("c|1", 40)):
        ids = r.sample(range(1000), n)
        sets[s] = [(*sorted((ids[k], ids[r.randrange(k)])), float(r.randrange(40))) for k in range(1, n)]
    tree = spark.createDataFrame([(s, *e) for s, edges in sets.items() for e in edges], "set_id string, u long, v long, w double")
    merges, places = dendrogram.dendrogram(tree, part)
    found, at = defaultdict(list), defaultdict(dict)
    for m in merges.orderBy("set_id", "e").collect():
        found[m.set_id].append((m.u, m.v, m.w, m["first"], m.size_a, m.size_b))
    for p in places.collect():
        assert p.id not in at[p.set_id]
        at[p.set_id][p.id] = p.place
    for s, edges in sets.items():
        want = joins_of(edges)
        assert found[s] == [x[:6] for x in want] and sorted(at[s].values()) == list(range(len(edges) + 1))
        for *_, first, a, b, left, right in want:
            start = at[s][first]
            assert sorted(at[s][i] for i in left) == list(range(start, start + a)) and sorted(at[s][i] for i in right) == list(range(start + a, start + a + b))


def test_merge_sizes_equal_sql_in_parts_of_twenty(spark, sf):
    from lacuna.operators import gaps

    cloud = neighbors.points(spark.read.parquet(f"{sf}/embeddings.parquet"), set_col="label")
    tree = graph.minimum_spanning_tree(cloud).cache()
    key = lambda df: sorted(tuple(r) for r in df.select("set_id", "u", "v", "e", "size_a", "size_b", "first").collect())
    assert key(gaps.merges(tree, 20)) == key(gaps.merges(tree))
    near = neighbors.knn(cloud).cache()
    wide = lambda part: sorted((r.set_id, r.e, round(r.gap, 9)) for r in gaps.gap_tree(tree, near, norm="group", part=part).collect())
    assert wide(20) == wide(1000)


@pytest.mark.parametrize("fan, stretch", [(4, 16), (64, 4096)])
def test_range_medians(spark, fan, stretch):
    r = random.Random(2)
    rows = [(s, i, float(r.randrange(30))) for s, n in (("a", 300), ("b", 3)) for i in range(n)]
    asked = []
    for e in range(60):
        s, n = r.choice((("a", 300), ("b", 3)))
        lo = r.randrange(n)
        asked.append((s, e, lo, r.randrange(lo, n + 1)))
    values = spark.createDataFrame(rows, "set_id string, place long, x double")
    found = ranges.range_medians(values, spark.createDataFrame(asked, "set_id string, e long, lo long, hi long"), fan, stretch)
    assert {x.e: x.median for x in found.collect()} == {e: statistics.median(x for t, i, x in rows if t == s and lo <= i < hi) for s, e, lo, hi in asked if hi > lo}


def test_ranks_over_ranges(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(20), k) for k in range(500)]
    got = {x.k: x.rank for x in ordering.ranks(spark.createDataFrame(rows, "g string, x int, k int"), ["g"], ["x", "k"], "rank", 40).collect()}
    for g in ("a", "b", None):
        assert [got[k] for _, _, k in sorted((x for x in rows if x[0] == g), key=lambda x: x[1:])] == list(range(1, sum(x[0] == g for x in rows) + 1))


def test_exact_quantiles(spark):
    r = random.Random(5)
    for values in ([r.gauss(0, 1) ** 5 for _ in range(3000)], [1.0] * 50, [r.choice([0.0, 1.0, 1e300, -1e300]) for _ in range(999)], [3.5], [1e-300 * k for k in range(700)]):
        df = spark.createDataFrame([(x,) for x in values] + [(None,)], "x double")
        shares = [0.0, 0.01, 1 / 3, 0.5, 0.77, 1.0]
        got = quantiles.exact_quantiles(df, F.col("x"), shares, bins=16, few=5)
        assert got == list(df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0])
    odd = spark.createDataFrame([(x,) for x in (math.inf, -math.inf, math.nan, 1.0, 2.0)], "x double")
    got = quantiles.exact_quantiles(odd, F.col("x"), [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4])
    assert quantiles.exact_quantiles(odd.limit(0), F.col("x"), [0.5]) == [None]
    assert sequence.value_tertile(spark.createDataFrame([(None,)], "x double"), "x").first().tertile is None


def test_group_folds_are_even_and_apart(spark):
    r = random.Random(6)
    rows = []
    for g in range(60):
        rows += [(len(rows) + k, f"g{g}", r.choice(["x", "y"] if g % 3 else ["z"])) for k in range(r.choice([1, 4, 20, 90]))]
    rows += [(10_000 + k, None, None) for k in range(5)]
    df = spark.createDataFrame(rows, "k long, grp string, label string")
    for batch in (10_000, 20):
        out = clusters.stratified_group_folds(df, "grp", "label", batch=batch).collect()
        assert Counter((x.k, x.grp, x.label) for x in out) == Counter(rows)
        of = defaultdict(set)
        for x in out:
            of[x.grp].add(x.fold)
        assert all(len(f) == 1 for f in of.values())
        share = Counter((x.fold, x.label) for x in out)
        for label in "xyz":
            total = sum(x.label == label for x in out)
            largest = max(Counter(x.grp for x in out if x.label == label).values())  # no fold is off by more than one group
            assert all(abs(share[f, label] - total / 5) <= largest for f in range(5))
    four = spark.createDataFrame([(k, f"g{k % 4}", "x") for k in range(40)], "k long, grp string, label string")
    assert len({x.fold for x in clusters.stratified_group_folds(four, "grp", "label").collect()}) == 4
    assert clusters.stratified_group_folds(four.limit(0), "grp", "label").count() == 0


def in_hull(p, points):
    """Whether p is a convex combination of the points, by the nearest one found so: Frank and Wolfe's steps towards it."""
    x = points.mean(axis=0)
    for _ in range(4000):
        far = points[((points - x) @ (p - x)).argmax()]
        if (far - x) @ (p - x) < ((p - x) ** 2).sum() * 0.5 - 1e-9 and (p - x) @ (p - x) > 1e-4 and ((points - p) @ (p - x)).max() < 0:
            return False
        step = far - x
        gain = (p - x) @ step / max(step @ step, 1e-30)
        x = x + min(max(gain, 0), 1) * step
    return bool(((p - x) ** 2).sum() < 1e-4)


def test_hulls_in_space(spark):
    r = np.random.default_rng(7)
    for z in (r.normal(size=(60, 3)), np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1, 0.5)], float), r.uniform(size=(200, 3)) ** 3):
        planes = geometry.facets(z)
        assert (z @ planes[:, :3].T <= planes[:, 3] + 1e-9).all()
        some = r.uniform(z.min(axis=0) - 0.2, z.max(axis=0) + 0.2, size=(60, 3))
        clear = np.abs(some @ planes[:, :3].T - planes[:, 3]).min(axis=1) > 0.03
        assert [bool(x) for x in geometry.inside(some, planes)[clear]] == [in_hull(p, z) for p in some[clear]]
        (row,) = geometry.half_spaces(cloud_of(spark, z), block=16).collect()
        assert list(geometry.inside(some, np.array(row.planes))[clear]) == list(geometry.inside(some, planes)[clear])
    flat = np.c_[r.normal(size=(30, 2)), np.zeros(30)]
    assert len(geometry.facets(flat)) == 0 and geometry.half_spaces(cloud_of(spark, flat)).count() == 0
    ball = r.normal(size=(150, 3))
    spread = geometry.hopkins_test(cloud_of(spark, r.uniform(size=(150, 3)))).first().hopkins
    lumps = geometry.hopkins_test(cloud_of(spark, np.concatenate([ball * 0.02, ball * 0.02 + 3]))).first().hopkins
    assert 0.3 < spread < 0.7 and lumps < 0.15
    assert geometry.hopkins_test(cloud_of(spark, ball).limit(0)).count() == 0


def test_mean_shift_in_blocks_equals_that_in_memory(spark):
    r = np.random.default_rng(8)
    sets = {"one": r.normal(size=(120, 2)), "two": np.concatenate([r.normal(size=(50, 2)) * 0.3, r.normal(size=(50, 2)) * 0.3 + 3])}
    cloud = cloud_of(spark, sets["one"], "one").unionByName(cloud_of(spark, sets["two"], "two")).cache()
    widths = spark.createDataFrame([("one", 0.9), ("two", 0.5)], "set_id string, h double")
    ends = defaultdict(dict)
    for x in density.ascended_in_blocks(cloud, widths, block=50, rounds=60).collect():
        ends[x.set_id][x.id] = x.y
    for s, h in (("one", 0.9), ("two", 0.5)):
        want = density.ascended(sets[s], h, 60)
        assert np.allclose([ends[s][i] for i in range(len(want))], want, atol=1e-6)
        # a definition without blocks: the mean under the kernel around each end is where it is, or near
        weight = np.exp(-((want[:, None] - sets[s][None]) ** 2).sum(axis=2) / (2 * h * h))
        assert np.abs(weight @ sets[s] / weight.sum(axis=1, keepdims=True) - want).max() < 1e-2 * h
    many = {x.set_id: x.many for x in density.modes_in_blocks(cloud, widths, block=50, rounds=60).collect()}
    assert many == {s: density.modes(sets[s], h, rounds=60) for s, h in (("one", 0.9), ("two", 0.5))} and many["two"]


def test_bootstraps_keep_the_variance(spark):
    z = np.random.default_rng(9).normal(size=(400, 2)) * [1.0, 5.0] + 7
    drawn = density.smoothed_bootstraps(cloud_of(spark, z), spark.createDataFrame([("s", 0.8)], "set_id string, h double"), 6).toPandas()
    assert drawn.groupby("rep").size().tolist() == [400] * 6
    x = np.array(drawn["z"].tolist())
    assert np.allclose(x.mean(axis=0), z.mean(axis=0), rtol=0.03) and np.allclose(x.std(axis=0), z.std(axis=0), rtol=0.06)


def plain_dbscan(z, eps, least):
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label = [-1] * len(z)
    for i in np.flatnonzero(core):
        todo = [i] if label[i] < 0 else []
        while todo:
            x = todo.pop()
            if label[x] < 0:
                label[x] = int(i)
                todo += list(np.flatnonzero(near[x] & core))
    return [(label[i] if core[i] else min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1), bool(core[i])) for i in range(len(z))]


def test_density_grid_of_dense_cells_stripes_and_many_coordinates(spark):
    r = np.random.default_rng(11)
    stripe = np.c_[np.zeros(150), r.uniform(0, 30, 150), r.normal(size=150) * 0.1]
    for z, eps, least in ((stripe, 0.5, 3), (np.concatenate([r.normal(size=(90, 2)) * 0.2, r.uniform(-5, 5, size=(60, 2))]), 0.6, 4), (r.normal(size=(80, 64)), 10.2, 3), (np.ones((40, 3)), 0.1, 3)):
        out = clusters.dbscan(cloud_of(spark, z), eps, least, block=16).orderBy("id").collect()
        assert [(x.cluster, x.core) for x in out] == plain_dbscan(z, eps, least)
    assert clusters.dbscan(cloud_of(spark, stripe).limit(0), 0.5).count() == 0


def test_slices_over_chunk_borders(spark):
    r = random.Random(12)
    heard = {"a": [float(k) for k in range(100)], "b": [float(-k) for k in range(7)], "none": []}
    events = [(k, r.choice(["a", "b", "absent"]), r.choice([None, -3, 0, 5, 9, 10, 11, 50, 99, 100, 400]), r.choice([None, -1, 0, 1, 9, 10, 11, 35, 400])) for k in range(120)]
    recordings = spark.createDataFrame(list(heard.items()), "file string, x array<double>")
    found = sounds.slices(spark.createDataFrame(events, "k long, file string, start long, length long"), recordings, "start", "length", size=10)
    got = {x.k: x.x for x in found.collect()}
    want = {k: heard[f][max(a or 0, 0) : max(a or 0, 0) + max(n or 0, 0)] for k, f, a, n in events if f in heard}
    assert got == want


def wav_bytes(rate, channels, width, frames, before=b"", claimed=None):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(bytes(frames * channels * width))
    b = out.getvalue()
    at = b.index(b"data")
    size = struct.pack("<I", claimed) if claimed is not None else b[at + 4 : at + 8]
    return b[:at] + before + b"data" + size + b[at + 8 :]


def test_riff_chunks_are_walked(spark, tmp_path):
    odd = b"LIST" + struct.pack("<I", 5) + b"abcde\0" + b"bext" + struct.pack("<I", 0)
    files = [wav_bytes(44100, 2, 2, 441), wav_bytes(250000, 1, 3, 999, odd), wav_bytes(8000, 1, 1, 80, odd, 0xFFFFFFFF), b"RIFF", b"no sound at all", b"RIFF\0\0\0\0AVI data", None]
    out = sounds.with_facts(spark.createDataFrame([(k, b) for k, b in enumerate(files)], "k long, content binary")).orderBy("k").collect()
    assert [(x.rate, x.channels, x.bits, x.frames) for x in out[:3]] == [(44100, 2, 16, 441), (250000, 1, 24, 999), (8000, 1, 8, 80)]
    assert math.isclose(out[0].seconds, 0.01) and all(x.frames is None and x.seconds is None for x in out[3:])
    with wave.open(io.BytesIO(files[1])) as w:
        assert (w.getframerate(), w.getnchannels(), w.getnframes()) == (out[1].rate, out[1].channels, out[1].frames)
    for k, b in enumerate(files[:4]):
        (tmp_path / f"{k}.wav").write_bytes(b)
    folder = {x.file[-5]: (x.rate, x.frames, x.length) for x in sounds.wav_facts(spark, str(tmp_path)).collect()}
    assert folder == {"0": (44100, 441, len(files[0])), "1": (250000, 999, len(files[1])), "2": (8000, 80, len(files[2])), "3": (None, None, 4)}
    facts = sounds.with_facts(spark.createDataFrame([(b,) for b in files], "content binary"))
    assert sum(x.files for x in sounds.rates_and_durations(facts).collect()) == 3


def test_band_levels_of_a_tone(spark):
    t = np.arange(20_000) / 50_000
    tone = np.sin(2 * np.pi * 12_000 * t) + 1e-4 * np.random.default_rng(1).normal(size=len(t))
    bands = {x.low_hz: x.level_db for x in sounds.band_levels(spark.createDataFrame([(50_000, tone.tolist()), (50_000, tone[:500].tolist()), (8000, [0.0] * 50)], "fs int, x array<double>")).collect()}
    assert set(bands) == {0, 10_000, 20_000} and max(bands, key=bands.get) == 10_000 and all(b <= 0 for b in bands.values())


def test_identical_points_have_no_dimension(spark):
    assert neighbors.intrinsic_dim(neighbors.knn(cloud_of(spark, np.ones((20, 2))))).first().d_hat is None


def test_new_queries(spark, sf):
    kept = {r.layout: r.kept for r in queries_cloud.umap_neighbours_kept(spark, sf).collect()}
    assert kept["umap"] > kept["components"]
    assert queries_cloud.stratified_group_folds(spark, sf).where("fold is null").count() == 0
    assert queries_cloud.hopkins_in_space(spark, sf).count() == 1


def test_known_clusters_of_all_embeddings_are_found(spark, sf):
    z = neighbors.points(spark.read.parquet(f"{sf}/embeddings.parquet")).withColumn("z", F.slice("z", 1, 5))
    moved = {r.id: np.array(r.z) for r in synth.around_centres(z, 3, 50.0).collect()}
    steps = [moved[r.id] - np.array(r.z) for r in z.orderBy("id").collect()]
    assert len(moved) == len(steps) and np.allclose(steps[0], steps[3]) and min(np.linalg.norm(steps[0] - steps[k]) for k in (1, 2)) > 10
    gate = gap_test(synth.around_centres(clusters.standardised(z)), n_null=20)
    assert gate.result.first().n_types == 8
    groups = {r.id: r.grp for r in gate.groups.collect() if r.grp >= 0}
    assert all(i % 8 == g % 8 for i, g in groups.items()) and len(groups) > 0.9 * len(steps)


def test_calls_follow_their_rows(spark):
    rows = spark.createDataFrame([(5, "graded_1d"), (2, "discrete_tight"), (7, "graded_1d")], "id long, kind string")
    made = {r.id: r for r in synth.drawn(rows).collect()}
    alone = {r.id: r for r in synth.repertoire(spark, "graded_1d", 8).collect()}
    assert set(made) == {2, 5, 7} and all(made[i].image == alone[i].image and made[i].duration == alone[i].duration for i in (5, 7))
    assert made[2].kind == "discrete_tight" and made[2].image != alone[2].image


def test_payloads_are_not_read_beyond_the_limit(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    audio = pa.array([{"bytes": b"RIFF1234", "path": "a"}, {"bytes": None, "path": "b"}, {"bytes": b"none", "path": "c"}])
    pq.write_table(pa.table({"id": [1, 2, 3], "audio": audio}), tmp_path / "small.parquet")
    large = [{"bytes": b"RIFF" + np.random.default_rng(0).bytes(50_000), "path": "d"}]
    pq.write_table(pa.table({"id": [4], "audio": pa.array(large)}), tmp_path / "large.parquet")
    pq.write_table(pa.table({"id": pa.array([], pa.int64()), "audio": audio[:0]}), tmp_path / "none.parquet")
    out = tables.peek_files(spark, [str(tmp_path)], "audio.bytes", most_bytes=10_000).collect()
    named = {}
    for r in out:
        named.setdefault(r.path.rsplit("/", 1)[1], []).append((r.rows, r.bytes, r.is_magic))
    assert named["small.parquet"] == [(3, 8, True), (3, None, None), (3, 4, False)]
    assert named["large.parquet"] == [(1, None, None)] and named["none.parquet"] == [(0, None, None)]
    assert next(r for r in out if "large" in r.path).group_bytes > 50_000
    # with a higher limit it is read
    assert [r.is_magic for r in tables.peek_files(spark, [str(tmp_path / "large.parquet")], "audio.bytes").collect()] == [True]
