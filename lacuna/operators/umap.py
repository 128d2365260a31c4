"""A layout of a point cloud in few dimensions that keeps neighbours near: uniform manifold approximation and projection.

The fuzzy neighbour graph. Each point gets a distance rho, to its nearest other point, and a bandwidth sigma so that the weights
exp(-max(0, d - rho) / sigma) of its k nearest sum to log2(k), by bisection. The weights of the two directions of an edge are
joined as chances that at least one holds, a + b - ab.

The layout begins with the principal components and is moved in epochs: sampled edges (as often as their weight says) attract their
ends, and for each such edge its first end is repelled by ``REPELLED`` random points, with steps that shrink from 1 to 0.

How it runs. Points are dealt into blocks of about ``BLOCK_POINTS`` by a hash that changes from round to round. A task moves the
points of its block over some epochs, with the neighbours in other blocks standing where the last round left them; since a block
is a random part of the set, the points that repel are drawn from it. A set of one block is done in one round. Between rounds only
positions and edges move, a row an edge, and what a task holds is bounded by the block and its edges (a point with very many
neighbours has a row for each). All draws are seeded by round, block and epoch, and rows are sorted first, so reruns agree.

Defined results. Identical points: rho is 0 and they attract fully. Sets of fewer than ``k`` + 1 points take what neighbours there
are; a point without any stays at its beginning, and an empty cloud has an empty layout.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.checkpoints import written
from lacuna.operators.clusters import pca
from lacuna.operators.neighbors import knn

K = 15
MIN_DIST, SPREAD = 0.1, 1.0
REPELLED = 5
EPOCHS = 200
ROUNDS = 20
BLOCK_POINTS = 20_000
#: The sampled edges of an epoch are taken in so many parts, one after the other, so that a point's pulls don't add up beyond their ends.
PARTS = 16
EXTENT = 10.0
STEP_MOST = 4.0


def bandwidths(d: np.ndarray, rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """rho and sigma of points from a row of distances to their nearest each (nan: none)."""
    rho = np.where(np.isnan(d).all(axis=1), 0.0, np.nanmin(np.where(np.isnan(d), np.inf, d), axis=1))
    beyond = np.maximum(d - rho[:, None], 0.0)
    want = np.log2(np.maximum((~np.isnan(d)).sum(axis=1), 1) + 1)
    low, high = np.zeros(len(d)), np.full(len(d), np.inf)
    sigma = np.ones(len(d))
    for _ in range(rounds):
        mass = np.nansum(np.exp(-beyond / sigma[:, None]), axis=1)
        high, low = np.where(mass > want, sigma, high), np.where(mass > want, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    # a floor, as all weights of equal distances would be 1 however small sigma is
    spread = np.nan_to_num(np.where(np.isnan(d).all(axis=1), 1.0, np.nansum(d, axis=1) / np.maximum((~np.isnan(d)).sum(axis=1), 1)))
    return rho, np.maximum(sigma, 1e-3 * np.where(spread > 0, spread, 1.0))


def fuzzy_graph(neighbors: DataFrame, k: int = K) -> DataFrame:
    """(set_id, i, j, w) for i < j: the symmetric weights of the edges to the k - 1 nearest others (the point itself is the k-th)."""
    near = neighbors.where(F.col("rank") < k).groupBy("set_id", "i").agg(F.sort_array(F.collect_list(F.struct("rank", "j", "d"))).alias("n"))
    near = near.select("set_id", "i", F.col("n.j").alias("j"), F.col("n.d").alias("d"))

    def weigh(batches):
        for rows in batches:
            if not len(rows):
                continue
            sizes = rows["d"].map(len).to_numpy()
            d = np.full((len(rows), sizes.max()), np.nan)
            for r, x in enumerate(rows["d"]):
                d[r, : len(x)] = x
            rho, sigma = bandwidths(d)
            w = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None])[~np.isnan(d)]
            yield pd.DataFrame({"set_id": np.repeat(rows["set_id"].to_numpy(), sizes), "i": np.repeat(rows["i"].to_numpy(), sizes), "j": np.concatenate(rows["j"].to_numpy()), "w": w})

    weights = near.mapInPandas(weigh, "set_id string, i long, j long, w double")
    pair = weights.select("set_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    both = pair.groupBy("set_id", "i", "j").agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count("*").alias("n"))
    return both.select("set_id", "i", "j", F.when(F.col("n") == 2, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))


def curve(min_dist: float = MIN_DIST, spread: float = SPREAD) -> tuple[float, float]:
    """a and b of 1 / (1 + a x^2b), fitted to 1 up to ``min_dist`` and an exponential of scale ``spread`` beyond, by Gauss and Newton."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(100):
        power = x ** (2 * b)
        got = 1 / (1 + a * power)
        slope = np.stack([-(got**2) * power, -(got**2) * a * power * 2 * np.log(x)], axis=1)
        step, *_ = np.linalg.lstsq(slope, want - got, rcond=None)
        a, b = max(a + step[0], 1e-3), max(b + step[1], 1e-3)
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


def moved(y: np.ndarray, fixed: np.ndarray, source: np.ndarray, target: np.ndarray, chance: np.ndarray, epochs: range, total: int, seed: list[int], a: float, b: float) -> np.ndarray:
    """Points ``y`` after some epochs. An edge leads from a point to another (from ``len(y)`` on: a fixed one) and is drawn by its chance."""
    y, n = y.copy(), len(y)
    for epoch in epochs:
        draw = np.random.default_rng([*seed, epoch])
        taken = np.flatnonzero(draw.random(len(source)) < chance)
        draw.shuffle(taken)
        rate = 1 - epoch / total
        for part in np.array_split(taken, PARTS):
            s, t = source[part], target[part]
            to = np.where(t[:, None] < n, y[np.minimum(t, n - 1)], fixed[np.maximum(t - n, 0)]) if len(fixed) else y[t]
            step = np.zeros_like(y)
            gap = y[s] - to
            square = (gap**2).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                pull = np.where(square > 0, -2 * a * b * square ** (b - 1) / (1 + a * square**b), 0.0)
            np.add.at(step, s, 2 * np.clip(pull[:, None] * gap, -STEP_MOST, STEP_MOST))
            for _ in range(REPELLED):
                other = draw.integers(0, n, len(s))
                gap = y[s] - y[other]
                square = (gap**2).sum(axis=1)
                push = np.where(other == s, 0.0, 2 * b / ((0.001 + square) * (1 + a * square**b)))
                np.add.at(step, s, np.clip(push[:, None] * gap, -STEP_MOST, STEP_MOST))
            y += rate * step
    return y


def layout(graph: DataFrame, start: DataFrame, epochs: int = EPOCHS, rounds: int = ROUNDS, block: int = BLOCK_POINTS, seed: int = 0, min_dist: float = MIN_DIST) -> DataFrame:
    """(set_id, id, z): the points of ``start`` (set_id, id, z) moved along the edges of ``graph``."""
    spark = start.sparkSession
    folder = f"umap-{uuid.uuid4().hex}"
    a, b = curve(min_dist)
    most = graph.groupBy("set_id").agg(F.max("w").alias("most"))
    both = graph.unionByName(graph.select("set_id", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    edges = written(both.join(most, "set_id").select("set_id", "i", "j", (F.col("w") / F.col("most")).alias("chance")), f"{folder}/edges")
    places = written(start.select("set_id", "id", F.col("z").alias("y")), f"{folder}/start")
    sizes = written(places.groupBy("set_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), f"{folder}/sizes")
    if (sizes.agg(F.max("blocks")).first()[0] or 1) == 1:
        rounds = 1
    for r in range(rounds):
        span = range(epochs * r // rounds, epochs * (r + 1) // rounds)
        own = places.join(sizes, "set_id").withColumn("b", F.pmod(F.xxhash64("id", F.lit(r + seed * 1000)), "blocks").cast("int")).drop("blocks")
        ends = edges.join(own.select("set_id", F.col("id").alias("i"), "b"), ["set_id", "i"]).join(places.select("set_id", F.col("id").alias("j"), F.col("y").alias("to")), ["set_id", "j"])

        def run(key: tuple, points: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
            points, links = points.sort_values("id"), links.sort_values(["i", "j"])
            ids, y = points["id"].to_numpy(), np.array(points["y"].tolist(), float).reshape(len(points), -1)
            if len(links):
                others = links[~links["j"].isin(ids)].drop_duplicates("j").sort_values("j")
                fixed = np.array(others["to"].tolist(), float).reshape(len(others), y.shape[1])
                near = np.searchsorted(ids, links["j"].to_numpy())
                inside = ids[np.minimum(near, len(ids) - 1)] == links["j"].to_numpy()
                target = np.where(inside, near, len(ids) + np.searchsorted(others["j"].to_numpy(), links["j"].to_numpy()))
                y = moved(y, fixed, np.searchsorted(ids, links["i"].to_numpy()), target, links["chance"].to_numpy(), span, epochs, [seed, r, int(key[1])], a, b)
            return pd.DataFrame({"set_id": np.full(len(ids), key[0], object), "id": ids, "y": list(y)})

        fresh = [F.col(c).alias(c) for c in ("set_id", "b", "i", "j", "chance", "to")]  # columns of their own, as both sides come from one table
        dealt = own.groupBy("set_id", "b").cogroup(ends.select(*fresh).groupBy("set_id", "b"))
        places = written(dealt.applyInPandas(run, "set_id string, id long, y array<double>"), f"{folder}/round-{r}")
    return places.select("set_id", "id", F.col("y").alias("z"))


def start_from_components(cloud: DataFrame, dimensions: int = 2) -> DataFrame:
    """The first principal components of one set, scaled so that the largest coordinate is ``EXTENT``."""
    flat = pca(cloud, dimensions)
    scale = flat.groupBy("set_id").agg(F.max(F.array_max(F.transform("z", lambda x: F.abs(x)))).alias("top"))
    return flat.join(scale, "set_id").select("set_id", "id", F.transform("z", lambda x: F.coalesce(F.try_divide(x * EXTENT, F.col("top")), F.lit(0.0))).alias("z"))


def umap(cloud: DataFrame, k: int = K, dimensions: int = 2, epochs: int = EPOCHS, rounds: int = ROUNDS, block: int = BLOCK_POINTS, seed: int = 0, neighbors: DataFrame | None = None) -> DataFrame:
    """(set_id, id, z): the layout of one set in ``dimensions``."""
    near = knn(cloud, k - 1) if neighbors is None else neighbors
    return layout(fuzzy_graph(near, k), start_from_components(cloud, dimensions), epochs, rounds, block, seed)


def neighbours_kept(before: DataFrame, after: DataFrame, k: int = K) -> DataFrame:
    """(set_id, kept): the share of each point's k nearest others, mean over the points, that are so in another layout, from both's neighbours."""
    a = before.where(F.col("rank") <= k).select("set_id", "i", "j")
    b = after.where(F.col("rank") <= k).select("set_id", "i", "j", F.lit(1).alias("there"))
    return a.join(b, ["set_id", "i", "j"], "left").groupBy("set_id").agg(F.avg(F.coalesce("there", F.lit(0))).alias("kept"))
