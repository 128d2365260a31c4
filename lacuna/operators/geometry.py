"""Convex hulls and Hopkins' statistic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.checkpoints import cut
from lacuna.operators.neighbors import BLOCK, knn, matrix, nearest


def outline(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The hull's corners counter-clockwise from the leftmost lowest; points on its edges are left out."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def chain(run: list) -> list:
        out: list = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(points) + chain(points[::-1])


def convex_hull(cloud: DataFrame, block: int = BLOCK) -> DataFrame:
    """(set_id, corner, x, y) of sets in the plane: hulls of blocks first, then the hull of their corners."""

    def hull(rows: pd.DataFrame) -> pd.DataFrame:
        found = outline(list(zip(rows["x"], rows["y"], strict=True)))
        return pd.DataFrame({"set_id": rows["set_id"].iloc[0], "corner": np.arange(len(found)), "x": [p[0] for p in found], "y": [p[1] for p in found]})

    schema = "set_id string, corner long, x double, y double"
    flat = cloud.select("set_id", "id", F.col("z")[0].alias("x"), F.col("z")[1].alias("y"))
    sizes = flat.groupBy("set_id").agg(F.ceil(F.count("*") / block).alias("_n"))
    dealt = flat.join(sizes, "set_id").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
    return dealt.groupBy("set_id", "_b").applyInPandas(hull, schema).groupBy("set_id").applyInPandas(hull, schema)


def facets(points: np.ndarray) -> np.ndarray:
    """The half-spaces of the hull of points in space, as rows (normal, offset): x is inside where normal . x <= offset. Flat sets: no rows.

    Points are added one by one: the facets that see the new one go, and it is joined to the edges around the gap.
    """
    points = np.unique(points, axis=0)
    scale = np.ptp(points, axis=0).max() if len(points) else 0.0
    near = 1e-10 * scale
    flat = np.zeros((0, 4))
    if len(points) < 4 or not scale:
        return flat
    a = points[0]
    b = points[((points - a) ** 2).sum(axis=1).argmax()]
    across = np.linalg.norm(np.cross(points - a, b - a), axis=1)
    c = points[across.argmax()]
    normal = np.cross(b - a, c - a)
    height = (points - a) @ normal
    d = points[np.abs(height).argmax()]
    if np.abs(height).max() <= near * max(np.linalg.norm(normal), near):
        return flat
    middle = (a + b + c + d) / 4

    def plane(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        n = np.cross(q - p, r - p)
        length = np.linalg.norm(n)
        n = n / length if length else n
        return np.append(n, n @ p) if n @ middle <= n @ p else np.append(-n, -(n @ p))

    corner = [a, b, c, d]
    faces = {frozenset(t): plane(*(corner[k] for k in t)) for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))}
    for p in points:
        seen = [f for f, s in faces.items() if s[:3] @ p > s[3] + near]
        if not seen:
            continue
        corner.append(p)
        edges: dict[frozenset, int] = {}
        for f in seen:
            faces.pop(f)
            for k in f:
                edges[f - {k}] = edges.get(f - {k}, 0) + 1
        for e, times in edges.items():
            if times == 1:
                faces[e | {len(corner) - 1}] = plane(*(corner[k] for k in e), p)
    return np.array(list(faces.values()))


def facet_corners(points: np.ndarray) -> np.ndarray:
    """The points that lie on a facet of their hull; all points of a flat set."""
    found = facets(points)
    if not len(found):
        return np.unique(points, axis=0)
    slack = 1e-9 * max(np.ptp(points, axis=0).max(), 1e-300)
    return points[(points @ found[:, :3].T >= found[:, 3] - slack).any(axis=1)]


def half_spaces(cloud: DataFrame, block: int = BLOCK) -> DataFrame:
    """(set_id, planes) of sets in the plane or in space, each plane an array of the normal and the offset; flat sets have no row.

    Blocks of points first keep the points on their own hulls, and the hull of these is the set's; a set all of whose points lie
    on its hull is one task's.
    """
    first = cloud.select("z").first()
    dim = len(first.z) if first else 2
    schema = "set_id string, planes array<array<double>>"

    def flat_sides(rows: pd.DataFrame) -> pd.DataFrame:
        corners = rows.sort_values("corner")[["x", "y"]].to_numpy()
        after = np.roll(corners, -1, axis=0)
        normal = np.stack([after[:, 1] - corners[:, 1], corners[:, 0] - after[:, 0]], axis=1)
        planes = np.concatenate([normal, (normal * corners).sum(axis=1)[:, None]], axis=1) if len(corners) > 2 else np.zeros((0, 3))
        return pd.DataFrame({"set_id": [rows["set_id"].iloc[0]], "planes": [planes.tolist()]})

    if dim == 2:
        return convex_hull(cloud, block).groupBy("set_id").applyInPandas(flat_sides, schema).where(F.size("planes") > 0)

    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        found = facet_corners(matrix(rows))
        return pd.DataFrame({"set_id": np.full(len(found), rows["set_id"].iloc[0], object), "z": pd.Series(list(found), dtype=object)})

    def sides(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"set_id": [rows["set_id"].iloc[0]], "planes": [facets(matrix(rows)).tolist()]})

    sizes = cloud.groupBy("set_id").agg(F.ceil(F.count("*") / block).alias("_n"))
    dealt = cloud.join(sizes, "set_id").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
    return dealt.groupBy("set_id", "_b").applyInPandas(corners, "set_id string, z array<double>").groupBy("set_id").applyInPandas(sides, schema).where(F.size("planes") > 0)


def inside(points: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Which points lie within all half-spaces or on their edge."""
    return (points @ planes[:, :-1].T <= planes[:, -1] + 1e-12).all(axis=1)


def hopkins_test(cloud: DataFrame, share: float = 0.1, repeats: int = 20, seed: int = 7) -> DataFrame:
    """(set_id, hopkins): mean over repeats of w / (u + w); LOWER means clustered. An empty cloud has no row.

    In each repeat max(10, share * n) points, chosen by a seeded hash, give w, the summed powers of their nearest-neighbour
    distances, and as many uniform points of the hull (up to 3 dimensions) or else of the bounding box give u. The power is the dimension.
    """
    some = cloud.select("z").first()
    if some is None:
        return cloud.select("set_id", F.lit(0.0).alias("hopkins"))
    dim = len(some.z)
    counts = cloud.groupBy("set_id").agg(F.count("*").alias("n"), *[F.min(F.col("z")[k]).alias(f"lo{k}") for k in range(dim)], *[F.max(F.col("z")[k]).alias(f"hi{k}") for k in range(dim)])
    counts = counts.withColumn("m", F.greatest(F.lit(10), F.floor(F.col("n") * share)).cast("int"))
    hulls = half_spaces(cloud) if dim in (2, 3) else counts.select("set_id", F.lit(None).cast("array<array<double>>").alias("planes"))

    def draw(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, row.repeat, *row.set_id.encode()])
                lo, hi = (np.array([getattr(row, f"{c}{k}") for k in range(dim)]) for c in ("lo", "hi"))
                found = np.zeros((0, dim))
                while len(found) < row.m:
                    p = lo + rng.random((2 * row.m, dim)) * (hi - lo)
                    hull = None if row.planes is None else np.array(list(row.planes), float)
                    found = np.concatenate([found, p if hull is None else p[inside(p, hull)]])
                out += [(row.set_id, (int(row.repeat) << 40) + k, z.tolist()) for k, z in enumerate(found[: row.m])]
            yield pd.DataFrame(out, columns=["set_id", "id", "z"])

    jobs = counts.join(hulls, "set_id", "left").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    drawn = jobs.mapInPandas(draw, "set_id string, id long, z array<double>")
    cloud = cut(cloud)
    u = nearest(cut(drawn), cloud).select("set_id", F.shiftright("i", 40).alias("repeat"), "d")
    u = u.groupBy("set_id", "repeat").agg(F.sum(F.pow("d", F.lit(float(dim)))).alias("u"))
    near = knn(cloud, 1).select("set_id", F.col("i").alias("id"), "d").join(counts.select("set_id", "m"), "set_id")
    chosen = near.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("repeat"))
    w = Window.partitionBy("set_id", "repeat").orderBy(F.xxhash64("id", "repeat", F.lit(seed)), "id")
    chosen = chosen.withColumn("_r", F.row_number().over(w)).where("_r <= m").groupBy("set_id", "repeat").agg(F.sum(F.pow("d", F.lit(float(dim)))).alias("w"))
    return chosen.join(u, ["set_id", "repeat"]).groupBy("set_id").agg(F.avg(F.col("w") / (F.col("u") + F.col("w"))).alias("hopkins"))
