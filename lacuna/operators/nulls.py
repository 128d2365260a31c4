"""Calibration: largest local gaps of smooth, gap-free clouds, one Spark row for each simulated cloud.

A job is (n, dim, shape, rep). Each replicate has a seed of its own from all the parameters, so the table is the same however
its rows are dealt to tasks, and a table may be kept as Parquet and extended by further replicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.gaps import MIN_GROUP
from lacuna.operators.neighbors import K, OFFSET, framed, kth_smallest

SHAPES = ("uniform", "gauss", "exponential")
N_NULL = 200
SEED = 2026


def null_cloud(shape: str, n: int, dim: int, rng: np.random.Generator) -> np.ndarray:
    """n points without gaps in the unit cube, a normal or an exponential distribution."""
    draw = {"uniform": rng.random, "gauss": rng.standard_normal, "exponential": rng.standard_exponential}
    return draw[shape]((n, dim))


#: Points of a cell, a box of points that lie near each other; pairs of cells are looked at together.
CELL = 512
#: Clouds of more points than this list the few nearest of each point for the tree, and find the k-th only around merges of large groups.
WHOLE = 4096
#: Points by whose distances a point's density is told, in so many groups; points whose nearest are found to learn what that says; the nearest listed, about.
SAMPLE, GROUPS, PILOTS, LISTED = 1024, 8, 400, 4
#: Points whose cells in reach are told at once; pairs of points at once; and searches that widen before the nearest of others is sought.
ASKED, AT_ONCE, WIDER = 32_768, 131_072, 8


def few_of(within: np.ndarray, m: int) -> np.ndarray:
    """The places that are true among the first m, of a buffer with room for seven more: eight at a time are looked through, as there are few."""
    up = -(-m // 8) * 8
    within[m:up] = False
    eights = np.flatnonzero(within[:up].view(np.uint64))
    which, more = np.nonzero(within[:up].reshape(-1, 8)[eights])
    return eights[which] * 8 + more


def smaller_sides(u: list[int], v: list[int], n: int) -> np.ndarray:
    """For a forest's edges in order: the size of the smaller of the two groups that each one joins."""
    parent, size, out = list(range(n)), [1] * n, []
    for a, b in zip(u, v, strict=True):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if size[a] < size[b]:
            a, b = b, a
        out.append(size[b])
        parent[b] = a
        size[a] += size[b]
    return np.array(out, int)


def cells(z: np.ndarray, most: int = CELL) -> list[np.ndarray]:
    """The points dealt into cells of at most so many, halved along the coordinate that spreads most."""
    done, left = [], [np.arange(len(z))]
    while left:
        own = left.pop()
        if len(own) <= most:
            done.append(own)
            continue
        x = z[own, z[own].std(axis=0).argmax()]
        order = np.argpartition(x, len(own) // 2)
        left += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return done


class _Cells:
    """A cloud in cells: points near a cell's are found by matrix products with the cells in reach, the nearest first."""

    def __init__(self, z: np.ndarray):
        parts = cells(z)
        self.order = np.concatenate(parts)
        self.z = z[self.order]
        self.ends = np.cumsum([0, *map(len, parts)])
        self.spans = list(zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True))
        self.low, self.high = (np.array([f(self.z[a:b], axis=0) for a, b in self.spans]) for f in (np.min, np.max))
        self.left, self.right, self.error, *_ = framed(self.z, self.z)
        most = max(CELL * CELL, AT_ONCE)
        self.room, self.within = np.empty(most, np.float32), np.empty(most + 7, bool)

    def apart(self, z: np.ndarray) -> np.ndarray:
        """The squared distance of the box around z to each cell's."""
        return (np.maximum(0.0, np.maximum(self.low - z.max(axis=0), z.min(axis=0) - self.high)) ** 2).sum(axis=1)

    def near(self, own: np.ndarray, k: int, reach: np.ndarray, skip=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``own``, point, squared distance): at least the k nearest of each of up to ``CELL`` points within its squared reach.

        ``skip`` tells of a range of points which are left out for which rows.
        """
        n, slack, left = len(own), self.error[own], self.left[own]
        away = self.apart(self.z[own])
        i, j, d2 = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        looked = 0
        for part, c in enumerate(np.argsort(away, kind="stable").tolist()):
            if away[c] > (reach + slack).max():
                break
            a, b = self.spans[c]
            width = b - a
            got = np.matmul(left, self.right[a:b].T, out=self.room[: n * width].reshape(n, width))
            if skip is not None:
                got[skip(a, b)] = np.inf
            if not part and width > k:
                reach = np.minimum(reach, np.partition(got, k - 1, axis=1)[:, k - 1] + slack)
            limit = np.minimum(reach + slack, 3e38).astype(np.float32)
            flat = np.flatnonzero(np.less_equal(got, limit[:, None], out=self.within[: n * width].reshape(n, width)))
            x, y = np.divmod(flat, width)
            fresh.append((x, y + a, got.ravel()[flat]))
            if part + 1 >= 1.5 * looked:  # the k-th so far comes nearer as more is seen
                looked = part + 1
                i, j, d2 = (np.concatenate([old, *new]) for old, new in zip((i, j, d2), zip(*fresh, strict=True), strict=True))
                fresh = []
                reach = np.minimum(reach, kth_smallest(i, d2, n, k) + slack)
                kept = d2 <= reach[i] + slack[i]
                i, j, d2 = i[kept], j[kept], d2[kept]
        if fresh:
            i, j, d2 = (np.concatenate([old, *new]) for old, new in zip((i, j, d2), zip(*fresh, strict=True), strict=True))
        kept = (d2 <= reach[i] + slack[i]) & (d2 < np.inf)
        i, j = i[kept], j[kept]
        exact = np.zeros(len(i))
        at = own[i]
        for x in self.z.T:
            exact += (x[at] - x[j]) ** 2
        return i, j, exact

    def nearest(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(indices, squared distances) of the k + 1 nearest of each point, itself among them, nearest first; points by their place in cells."""
        near, square = np.empty((len(self.z), k + 1), int), np.empty((len(self.z), k + 1))
        for a, b in self.spans:
            i, j, d2 = self.near(np.arange(a, b), k + 1, np.full(b - a, np.inf))
            order = np.lexsort((j, d2, i))
            i, j, d2 = i[order], j[order], d2[order]
            first = np.searchsorted(i, np.arange(b - a))[:, None] + np.arange(k + 1)
            near[a:b], square[a:b] = j[first], d2[first]
        return near, square

    def pairs(self, own: np.ndarray, reach: np.ndarray, once: bool = False, comp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of ``own``, point, squared distance) of all points within the squared ``reach`` of each of ``own``, and of some a little farther.

        Each point meets only the cells that its own reach touches. ``once``: a pair is listed from the point of larger reach only,
        or from both if they are equal. ``comp``: points of one component don't count.
        """
        found = [(np.zeros(0, int), np.zeros(0, int))]
        right, dealt, rank = self.right, None, np.arange(len(own))
        if once:  # the points of each cell by reach: those of up to a row's reach come first
            dealt = np.lexsort((reach, np.repeat(np.arange(len(self.spans)), np.diff(self.ends))))
            right, steps, rank = self.right[dealt], reach[dealt], np.argsort(reach, kind="stable")
        most = float(self.left[:, -1].max())
        low, high = (np.array([f(self.left[a:b, :-2] * np.float32(-0.5), axis=0) for a, b in self.spans]) for f in (np.min, np.max))
        size = max(64, AT_ONCE // len(self.spans))
        room = [np.empty((len(self.spans), size), np.float32) for _ in range(3)]
        for at in range(0, len(own), ASKED):
            rows = rank[at : at + ASKED]
            mine, n = own[rows], len(rows)
            limit = (np.minimum(reach[rows], 4.1 * most) + 4 * self.error[mine]).astype(np.float32)
            x, near = self.left[mine, :-2].T * np.float32(-0.5), np.empty((len(self.spans), n), bool)
            for lo in range(0, n, size):
                hi = min(n, lo + size)
                apart, below, above = (r[:, : hi - lo] for r in room)
                apart[:] = 0.0
                for c, z in enumerate(x[:, lo:hi]):
                    np.subtract(low[:, c, None], z, out=below)
                    np.subtract(z, high[:, c, None], out=above)
                    np.maximum(np.maximum(below, above, out=below), 0.0, out=below)
                    apart += np.multiply(below, below, out=below)
                np.less_equal(apart, limit[lo:hi], out=near[:, lo:hi])
            left = self.left[mine]
            left[:, -1] -= limit
            for c, (a, b) in enumerate(self.spans):
                asked = np.flatnonzero(near[c])
                step, part = max(1, AT_ONCE // (b - a)), left[asked]
                for r in range(0, len(asked), step):
                    some = part[r : r + step]
                    width = b - a if not once else int(np.searchsorted(steps[a:b], reach[rows[asked[min(r + step, len(asked)) - 1]]], side="right"))
                    m = len(some) * width
                    if not m:
                        continue
                    got = np.matmul(some, right[a : a + width].T, out=self.room[:m].reshape(len(some), width))
                    np.less(got, 0.0, out=self.within[:m].reshape(len(some), width))
                    i, j = np.divmod(few_of(self.within, m), width)
                    i, j = rows[asked[r + i]], j + a if dealt is None else dealt[j + a]
                    if comp is not None:
                        other = comp[own[i]] != comp[j]
                        i, j = i[other], j[other]
                    if len(i):
                        found.append((i, j))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        exact, at = np.zeros(len(i)), own[i]
        for x in self.z.T:
            exact += (x[at] - x[j]) ** 2
        return i, j, exact

    def learn(self, k: int) -> None:
        """Learns from some points how far their up to ``k`` nearest others are, by the distances to a sample, for ``reach_of``."""
        n = len(self.z)
        m = min(SAMPLE, n // 8) // GROUPS * GROUPS
        some = (np.arange(m) * n // m).reshape(-1, GROUPS).T.ravel()
        right, column = self.right[some].T, np.full(n, -1)
        column[some] = np.arange(m)
        self.level = np.empty(n)
        for at in range(0, n, 128):
            got = np.matmul(self.left[at : at + 128], right)
            itself = np.flatnonzero(column[at : at + 128] >= 0)
            got[itself, column[at + itself]] = np.inf
            self.level[at : at + 128] = np.log(np.maximum(got.reshape(len(got), GROUPS, -1).min(axis=2), 1e-30)).mean(axis=1)
        pilots = (2 * np.arange(PILOTS) + 1) * n // (2 * PILOTS)
        found = []
        for at in range(0, PILOTS, 100):
            own = pilots[at : at + 100]
            i, _, d2 = self.near(own, k + 1, np.full(len(own), np.inf))
            order = np.lexsort((d2, i))
            found.append(d2[order][np.searchsorted(i[order], np.arange(len(own)))[:, None] + np.arange(k + 1)])
        self.known = self.level[pilots], np.log(np.maximum(np.concatenate(found), 1e-30))

    def reach_of(self, own: np.ndarray, k: int, share: float) -> np.ndarray:
        """About the squared distance within which each of ``own`` has its k nearest others, for such a share of points."""
        level, far = self.known[0], self.known[1][:, k]
        slope, base = np.polyfit(level, far, 1)
        return np.exp(base + slope * self.level[own] + np.quantile(far - base - slope * level, share))

    def some_nearest(self, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(indices, squared distances) of the k + 1 nearest of some points, themselves among them, nearest first, in reaches that widen."""
        near, square = np.empty((len(own), k + 1), int), np.empty((len(own), k + 1))
        left, reach = np.arange(len(own)), self.reach_of(own, k, 0.9)
        while len(left):
            i, j, d2 = self.pairs(own[left], reach)
            kept = d2 <= reach[i]
            i, j, d2 = i[kept], j[kept], d2[kept]
            order = np.lexsort((j, d2, i))
            many = np.bincount(i, minlength=len(left))
            there = many > k
            first = order[(np.cumsum(many) - many)[there][:, None] + np.arange(k + 1)]
            near[left[there]], square[left[there]] = j[first], d2[first]
            left, reach = left[~there], reach[~there] * 2.0 ** (2 / self.z.shape[1])
        return near, square

    def tree(self, u: np.ndarray, v: np.ndarray, d2: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(squared length, u, v) of the spanning tree, from listed pairs: all of a point that are shorter than its ``beyond``.

        A component takes its best edge of those listed, which is the best of all unless some point of it has its whole list within
        the component and nearer than that edge. Where only such components and the largest are left, the others' points are searched.
        """
        n, searches = len(self.z), 0
        u, v, d2 = u[u != v], v[u != v], d2[u != v]
        order = np.argsort(d2, kind="stable")
        u, v, d2 = u[order], v[order], d2[order]
        beyond, comp, edges = beyond.copy(), np.arange(n), []
        while True:
            names, comp = np.unique(comp, return_inverse=True)
            m = len(names)
            if m == 1:
                break
            open_ = comp[u] != comp[v]
            u, v, d2 = u[open_], v[open_], d2[open_]
            best, back = np.full((2, m), len(u)), np.arange(len(u))[::-1]
            best[0, comp[u[::-1]]], best[1, comp[v[::-1]]] = back, back  # the last that is written is the first of the component
            best = best.min(axis=0)
            length = np.append(d2, np.inf)[best]
            unseen = np.full(m, np.inf)
            np.minimum.at(unseen, comp, beyond)
            sure = unseen > length
            if not sure.any():
                searches += 1
                more = (self.wider if searches <= WIDER else self.outward)(comp, beyond, length)
                u, v, d2 = (np.concatenate(c) for c in zip((u, v, d2), more, strict=True))
                order = np.argsort(d2, kind="stable")
                u, v, d2 = u[order], v[order], d2[order]
                continue
            picked = np.unique(best[sure])
            edges.append((d2[picked], u[picked], v[picked]))
            # each sure component hangs on the other end's; of two that hang on each other the smaller is the top
            top = np.arange(m)
            own = np.flatnonzero(sure)
            x, y = comp[u[best[own]]], comp[v[best[own]]]
            top[own] = np.where(x == own, y, x)
            both = (top[top] == np.arange(m)) & (np.arange(m) < top)
            top[both] = np.flatnonzero(both)
            while not (top[top] == top).all():
                top = top[top]
            comp = top[comp]
        return tuple(np.concatenate(c) for c in zip(*edges, strict=True)) if edges else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))

    def wider(self, comp: np.ndarray, beyond: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, squared length): edges to points of other components, of four times the volume seen before, for those whose lists leave it open."""
        asked = np.flatnonzero((comp != np.bincount(comp).argmax()) & (beyond <= length[comp]))
        reach = np.minimum(length[comp[asked]] * (1 + 1e-12), beyond[asked] * 4.0 ** (2 / self.z.shape[1]))
        i, j, d2 = self.pairs(asked, reach, comp=comp)
        beyond[asked] = np.nextafter(reach, np.inf)
        return asked[i], j, d2

    def outward(self, comp: np.ndarray, beyond: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, v, squared length): edges to the nearest point of another component, for points of all but the largest whose lists leave it open."""
        large = np.bincount(comp).argmax()
        asked = np.flatnonzero((comp != large) & (beyond <= length[comp]))
        us, vs, ds = [], [], []
        for a in range(0, len(asked), CELL):
            own = asked[a : a + CELL]
            i, j, d2 = self.near(own, 1, length[comp[own]] * (1 + 1e-12), lambda lo, hi, own=own: comp[own][:, None] == comp[None, lo:hi])
            other = comp[own[i]] != comp[j]
            i, j, d2 = i[other], j[other], d2[other]
            # what is not listed now is farther than the nearest found or, if none is, than the component's edge
            nearest = length[comp[own]].copy()
            np.minimum.at(nearest, i, d2)
            beyond[own] = np.nextafter(nearest, np.inf)
            us.append(own[i]), vs.append(j), ds.append(d2)
        return np.concatenate(us), np.concatenate(vs), np.concatenate(ds)


def listed(near: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``tree`` takes, from the nearest of each point."""
    return np.repeat(np.arange(len(near)), near.shape[1]), near.ravel(), square.ravel(), square[:, -1]


def nearest(z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each point the indices of its k nearest others and itself, and the distance of the farthest of them plus the offset."""
    cloud = _Cells(z)
    near, square = cloud.nearest(k)
    back = np.argsort(cloud.order)
    return cloud.order[near][back], (np.sqrt(square[:, -1]) + OFFSET)[back]


def tree_edges(z: np.ndarray, k: int = K) -> list[tuple[float, int, int]]:
    """The spanning tree (length plus the offset, u, v)."""
    cloud = _Cells(z)
    near, square = cloud.nearest(min(k, len(z) - 1))
    d2, u, v = cloud.tree(*listed(near, square))
    return list(zip((np.sqrt(d2) + OFFSET).tolist(), cloud.order[u].tolist(), cloud.order[v].tolist(), strict=True))


def largest_gap(z: np.ndarray, k: int = K, min_group: int = MIN_GROUP) -> float:
    """The largest local gap of one simulated cloud; 0 without a merge of two large groups. Memory grows with n, not n squared.

    The tree needs few neighbours of each point, and only points around merges of large groups need their k nearest. Of those merges,
    the ones are measured whose gap may be the largest, by radii that are too small.
    """
    n = len(z)
    if n <= k:
        raise ValueError(f"a cloud needs more than {k} points")
    cloud = _Cells(z)
    if n <= WHOLE:
        near, square = cloud.nearest(k)
        u, v, d2, beyond = listed(near, square)
    else:
        cloud.learn(max(k, LISTED))
        beyond = cloud.reach_of(np.arange(n), LISTED, 0.5)
        u, v, d2 = cloud.pairs(np.arange(n), beyond, once=True)
        seen = sum(np.bincount(c[(d2 <= beyond[c]) & (u != v)], minlength=n) for c in (u, v))  # others within beyond, some of them twice
    d2, u, v = cloud.tree(u, v, d2, beyond)
    order = np.argsort(d2, kind="stable")
    w, u, v = np.sqrt(d2[order]) + OFFSET, u[order], v[order]
    large = np.flatnonzero(smaller_sides(u.tolist(), v.tolist(), n) >= min_group)
    if n <= WHOLE:
        radius, place = np.sqrt(square[:, -1]) + OFFSET, np.arange(n)
    else:
        ends, place = np.unique(np.concatenate([u[large], v[large]])), np.zeros(n, int)
        near, square = cloud.some_nearest(ends, k)
        place[ends] = np.arange(len(ends))
        radius, exact = np.where(seen < k, np.sqrt(beyond) * (1 - 1e-12), 0.0) + OFFSET, np.zeros(n, bool)
        radius[ends], exact[ends] = np.sqrt(square[:, -1]) + OFFSET, True
    around = [np.union1d(near[place[u[e]]], near[place[v[e]]]) for e in large]
    gaps = np.array([w[e] / np.median(radius[at]) for e, at in zip(large, around, strict=True)])
    if n <= WHOLE:
        return float(gaps.max(initial=0.0))
    best, at, many, order = 0.0, 0, 32, np.argsort(-gaps, kind="stable")
    while at < len(order) and gaps[order[at]] >= best:
        some = order[at : at + many].tolist()
        asked = np.unique(np.concatenate([around[e] for e in some]))
        asked = asked[~exact[asked]]
        if len(asked):
            radius[asked], exact[asked] = np.sqrt(cloud.some_nearest(asked, k)[1][:, -1]) + OFFSET, True
        best = max(best, *(w[large[e]] / np.median(radius[around[e]]) for e in some))
        at, many = at + many, 2 * many
    return float(best)


def null_table(spark: SparkSession, cells: list[tuple[int, int]], n_null: int = N_NULL, shapes: tuple[str, ...] = SHAPES, k: int = K, min_group: int = MIN_GROUP, seed: int = SEED) -> DataFrame:
    """(n, dim, shape, rep, max_gap) for each cell (n, dim), shape and replicate."""
    jobs = spark.createDataFrame([(n, d) for n, d in sorted(set(cells))], "n int, dim int")
    jobs = jobs.select("n", "dim", F.posexplode(F.array(*[F.lit(s) for s in shapes])).alias("_s", "shape")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_null - 1))).alias("rep"))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [largest_gap(null_cloud(s, n, d, np.random.default_rng([seed, n, d, shapes.index(s), r])), k, min_group) for n, d, s, r in batch.itertuples(index=False)]
            yield batch.assign(max_gap=found)

    # large clouds have a task each, and small ones share some; the clouds of each cell and shape go to one task after the other
    many = len(set(cells)) * len(shapes) * n_null
    tasks = max(1, min(many if max((n for n, _ in cells), default=0) > WHOLE else many // 8, 10_000))
    dealt = jobs.repartitionById(tasks, F.pmod(F.xxhash64("n", "dim") + F.col("_s") * n_null + F.col("rep"), F.lit(tasks)).cast("int")).drop("_s")
    return dealt.mapInPandas(simulate, "n int, dim int, shape string, rep int, max_gap double")


def cached_null_table(spark: SparkSession, path: str, cells: list[tuple[int, int]], n_null: int = N_NULL, shapes: tuple[str, ...] = SHAPES, k: int = K, min_group: int = MIN_GROUP, seed: int = SEED) -> DataFrame:
    """The table from ``path``, to which cells not yet there are added. All parameters are part of the key."""
    key = {"n_null": n_null, "k": k, "min_group": min_group, "seed": seed}
    try:
        kept = spark.read.parquet(path).where(" and ".join(f"{c} = {v}" for c, v in key.items()))
        have = {(r.n, r.dim) for r in kept.select("n", "dim").distinct().collect()}
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        have = set()
    missing = [c for c in cells if c not in have]
    if missing:
        made = null_table(spark, missing, n_null, shapes, k, min_group, seed)
        made.withColumns({c: F.lit(v) for c, v in key.items()}).write.mode("append").partitionBy("n", "dim").parquet(path)
    wanted = spark.createDataFrame(sorted(set(cells)), "n int, dim int")
    kept = spark.read.parquet(path).where(" and ".join(f"{c} = {v}" for c, v in key.items()))
    return kept.join(F.broadcast(wanted), ["n", "dim"]).select("n", "dim", "shape", "rep", "max_gap")


def null_quantiles(nulls: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(shape, dim, q50, q95, q99): quantiles of the largest gaps of each cell."""
    return nulls.groupBy("shape", "dim").agg(*[F.percentile("max_gap", F.lit(q)).alias(f"q{round(100 * q)}") for q in quantiles])


def shape_invariance(nulls: DataFrame, quantile: float = 0.95) -> DataFrame:
    """(dim, ratio): largest over smallest quantile of the shapes; near 1 if the null doesn't depend on the shape."""
    cells = nulls.groupBy("dim", "shape").agg(F.percentile("max_gap", F.lit(quantile)).alias("q"))
    return cells.groupBy("dim").agg((F.max("q") / F.min("q")).alias("ratio"))
