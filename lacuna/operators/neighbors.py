"""Pairwise distances, nearest neighbours and intrinsic dimension of point clouds.

A cloud is rows (set_id, id, z): many sets in one table, each its own cloud, z an ``array<double>``. Points of a set are dealt
into blocks by a hash of their id, and every block meets every block of the set in a task of its own (``block_pairs``), so
that no task has a set. Distances are made from differences, not from expanded squares, and sums run in order of the coordinates,
so results equal those of SQL. Searches for the nearest rule out most pairs first, by expanded squares and a bound on their error.

A search (``nearest``) takes a set's points in parts, a task each, by which all points of the set stream in stretches, and passes only
the result on. In few dimensions parts and stretches are in order of place, and leaves that lie too far away are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.checkpoints import cut

K = 15
BLOCK = 1024
#: A search takes a set in so many parts or more, so that there are tasks for all cores, each of at most so many points.
PARTS, PART_POINTS = 12, 65_536
#: Pairs of blocks are dealt into tasks of about so many pairs of points, but so many tasks at least and at most.
TASK_PAIRS, LEAST_TASKS, MOST_TASKS = 50_000_000, 24, 2000
#: Pairs whose distances are made at once, as caches hold them; in a search, rows and columns.
CACHED, ROWS, COLUMNS = 65_536, 512, 4096
#: A search by streams takes a set in so many parts or more, and points stream in stretches of about so many coordinates.
STREAMS, STRETCH = 24, 524_288
#: Rows that a task passes on at once.
TASK_ROWS = 524_288
#: In so many dimensions at most, points are put in order of place, in leaves of at most so many.
FEW, LEAF = 4, 256
OFFSET = 1e-9  # keeps duplicate points apart from missing edges
LOG_OFFSET = 1e-12


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays, within the generated code of the JVM."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def points(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", set_col: str | None = None) -> DataFrame:
    """(set_id, id, z) of any table with an id and an array column; FLOAT becomes DOUBLE before any distance."""
    own = F.col(set_col).cast("string") if set_col else F.lit("all")
    return df.select(own.alias("set_id"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("z"))


def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, summed coordinate by coordinate, for as many rows at once as caches hold."""
    total = np.zeros((len(a), len(b)))
    rows = max(1, CACHED // max(len(b), 1))
    for k in range(0, len(a), rows):
        part = total[k : k + rows]
        step = np.empty_like(part)
        for x, y in zip(a[k : k + rows].T, b.T, strict=True):
            np.subtract(x[:, None], y[None, :], out=step)
            np.multiply(step, step, out=step)
            part += step
    return np.sqrt(total, out=total)


def framed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (-2a, 1, a^2) and (b, b^2, 1), whose products are squared distances, in single precision around the middle of b; the error of
    a row's products; and which rows of a and of b are too large for that, or not finite."""
    odd_a, odd_b = ~(np.abs(a) < 1e14).all(axis=1), ~(np.abs(b) < 1e14).all(axis=1)
    middle = b[~odd_b].mean(axis=0) if not odd_b.all() else np.zeros(b.shape[1])
    a, b = np.where(odd_a[:, None], 0.0, a - middle), np.where(odd_b[:, None], 0.0, b - middle)
    own, others = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 2 * (a.shape[1] + 8) * np.finfo(np.float32).eps * (own + others.max(initial=0.0)) + 1e-36
    left = np.concatenate([-2 * a, np.ones((len(a), 1)), own[:, None]], axis=1).astype(np.float32)
    right = np.concatenate([b, others[:, None], np.ones((len(b), 1))], axis=1).astype(np.float32)
    return left, right, error, odd_a, odd_b


def kth_smallest(i: np.ndarray, d2: np.ndarray, n: int, k: int) -> np.ndarray:
    """About the k-th smallest d2, 0 at least, of each row 0 to n - 1 among those listed; infinite where there are fewer."""
    scale = 2.0 * float(d2.max(initial=0.0)) + 1e-30
    key = np.sort(i + np.maximum(d2, 0.0) / scale)  # below a half beyond the row's number
    many = np.bincount(i, minlength=n)
    at, there = np.cumsum(many) - many + k - 1, many >= k
    out = np.full(n, np.inf)
    out[there] = (key[at[there]] - np.flatnonzero(there)) * scale
    return out


def closest(a: np.ndarray, b: np.ndarray, k: int, skipped: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance): for each row of a the k nearest rows of b at a finite distance, by distance and row, as ``square`` has them.

    ``skipped`` tells for some rows of a which rows of b don't count. Squared distances in single precision, which are matrix products,
    rule out what lies farther than the k-th so far by more than their error; what is left, equal distances included, is measured exactly.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore", invalid="ignore"):
        left, right, error, odd_a, odd_b = framed(a, b)
        always = np.flatnonzero(odd_b)
        room, within = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS, bool)  # used again: fresh memory costs more than the products
        for at in range(0, len(a), ROWS):
            here = slice(at, min(at + ROWS, len(a)))
            n, slack = here.stop - at, error[here]
            out = skipped(here) if skipped else None
            reach, looked = np.full(n, np.inf), 0
            i, j, d2 = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
            for part, lo in enumerate(range(0, len(b), COLUMNS)):
                width = min(COLUMNS, len(b) - lo)
                near = np.matmul(left[here], right[lo : lo + width].T, out=room[: n * width].reshape(n, width))
                if len(always):
                    near[:, odd_b[lo : lo + COLUMNS]] = np.inf
                if out is not None:
                    near[out[:, lo : lo + COLUMNS]] = np.inf
                if not part and width > k:
                    reach = np.partition(near, k - 1, axis=1)[:, k - 1] + slack
                limit = np.where(odd_a[here], 3e38, np.minimum(reach + slack, 3e38)).astype(np.float32)
                flat = np.flatnonzero(np.less_equal(near, limit[:, None], out=within[: n * width].reshape(n, width)))
                x, y = np.divmod(flat, width)
                i, j, d2 = np.concatenate([i, x]), np.concatenate([j, y + lo]), np.concatenate([d2, near.ravel()[flat]])
                if part + 1 >= 2 * looked:  # the k-th so far comes nearer as more is seen
                    looked = part + 1
                    reach = np.minimum(reach, kth_smallest(i, d2, n, k) + slack)
            kept = (d2 <= reach[i] + slack[i]) | odd_a[here][i]
            i, j = np.concatenate([i[kept], np.repeat(np.arange(n), len(always))]), np.concatenate([j[kept], np.tile(always, n)])
            if out is not None:
                i, j = i[~out[i, j]], j[~out[i, j]]
            i += at
            d = np.zeros(len(i))
            for x, y in zip(a.T, b.T, strict=True):
                d += (x[i] - y[j]) ** 2
            d = np.sqrt(d)
            i, j, d = i[np.isfinite(d)], j[np.isfinite(d)], d[np.isfinite(d)]
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            found.append((i[place < k], j[place < k], d[place < k]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def leaves(n: int, size: int) -> list[slice]:
    """A sequence of n halved until no part has more than ``size``."""
    parts = 1
    while n > parts * size:
        parts *= 2
    ends = np.arange(parts + 1) * n // parts
    return [slice(int(lo), int(hi)) for lo, hi in zip(ends, ends[1:], strict=False) if hi > lo]


def by_place(z: np.ndarray, size: int) -> np.ndarray:
    """An order in which the ``leaves`` of the points lie apart: each half is cut in the middle of its widest coordinate."""
    n, parts = len(z), 1
    order = np.arange(n)
    while n > parts * size:
        ends = np.arange(2 * parts + 1) * n // (2 * parts)
        for lo, middle, hi in zip(ends[:-1:2], ends[1::2], ends[2::2], strict=True):
            own = order[lo:hi]
            if len(own) > 1:
                order[lo:hi] = own[np.argpartition(z[own, np.ptp(z[own], axis=0).argmax()], middle - lo)]
        parts *= 2
    return order


def few_true(near: np.ndarray, limit: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is within its row's limit: eight at a time are looked through, as there are few."""
    n, width = near.shape
    padded = -(-width // 8) * 8
    within = room[: n * padded].reshape(n, padded)
    within[:, width:] = False
    np.less_equal(near, limit[:, None], out=within[:, :width])
    eights = np.flatnonzero(within.reshape(-1).view(np.uint64))
    which, more = np.nonzero(within.reshape(-1, 8)[eights])
    return np.divmod(eights[which] * 8 + more, padded)


class Nearest:
    """The ``k`` nearest, by (d, id), of some points among others that come stretch by stretch; ``apart``: points of the same id don't count.

    What is kept is k rows a point, and pairs within the k-th distance so far and the error of single precision, which are measured
    exactly and sorted in when they are as many. In few dimensions the others come in order of place (``by_place``).
    """

    def __init__(self, ids: np.ndarray, z: np.ndarray, k: int, apart: bool):
        self.few = z.shape[1] <= FEW
        order = by_place(z, LEAF) if self.few else np.arange(len(z))
        self.ids, self.z, self.k, self.apart = ids[order], z[order], k, apart
        self.sorted_ids = np.sort(ids)
        self.groups = leaves(len(z), LEAF if self.few else ROWS)
        self.reach = np.full(len(z), np.inf)  # the square of the k-th distance so far
        self.kept: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in self.groups]
        self.waiting = [0] * len(self.groups)
        self.room = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS, bool)  # used again: fresh memory costs more than the products

    def away(self, y: np.ndarray, cuts: list[slice]) -> np.ndarray:
        """The least square of a distance between the boxes around the groups and around the leaves."""
        box = lambda z, parts: (np.array([z[p].min(axis=0) for p in parts]), np.array([z[p].max(axis=0) for p in parts]))
        (low, high), (lo, hi) = box(self.z, self.groups), box(y, cuts)
        gap = np.maximum(np.maximum(lo[None] - high[:, None], low[:, None] - hi[None]), 0.0)
        return (gap * gap).sum(axis=2) * (1 - 1e-9)

    def see(self, theirs: np.ndarray, y: np.ndarray) -> None:
        """Takes the points (ids ``theirs``, coordinates ``y``) into account."""
        with np.errstate(over="ignore", invalid="ignore"):
            left, right, error, odd_a, odd_b = framed(self.z, y)
            own = np.searchsorted(self.sorted_ids, theirs, side="right") > np.searchsorted(self.sorted_ids, theirs) if self.apart else np.zeros(len(y), bool)
            same = int(np.unique(theirs[own], return_counts=True)[1].max(initial=0))
            cuts, always = leaves(len(y), LEAF if self.few else COLUMNS), np.flatnonzero(odd_b)
            away = self.away(y, cuts) if self.few and not odd_a.any() and not odd_b.any() else None
            for g, here in enumerate(self.groups):
                n, slack, k = here.stop - here.start, error[here], self.k + same
                for c in range(len(cuts)) if away is None else np.argsort(away[g], kind="stable"):
                    if away is not None and away[g, c] > self.reach[here].max():
                        break
                    cut_, width = cuts[c], cuts[c].stop - cuts[c].start
                    near = np.matmul(left[here], right[cut_].T, out=self.room[0][: n * width].reshape(n, width))
                    if len(always):
                        near[:, odd_b[cut_]] = np.inf
                    limit = self.reach[here] + slack
                    if width > k and np.isinf(limit).any():
                        limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack)
                    limit = np.where(odd_a[here], 3e38, np.minimum(limit, 3e38)).astype(np.float32)
                    i, j = few_true(near, limit, self.room[1])
                    if len(i):
                        self.take(g, i + here.start, j + cut_.start, theirs, y)
                if len(always):
                    self.take(g, np.repeat(np.arange(here.start, here.stop), len(always)), np.tile(always, n), theirs, y)

    def take(self, g: int, i: np.ndarray, j: np.ndarray, theirs: np.ndarray, y: np.ndarray) -> None:
        """Measures pairs of a point of group g and one of y exactly."""
        if self.apart:
            other = self.ids[i] != theirs[j]
            i, j = i[other], j[other]
        d = np.zeros(len(i))
        for at in range(0, len(i) if y.shape[1] else 0, CACHED):
            step = self.z[i[at : at + CACHED]] - y[j[at : at + CACHED]]
            np.multiply(step, step, out=step)
            d[at : at + CACHED] = np.cumsum(step, axis=1, out=step)[:, -1]  # in order of the coordinates, as in ``square``
        d = np.sqrt(d)
        there = np.isfinite(d)
        self.kept[g].append((i[there], theirs[j[there]], d[there]))
        self.waiting[g] += int(there.sum())
        if self.waiting[g] >= self.k * (self.groups[g].stop - self.groups[g].start):
            self.settle(g)

    def settle(self, g: int) -> None:
        """Leaves the k nearest of each point of a group."""
        i, j, d = (np.concatenate(c) for c in zip(*self.kept[g], strict=True))
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, d, last = i[place < self.k], j[place < self.k], d[place < self.k], place[place < self.k] == self.k - 1
        self.reach[i[last]] = d[last] ** 2
        self.kept[g], self.waiting[g] = [(i, j, d)], 0

    def found(self) -> pd.DataFrame:
        """(i, j, d, rank) of all points; points of one id share their ranks."""
        for g, kept in enumerate(self.kept):
            if kept:
                self.settle(g)
        kept = [part for parts in self.kept for part in parts] or [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        i, j, d = (np.concatenate(c) for c in zip(*kept, strict=True))
        i = self.ids[i]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        few = place < self.k
        return pd.DataFrame({"i": i[few], "j": j[few], "d": d[few], "rank": place[few].astype(np.int32) + 1})


def sized(cloud: DataFrame, block: int | None = None) -> DataFrame:
    """(set_id, parts, n): in how many parts a search takes each set, at most ``block`` points each if it is given."""
    n = F.count("*")
    parts = F.ceil(n / block) if block else F.greatest(F.ceil(n / PART_POINTS), F.least(F.ceil(n / BLOCK), F.lit(STREAMS)))
    return cut(cloud.groupBy("set_id").agg(parts.cast("int").alias("parts"), n.cast("double").alias("n")))


def stretches(cloud: DataFrame, sizes: DataFrame) -> DataFrame:
    """(set_id, part, asked, ids, z): the points of each part of the sets of ``sizes`` (set_id, parts, asked), many to a row, z one coordinate after the other."""
    tasks = min(sizes.agg(F.coalesce(F.sum(F.col("parts").cast("long")), F.lit(1))).first()[0], MOST_TASKS)
    dealt = cloud.join(sizes.select("set_id", "parts", "asked"), "set_id").select("set_id", "asked", "id", "z", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, z = rows["id"].to_numpy(), matrix(rows)
        order = by_place(z, LEAF) if z.shape[1] <= FEW else np.argsort(ids, kind="stable")
        size = max(BLOCK, min(PART_POINTS, STRETCH // max(z.shape[1], 1)))
        runs = [order[at : at + size] for at in range(0, len(order), size)]
        return pd.DataFrame({"set_id": key[0], "part": key[1], "asked": key[2], "ids": [ids[r] for r in runs], "z": [z[r].ravel() for r in runs]})

    schema = "set_id string, part int, asked int, ids array<long>, z array<double>"
    return cut(dealt.repartition(max(tasks, 1), "set_id", "part", "asked").groupBy("set_id", "part", "asked").applyInPandas(pack, schema))


def nearest(queries: DataFrame, cloud: DataFrame, k: int = 1, apart: bool = False, block: int | None = None) -> DataFrame:
    """(set_id, i, j, d, rank): the k nearest points j of the set's ``cloud`` to each i of ``queries``, by (d, j); ``apart``: of another id.

    Each part of a set's queries is a task, to which the set's points come in stretches. So a point travels once for each part, and
    tasks hold a part and a stretch.
    """
    def searched(key: tuple, own: tuple[np.ndarray, np.ndarray], others: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        search = Nearest(*own, k, apart)
        for _, ids, z in others:
            search.see(ids, z)
        out = search.found()
        yield batch_of(key[0], {c: out[c].to_numpy() for c in out.columns})

    return streamed(queries, cloud, searched, "i long, j long, d double, rank int", block)


def batch_of(set_id: str, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_pydict({"set_id": pa.repeat(pa.scalar(set_id, pa.string()), n)} | {c: pa.array(x) for c, x in columns.items()})


def streamed(queries: DataFrame, cloud: DataFrame, work: Callable, schema: str, block: int | None = None, half: bool = False) -> DataFrame:
    """What ``work((set_id, part), (ids, z), others)`` yields for each part of each set's ``queries``; others are (part, ids, z) of all its points, in stretches.

    ``half``: of two parts of one cloud only one gets the other, each about as many, and each gets itself.
    """
    itself = queries is cloud
    sizes = sized(cloud, block)
    asks = sizes if itself else sized(queries, block)
    both = cut(sizes.join(asks.select("set_id", F.col("parts").alias("asked"), F.col("n").alias("m")), "set_id"))
    tasks, pairs = both.agg(F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0))).first()
    right = stretches(cloud, both)
    left = right if itself else stretches(queries, both.select("set_id", F.col("asked").alias("parts"), "asked"))
    mine = left.select("set_id", F.col("part").alias("to"), F.lit(-1).alias("of"), "ids", "z")
    others = right.select("set_id", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)).alias("to"), F.col("part").alias("of"), "asked", "ids", "z")
    if half:  # parts stand in a ring, and each gets those before it up to the opposite one
        ahead = F.pmod(F.col("of") - F.col("to"), F.col("asked"))
        others = others.where((2 * ahead < F.col("asked")) | ((2 * ahead == F.col("asked")) & (F.col("to") < F.col("of"))))
    spread = max(1, min(tasks, max(LEAST_TASKS, int(pairs / TASK_PAIRS)), MOST_TASKS))
    # the parts of a set go to one task after the other, so that none gets many of them
    rows = mine.unionByName(others.drop("asked")).repartitionById(spread, F.pmod(F.xxhash64("set_id") + F.col("to"), F.lit(spread)).cast("int")).sortWithinPartitions("set_id", "to", "of")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in range(batch.num_rows):
                set_id, to, of, ids, z = (batch.column(c)[r] for c in ("set_id", "to", "of", "ids", "z"))
                ids = ids.values.to_numpy()
                yield (set_id.as_py(), to.as_py()), of.as_py(), ids, z.values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groupby(unpacked(batches), itemgetter(0)):
            own, first = [], None
            for row in group:
                if row[1] >= 0:
                    first = row
                    break
                own.append(row[2:])
            if own and first is not None:
                part = tuple(np.concatenate(c) for c in zip(*own, strict=True))
                yield from work(key, part, (row[1:] for row in chain([first], group)))

    return rows.mapInArrow(run, f"set_id string, {schema}")


def block_pairs(cloud: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int | None = BLOCK, extra: tuple[str, ...] = (), half: bool = False) -> DataFrame:
    """``work(left, right)`` for every ordered pair of blocks of each set; both have id, z and the ``extra`` columns.

    ``half``: for each pair of blocks in one order only. Without ``block`` a set has ``PARTS`` blocks (fewer if it is small), or those
    of ``PART_POINTS``: a point travels once for each block, so work that can take large blocks has less to move and to add up.
    """
    n = F.count("*")
    parts = F.ceil(n / block) if block else F.greatest(F.ceil(n / PART_POINTS), F.least(F.ceil(n / BLOCK), F.lit(PARTS)))
    sizes = cut(cloud.groupBy("set_id").agg(parts.cast("int").alias("_n"), n.cast("double").alias("_all")))
    tasks, pairs = sizes.agg(F.coalesce(F.sum(F.col("_n").cast("long") * F.col("_n")), F.lit(0)), F.coalesce(F.sum(F.col("_all") * F.col("_all")), F.lit(0.0))).first()
    dealt = cloud.join(sizes.drop("_all"), "set_id").withColumn("_own", F.pmod(F.xxhash64("id"), "_n").cast("int"))
    dealt = dealt.select("set_id", "id", "z", *extra, "_own", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
    keep = ["id", "z", *extra]
    kinds = {"long": "int64", "double": "float64"}
    types = {"set_id": "object"} | {c.split()[0]: kinds.get(c.split()[1], "object") for c in schema.split(", ")}
    left = dealt.select("set_id", F.col("_own").alias("_p"), F.col("_other").alias("_q"), *keep)
    fresh = lambda c: F.col(c).alias(c)  # noqa: E731  columns of their own, for a join with the same table
    right = dealt.select(fresh("set_id"), F.col("_other").alias("_p"), F.col("_own").alias("_q"), *[fresh(c) for c in keep])

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b) or (half and key[1] > key[2]):
            return pd.DataFrame({name: pd.Series(dtype=kind) for name, kind in types.items()})
        out = work(a, b)
        return pd.DataFrame({"set_id": np.full(len(out), key[0], object), **{c: out[c].to_numpy() for c in out.columns}}).astype(types)

    keys = ["set_id", "_p", "_q"]
    if tasks > 1:  # pairs of blocks are much work and few bytes, by which Spark would put many of them in a task
        spread = min(tasks, max(LEAST_TASKS, int(pairs / TASK_PAIRS)), MOST_TASKS)
        left, right = left.repartition(spread, *keys), right.repartition(spread, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"set_id string, {schema}")


def matrix(rows: pd.DataFrame) -> np.ndarray:
    """The points' coordinates, a row each; without points no columns either."""
    return np.array(rows["z"].tolist(), float).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def pairwise(cloud: DataFrame, block: int | None = None) -> DataFrame:
    """(set_id, i, j, d) for i < j: all pairs of each set, a part of its points in each task. As many rows as pairs: for small clouds.

    A task makes about ``TASK_ROWS`` of its rows at a time, and a point travels to half of the parts.
    """

    def every(key: tuple, own: tuple[np.ndarray, np.ndarray], others: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, z = own
        for part, theirs, y in others:
            rows = max(1, TASK_ROWS // max(len(theirs), 1))
            for at in range(0, len(ids), rows):
                mine = ids[at : at + rows]
                d = square(z[at : at + rows], y)
                if part == key[1]:
                    x, other = np.nonzero(mine[:, None] < theirs[None, :])
                    yield batch_of(key[0], {"i": mine[x], "j": theirs[other], "d": d[x, other]})
                else:
                    low, high = np.minimum(mine[:, None], theirs[None, :]), np.maximum(mine[:, None], theirs[None, :])
                    yield batch_of(key[0], {"i": low.ravel(), "j": high.ravel(), "d": d.ravel()})

    return streamed(cloud, cloud, every, "i long, j long, d double", block, half=True)


def nearest_of_others(cloud: DataFrame, block: int | None = None) -> DataFrame:
    """(set_id, i, d): the distance of each point of a cloud with a column ``label`` (long) to the nearest one of another label."""

    def other(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = a["label"].to_numpy(), b["label"].to_numpy()
        i, _, d = closest(matrix(a), matrix(b), 1, lambda here: mine[here, None] == theirs[None, :])
        return pd.DataFrame({"i": a["id"].to_numpy()[i], "d": d})

    return block_pairs(cloud, other, "i long, d double", block, extra=("label",)).groupBy("set_id", "i").agg(F.min("d").alias("d"))


def knn(cloud: DataFrame, k: int = K, block: int | None = None) -> DataFrame:
    """(set_id, i, j, d, rank): the k nearest others of each point by (d, j)."""
    return nearest(cloud, cloud, k, True, block)


def kth_radius(neighbors: DataFrame, k: int = K) -> DataFrame:
    """(set_id, id, rk): distance to the k-th nearest other point, plus the offset."""
    return neighbors.where(F.col("rank") == k).select("set_id", F.col("i").alias("id"), (F.col("d") + OFFSET).alias("rk"))


def symmetric_graph(neighbors: DataFrame) -> DataFrame:
    """(set_id, i, j) in both directions, once each."""
    flipped = neighbors.select("set_id", F.col("j").alias("i"), F.col("i").alias("j"))
    return neighbors.select("set_id", "i", "j").unionByName(flipped).distinct()


def intrinsic_dim(neighbors: DataFrame, k: int = K) -> DataFrame:
    """(set_id, d_hat): maximum-likelihood dimension, inverse of the mean over points of mean log distance ratios; null where all ratios are 1."""
    far = neighbors.withColumn("t", F.col("d") + LOG_OFFSET).withColumn("tk", F.max("t").over(Window.partitionBy("set_id", "i")))
    per_point = far.where(F.col("rank") < k).groupBy("set_id", "i").agg((F.sum(F.ln(F.col("tk") / F.col("t"))) / (k - 1)).alias("m"))
    return per_point.groupBy("set_id").agg(F.try_divide(F.lit(1.0), F.avg("m")).alias("d_hat"))


def null_dims(dims: DataFrame, max_dim: int = 10) -> DataFrame:
    """(set_id, dims): the whole dimensions around d_hat, between 1 and ``max_dim``."""
    clamp = lambda c: F.least(F.greatest(c, F.lit(1)), F.lit(max_dim)).cast("int")
    return dims.select("set_id", F.array_sort(F.array_distinct(F.array(clamp(F.floor("d_hat")), clamp(F.ceil("d_hat"))))).alias("dims"))


def rms_scaled(cloud: DataFrame) -> DataFrame:
    """Each set divided by the root mean square of all its coordinates."""
    squares = cloud.select("set_id", F.aggregate("z", F.lit(0.0), lambda s, x: s + x * x).alias("s"), F.size("z").alias("n"))
    rms = squares.groupBy("set_id").agg(F.sqrt(F.sum("s") / F.sum("n")).alias("_rms"))
    return cloud.join(rms, "set_id").select("set_id", "id", F.transform("z", lambda x: x / F.col("_rms")).alias("z"))

