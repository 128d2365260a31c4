"""Spanning trees over mutual-reachability distances, without lists of neighbours.

A point's core distance is that to its k-th nearest other, where k may be a part of the set. So the k nearest are never listed: a
sample of the set gives each point a range of distances, which all pairs of blocks then count into cells; the cell that holds the
k-th is listed, in which few distances are left, and equal ones are kept once with their number. Single precision and a bound on its
error decide what is counted, and what is near a limit is measured exactly.

An edge is as long as the largest of its length and the core distances of its ends, so it is never shorter than the core distance of
an end. A point with a denser one among its k nearest therefore takes the first such as its best edge. What components that leaves are
joined in rounds: the densest point of each gives a bound, and only points with core distances below the bound are searched.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.checkpoints import written
from lacuna.operators.graph import components
from lacuna.operators.neighbors import MOST_TASKS, ROWS, block_pairs, framed, knn, matrix

#: Up to so many neighbours are listed.
LISTED = 32
#: Points of a sample, and how many deviations of the rank in it a range reaches to either side.
SAMPLE, DEVIATIONS = 8192, 6
#: A range is counted in so many cells, and a cell of at most so many distances is listed.
CELLS, CELL_MOST = 64, 512
#: Up to so many points are sent to all blocks of the others.
FEW = 8192
COLUMNS = 2048


def _kept(df: DataFrame) -> DataFrame:
    """As a table, whose size Spark knows: sizes estimated from checkpoints of joins multiply from round to round, until planning takes minutes."""
    return written(df, f"reachability-{uuid.uuid4().hex}")


def against(few: DataFrame, many: DataFrame, work, schema: str) -> DataFrame:
    """``work(few, some)`` for blocks of ``many``, each of which meets all points of ``few`` of its set; both have the same columns."""
    keep = [c for c in many.columns if c != "set_id"]
    sizes = _kept(many.groupBy("set_id").agg(F.ceil(F.count("*") / FEW).cast("int").alias("_n")))
    tasks = sizes.agg(F.sum("_n")).first()[0] or 1
    fresh = lambda c: F.col(c).alias(c)  # noqa: E731  columns of their own, as both sides may come from one table
    left = few.join(sizes, "set_id").select("set_id", *keep, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_p"))
    right = many.join(sizes, "set_id").select(fresh("set_id"), *[fresh(c) for c in keep], F.pmod(F.xxhash64("id"), "_n").cast("int").alias("_p"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ("set_id", *names)})
        out = work(a, b)
        return out.assign(set_id=np.full(len(out), key[0], object))[["set_id", *names]]

    deal = lambda rows: rows.repartition(min(tasks, MOST_TASKS), "set_id", "_p").groupBy("set_id", "_p")
    return deal(left).cogroup(deal(right)).applyInPandas(run, f"set_id string, {schema}")


def products(a: np.ndarray, b: np.ndarray, same: np.ndarray):
    """(rows of a, squared distances to all of b in single precision, their error) for some rows at a time; ``same``: the row of b that is the point itself, or -1."""
    left, right, error, _, _ = framed(a, b)
    for at in range(0, len(a), ROWS):
        here = slice(at, min(at + ROWS, len(a)))
        near = left[here] @ right.T
        own = np.flatnonzero(same[here] >= 0)
        near[own, same[here][own]] = np.inf
        yield here, near, error[here]


def itself(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each id of a its place in the ids of b, which are sorted, or -1."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return np.where(b[at] == a, at, -1)


def single(x: np.ndarray) -> np.ndarray:
    """Limits in single precision, not below what they were."""
    return np.nextafter(np.minimum(x, 3e38).astype(np.float32), np.float32(np.inf))[:, None]


def measured(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    d = np.zeros(len(i))
    for x, y in zip(a.T, b.T, strict=True):
        d += (x[i] - y[j]) ** 2
    return np.sqrt(d)


def ranged(sample: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
    """(id, lo, hi): squared distances between which that to the k-th nearest is looked for, from a sample; ``share`` is k over all others."""
    sample = sample.sort_values("id")
    same = itself(points["id"].to_numpy(), sample["id"].to_numpy())
    rank = points["share"].iloc[0] * len(sample)
    low, high = (int(rank + s * DEVIATIONS * (np.sqrt(rank) + 1)) for s in (-1, 1))
    lo, hi = np.full(len(points), -1.0), np.empty(len(points))
    for here, near, _ in products(matrix(points), matrix(sample), same):
        top = min(high, len(sample) - 1)
        near = np.partition(near, [max(low, 0), top], axis=1)
        hi[here] = np.where(np.isfinite(near[:, top]), near[:, top], near[:, max(top - 1, 0)])
        if low >= 0:
            lo[here] = near[:, low]
    hi = np.where(np.isfinite(hi), hi, 1.0)
    return pd.DataFrame({"id": points["id"].to_numpy(), "lo": np.minimum(lo, hi), "hi": hi})


def counted(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(id, counts, error): for each open point of a how many of b are not beyond lo, and how many are in each cell from there to hi."""
    a, b = a[a["open"] == 1], b.sort_values("id")
    lo, hi = a["lo"].to_numpy(), a["hi"].to_numpy()
    per = CELLS / np.maximum(hi - lo, 1e-300)
    counts, errors = np.zeros((len(a), CELLS + 1), np.int32), np.zeros(len(a))
    if len(a):
        for here, near, error in products(matrix(a), matrix(b), itself(a["id"].to_numpy(), b["id"].to_numpy())):
            flat = np.flatnonzero(near <= single(hi[here]))
            i, x = flat // len(b), near.ravel()[flat]
            cell = np.clip(np.ceil((x - lo[here][i]) * per[here][i]), 0, CELLS).astype(np.int64)
            counts[here] = np.bincount(i * (CELLS + 1) + cell, minlength=len(near) * (CELLS + 1)).reshape(len(near), -1)
            errors[here] = error
    return pd.DataFrame({"id": a["id"].to_numpy(), "counts": list(counts), "error": errors})


def narrowed(batches):
    """(set_id, id, lo, hi, open) from the counts of all blocks: the cell that holds the k-th, wider by the error."""
    for rows in batches:
        if not len(rows):
            continue
        upto = np.cumsum([np.sum(c.tolist(), axis=0) for c in rows["counts"]], axis=1)
        lo, hi, k, error = (rows[c].to_numpy() for c in ("lo", "hi", "k", "error"))
        cell = (upto < k[:, None]).sum(axis=1)
        width = (hi - lo) / CELLS
        below, above = cell == 0, cell > CELLS
        inside = ~below & ~above
        at = np.clip(cell, 1, CELLS)
        many = np.take_along_axis(upto, at[:, None], 1)[:, 0] - np.take_along_axis(upto, at[:, None] - 1, 1)[:, 0]
        new_lo = np.where(inside, lo + (at - 1) * width - 2 * error, np.where(above, hi - 2 * error, -1.0))
        new_hi = np.where(inside, lo + at * width, np.where(above, 2 * np.abs(hi) + (hi - lo) + error, lo)) + 2 * error
        again = ~inside | ((many > CELL_MOST) & (width > 8 * error))
        yield pd.DataFrame({"set_id": rows["set_id"], "id": rows["id"], "lo": new_lo, "hi": new_hi, "open": again.astype(np.int64)})


def listed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(id, below, d, n): how many of b are surely nearer than the range of a point of a, and the distances around the range with their numbers."""
    b = b.sort_values("id")
    x, y, lo, hi = matrix(a), matrix(b), a["lo"].to_numpy(), a["hi"].to_numpy()
    below, found, number = np.zeros(len(a), np.int64), [], []
    for here, near, error in products(x, y, itself(a["id"].to_numpy(), b["id"].to_numpy())):
        flat = np.flatnonzero(near <= single(hi[here] + error))
        i, j = np.divmod(flat, len(b))
        nearer = near.ravel()[flat] <= (lo[here] - error)[i]
        below[here] = np.bincount(i[nearer], minlength=len(near))
        i, j = i[~nearer], j[~nearer]
        d = measured(x, y, i + here.start, j)
        order = np.lexsort((d, i))
        i, d = i[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1])])[: len(i)])
        many = np.diff(np.append(first, len(i)))
        ends = np.searchsorted(i[first], np.arange(1, len(near)))
        found += np.split(d[first], ends)
        number += np.split(many, ends)
    return pd.DataFrame({"id": a["id"].to_numpy(), "below": below, "d": found, "n": number})


def chosen(batches):
    """(set_id, id, core): the k-th distance, where it is in the range; what isn't listed is outside of that."""
    for rows in batches:
        cores = np.full(len(rows), np.nan)
        for r, (k, lo, hi, below, d, n) in enumerate(zip(rows["k"], rows["lo"], rows["hi"], rows["below"], rows["d"], rows["n"], strict=True)):
            d, n = np.concatenate(list(d)), np.concatenate(list(n))
            order = np.argsort(d)
            at = np.searchsorted(below + np.cumsum(n[order]), k)
            if below < k and at < len(d) and lo <= d[order[at]] ** 2 <= hi:
                cores[r] = d[order[at]]
        yield pd.DataFrame({"set_id": rows["set_id"], "id": rows["id"], "core": cores})


def core_distances(cloud: DataFrame, k: int) -> DataFrame:
    """(set_id, id, core): the distance to the k-th nearest other, for points with so many at a finite distance."""
    odd = F.exists("z", lambda x: F.isnan(x) | (F.abs(x) >= 1e14))
    if k <= LISTED or cloud.where(odd).limit(1).count():
        return knn(cloud, k).where(F.col("rank") == k).select("set_id", F.col("i").alias("id"), F.col("d").alias("core"))
    sizes = cloud.groupBy("set_id").agg(F.count("*").alias("_all")).where(F.col("_all") > k)
    own = _kept(cloud.select("set_id", "id", "z").join(sizes, "set_id").withColumn("share", k / F.col("_all")))
    sample = own.where(F.pmod(F.xxhash64("id", F.lit("sample")), "_all") < SAMPLE).drop("_all")
    ranges = _kept(against(sample, own.drop("_all"), ranged, "id long, lo double, hi double").withColumn("open", F.lit(1).cast("long")))
    while True:
        placed = own.select("set_id", "id", "z").join(ranges, ["set_id", "id"])
        counts = block_pairs(placed, counted, "id long, counts array<int>, error double", None, extra=("lo", "hi", "open"))
        sums = counts.groupBy("set_id", "id").agg(F.collect_list("counts").alias("counts"), F.max("error").alias("error"))
        state = sums.join(ranges.where("open = 1").select("set_id", "id", "lo", "hi"), ["set_id", "id"]).withColumn("k", F.lit(k))
        fresh = state.mapInPandas(narrowed, "set_id string, id long, lo double, hi double, open long")
        ranges = _kept(ranges.where("open = 0").unionByName(fresh))
        if not ranges.where("open = 1").limit(1).count():
            break
    placed = own.select("set_id", "id", "z").join(ranges, ["set_id", "id"])
    lists = block_pairs(placed, listed, "id long, below long, d array<double>, n array<long>", None, extra=("lo", "hi"))
    lists = lists.groupBy("set_id", "id").agg(F.sum("below").alias("below"), F.collect_list("d").alias("d"), F.collect_list("n").alias("n"))
    cores = _kept(lists.join(ranges, ["set_id", "id"]).withColumn("k", F.lit(k)).mapInPandas(chosen, "set_id string, id long, core double"))
    if cores.where(F.isnan("core")).limit(1).count():
        raise ArithmeticError("a distance is outside of the range that was counted for it")
    return cores


def leaving(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(comp, u, v, w): for each component with points asked for in a, the best edge by (w, u, v) from one of them to a point of another component in b."""
    a, b = a[a["asked"] == 1], b.sort_values("id")
    if not len(a):
        return pd.DataFrame({"comp": np.zeros(0, int), "u": np.zeros(0, int), "v": np.zeros(0, int), "w": np.zeros(0)})
    x, y, mine, theirs = matrix(a), matrix(b), a["comp"].to_numpy(), b["comp"].to_numpy()
    ids, others, core, far = a["id"].to_numpy(), b["id"].to_numpy(), a["core"].to_numpy(), b["core"].to_numpy()
    left, right, error, _, _ = framed(x, y)
    limit, far2 = core * core, (far * far).astype(np.float32)
    best, to = np.full(len(a), np.inf), np.full(len(a), -1)
    for at in range(0, len(a), ROWS):
        rest = np.arange(at, min(at + ROWS, len(a)))
        for lo in range(0, len(b), COLUMNS):
            if not len(rest):
                break
            part = slice(lo, min(lo + COLUMNS, len(b)))
            width = part.stop - lo
            near = left[rest] @ right[part].T
            # an edge as short as the point's core distance can't be beaten but by the same to a smaller id, and ids ascend
            flat = np.flatnonzero(near <= single((limit + error)[rest]))
            i, j = np.divmod(flat, width)
            fit = (far[part][j] <= core[rest[i]]) & (theirs[part][j] != mine[rest[i]])
            i, j, d2 = i[fit], j[fit], near.ravel()[flat[fit]]
            sure = d2 <= (limit - error)[rest[i]]
            first = np.full(len(rest), width)
            first[i[sure][::-1]] = j[sure][::-1]
            doubtful = ~sure & (j < first[i])
            i, j = i[doubtful], j[doubtful]
            while len(i):
                head = np.concatenate([[True], i[1:] != i[:-1]])
                rows, cols = i[head], j[head]
                there = measured(x, y, rest[rows], cols + lo) <= core[rest[rows]]
                first[rows[there]] = cols[there]
                left_over = ~head & ~np.isin(i, rows[there])
                i, j = i[left_over], j[left_over]
            got = first < width
            best[rest[got]], to[rest[got]] = core[rest[got]], first[got] + lo
            near, rest = near[~got], rest[~got]
            if not len(rest):
                break
            np.maximum(near, far2[part][None, :], out=near)
            near[mine[rest][:, None] == theirs[part][None, :]] = np.inf
            low = np.maximum(near.min(axis=1), limit[rest])
            reach = np.minimum(low, best[rest] ** 2) * (1 + 1e-6) + 2 * error[rest]
            i, j = np.divmod(np.flatnonzero(near <= np.where(np.isfinite(low), single(reach)[:, 0], -1)[:, None]), width)
            w = np.maximum(np.maximum(measured(x, y, rest[i], j + lo), core[rest[i]]), far[part][j])
            order = np.lexsort((j, w, i))
            i, j, w = i[order], j[order], w[order]
            head = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])[: len(i)])
            i, j, w = rest[i[head]], j[head] + lo, w[head]
            closer = w < best[i]  # of equals the smaller id was seen before
            best[i[closer]], to[i[closer]] = w[closer], j[closer]
    some = to >= 0
    ends, other = ids[some], others[to[some]]
    out = pd.DataFrame({"comp": mine[some], "u": np.minimum(ends, other), "v": np.maximum(ends, other), "w": best[some]})
    return out.sort_values(["w", "u", "v"]).drop_duplicates("comp")


EDGES = "comp long, u long, v long, w double"


def reachability_tree(cloud: DataFrame, block: int | None = None) -> DataFrame:
    """(set_id, u, v, w) with u < v: the minimum spanning tree of points (set_id, id, z, core) by (w, u, v), w the mutual-reachability distance."""
    cloud = _kept(cloud.select("set_id", "id", "z", "core"))
    columns = ("core", "comp", "asked")
    best = lambda found: _kept(found.groupBy("set_id", "comp").agg(F.min(F.struct("w", "u", "v")).alias("e")))
    one = F.lit(1).cast("long")
    found = best(block_pairs(cloud.withColumn("comp", F.col("id")).withColumn("asked", one), leaving, EDGES, block, extra=columns))
    tree = found.select("set_id", "e.u", "e.v", "e.w").distinct()
    while True:
        tree = _kept(tree)
        labels = _kept(components(cloud.select("set_id", "id"), tree))
        sizes = labels.groupBy("set_id", "comp").agg(F.count("*").alias("n"))
        largest = _kept(sizes.groupBy("set_id").agg(F.count("*").alias("many"), F.max_by("comp", F.struct("n", "comp")).alias("largest")).where("many > 1"))
        if not largest.limit(1).count():
            return tree
        placed = _kept(cloud.join(labels, ["set_id", "id"]).join(largest.select("set_id", "largest"), "set_id"))
        small = placed.where("comp <> largest")
        densest = small.groupBy("set_id", "comp").agg(F.min(F.struct("core", "id")).alias("m")).select("set_id", "comp", F.col("m.id").alias("id"))
        bound = best(_searched(placed, small.join(densest, ["set_id", "comp", "id"], "left_semi"))).select("set_id", "comp", F.col("e.w").alias("bound"))
        asked = small.join(bound, ["set_id", "comp"]).where("core <= bound").select(*small.columns)
        reach = bound.groupBy("set_id").agg(F.max("bound").alias("bound"))
        found = best(_searched(placed.join(reach, "set_id").where("core <= bound").drop("bound"), asked))
        if not found.limit(1).count():
            return tree
        tree = tree.unionByName(found.select("set_id", "e.u", "e.v", "e.w").distinct())


def _searched(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """The best edges of the points asked for: few meet all blocks, of many each block meets each."""
    asked = _kept(asked.select("set_id", "id"))
    marked = placed.join(asked.withColumn("asked", F.lit(1).cast("long")), ["set_id", "id"], "left").withColumn("asked", F.coalesce("asked", F.lit(0).cast("long")))
    marked = _kept(marked.select("set_id", "id", "z", "core", "comp", "asked"))
    if (asked.groupBy("set_id").count().agg(F.max("count")).first()[0] or 0) <= FEW:
        return against(marked.where("asked = 1"), marked, leaving, EDGES)
    return block_pairs(marked, leaving, EDGES, None, extra=("core", "comp", "asked"))
