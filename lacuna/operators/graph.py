"""Connected components and minimum spanning trees as DataFrame jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.checkpoints import cut
from lacuna.operators.neighbors import BLOCK, OFFSET, K, block_pairs, closest, knn, matrix, square


#: So many edges of a set are joined within one task; the rest is done in rounds of Spark jobs.
TASK_EDGES = 1_000_000


class _Forest:
    """Union-find over the distinct ends of some edges; the smallest end names a tree."""

    def __init__(self, u: np.ndarray, v: np.ndarray):
        self.ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        self.u, self.v = ends[: len(u)].tolist(), ends[len(u) :].tolist()
        self.parent = list(range(len(self.ids)))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, k: int) -> bool:
        """Joins the ends of edge k; whether they were apart."""
        a, b = self.root(self.u[k]), self.root(self.v[k])
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _sized(edges: DataFrame) -> DataFrame:
    return edges.groupBy("set_id").agg(F.ceil(F.count("*") / TASK_EDGES).cast("int").alias("_parts"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, id, comp): nodes (set_id, id) labelled with the smallest id reachable by edges (set_id, u, v).

    Sets of up to ``TASK_EDGES`` edges are labelled in a task each, larger ones in rounds.
    """
    edges = cut(edges.select("set_id", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    sizes = cut(_sized(edges))

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        forest = _Forest(rows["u"].to_numpy(), rows["v"].to_numpy())
        for k in range(len(rows)):
            forest.join(k)
        return pd.DataFrame({"set_id": rows["set_id"].iloc[0], "id": forest.ids, "comp": forest.ids[[forest.root(i) for i in range(len(forest.ids))]]})

    small = edges.join(sizes.where("_parts = 1").select("set_id"), "set_id")
    found = small.groupBy("set_id").applyInPandas(label, "set_id string, id long, comp long")
    large = sizes.where("_parts > 1").select("set_id")
    if large.limit(1).count():
        found = found.unionByName(components_in_rounds(nodes.join(large, "set_id", "left_semi"), edges.join(large, "set_id", "left_semi")))
    return nodes.select("set_id", "id").join(found, ["set_id", "id"], "left").select("set_id", "id", F.coalesce("comp", "id").alias("comp"))


def components_in_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(set_id, id, comp): nodes (set_id, id) labelled with the smallest id reachable by edges (set_id, u, v).

    Labels go over edges and then to the label's own label, so the rounds grow with the logarithm of the longest path.
    """
    labels = cut(nodes.select("set_id", "id", F.col("id").alias("comp")))
    both = cut(edges.select("set_id", "u", "v").unionByName(edges.select("set_id", F.col("v").alias("u"), F.col("u").alias("v"))))
    while True:
        seen = both.join(labels.select("set_id", F.col("id").alias("v"), F.col("comp").alias("other")), ["set_id", "v"])
        lowest = seen.groupBy("set_id", F.col("u").alias("id")).agg(F.min("other").alias("low"))
        near = labels.join(lowest, ["set_id", "id"], "left").select("set_id", "id", "comp", F.least("comp", F.coalesce("low", "comp")).alias("new"))
        # the old label takes the smallest new one of its members, and each member that of its new label
        hook = near.groupBy("set_id", F.col("comp").alias("new")).agg(F.min("new").alias("hook"))
        moved = near.join(hook, ["set_id", "new"], "left").select("set_id", "id", "comp", F.least("new", F.coalesce("hook", "new")).alias("new"))
        moved = cut(moved)
        changed = moved.where("comp <> new").limit(1).count()
        labels = moved.select("set_id", "id", F.col("new").alias("comp"))
        if not changed:
            return labels


def contracted(labels: DataFrame, picked: DataFrame) -> DataFrame:
    """Labels (set_id, id, comp) after joining components by edges (set_id, u, v): only the graph of components is walked."""
    end = lambda c: labels.select("set_id", F.col("id").alias(c), F.col("comp").alias(f"_{c}"))
    between = picked.select("set_id", "u", "v").join(end("u"), ["set_id", "u"]).join(end("v"), ["set_id", "v"]).select("set_id", F.col("_u").alias("u"), F.col("_v").alias("v"))
    merged = components(labels.select("set_id", F.col("comp").alias("id")).distinct(), between)
    return cut(labels.join(merged.select("set_id", F.col("id").alias("comp"), F.col("comp").alias("_new")), ["set_id", "comp"]).select("set_id", "id", F.col("_new").alias("comp")))


def thinned(rows: pd.DataFrame) -> pd.DataFrame:
    """The minimum spanning forest of some edges (u, v, w), by (w, u, v)."""
    rows = rows.sort_values(["w", "u", "v"]).reset_index(drop=True)
    forest = _Forest(rows["u"].to_numpy(), rows["v"].to_numpy())
    return rows[[forest.join(k) for k in range(len(rows))]]


def spanning_tree_of_edges(cloud: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum spanning tree (set_id, u, v, w) of a table of edges, ties by (w, u, v).

    An edge that is in the tree is in the spanning forest of any part of the edges that has it. So the edges of a set are dealt into
    parts of ``TASK_EDGES``, each part keeps its forest, and so on until one part is left. Where that no longer lessens them, as in
    sets of more points than a task joins, rounds follow in which each component takes its best edge.
    """
    edges = cut(edges.select("set_id", "u", "v", "w"))
    while True:
        sizes = cut(_sized(edges))
        one = (sizes.agg(F.max("_parts")).first()[0] or 1) == 1
        dealt = edges.join(sizes, "set_id").withColumn("_part", F.pmod(F.xxhash64("u", "v"), "_parts"))
        kept = cut(dealt.groupBy("set_id", "_part").applyInPandas(lambda rows: thinned(rows[["set_id", "u", "v", "w"]]), "set_id string, u long, v long, w double"))
        if one:
            return kept
        if kept.count() > 0.8 * edges.count():
            return spanning_tree_in_rounds(cloud, kept)
        edges = kept


def spanning_tree_in_rounds(cloud: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimum spanning tree of a table of edges (set_id, u, v, w), by rounds in which each component takes its best edge."""
    edges = cut(edges)
    labels = cut(cloud.select("set_id", "id", F.col("id").alias("comp")))
    tree = None
    while True:
        side = lambda c: labels.select("set_id", F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
        open_ = edges.join(side("u"), ["set_id", "u"]).join(side("v"), ["set_id", "v"]).where("cu <> cv")
        ends = open_.select("set_id", "u", "v", "w", F.explode(F.array("cu", "cv")).alias("comp"))
        picked = cut(ends.groupBy("set_id", "comp").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("set_id", "e.u", "e.v", "e.w").distinct())
        if not picked.limit(1).count():
            return picked if tree is None else tree
        tree = picked if tree is None else tree.unionByName(picked)
        labels = contracted(labels, picked)


def small_tree(rows: pd.DataFrame, core: str | None = None) -> pd.DataFrame:
    """The spanning tree (u, v, w) of a few points (id, z), grown from the first; equal lengths go by (u, v).

    ``core`` names a column of radii: an edge is then as long as the largest of its length and the radii of its ends.
    """
    rows = rows.drop_duplicates("id").sort_values("id")
    ids, z = rows["id"].to_numpy(), matrix(rows)
    n = len(ids)
    d = square(z, z)
    if core:
        radius = rows[core].to_numpy()
        d = np.maximum(d, np.maximum(radius[:, None], radius[None, :]))
    else:
        d += OFFSET
    best, source, outside = d[0].copy(), np.zeros(n, int), np.ones(n, bool)
    outside[0] = False
    edges = []
    for _ in range(n - 1):
        reach = np.where(outside, best, np.inf)
        ties = np.flatnonzero(reach == reach.min())
        j = min(ties, key=lambda k: (min(k, source[k]), max(k, source[k])))
        edges.append((ids[min(j, source[j])], ids[max(j, source[j])], best[j]))
        outside[j] = False
        k = np.arange(n)
        old, new = np.minimum(k, source) * n + np.maximum(k, source), np.minimum(k, j) * n + np.maximum(k, j)
        closer = (d[j] < best) | ((d[j] == best) & (new < old))
        best[closer], source[closer] = d[j][closer], j
    return pd.DataFrame(edges, columns=["u", "v", "w"])


def minimum_spanning_tree(cloud: DataFrame, block: int = BLOCK, near: DataFrame | None = None, k: int = K) -> DataFrame:
    """(set_id, u, v, w) with u < v: for each set, the tree over Euclidean distances plus the offset, ties by (w, u, v).

    Sets of one block are done at once, larger ones from the ``k`` nearest of each point (``near``, if they are there already). Where
    the neighbours' forest has more edges than a task joins, each pair of blocks gives the tree of its points, and the tree of all these
    edges is the result, since an edge of the whole tree is in the tree of any part that holds both its ends.
    """
    counts = cut(cloud.groupBy("set_id").agg(F.count("*").alias("n")))
    most = counts.agg(F.max("n")).first()[0] or 0
    if most <= block:
        return block_trees(cloud, block)
    huge = counts.where(F.col("n") > TASK_EDGES).select("set_id")
    if most <= TASK_EDGES:
        return tree_of_neighbours(cloud, near, k)
    rest = cloud.join(huge, "set_id", "left_semi")
    out = tree_of_neighbours(cloud.join(huge, "set_id", "left_anti"), near.join(huge, "set_id", "left_anti") if near is not None else None, k)
    return out.unionByName(spanning_tree_of_edges(rest, block_trees(rest, block)))


def certain_edges(edges: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
    """The forest (u, v, w) of listed edges, told apart (kind 1: surely of the tree, 0: not), and (u: point, v: component) of kind 2 after joining the sure ones.

    ``beyond`` (id, w): edges of a point that aren't listed are that long at least. An edge is sure if it is shorter than those of all
    points on one of the sides that it joins, as it is then the shortest of all that leave that side.
    """
    edges = edges.sort_values(["w", "u", "v"])
    ids, at = np.unique(beyond["id"].to_numpy(), return_index=True)
    low = beyond["w"].to_numpy()[at].tolist()
    u, v, w = np.searchsorted(ids, edges["u"].to_numpy()).tolist(), np.searchsorted(ids, edges["v"].to_numpy()).tolist(), edges["w"].tolist()
    parent, comp, sure = list(range(len(ids))), list(range(len(ids))), np.zeros(len(w), np.int64)

    def root(of: list[int], i: int) -> int:
        while of[i] != i:
            of[i] = i = of[of[i]]
        return i

    for e in range(len(w)):
        x, y = root(parent, u[e]), root(parent, v[e])
        if w[e] < low[x] or w[e] < low[y]:
            sure[e] = 1
            p, q = root(comp, u[e]), root(comp, v[e])
            comp[max(p, q)] = min(p, q)
        parent[max(x, y)] = min(x, y)
        low[min(x, y)] = min(low[x], low[y])
    names = pd.DataFrame({"u": ids, "v": ids[[root(comp, i) for i in range(len(ids))]], "w": 0.0, "kind": 2})
    return pd.concat([edges[["u", "v", "w"]].assign(kind=sure), names])


def tree_of_neighbours(cloud: DataFrame, near: DataFrame | None = None, k: int = K) -> DataFrame:
    """The spanning tree as in ``minimum_spanning_tree``, from each point's k nearest.

    The forest of the listed pairs is made first. Its edges that can't be beaten by a pair that isn't listed are of the tree. Where
    that leaves several components, all but a set's largest get their best edge in rounds, for which those of their points are
    searched whose lists don't settle it.
    """
    near = cut(knn(cloud, k)) if near is None else near
    listed = near.select("set_id", F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v"), (F.col("d") + OFFSET).alias("w")).distinct()
    forest = spanning_tree_of_edges(cloud, listed)
    full = near.groupBy("set_id", F.col("i").alias("id")).agg(F.count("*").alias("n"), (F.max("d") + OFFSET).alias("w"))
    beyond = cloud.select("set_id", "id").distinct().join(full, ["set_id", "id"], "left").select("set_id", "id", F.when(F.col("n") >= k, F.col("w")).otherwise(F.lit(float("inf"))).alias("w"))
    beyond = cut(beyond)

    def told(key: tuple, edges: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
        return certain_edges(edges, beyond).assign(set_id=key[0])[["set_id", "u", "v", "w", "kind"]]

    both = cut(forest.groupBy("set_id").cogroup(beyond.groupBy("set_id")).applyInPandas(told, "set_id string, u long, v long, w double, kind long"))
    tree, open_ = both.where("kind = 1").select("set_id", "u", "v", "w"), both.where("kind = 0").select("set_id", "u", "v", "w")
    labels = both.where("kind = 2").select("set_id", F.col("u").alias("id"), F.col("v").alias("comp"))
    while True:
        sizes = cut(labels.groupBy("set_id", "comp").agg(F.count("*").alias("n")))
        largest = sizes.groupBy("set_id").agg(F.count("*").alias("many"), F.max_by("comp", F.struct("n", "comp")).alias("largest")).where("many > 1")
        if not largest.limit(1).count():
            return tree
        end = lambda c: labels.select("set_id", F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
        leaving = open_.join(end("u"), ["set_id", "u"]).join(end("v"), ["set_id", "v"]).where("cu <> cv").select("set_id", F.explode(F.array("cu", "cv")).alias("comp"), F.struct("w", "u", "v").alias("e"))
        best = leaving.groupBy("set_id", "comp").agg(F.min("e").alias("best"))
        small = labels.join(largest.select("set_id", "largest"), "set_id").join(best, ["set_id", "comp"], "left")
        small = small.join(beyond, ["set_id", "id"]).select("set_id", "id", "comp", "best", (F.col("comp") != F.col("largest")).alias("_small"), "w")
        asked = (F.col("_small") & (F.col("best").isNull() | (F.col("w") <= F.col("best.w")))).cast("long").alias("asked")
        small = cut(small.select("set_id", "id", "comp", F.when(F.col("_small"), F.col("best")).alias("best"), asked))
        found = small.where("best is not null").select("set_id", "comp", F.col("best").alias("e"))
        if small.where("asked = 1").limit(1).count():
            placed = cloud.join(small.select("set_id", "id", "comp", "asked"), ["set_id", "id"])
            out = block_pairs(placed, outward, "comp long, u long, v long, w double", None, extra=("comp", "asked"))
            found = found.unionByName(out.select("set_id", "comp", F.struct("w", "u", "v").alias("e")))
        picked = cut(found.groupBy("set_id", "comp").agg(F.min("e").alias("e")).select("set_id", "e.u", "e.v", "e.w").distinct())
        if not picked.limit(1).count():  # what is left has no distance to the others
            return tree
        tree = tree.unionByName(picked)
        labels = contracted(labels, picked)


def outward(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(comp, u, v, w): for each component with points asked for in a, the best edge from one of them to a point of another component in b."""
    a, b = a[a["asked"] == 1].sort_values("id"), b.sort_values("id")
    if not len(a):
        return pd.DataFrame({"comp": np.zeros(0, int), "u": np.zeros(0, int), "v": np.zeros(0, int), "w": np.zeros(0)})
    mine, theirs, x, y = a["comp"].to_numpy(), b["comp"].to_numpy(), a["id"].to_numpy(), b["id"].to_numpy()
    i, j, d = closest(matrix(a), matrix(b), 1, lambda here: mine[here, None] == theirs[None, :])
    out = pd.DataFrame({"comp": mine[i], "u": np.minimum(x[i], y[j]), "v": np.maximum(x[i], y[j]), "w": d + OFFSET})
    return out.sort_values(["w", "u", "v"]).drop_duplicates("comp")


def block_trees(cloud: DataFrame, block: int = BLOCK, core: str | None = None) -> DataFrame:
    """(set_id, u, v, w): the trees of all pairs of blocks, each edge once. ``core``: see ``small_tree``."""
    return block_pairs(cloud, lambda a, b: small_tree(pd.concat([a, b]), core), "u long, v long, w double", block, extra=(core,) if core else (), half=True).distinct()
