"""The dendrogram of single linkage over a spanning tree, as Spark jobs in which no task holds a set's tree.

Edges are ranked by (w, u, v). A block of edges with consecutive ranks is split in the middle: the lower half joins points into
components, and for the upper half each component is one point of their joint size. Both halves are blocks of their own, so after
as many rounds as the number of blocks has doublings all blocks have at most ``PART`` edges and are folded in a task each. What a
round does for all blocks of all sets is one labelling and a few joins.

Leaves are numbered so that the members of each merge stand next to each other: at a merge the side with the smallest id comes
first. A point's place in a block is its place in the lower half plus its component's place in the upper half; so places add up
from the smallest blocks to the whole. The smallest id of a group is its first leaf, and a merge is the range of places from its
first leaf's on, ``size_a`` of the first side and then ``size_b`` of the other.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.checkpoints import written
from lacuna.operators.graph import components
from lacuna.operators.ordering import ranks

PART = 100_000

def ranked(tree: DataFrame) -> DataFrame:
    """(set_id, u, v, w, e): edges with their rank from 1 by (w, u, v)."""
    return ranks(tree.select("set_id", "u", "v", "w"), ["set_id"], ["w", "u", "v"], "e").withColumn("e", F.col("e").cast("int"))


def _folded(edges: pd.DataFrame) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """For the edges of a block in order: (first leaf, size of its side, size of the other), and each point's place in its group."""
    parent: dict[int, int] = {}
    size: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, n in zip([*edges["a"], *edges["b"]], [*edges["na"], *edges["nb"]], strict=True):
        parent[x], size[x] = x, n
    out, joins = [], []
    for a, b in zip(edges["a"].tolist(), edges["b"].tolist(), strict=True):
        a, b = sorted((root(a), root(b)))
        out.append((a, size[a], size[b]))
        joins.append((a, b, size[a]))
        parent[b] = a
        size[a] += size[b]
    # undone from the last on: the side of b begins behind that of a, and the side of a where the group does
    place = dict.fromkeys(parent, 0)
    for a, b, n in reversed(joins):
        place[b] = place[a] + n
    return out, place


def dendrogram(tree: DataFrame, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Merges (set_id, u, v, w, e, first, size_a, size_b) of a spanning tree or forest (set_id, u, v, w), and places (set_id, id, place) of its points.

    ``first`` is the smallest id of the merged group, ``size_a`` the size of its side. Places count from 0 within each group that is left.
    """
    name = f"dendrogram-{uuid.uuid4().hex}"
    edges = ranked(tree)
    edges = written(edges.select("*", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"), F.lit("").alias("block")), f"{name}/edges")
    key = ["set_id", "block"]
    halved: list[tuple[DataFrame, DataFrame]] = []  # of each round: the blocks that were split, and (block, id, comp) of their lower halves
    done: list[DataFrame] = []
    while True:
        counts = written(edges.groupBy(*key).agg(F.count("*").alias("m"), F.min("e").alias("least"), F.max("e").alias("most")), f"{name}/counts-{len(halved)}")
        done.append(edges.join(counts.where(F.col("m") <= part).select(*key), key))
        large = counts.where(F.col("m") > part)
        if not large.limit(1).count():
            break
        # ranks of a block are consecutive, so the middle rank halves it
        split = edges.join(large.select(*key, F.floor((F.col("least") + F.col("most")) / 2).alias("middle")), key)
        low = split.where(F.col("e") <= F.col("middle")).drop("middle")
        high = split.where(F.col("e") > F.col("middle")).drop("middle")
        tag = F.concat_ws("|", "set_id", "block")
        ends = low.select("set_id", "block", F.col("a").alias("id"), F.col("na").alias("n")).unionByName(low.select("set_id", "block", F.col("b").alias("id"), F.col("nb").alias("n"))).distinct()
        labels = components(ends.select(tag.alias("set_id"), "id"), low.select(tag.alias("set_id"), F.col("a").alias("u"), F.col("b").alias("v")))
        found = ends.withColumn("tag", tag).join(labels.select(F.col("set_id").alias("tag"), "id", "comp"), ["tag", "id"]).drop("tag")
        found = written(found, f"{name}/labels-{len(halved)}")
        sizes = found.groupBy(*key, "comp").agg(F.sum("n").alias("size"))
        as_end = lambda c: found.join(sizes, [*key, "comp"]).select(*key, F.col("id").alias(c), F.col("comp").alias(f"_{c}"), F.col("size").alias(f"_n{c}"))
        for c in "ab":
            high = high.join(as_end(c), [*key, c], "left").withColumn(c, F.coalesce(f"_{c}", c)).withColumn(f"n{c}", F.coalesce(f"_n{c}", f"n{c}")).drop(f"_{c}", f"_n{c}")
        halves = low.withColumn("block", F.concat("block", F.lit("0"))).unionByName(high.select(*low.columns).withColumn("block", F.concat("block", F.lit("1"))))
        halved.append((large.select(*key), found.select(*key, "id", "comp")))
        edges = written(halves, f"{name}/halves-{len(halved)}")
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("e").reset_index(drop=True)
        merged, place = _folded(rows)
        points = pd.DataFrame({"id": list(place), "place": list(place.values())})
        out = rows[["u", "v", "w", "e"]].assign(first=[m[0] for m in merged], size_a=[m[1] for m in merged], size_b=[m[2] for m in merged])
        out = pd.concat([out.astype({"e": "Int64"}), points]).convert_dtypes()
        return out.assign(set_id=rows["set_id"].iloc[0], block=rows["block"].iloc[0])

    schema = "set_id string, block string, u long, v long, w double, e int, first long, size_a long, size_b long, id long, place long"
    both = written(leaves.groupBy(*key).applyInPandas(lambda rows: fold(rows)[[c.split()[0] for c in schema.split(", ")]], schema), f"{name}/folded")
    merges = both.where("e is not null").select("set_id", "u", "v", "w", "e", "first", "size_a", "size_b")
    places = both.where("e is null").select(*key, "id", "place")
    for depth in range(len(halved) - 1, -1, -1):
        blocks, labels = halved[depth]
        inner = places.where(F.length("block") > depth)
        low = inner.where(F.substring("block", -1, 1) == "0").select("set_id", F.expr("substr(block, 1, length(block) - 1)").alias("block"), "id", F.col("place").alias("low"))
        high = inner.where(F.substring("block", -1, 1) == "1").select("set_id", F.expr("substr(block, 1, length(block) - 1)").alias("block"), F.col("id").alias("comp"), F.col("place").alias("high"))
        # points of the lower half stand within their component; components that only the upper half knows are points of their own
        mine = low.join(labels, [*key, "id"]).join(high, [*key, "comp"], "left").select(*key, "id", (F.col("low") + F.coalesce("high", F.lit(0))).alias("place"))
        rest = high.join(labels.select(*key, "comp").distinct(), [*key, "comp"], "left_anti").select(*key, F.col("comp").alias("id"), F.col("high").alias("place"))
        places = written(places.where(F.length("block") <= depth).unionByName(mine).unionByName(rest), f"{name}/places-{depth}")
    return merges, places.select("set_id", "id", "place")
