"""Local gaps of the merges of a spanning tree, and the groups that cutting them leaves.

Going up the tree's edges by length, a merge of two groups of at least ``min_group`` points has a gap: the edge's length over
the median distance-to-the-k-th-neighbour around it. The tree and the neighbours are Spark jobs over all pairs; the sizes of the
groups that its edges join come from the dendrogram, which is made in blocks of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.dendrogram import PART, dendrogram
from lacuna.operators.graph import components
from lacuna.operators.neighbors import K, kth_radius
from lacuna.operators.ranges import range_medians

MIN_GROUP = 10


def merges(tree: DataFrame, part: int = PART) -> DataFrame:
    """The edges with their rank e and the sizes size_a and size_b of the groups they join, and the group's smallest id, ``first``."""
    return dendrogram(tree, part)[0].select("set_id", "u", "v", "w", "e", "size_a", "size_b", "first")


def gap_tree(tree: DataFrame, neighbors: DataFrame, k: int = K, min_group: int = MIN_GROUP, norm: str = "local", part: int = PART) -> DataFrame:
    """(set_id, u, v, w, e, gap) of every merge of two groups of at least ``min_group`` points.

    ``norm="local"``: median over the k nearest of both ends, themselves included. ``norm="group"``: over all members of both
    groups, the older measure; they stand next to each other in the dendrogram's order, so each median is one over a range.
    """
    joins, places = dendrogram(tree, part)
    big = joins.where((F.col("size_a") >= min_group) & (F.col("size_b") >= min_group))
    rk = kth_radius(neighbors, k)
    if norm == "local":
        near = neighbors.where(F.col("rank") <= k).select("set_id", F.col("i").alias("end"), F.col("j").alias("id"))
        near = near.unionByName(rk.select("set_id", F.col("id").alias("end"), "id"))
        ends = big.select("set_id", "e", F.col("u").alias("end")).unionByName(big.select("set_id", "e", F.col("v").alias("end")))
        around = ends.join(near, ["set_id", "end"]).select("set_id", "e", "id").distinct()
        scale = around.join(rk, ["set_id", "id"]).groupBy("set_id", "e").agg(F.median("rk").alias("scale"))
    else:
        values = places.join(rk, ["set_id", "id"]).select("set_id", "place", F.col("rk").alias("x"))
        first = places.select("set_id", F.col("id").alias("first"), "place")
        spans = big.join(first, ["set_id", "first"]).select("set_id", F.col("e").cast("long").alias("e"), F.col("place").alias("lo"), (F.col("place") + F.col("size_a") + F.col("size_b")).alias("hi"))
        scale = range_medians(values, spans).withColumnRenamed("median", "scale")
    return big.join(scale, ["set_id", "e"]).select("set_id", "u", "v", "w", "e", (F.col("w") / F.col("scale")).alias("gap"))


def max_gap(sets: DataFrame, gaps: DataFrame) -> DataFrame:
    """(set_id, max_gap): 0 where no merge has a gap."""
    top = gaps.groupBy("set_id").agg(F.max("gap").alias("max_gap"))
    return sets.select("set_id").distinct().join(top, "set_id", "left").select("set_id", F.coalesce("max_gap", F.lit(0.0)).alias("max_gap"))


def cut_groups(cloud: DataFrame, tree: DataFrame, gaps: DataFrame, thresholds: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(set_id, id, grp): groups left by dropping edges whose gap is above the set's threshold (set_id, thr).

    A group is named by its smallest id; points of groups below ``min_group`` get -1.
    """
    drop = gaps.join(thresholds, "set_id").where("gap > thr").select("set_id", "u", "v")
    labels = components(cloud.select("set_id", "id"), tree.join(drop, ["set_id", "u", "v"], "left_anti"))
    sizes = labels.groupBy("set_id", "comp").agg(F.count("*").alias("n"))
    return labels.join(sizes, ["set_id", "comp"]).select("set_id", "id", F.when(F.col("n") >= min_group, F.col("comp")).otherwise(F.lit(-1)).cast("long").alias("grp"))
