"""The calibrated gate: are the points of each set discrete types or a continuum?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.checkpoints import cut
from lacuna.operators.gaps import MIN_GROUP, cut_groups, gap_tree, max_gap
from lacuna.operators.graph import minimum_spanning_tree
from lacuna.operators.neighbors import K, intrinsic_dim, knn, null_dims
from lacuna.operators.nulls import N_NULL, SHAPES, null_table

ALPHA = 0.05
MAX_DIM = 10


def decide(observed: DataFrame, gaps: DataFrame, nulls: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(set_id, max_gap, threshold, p, n_types, is_discrete).

    ``observed``: (set_id, n, dims, max_gap); ``nulls``: (n, dim, shape, max_gap). The most lenient null counts: the largest
    quantile and the largest p over shapes and dimensions.
    """
    pairs = observed.select("set_id", "n", F.explode("dims").alias("dim"), "max_gap")
    drawn = pairs.join(nulls.withColumnRenamed("max_gap", "null_gap"), ["n", "dim"])
    cells = drawn.groupBy("set_id", "dim", "shape").agg(F.percentile("null_gap", F.lit(1 - alpha)).alias("q"), ((1 + F.count_if(F.col("null_gap") >= F.col("max_gap"))) / (1 + F.count("*"))).alias("p"))
    rules = cells.groupBy("set_id").agg(F.max("q").alias("threshold"), F.max("p").alias("p"))
    above = gaps.join(rules, "set_id").where("gap > threshold").groupBy("set_id").agg(F.count("*").alias("above"))
    out = observed.select("set_id", "max_gap").join(rules, "set_id").join(above, "set_id", "left")
    return out.select("set_id", "max_gap", "threshold", "p", (1 + F.coalesce("above", F.lit(0))).cast("int").alias("n_types"), (F.col("p") < alpha).alias("is_discrete"))


@dataclass
class Gate:
    """``result``: a row for each set; ``gaps``: its merges; ``groups``: (set_id, id, grp)."""

    result: DataFrame
    gaps: DataFrame
    groups: DataFrame


def gap_test(cloud: DataFrame, n_null: int = N_NULL, alpha: float = ALPHA, k: int = K, min_group: int = MIN_GROUP, max_dim: int = MAX_DIM, shapes: tuple[str, ...] = SHAPES, nulls: DataFrame | None = None) -> Gate:
    """The gate for every set of the cloud (set_id, id, z). ``nulls`` may be a table kept from before."""
    cloud = cut(cloud)
    small = cloud.groupBy("set_id").agg(F.count("*").alias("n")).where(F.col("n") <= k).limit(1).collect()
    if small:
        raise ValueError(f"set {small[0].set_id} has {small[0].n} points; more than {k} are needed")
    neighbors = cut(knn(cloud, k))
    tree = cut(minimum_spanning_tree(cloud, near=neighbors, k=k))
    gaps = cut(gap_tree(tree, neighbors, k, min_group))
    dims = intrinsic_dim(neighbors, k)
    counts = cloud.groupBy("set_id").agg(F.count("*").cast("int").alias("n"))
    observed = cut(counts.join(dims, "set_id").join(null_dims(dims, max_dim), "set_id").join(max_gap(cloud, gaps), "set_id"))
    if nulls is None:
        cells = [(r.n, r.dim) for r in observed.select("n", F.explode("dims").alias("dim")).distinct().collect()]
        nulls = cut(null_table(cloud.sparkSession, cells, n_null, shapes, k, min_group))
    decided = cut(decide(observed, gaps, nulls, alpha))
    result = observed.select("set_id", "n", "d_hat", F.col("dims").alias("null_dims")).join(decided, "set_id")
    groups = cut_groups(cloud, tree, gaps, decided.select("set_id", F.col("threshold").alias("thr")), min_group)
    return Gate(result, gaps, groups)
