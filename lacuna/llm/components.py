"""Connected components of an edge table by alternating stars; nothing is gathered on the driver but a yes or no each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. No edges: no rows."""
    pairs = saved(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _stars(pairs):
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # dealt anew after the sums, so that the join below reads two shuffles and Spark may split a node with very many edges
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).repartition("u", "m")
        # every larger neighbour hangs on the smallest node around, then every smaller one does
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = hung.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = saved(small.where("u <> v").distinct())
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(pairs: DataFrame) -> bool:
    """Whether each node hangs on one other node, and none hangs on a node that hangs itself."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).unionAll(pairs.select(F.col("v").alias("node"), F.lit(0).alias("hangs")))
    return not ends.groupBy("node").agg(F.sum("hangs").alias("up"), F.min("hangs").alias("least")).where("up > 1 or (up = 1 and least = 0)").limit(1).count()
