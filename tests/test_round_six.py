"""Tests of the sixth round's changes to searches: spread over tasks."""

import numpy as np
from pyspark.sql import functions as F

from lacuna.operators import neighbors


def _points(spark, z):
    return spark.createDataFrame([("s", i, x.tolist()) for i, x in enumerate(z)], "set_id string, id long, z array<double>")


def test_pairs_of_blocks_are_spread_over_tasks(spark):
    """Before, they were in as many tasks as shuffles have partitions, here 4, or fewer."""
    cloud = _points(spark, np.random.default_rng(1).normal(size=(600, 2)))
    found = neighbors.block_pairs(cloud, lambda a, b: a[["id"]].head(1), "id long", 100)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 8
