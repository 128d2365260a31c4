"""Ranks of rows in order, without one task for a group."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.checkpoints import written

RANGE_ROWS = 100_000


def ranks(rows: DataFrame, by: list[str], order: list[str], name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with their rank, from 1, in ``name``, among those equal in ``by`` in the order of ``order``; rows equal in both stand in any order.

    Rows are sorted in ranges of about ``range_rows``, however they fall on the groups; a rank is the place in the range after the counts
    of the group's ranges before. Nulls come first.
    """
    parts = max(1, -(-rows.count() // range_rows))
    dealt = rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))), f"ranks-{uuid.uuid4().hex}")
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_of"), before.alias("_before"))
    match = F.col("_part") == F.col("_of")
    for b in by:
        match = match & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return dealt.join(counts, match).select(*rows.columns, (F.col("_at") + F.col("_before")).cast("long").alias(name))
