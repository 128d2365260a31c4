"""All queries of the library's own operators, and the SQL with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna import queries_cloud, queries_reports, queries_tables

QUERIES = queries_cloud.QUERIES | queries_tables.QUERIES | queries_reports.QUERIES
SMOKE_NULLS = 50
ORACLE_SQL = queries_cloud.SQL | queries_tables.SQL | queries_reports.SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on all embeddings: n, d_hat, max_gap, threshold, p, n_types, is_discrete.

    A smoke check with ``SMOKE_NULLS`` null clouds for each cell; the query ``gate`` simulates all ``nulls.N_NULL``.
    """
    return queries_cloud.gate(spark, sf_dir, SMOKE_NULLS)
