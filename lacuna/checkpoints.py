"""Cutting the lineage of iterative jobs in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Where none is set, a local session (as in tests) gets one under the warehouse; on a cluster that is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again.

    Spark removes a checkpoint when its rows are no longer in use, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table called ``name`` in the shared folder and read again.

    For many rounds of joins: a checkpoint keeps the sizes Spark has estimated, which multiply from round to round, and a table has its own.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
