"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import free_name, looked_up, quoted, saved, shared_folder
from lacuna.llm.minhash_dedup import near_duplicates
from lacuna.llm.mixing import mix
from lacuna.llm.packing import packed
from lacuna.llm.pseudonyms import pseudonymised, session_key
from lacuna.llm.quality_trees import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, trained on the labels of ``sf_dir``, rejects."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component: the one with the smallest doc_id, rows without one last.

    Rows with the same doc_id and text count as one document, named by a 64-bit hash of both, of which one row stays; rows
    without doc_id are named by their text. Rows that share a doc_id but not the text are documents of their own.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    name = free_name(docs, "key")
    keyed = docs.withColumn(name, key)
    found = near_duplicates(docs.select(key.alias("doc_id"), "text")).groupBy(F.col("doc_id").alias(name)).agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    ids = keyed.groupBy(name).agg(F.min(F.col("doc_id").cast("long")).alias("id"))
    first = found.join(ids, name).groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", name, "n")).alias("first"))
    kept = saved(first.select(f"first.{name}", "first.n"))
    single = keyed.join(kept.where("n = 1").select(name), name, "left_semi").select(*quoted(docs.columns))
    repeated = looked_up(keyed, kept.where("n > 1").select(name), [name], "left_semi")
    one = repeated.groupBy(name).agg(F.min_by(F.struct(*quoted(docs.columns)), F.xxhash64(*quoted(docs.columns))).alias("row")).select("row.*")
    return single.unionByName(one)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same form."""
    return pseudonymised(docs, session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*quoted(docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin and offset. Copies made by the mixture never share a bin."""
    return packed(docs)


STAGES = [("quality classifier", quality), ("near-duplicates", near_dedup), ("personal data", pii), ("source mixture", mixing), ("packing", packing)]

#: The trees, the signatures and the best-fit search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written to the shared folder before the next reads it.

    Each run has a folder of its own, so that a second one doesn't change what a first one still reads.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
