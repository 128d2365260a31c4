"""From calls to verdicts: images or contours to ten components, the gate, and its score against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.clusters import pca
from lacuna.operators.gate import Gate, gap_test
from lacuna.operators.neighbors import rms_scaled
from lacuna.operators.scores import adjusted_rand


def cloud_of(calls: DataFrame, components: int = 10) -> DataFrame:
    """(set_id, id, z) of calls (id, image): principal components, scaled to a root mean square of 1."""
    return rms_scaled(pca(calls.select(F.lit("all").alias("set_id"), "id", F.col("image").alias("z")), components))


def judge(calls: DataFrame, **options) -> Gate:
    """The gate over calls (id, image)."""
    return gap_test(cloud_of(calls), **options)


def agreement(gate: Gate, labels: DataFrame, label: str = "label") -> DataFrame:
    """(set_id, ari) of the groups, -1 left out, against labels (id, label)."""
    return adjusted_rand(gate.groups.where("grp >= 0").join(labels, "id"), "grp", label, ["set_id"])


def passes(runs: DataFrame, kind: str = "repertoire", p: str = "p", alpha: float = 0.05) -> DataFrame:
    """(discrete, runs, hits, passed): at least 80 % of runs with types rejected, at most 20 % (or one) of the continua."""
    rows = runs.withColumn("discrete", F.col(kind).startswith("discrete"))
    out = rows.groupBy("discrete").agg(F.count("*").alias("runs"), F.count_if(F.col(p) < alpha).alias("hits"))
    rule = F.when(F.col("discrete"), F.col("hits") >= F.ceil(0.8 * F.col("runs"))).otherwise(F.col("hits") <= F.greatest(F.lit(1), F.floor(0.2 * F.col("runs"))))
    return out.withColumn("passed", rule)
