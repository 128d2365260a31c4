"""Summaries over runs and verdicts: what the tables and figures of an analysis are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.scores import balanced_accuracy
from lacuna.operators.sequence import value_tertile


def counts_by_method(runs: DataFrame, method: str = "method", k: str = "k") -> DataFrame:
    """(method, median_k, min_k, max_k): cluster counts of each method's runs."""
    return runs.groupBy(method).agg(F.median(k).alias("median_k"), F.min(k).alias("min_k"), F.max(k).alias("max_k"))


def effect_ratio(verdicts: DataFrame) -> DataFrame:
    """Adds ``ratio``: how far the largest gap reaches towards its threshold; null for a threshold of 0."""
    return verdicts.withColumn("ratio", F.try_divide("max_gap", "threshold"))


def count_error(runs: DataFrame, by: list[str], k: str = "k", truth: str = "n_labels") -> DataFrame:
    """(by, median_error): median absolute difference of found and labelled counts."""
    return runs.groupBy(*by).agg(F.median(F.abs(F.col(k) - F.col(truth))).alias("median_error"))


def share_meeting(runs: DataFrame, meets: Column, by: list[str]) -> DataFrame:
    """(by, runs, met, share) of a predicate over the runs of each subset; null counts as not met."""
    out = runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(F.coalesce(meets, F.lit(False))).alias("met"))
    return out.withColumn("share", F.col("met") / F.col("runs"))


def share_unassigned(groups: DataFrame, by: list[str], group: str = "grp") -> DataFrame:
    """(by, unassigned): share of the points whose group is -1."""
    return groups.groupBy(*by).agg(F.avg((F.col(group) == -1).cast("double")).alias("unassigned"))


def accuracy_by_tertile(df: DataFrame, value: str, truth: str, predicted: str) -> DataFrame:
    """(tertile, n, lowest, highest, balanced_accuracy) within the thirds of a value; rows without the value are left out."""
    rows = value_tertile(df, value).where(F.col("tertile").isNotNull())
    facts = rows.groupBy("tertile").agg(F.count("*").alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return facts.join(balanced_accuracy(rows, truth, predicted, ["tertile"]), "tertile")


def types_against(gaps: DataFrame, nulls: DataFrame, sets: DataFrame, dim: int = 1, alpha: float = 0.05) -> DataFrame:
    """(set_id, n_types) if only the nulls of one dimension counted: the worst case of a thin set."""
    rule = nulls.where(F.col("dim") == dim).groupBy("shape").agg(F.percentile("max_gap", F.lit(1 - alpha)).alias("q")).agg(F.max("q").alias("_thr"))
    above = gaps.crossJoin(F.broadcast(rule)).where("gap > _thr").groupBy("set_id").agg(F.count("*").alias("_above"))
    return sets.select("set_id").distinct().join(above, "set_id", "left").select("set_id", (1 + F.coalesce("_above", F.lit(0))).alias("n_types"))


def control_verdicts(runs: DataFrame, alpha: float = 0.05, off_by: int = 2, least_ari: float = 0.5) -> DataFrame:
    """Adds rejects, types_fit and groups_fit to runs (p, n_types, n_categories, ari)."""
    return runs.select(
        "*", (F.col("p") < alpha).alias("rejects"), (F.abs(F.col("n_types") - F.col("n_categories")) <= off_by).alias("types_fit"), (F.col("ari") > least_ari).alias("groups_fit")
    )
