"""Agreement and association: contingency tables, adjusted Rand index, mutual information, chi-square, Hopkins, accuracy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, a, b, n): counts of pairs that occur, in long form."""
    return df.groupBy(*(by or []), a, b).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """The counts as a table with a column for each of ``values``; pairs that don't occur have 0."""
    return df.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0)


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(by, ari) of two labellings. Where both are trivial the index is 1. All sums are of map-side partial counts."""
    by = by or []
    cells = contingency(df, a, b, by)
    key = by or [F.lit(1).alias("_all")]
    names = by or ["_all"]
    cells = cells.select(*key, F.col(a).alias("_a"), F.col(b).alias("_b"), "n")
    inner = cells.groupBy(*names).agg(F.sum(_pairs(F.col("n"))).alias("_s"), F.sum("n").alias("_t"))
    left = cells.groupBy(*names, "_a").agg(F.sum("n").alias("n")).groupBy(*names).agg(F.sum(_pairs(F.col("n"))).alias("_sa"))
    right = cells.groupBy(*names, "_b").agg(F.sum("n").alias("n")).groupBy(*names).agg(F.sum(_pairs(F.col("n"))).alias("_sb"))
    both = inner.join(left, names).join(right, names)
    expected = F.col("_sa") * F.col("_sb") / _pairs(F.col("_t"))
    highest = (F.col("_sa") + F.col("_sb")) / 2
    trivial = (F.col("_t") < 2) | (highest == F.try_divide(F.col("_sa") * F.col("_sb"), _pairs(F.col("_t"))))
    return both.select(*by, F.when(trivial, F.lit(1.0)).otherwise((F.col("_s") - expected) / (highest - expected)).alias("ari"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(mi, h_a, h_b) in nats."""
    cells = contingency(df, a, b)
    rows = cells.groupBy(a).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("nb"))
    sizes = cells.agg(F.sum("n").alias("t"))
    mi = cells.join(rows, a).join(cols, b).crossJoin(sizes).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda t, n, name: t.crossJoin(sizes).agg((-F.sum(F.col(n) / F.col("t") * F.ln(F.col(n) / F.col("t")))).alias(name))
    return mi.crossJoin(entropy(rows, "na", "h_a")).crossJoin(entropy(cols, "nb", "h_b"))


def chance_information(a: int, b: int, n: int) -> float:
    """What a group of a and one of b of n rows add to the expected mutual information of random labellings (hypergeometric)."""
    k = np.arange(max(1, a + b - n), min(a, b) + 1)
    log_f = np.vectorize(math.lgamma, otypes=[float])
    fixed = sum(math.lgamma(x + 1) for x in (a, b, n - a, n - b)) - math.lgamma(n + 1)
    log_p = fixed - log_f(k + 1) - log_f(a - k + 1) - log_f(b - k + 1) - log_f(n - a - b + k + 1)
    return float((k / n * np.log(n * k / (a * b)) * np.exp(log_p)).sum())


def expected_information(sizes_a: list[int], sizes_b: list[int]) -> float:
    """Expected mutual information of two random labellings with these group sizes."""
    return sum(chance_information(a, b, sum(sizes_a)) for a in sizes_a for b in sizes_b)


def adjusted_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ami): adjusted mutual information with the arithmetic mean of the entropies.

    The expectation is a sum over pairs of distinct group sizes, of which n rows have at most about sqrt(2 n), dealt over tasks.
    """
    of_size = lambda c, name: df.groupBy(c).agg(F.count("*").alias(name)).groupBy(name).agg(F.count("*").alias(f"{name}_times"))
    total = df.agg(F.count("*").alias("t"))
    pairs = of_size(a, "na").crossJoin(F.broadcast(of_size(b, "nb"))).crossJoin(F.broadcast(total))
    each = F.pandas_udf(lambda x, y, n: pd.Series([chance_information(int(i), int(j), int(m)) for i, j, m in zip(x, y, n, strict=True)], dtype=float), "double")
    chance = pairs.agg(F.sum(F.col("na_times") * F.col("nb_times") * each("na", "nb", "t")).alias("chance"), F.sum("na_times").alias("ka"), F.sum("nb_times").alias("kb"), F.count("*").alias("cells"))
    both = mutual_information(df, a, b).crossJoin(chance)
    below = (F.col("h_a") + F.col("h_b")) / 2 - F.col("chance")
    one = (F.col("h_a") <= 0) & (F.col("h_b") <= 0)
    return both.select(F.when(one, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("mi") - F.col("chance"), below), F.lit(1.0))).alias("ami"))


def chi_square(df: DataFrame, group: str, category: str, by: list[str], min_total: int = 0) -> DataFrame:
    """(by, n, chi2, dof, v) of group x category for each value of ``by``.

    Categories below ``min_total`` are left out; empty cells count. With one degree of freedom the deviations are lessened by
    at most 1/2 (Yates). ``v`` is Cramer's V, null where there is one row or column.
    """
    cells = contingency(df, group, category, by)
    per_cat = Window.partitionBy(*by, category)
    cells = cells.withColumn("_c", F.sum("n").over(per_cat)).where(F.col("_c") >= min_total).drop("_c")
    rows = cells.groupBy(*by, group).agg(F.sum("n").alias("r"))
    cols = cells.groupBy(*by, category).agg(F.sum("n").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("t"), F.countDistinct(group).alias("nr"), F.countDistinct(category).alias("nc"))
    grid = rows.join(cols, by).join(cells, [*by, group, category], "left").join(total, by)
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    e = F.col("r") * F.col("c") / F.col("t")
    off = F.abs(F.coalesce("n", F.lit(0)) - e)
    part = F.pow(off - F.when(dof == 1, F.least(F.lit(0.5), off)).otherwise(0.0), F.lit(2.0)) / e
    out = grid.groupBy(*by, "t", "nr", "nc").agg(F.sum(part).alias("chi2"))
    v = F.when(F.least("nr", "nc") > 1, F.sqrt(F.col("chi2") / (F.col("t") * (F.least("nr", "nc") - 1))))
    return out.select(*by, F.col("t").alias("n"), "chi2", dof.cast("int").alias("dof"), v.alias("v"))


def chi_square_tail(x: float, dof: int) -> float:
    """Survival function of the chi-square distribution for whole degrees of freedom, in closed form."""
    if x <= 0 or dof <= 0:
        return 1.0
    half = x / 2
    if dof % 2 == 0:
        term = total = math.exp(-half)
        for k in range(1, dof // 2):
            term *= half / k
            total += term
        return total
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(2 * x / math.pi) * math.exp(-half)
    for k in range(3, dof + 1, 2):
        total += term
        term *= x / k
    return total


def bonferroni(tests: DataFrame, p: str = "p", name: str = "p_bonf") -> DataFrame:
    """Adds p times the number of all rows, at most 1."""
    count = tests.agg(F.count("*").alias("_m"))
    return tests.crossJoin(F.broadcast(count)).withColumn(name, F.least(F.col(p) * F.col("_m"), F.lit(1.0))).drop("_m")


def with_p(tests: DataFrame, chi2: str = "chi2", dof: str = "dof") -> DataFrame:
    """Adds p and, over all rows together, Bonferroni's p_bonf."""
    tail = F.pandas_udf(lambda x, d: pd.Series([chi_square_tail(float(a), int(b)) for a, b in zip(x, d, strict=True)], dtype=float), "double")
    return bonferroni(tests.withColumn("p", tail(F.col(chi2), F.col(dof))))


def balanced_accuracy(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Mean over classes of the share found right."""
    by = by or []
    recall = df.groupBy(*by, truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("r"))
    return recall.groupBy(*by).agg(F.avg("r").alias("balanced_accuracy"))


def hopkins(data_nearest: DataFrame, reference_nearest: DataFrame, dim: int) -> DataFrame:
    """(hopkins) from nearest-neighbour distances d of data points and of uniform reference points; LOWER means clustered."""
    power = lambda t, name: t.groupBy("repeat").agg(F.sum(F.pow(F.col("d"), F.lit(float(dim)))).alias(name))
    both = power(data_nearest, "w").join(power(reference_nearest, "u"), "repeat")
    return both.agg(F.avg(F.col("w") / (F.col("u") + F.col("w"))).alias("hopkins"))


def p_values(observed: DataFrame, nulls: DataFrame) -> DataFrame:
    """(p): the largest over (dim, shape) of (1 + nulls at or above the observed) / (1 + nulls)."""
    cells = nulls.crossJoin(F.broadcast(observed)).groupBy("dim", "shape").agg(((1 + F.count_if(F.col("max_gap") >= F.col("obs"))) / (1 + F.count("*"))).alias("p"))
    return cells.agg(F.max("p").alias("p"))
