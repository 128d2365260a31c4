"""Do types split a label, does context explain the split, and does it survive without duration?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.scores import adjusted_rand, chi_square, contingency, with_p

PURE, LEAST, MIN_TOTAL = 0.8, 10, 5
VARIABLES = ("run_pos", "prev", "pos_bin", "recording")


def pure_groups(df: DataFrame, group: str, label: str, by: list[str], least: int = LEAST, pure: float = PURE) -> DataFrame:
    """(by, group, label, n) of groups, -1 left out, in which one label has ``least`` rows and the share ``pure``."""
    cells = contingency(df.where(F.col(group) >= 0), group, label, by)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by, group))
    return cells.withColumn("_s", share).where((F.col("n") >= least) & (F.col("_s") >= pure)).drop("_s")


def splits(df: DataFrame, group: str, label: str, by: list[str]) -> DataFrame:
    """(by, label, group) of labels that two pure groups or more share."""
    pure = pure_groups(df, group, label, by)
    count = F.count("*").over(Window.partitionBy(*by, label))
    return pure.withColumn("_k", count).where("_k >= 2").select(*by, label, group)


def context_tests(df: DataFrame, group: str, label: str, by: list[str], variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """(by, label, var, n, chi2, dof, v, p, p_bonf): group against each context variable within each split label.

    Rows are unpivoted once, so all variables and labels are tested in one job; p_bonf counts all tests.
    """
    rows = df.join(splits(df, group, label, by), [*by, label, group], "left_semi")
    long = rows.unpivot([*by, label, group], list(variables), "var", "value")
    tests = chi_square(long, group, "value", [*by, label, "var"], MIN_TOTAL).where("dof > 0")
    return with_p(tests)


def strongest(tests: DataFrame, by: list[str]) -> DataFrame:
    """The test with the largest V of each split."""
    w = Window.partitionBy(*by).orderBy(F.desc("v"), "var")
    return tests.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def survival(df: DataFrame, before: str, after: str, label: str, by: list[str], least_ari: float = 0.5) -> DataFrame:
    """(by, label, orig_groups, new_pure_groups, agreement, survives) for labels split by ``before``."""
    old = splits(df, before, label, by)
    new = pure_groups(df, after, label, by)
    rows = df.join(old, [*by, label, before], "left_semi").join(new, [*by, label, after], "left_semi")
    ari = adjusted_rand(rows, before, after, [*by, label]).withColumnRenamed("ari", "agreement")
    n_old = old.groupBy(*by, label).agg(F.count("*").alias("orig_groups"))
    n_new = new.groupBy(*by, label).agg(F.count("*").alias("new_pure_groups"))
    out = n_old.join(n_new, [*by, label], "left").join(ari, [*by, label], "left").na.fill(0, ["new_pure_groups"])
    return out.withColumn("survives", F.coalesce((F.col("new_pure_groups") >= 2) & (F.col("agreement") >= least_ari), F.lit(False)))
