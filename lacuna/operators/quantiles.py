"""Exact quantiles of a column of any length, by refining histograms; no task holds the column or its distinct values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
FEW = 2000


def exact_quantiles(df: DataFrame, value: Column, shares: list[float], bins: int = BINS, few: int = FEW) -> list[float | None]:
    """The quantiles of the values that aren't null at ``shares`` (0 to 1), with linear interpolation between ranks; none: all None.

    A pass counts the values of each interval in ``bins`` equal bins, with map-side counts, and keeps the least and greatest value of
    each. The bin that holds a rank sought is the next pass's interval, until it has one value, or at most ``few``, which are
    fetched in order. Infinite values and NaN, which comes last, are counted apart.
    """
    x = value.cast("double")
    rows = df.select(x.alias("x")).where("x is not null")
    finite = ~F.isnan("x") & (F.abs("x") != F.lit(math.inf))
    inside = F.when(finite, F.col("x"))
    n, low, high, kept, least, most = rows.agg(F.count("*"), F.count_if(F.col("x") == -math.inf), F.count_if(F.col("x") == math.inf), F.count(inside), F.min(inside), F.max(inside)).first()
    if not n:
        return [None] * len(shares)
    rows = rows.where(finite)
    found: dict[int, float] = {}
    open_: dict[tuple[float, float], tuple[int, set[int]]] = {}  # interval: how many values come before it, the ranks sought in it
    for share in shares:
        at = share * (n - 1)
        for rank in {math.floor(at), math.ceil(at)}:
            if rank < low:
                found[rank] = -math.inf
            elif rank >= low + kept:
                found[rank] = math.inf if rank < low + kept + high else math.nan
            elif least == most:
                found[rank] = least
            else:
                open_.setdefault((least, most), (low, set()))[1].add(rank)
    while open_:
        pick, where = None, list(open_)
        for k, (a, b) in enumerate(where):
            place = F.floor((F.col("x") / 2 - a / 2) / (b / 2 - a / 2) * bins)
            hit = F.struct(F.lit(k).alias("of"), F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
            pick = F.when(F.col("x").between(a, b), hit) if pick is None else pick.when(F.col("x").between(a, b), hit)
        counted = rows.select("x", pick.alias("p")).where("p is not null").groupBy("p.of", "p.bin").agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        wider = open_
        open_ = {}
        for k, interval in enumerate(where):
            before, ranks = wider[interval]
            for row in sorted((r for r in counted if r["of"] == k), key=lambda r: r["bin"]):
                sought = {r for r in ranks if before <= r < before + row["n"]}
                if sought and row["a"] == row["b"]:
                    found |= dict.fromkeys(sought, row["a"])
                elif sought and row["n"] <= few:
                    values = sorted(r[0] for r in rows.where(F.col("x").between(row["a"], row["b"])).collect())
                    found |= {r: values[r - before] for r in sought}
                elif sought:
                    open_[row["a"], row["b"]] = (before, sought)
                before += row["n"]
    out = []
    for share in shares:
        at = share * (n - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a if a == b or at == math.floor(at) else (math.ceil(at) - at) * a + (at - math.floor(at)) * b)
    return out
