"""Medians over ranges of a sequence, for many ranges at once: a wavelet tree as rounds of Spark jobs.

Values are replaced by their ranks, and ranks are read digit by digit in base ``FAN``. A node of the tree holds the points that
agree in the digits so far, in order of their places. A range within a node is a pair of indices; counting each digit before
both indices tells which child holds the value of the rank sought, and the counts of that digit are the range in the child. The
counts before an index are those before its stretch of ``STRETCH`` points, kept as running totals, and those within the stretch,
counted in the task that has it. So a task holds a stretch, however long the sequence and the ranges are.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.checkpoints import written
from lacuna.operators.ordering import ranks

FAN = 64
STRETCH = 4096


def range_medians(values: DataFrame, ranges: DataFrame, fan: int = FAN, stretch: int = STRETCH) -> DataFrame:
    """(set_id, e, median) of the values (set_id, place, x), with places from 0 without gaps, in each range (set_id, e, lo, hi), hi excluded.

    Of an even number of values the mean of the two in the middle. Empty ranges have no row.
    """
    name = f"ranges-{uuid.uuid4().hex}"
    points = ranks(values.select("set_id", "place", "x"), ["set_id"], ["x", "place"], "rank")
    points = written(points.withColumn("rank", F.col("rank") - 1), f"{name}/points")
    digits, most = 1, (points.agg(F.max("rank")).first()[0] or 0)
    while fan**digits <= most:
        digits += 1
    n = F.col("hi") - F.col("lo")
    middle = F.array(F.floor((n - 1) / 2), F.floor(n / 2))
    asked = ranges.where(n > 0).select("set_id", "e", "lo", "hi", F.posexplode(middle).alias("which", "k"))
    asked = asked.select("set_id", "e", "which", F.lit(0).cast("long").alias("node"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "k")
    for level in range(digits):
        unit = fan ** (digits - 1 - level)
        own = points.withColumn("node", F.floor(F.col("rank") / (unit * fan)))
        own = ranks(own, ["set_id", "node"], ["place"], "at").withColumn("at", F.col("at") - 1) if level else own.withColumn("at", F.col("place"))
        own = own.select("set_id", "node", F.floor(F.col("at") / stretch).alias("part"), "at", F.pmod(F.floor(F.col("rank") / unit), F.lit(fan)).cast("int").alias("digit"))
        counts = own.groupBy("set_id", "node", "part", "digit").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("set_id", "node", "digit").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
        totals = counts.select("set_id", "node", "digit", "part", before.alias("upto"))
        ends = asked.select("set_id", "e", "which", "node", "k", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("lo").alias("index")), F.struct(F.lit(1).alias("end"), F.col("hi").alias("index")))).alias("s")).select("set_id", "e", "which", "node", "k", "s.*")
        ends = ends.withColumn("part", F.floor(F.col("index") / stretch))

        def count(key: tuple, points: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
            points = points.sort_values("at")
            digit, at = points["digit"].to_numpy(), points["at"].to_numpy()
            cut = np.searchsorted(at, ends["index"].to_numpy())
            found = np.zeros((len(ends), fan), np.int64)
            for d in range(fan):
                found[:, d] = np.searchsorted(np.flatnonzero(digit == d), cut)
            return pd.DataFrame({"set_id": np.full(len(ends), key[0], object), "node": key[1], "part": key[2], "e": ends["e"].to_numpy(), "which": ends["which"].to_numpy(), "k": ends["k"].to_numpy(), "end": ends["end"].to_numpy(), "within": pd.Series(list(found), dtype=object)})

        here = own.groupBy("set_id", "node", "part").cogroup(ends.groupBy("set_id", "node", "part")).applyInPandas(count, "set_id string, node long, part long, e long, which int, k long, end int, within array<long>")
        earlier = _vectors(totals, fan)
        here = here.join(earlier, ["set_id", "node", "part"], "left")
        whole = F.when(F.col("earlier").isNull(), F.col("within")).otherwise(F.zip_with("within", "earlier", lambda a, b: a + b))
        both = here.groupBy("set_id", "e", "which", "node", "k").agg(F.max(F.when(F.col("end") == 0, whole)).alias("lo"), F.max(F.when(F.col("end") == 1, whole)).alias("hi"))
        inside = F.zip_with("hi", "lo", lambda a, b: a - b)
        # the digit whose running count first exceeds k
        state = F.struct(F.lit(0).alias("digit"), F.col("k").alias("left"), F.lit(False).alias("found"))
        walk = F.aggregate(inside, state, lambda s, c: F.when(s["found"], s).when(s["left"] < c, F.struct(s["digit"].alias("digit"), s["left"].alias("left"), F.lit(True).alias("found"))).otherwise(F.struct((s["digit"] + 1).alias("digit"), (s["left"] - c).alias("left"), F.lit(False).alias("found"))))
        step = both.withColumn("step", walk)
        asked = step.select("set_id", "e", "which", (F.col("node") * fan + F.col("step.digit")).alias("node"), F.element_at("lo", F.col("step.digit") + 1).alias("lo"), F.element_at("hi", F.col("step.digit") + 1).alias("hi"), F.col("step.left").alias("k"))
        asked = written(asked, f"{name}/asked-{level}")
    found = asked.join(points.select("set_id", F.col("rank").alias("node"), "x"), ["set_id", "node"])
    return found.groupBy("set_id", "e").agg(F.avg("x").alias("median"))


def _vectors(totals: DataFrame, fan: int) -> DataFrame:
    """(set_id, node, part, earlier): how often each digit comes before a stretch, from running totals (.., digit, part, upto) of the stretches that have it."""
    spans = totals.groupBy("set_id", "node").agg(F.max("part").alias("last"))
    parts = spans.select("set_id", "node", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last") + 1)).alias("part"))
    # a digit's total stands until the next stretch that has it
    stands = totals.withColumn("next", F.lead("part").over(Window.partitionBy("set_id", "node", "digit").orderBy("part")))
    stands = stands.join(spans, ["set_id", "node"]).select("set_id", "node", "digit", "upto", F.explode(F.sequence(F.col("part") + 1, F.coalesce("next", F.col("last") + 1))).alias("part"))
    pairs = stands.groupBy("set_id", "node", "part").agg(F.map_from_entries(F.collect_list(F.struct("digit", "upto"))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0)).cast("long"))
    return parts.join(pairs, ["set_id", "node", "part"]).select("set_id", "node", "part", vector.alias("earlier"))
