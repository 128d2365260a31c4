"""Order-dependent columns of sequences: previous label, run position, terciles, quartiles, sessions and jumps.

``by`` names the columns of a sequence, ``order`` those that order it. All are window functions over one partitioning, which
Spark sorts once however many of them a query uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.quantiles import exact_quantiles


def previous_label(df: DataFrame, label: str, by: list[str], order: list[str], name: str = "prev") -> DataFrame:
    """The label before, or START."""
    return df.withColumn(name, F.coalesce(F.lag(label).over(Window.partitionBy(*by).orderBy(*order)), F.lit("START")))


def run_position(df: DataFrame, label: str, by: list[str], order: list[str], name: str = "run_pos") -> DataFrame:
    """1st, 2nd, 3rd or 4th+: the place in the run of equal labels."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*order))
    names = F.array(*[F.lit(x) for x in ("1st", "2nd", "3rd", "4th+")])
    return runs.withColumn(name, F.element_at(names, F.least(place, F.lit(4)))).drop("_new", "_run")


def position_tercile(df: DataFrame, by: list[str], order: list[str], name: str = "pos_bin") -> DataFrame:
    """early, middle or late: third of the relative position (0 for a sequence of one)."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    m = F.count("*").over(Window.partitionBy(*by))
    third = F.least(F.floor(3 * F.when(m > 1, k / (m - 1)).otherwise(0.0)), F.lit(2)).cast("int")
    return df.withColumn(name, F.element_at(F.array(F.lit("early"), F.lit("middle"), F.lit("late")), third + 1))


def rank_quartile(df: DataFrame, by: list[str], order: list[str], name: str = "recording", parts: int = 4, piece: Column | None = None) -> DataFrame:
    """Q1 to Q4 by rank: the bins of linear quantiles of 1..n, which differ from ``ntile`` for most n.

    ``piece``, never null and growing with the order, is for one long sequence (``by`` empty): its rows are numbered piece by
    piece, so that no task has all of them.
    """
    if piece is not None:
        if by:
            raise ValueError("pieces are for one sequence")
        sizes = df.groupBy(piece.alias("_piece")).agg(F.count("*").alias("_m"))
        before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("_piece", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy()).alias("_all"))
        df = df.withColumn("_piece", piece).join(sizes, "_piece")
        rank = F.row_number().over(Window.partitionBy("_piece").orderBy(*order)) + F.col("_before")
        n = F.col("_all")
    else:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        n = F.count("*").over(Window.partitionBy(*by))
    bin_ = F.when(n > 1, F.greatest(F.lit(1), F.ceil(F.lit(float(parts)) * (rank - 1) / (n - 1)))).otherwise(1).cast("int")
    return df.withColumn(name, F.concat(F.lit("Q"), bin_)).drop("_piece", "_before", "_all")


def value_tertile(df: DataFrame, value: str, name: str = "tertile") -> DataFrame:
    """1 to 3 by value: cut at the thirds' exact quantiles, ties together, upper bounds inclusive; null: null."""
    low, high = exact_quantiles(df, F.col(value), [1 / 3, 2 / 3])
    place = F.when(F.col(value) <= F.lit(low), 1).when(F.col(value) <= F.lit(high), 2).when(F.col(value).isNotNull(), 3)
    return df.withColumn(name, place)


def islands(df: DataFrame, by: list[str], frame: str, gap: Column | float, name: str = "island") -> DataFrame:
    """Numbers runs of frames: a new one starts where a frame is more than ``gap`` after the one before."""
    w = Window.partitionBy(*by).orderBy(frame)
    new = F.when(F.col(frame) - F.lag(frame).over(w) <= (F.lit(gap) if not isinstance(gap, Column) else gap), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def jumps(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "jump") -> DataFrame:
    """Absolute difference to the value before within the run; null for its first."""
    return df.withColumn(name, F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order))))


def sessions(df: DataFrame, by: list[str], frame: str, value: str, gap: float, shortest: float, longest: float, largest_jump: float) -> DataFrame:
    """Events of active frames: islands, then filters by duration (inclusive) and by the median jump, of which there must be one.

    Returns (by, island, onset, offset, duration, n_frames, peak, median_jump).
    """
    runs = jumps(islands(df, by, frame, gap), value, [*by, "island"], [frame])
    events = runs.groupBy(*by, "island").agg(
        F.min(frame).alias("onset"), F.max(frame).alias("offset"), (F.max(frame) - F.min(frame)).alias("duration"), F.count("*").alias("n_frames"), F.max(value).alias("peak"), F.median("jump").alias("median_jump"), F.count("jump").alias("_jumps"),
    )
    return events.where(F.col("duration").between(shortest, longest) & (F.col("_jumps") > 0) & (F.col("median_jump") <= largest_jump)).drop("_jumps")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in this order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def interpolated(series: DataFrame, grid: DataFrame, by: list[str], x: str, y: str, clamp: bool = True) -> DataFrame:
    """(by, x, y): the series at the grid's points by linear interpolation; beyond its ends the end value, or null.

    An as-of join in both directions over one sorted timeline of both tables, without a range join.
    """
    mixed = series.select(*by, F.col(x).cast("double").alias("_x"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).alias("_at"), F.lit(0).alias("_grid"))
    mixed = mixed.unionByName(grid.select(*by, F.col(x).cast("double").alias("_x"), F.lit(None).cast("struct<x:double,y:double>").alias("_at"), F.lit(1).alias("_grid")))
    w = Window.partitionBy(*by).orderBy("_x", "_grid")
    before = F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_at", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = mixed.select(*by, "_x", "_grid", before.alias("_b"), after.alias("_a")).where("_grid = 1")
    b, a = F.col("_b"), F.col("_a")
    between = b["y"] + (a["y"] - b["y"]) * F.try_divide(F.col("_x") - b["x"], a["x"] - b["x"])
    outside = F.coalesce(b["y"], a["y"]) if clamp else F.when(b["x"] == F.col("_x"), b["y"])
    return found.select(*by, F.col("_x").alias(x), F.when(b["x"] == F.col("_x"), b["y"]).when(a.isNull() | b.isNull(), outside).otherwise(between).alias(y))
