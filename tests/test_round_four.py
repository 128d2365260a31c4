"""Tests of the fourth round's changes: work that must not grow with the number of recordings, rows or pairs that a task holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import queries_reports, queries_tables
from lacuna.operators import neighbors, synth
from lacuna.sources import sounds


def test_recordings_are_dealt_over_tasks(spark):
    made = synth.bursts(spark.range(300), "id", seconds=0.1).select("file", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in made) == 300 and max(r["count"] for r in made) <= 2 * synth.NAMES_A_TASK


@pytest.mark.parametrize("query", ["clean_calls", "sliced_calls", "aligned_spectra"])
def test_recordings_are_neither_kept_nor_shuffled(spark, sf, query, monkeypatch):
    """No checkpoint, and no exchange but the last one's slices, holds a recording's samples."""
    kept = []
    monkeypatch.setattr(synth, "cut", lambda df: kept.append(df.columns) or df)
    plan = getattr(queries_reports, query)(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert kept and all("x" not in c for c in kept)
    assert "Join" not in plan and "Checkpoint" not in plan and "LogicalRDD" not in plan


def test_slices_in_rows_are_those_of_the_join(spark):
    x = [float(k) for k in range(20)]
    calls = [(0, 5), (3, 4), (18, 9), (25, 3), (-4, 6), (7, 0), (None, 2), (4, None)]
    whole = spark.createDataFrame([("a", x, [c[0] for c in calls], [c[1] for c in calls]), ("b", [], [1], [2]), ("c", None, [1], [2])], "file string, x array<double>, first array<long>, many array<long>")
    events = spark.createDataFrame([("a", *c) for c in calls] + [("b", 1, 2), ("c", 1, 2)], "file string, first long, many long")
    key = lambda r: (r.file, str(r.first), str(r.many), r.x)
    got = sounds.slices_in_rows(whole, "first", "many").select("file", F.col("first").alias("first"), "many", "x")
    wanted = sounds.slices(events, whole.select("file", "x"), "first", "many", size=6).select("file", "first", "many", "x")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, wanted.collect())))


def test_percentiles_of_all_rows_are_no_single_task(spark, sf):
    """Spark's exact percentile holds all distinct values of a group in one task; there must be none over the whole table."""
    found = queries_tables.nan_skipping_percentiles(spark, sf)
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("nan_skipping_percentiles", "")
    x = [r.l_extendedprice / r.l_quantity for r in spark.read.parquet(f"{sf}/lineitem.parquet").where("l_discount <> 0").collect()]
    row = found.first()
    assert row.n == len(x) and np.allclose([row.p25, row.med], np.quantile(x, [0.25, 0.5]), atol=1e-4)


@pytest.mark.parametrize("kind", ["uniform", "copies", "far", "grid", "odd"])
def test_closest_rows_are_those_of_all_distances(kind):
    rng = np.random.default_rng(1)
    a, b = rng.random((90, 8)), rng.random((130, 8))
    if kind == "copies":
        a, b = a[:3].repeat(30, axis=0), np.concatenate([a[:3].repeat(40, axis=0), b[:10]])
    elif kind == "far":
        a, b = a + 1e7, b + 1e7
    elif kind == "grid":
        a, b = np.round(3 * a), np.round(3 * b)
    elif kind == "odd":
        a[4], b[5, 2], b[6] = np.nan, np.inf, 1e200
    with np.errstate(all="ignore"):
        d = neighbors.square(a, b)
    skipped = (np.arange(90)[:, None] + np.arange(130)[None, :]) % 7 == 0
    d[skipped] = np.inf
    for k in (1, 5, 130, 200):
        i, j, found = neighbors.closest(a, b, k, lambda here: skipped[here])
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        wanted = [(r, c, d[r, c]) for r in range(90) for c in order[r] if np.isfinite(d[r, c])]
        assert list(zip(i.tolist(), j.tolist(), found.tolist(), strict=True)) == wanted


def test_searches_pass_few_rows_on(spark):
    """A search gives k rows a point and part; with blocks of fixed size the rows grew with the square of the points."""
    assert neighbors.PART_POINTS >= 16 * neighbors.BLOCK
    cloud = spark.range(20_000).select(F.lit("all").alias("set_id"), "id", F.array((F.col("id") % 997).cast("double"), (F.col("id") % 1009).cast("double")).alias("z"))
    rows = neighbors.block_pairs(cloud, lambda a, b: a[["id"]], "id long", None).count()
    assert rows == 20_000 * neighbors.PARTS
