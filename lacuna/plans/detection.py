"""Calls in recordings: active frames, sessions of them, filters and the events' measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import sequence
from lacuna.operators.signal import frame_table, frames

#: Bands in Hz, tonality in dB, times in ms and the largest median jump in Hz of ultrasonic mouse calls.
LOW, HIGH, TONAL_DB, MERGE_MS, SHORTEST_MS, LONGEST_MS, JUMP_HZ = 30e3, 110e3, 15.0, 10.0, 5.0, 300.0, 6e3
NPERSEG, NOVERLAP = 512, 384
CLEAN_DB = 20.0


def detect(recordings: DataFrame, keys: tuple[str, ...] = ("file",), low: float = LOW, high: float = HIGH, tonal_db: float = TONAL_DB) -> DataFrame:
    """(keys, fs, onset_s, offset_s, dur_ms, peak_khz, tonality_db) of recordings (keys, fs, x).

    Frames whose band maximum stands ``tonal_db`` above the median are active; runs join over gaps of up to ``MERGE_MS``, one frame
    at least. A run from its first to its last frame lasts ``SHORTEST_MS`` to ``LONGEST_MS``, and its active frames have jumps of at
    most ``JUMP_HZ`` in the median. The event reaches half a window further on both sides, within the recording; ``dur_ms`` is
    from onset to offset, and peak and tonality are the medians of its active frames.
    """
    return events_of(frames(recordings, low, high, NPERSEG, NOVERLAP, keys).where(F.col("tonal_db") >= tonal_db), keys)


def active_frames(recording: dict) -> pd.DataFrame:
    """Columns of ``FRAME`` of the active frames of a recording (fs, x), where nothing else of it is asked for."""
    found = pd.DataFrame(frame_table(recording["x"], recording["fs"], LOW, HIGH, NPERSEG, NOVERLAP))
    return found[found["tonal_db"] >= TONAL_DB]


def events_of(active: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """What ``detect`` tells, from the active frames of each recording."""
    by = list(keys)
    active = active.withColumnRenamed("n", "_n")
    step = (NPERSEG - NOVERLAP) / F.col("fs")
    runs = sequence.islands(active, by, "frame", F.greatest(F.floor(MERGE_MS / 1000 / step), F.lit(1)))
    runs = sequence.jumps(runs, "peak_hz", [*by, "island"], ["frame"])
    events = runs.groupBy(*by, "fs", "_n", "island").agg(
        F.min("t").alias("a"), F.max("t").alias("b"), (1000 * (F.max("frame") - F.min("frame") + 1)).alias("span"),
        F.median("peak_hz").alias("peak"), F.median("tonal_db").alias("tonal"), F.median("jump").alias("jump"), F.count("jump").alias("jumps"),
    )
    events = events.where((F.col("span") * step).between(SHORTEST_MS, LONGEST_MS) & (F.col("jumps") > 0) & (F.col("jump") <= JUMP_HZ))
    half = NPERSEG / 2 / F.col("fs")
    onset, offset = F.greatest(F.col("a") - half, F.lit(0.0)), F.least(F.col("b") + half, F.col("_n") / F.col("fs"))
    return events.select(*by, F.col("fs").cast("int").alias("fs"), onset.alias("onset_s"), offset.alias("offset_s"), (1000 * (offset - onset)).alias("dur_ms"), (F.col("peak") / 1000).alias("peak_khz"), F.col("tonal").alias("tonality_db"))


def clean(events: DataFrame, least_db: float = CLEAN_DB) -> DataFrame:
    """The events that stand out clearly."""
    return events.where(F.col("tonality_db") >= least_db)


def capped(df: DataFrame, by: list[str], key: str, most: int = 1500) -> DataFrame:
    """At most ``most`` rows of each group, those with the smallest MD5 of the key: a sample that reruns agree on."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def looked_at(df: DataFrame, key: str, rows: int = 24) -> DataFrame:
    """A fixed number of rows to look at, those with the smallest MD5 of the key."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(rows)
