"""Sessions of events as they arrive: the batch islands as a session window with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_events(stream: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value", gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(key, onset, offset, n_frames, peak): a session ends when nothing comes for ``gap``; rows later than ``late`` are left out.

    State is a session window's partial sums, not its rows. Works on batch tables too, with the same rows.
    """
    w = F.session_window(F.col(ts), gap)
    out = stream.withWatermark(ts, late).groupBy(F.col(key), w).agg(F.min(ts).alias("onset"), F.max(ts).alias("offset"), F.count("*").alias("n_frames"), F.max(value).alias("peak"))
    return out.select(key, "onset", "offset", "n_frames", "peak")
