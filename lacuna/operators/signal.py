"""Spectra and images of sounds: a row is a recording or a call; small numpy functions turn samples into frames or pixels.

Everything after the transform (activity, runs, filters) is Spark SQL over the frames, see ``plans.detection``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    """A window flat in the middle with cosine flanks over ``share`` of its length, periodic."""
    x = np.arange(n) / n
    edge = share / 2
    out = np.ones(n)
    rise = x < edge
    out[rise] = (1 + np.cos(np.pi * (x[rise] / edge - 1))) / 2
    fall = x > 1 - edge
    out[fall] = (1 + np.cos(np.pi * ((x[fall] - 1) / edge + 1))) / 2
    return out


#: Segments that are transformed at once.
FRAMES = 64


def spectrogram(x: np.ndarray, fs: float, nperseg: int, noverlap: int, window: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, times, power density by frequency and time): one-sided, each segment's mean taken off."""
    window = tukey(nperseg) if window is None else window
    if len(x) < nperseg:
        x = np.pad(np.asarray(x, float), (0, nperseg - len(x)))
    seg = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), nperseg)[:: nperseg - noverlap]
    scale = fs * (window**2).sum()
    power = np.empty((len(seg), nperseg // 2 + 1))
    for a in range(0, len(seg), FRAMES):  # as many as caches hold
        part = seg[a : a + FRAMES]
        part = part - part.mean(axis=1, keepdims=True)
        part *= window
        np.divide(np.abs(np.fft.rfft(part, axis=1)) ** 2, scale, out=power[a : a + FRAMES])
    power[:, 1 : -1 if nperseg % 2 == 0 else None] *= 2
    times = (np.arange(len(seg)) * (nperseg - noverlap) + nperseg / 2) / fs
    return np.fft.rfftfreq(nperseg, 1 / fs), times, power.T


def band_of(f: np.ndarray, low: float, high: float) -> slice:
    """The rows of ascending frequencies from ``low`` to ``high``, as a slice, which copies nothing."""
    return slice(int(np.searchsorted(f, low)), int(np.searchsorted(f, high, side="right")))


def welch(x: np.ndarray, fs: float, nperseg: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, mean power density) over half-overlapping Hann segments."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(nperseg) / nperseg)
    f, _, p = spectrogram(x, fs, nperseg, nperseg // 2, window)
    return f, p.mean(axis=1)


#: A call's log power counts from this many decades below its maximum.
DECADES = 4.0


def log_power(power: np.ndarray, floor: float, decades: float = DECADES) -> np.ndarray:
    """Decimal logarithm of power densities, its top ``decades`` scaled from 0 to 1."""
    level = np.log10(power + floor)
    level -= level.max()
    level /= decades
    level += 1
    return np.clip(level, 0, 1, out=level)


def resampled(values: np.ndarray, at: np.ndarray, new: np.ndarray, axis: int) -> np.ndarray:
    """Linear interpolation of a table along one axis, as ``np.interp`` has it for each line."""
    lines = np.moveaxis(values, axis, 0)
    left = np.clip(np.searchsorted(at, new, side="right") - 1, 0, max(len(at) - 2, 0))
    right = np.minimum(left + 1, len(at) - 1)
    wide = np.where(right > left, at[right] - at[left], 1.0)
    shape = (-1,) + (1,) * (lines.ndim - 1)
    out = (lines[right] - lines[left]) / wide.reshape(shape) * (new - at[left]).reshape(shape) + lines[left]
    out[new <= at[0]], out[new >= at[-1]] = lines[0], lines[-1]
    return np.moveaxis(out, 0, axis)


def call_pixels(x: np.ndarray, fs: float, duration_ms: float | None, longest_ms: float, low: float, high: float, nperseg: int = 256, noverlap: int = 224, floor: float = 1e-12, side: int = 32, decades: float = DECADES, full_width: bool = False) -> np.ndarray:
    """A side x side image, row after row: log frequency from ``low`` to ``high`` up, log duration across (or full width).

    Column j of a call that is w columns wide shows the moment (j + 0.5) / w of it, and is covered by the fraction of the column
    that the call reaches. Without a duration that of the samples counts, after they are padded to one segment.
    """
    if len(x) < nperseg:
        x = np.pad(np.asarray(x, float), (0, nperseg - len(x)))
    f, _, p = spectrogram(x, fs, nperseg, noverlap)
    band = (f >= low) & (f <= high)
    up = resampled(np.log10(p[band] + floor), f[band], np.geomspace(low, high, side), 0)
    up = np.clip(1 + (up - up.max()) / decades, 0, 1)
    if full_width:
        width = float(side)
    else:
        ms = 1000 * len(x) / fs if duration_ms is None else duration_ms
        width = max(side * np.log1p(ms) / np.log1p(longest_ms), 2.0)
    column = np.arange(side)
    moment = np.minimum((column + 0.5) / width, 1) * (up.shape[1] - 1)
    return (resampled(up, np.arange(up.shape[1]), moment, 1) * np.clip(width - column, 0, 1)).ravel()


def aligned_spectrum(x: np.ndarray, fs: float, start: int, length: int, grid_ms: np.ndarray, low: float, high: float, pad_ms: float = 20.0, nperseg: int = 256, noverlap: int = 224) -> np.ndarray:
    """Log power, scaled as in images, by (frequency, time after onset) on the grid; not a number where there is no frame.

    The call is taken with ``pad_ms`` on both sides.
    """
    pad = int(pad_ms * fs / 1000)
    a = max(start - pad, 0)
    f, t, p = spectrogram(x[a : start + length + pad], fs, nperseg, noverlap)
    band = band_of(f, low, high)
    ms = 1000 * (t - (start - a) / fs)
    out = resampled(log_power(p[band], 1e-12), ms, grid_ms, 1)
    out[:, (grid_ms < ms[0]) | (grid_ms > ms[-1])] = np.nan
    return out


def aligned_spectra(calls: DataFrame, grid_ms: np.ndarray, low: float, high: float, pad_ms: float = 20.0) -> DataFrame:
    """Adds ``spectrum`` to calls (x, fs, start, length), x being the whole recording: frequency after frequency on the grid."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, fs: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([aligned_spectrum(np.asarray(a, float), r, int(s), int(n), grid_ms, low, high, pad_ms).ravel() for a, r, s, n in zip(x, fs, start, length, strict=True)])

    return calls.withColumn("spectrum", run("x", F.col("fs").cast("double"), F.col("start").cast("long"), F.col("length").cast("long")))


#: What is told of each frame.
FRAME = "fs double, n long, frame long, t double, tonal_db double, peak_hz double"


def frame_table(x: np.ndarray, fs: float, low: float, high: float, nperseg: int, noverlap: int) -> dict:
    """Columns of ``FRAME`` of one recording: how far the band's maximum stands above its median."""
    f, t, p = spectrogram(np.asarray(x, float), fs, nperseg, noverlap)
    band = band_of(f, low, high)
    db = 10 * np.log10(p[band] + 1e-20)
    return {"fs": float(fs), "n": len(x), "frame": np.arange(len(t)), "t": t, "tonal_db": db.max(axis=0) - np.median(db, axis=0), "peak_hz": f[band][db.argmax(axis=0)]}


def frames(recordings: DataFrame, low: float, high: float, nperseg: int = 512, noverlap: int = 384, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, fs, n, frame, t, tonal_db, peak_hz) of recordings (keys, fs, x) of n samples, see ``frame_table``."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, **frame_table(row.x, row.fs, low, high, nperseg, noverlap)})

    types = ", ".join(f"{k} {recordings.schema[k].dataType.simpleString()}" for k in keys)
    return recordings.select(*keys, "fs", "x").mapInPandas(run, f"{types}, {FRAME}")


def images(calls: DataFrame, longest_ms: float, low: float, high: float, **options) -> DataFrame:
    """Adds ``image`` to calls (x, fs and, if it is there, duration_ms)."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, fs: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([call_pixels(np.asarray(a, float), b, None if pd.isna(c) else c, longest_ms, low, high, **options) for a, b, c in zip(x, fs, ms, strict=True)])

    ms = F.col("duration_ms") if "duration_ms" in calls.columns else F.lit(None).cast("double")
    return calls.withColumn("image", run("x", F.col("fs").cast("double"), ms))


def power_by_bin(recordings: DataFrame, width_hz: float = 10_000.0, nperseg: int = 1024) -> DataFrame:
    """(bin, db): mean power density of all recordings by frequency bin, summed up in Spark."""

    def run(batches):
        for batch in batches:
            for x, fs in zip(batch["x"], batch["fs"], strict=True):
                f, p = welch(np.asarray(x, float), fs, nperseg)
                yield pd.DataFrame({"bin": (f // width_hz).astype("int64"), "p": p})

    bins = recordings.select("x", "fs").mapInPandas(run, "bin long, p double").groupBy("bin").agg(F.avg("p").alias("p"))
    return bins.select("bin", (10 * F.log10(F.col("p") + 1e-20)).alias("db"))


def mean_spectra(spectra: DataFrame, by: list[str], column: str = "spectrum") -> DataFrame:
    """(by, pos, value): element-wise mean over a group's equal-shaped arrays, leaving out what is not a number."""
    long = spectra.select(*by, F.posexplode(column).alias("pos", "_v")).withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    return long.groupBy(*by, "pos").agg(F.avg("_v").alias("value"))
