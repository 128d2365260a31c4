"""WAV files and embedded WAV bytes, and XML annotations of song files."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.checkpoints import cut
from lacuna.operators import sequence


def decode(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples of the first channel) of PCM WAV bytes."""
    with wave.open(io.BytesIO(content)) as w:
        width, channels = w.getsampwidth(), w.getnchannels()
        raw = w.readframes(w.getnframes())
        if width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8
        else:
            x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.int32) - (128 if width == 1 else 0)
        return w.getframerate(), x.reshape(-1, channels)[:, 0]


def decoded(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds fs and x, the samples of the first channel."""

    @F.pandas_udf("fs int, x array<double>")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = [decode(bytes(b)) if b is not None else (None, None) for b in rows]
        return pd.DataFrame({"fs": pd.array([r for r, _ in out], "Int32"), "x": [None if x is None else x.astype(float) for _, x in out]})

    return df.withColumn("_wav", run(content)).select(*df.columns, F.col("_wav.fs").alias("fs"), F.col("_wav.x").alias("x"))


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """(file, fs, x) of all WAV files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return decoded(files.select(F.col("path").alias("file"), "content")).drop("content")


def wav_header(content: Column) -> dict[str, Column]:
    """sr and clip_s of canonical WAV bytes by arithmetic on the header, without decoding."""
    little = lambda a, n: F.conv(F.hex(F.concat(*[F.substring(content, a + n - 1 - i, 1) for i in range(n)])), 16, 10).cast("long")
    rate, step = little(25, 4), little(33, 2)
    return {"sr": rate.cast("int"), "clip_s": (F.length(content) - 44) / step / rate}


#: Samples in a chunk of a recording.
CHUNK = 262_144


def chunked(recordings: DataFrame, on: str = "file", size: int = CHUNK) -> DataFrame:
    """(file, chunk, x): recordings (file, x) in chunks of ``size`` samples, numbered from 0."""
    at = F.when(F.size("x") > 0, F.sequence(F.lit(0), F.size("x") - 1, F.lit(size)))
    return recordings.select(on, F.posexplode(F.transform(at, lambda i: F.slice("x", i + 1, F.lit(size)))).alias("chunk", "x"))


def slices_of_chunks(events: DataFrame, chunks: DataFrame, start: str, length: str, on: str = "file", size: int = CHUNK) -> DataFrame:
    """Each event of a recording that has chunks, with x, its samples; what lies before the beginning or behind the end is left out.

    An event asks for the chunks that it touches and gets its part of each, so no recording travels whole; the parts are put together
    in order. A null start or length is 0, and a length of 0 or less gives no samples.
    """
    first, last = F.greatest(F.col(start), F.lit(0)).cast("long"), (F.greatest(F.col(start), F.lit(0)) + F.greatest(F.col(length), F.lit(0)) - 1).cast("long")
    known = events.join(chunks.select(on).distinct(), on, "left_semi")
    asked = cut(known.select("*", F.monotonically_increasing_id().alias("_event"), first.alias("_first"), last.alias("_last")))
    wanted = asked.where("_last >= _first").select(on, "_event", "_first", "_last", F.explode(F.sequence(F.floor(F.col("_first") / size).cast("int"), F.floor(F.col("_last") / size).cast("int"))).alias("chunk"))
    begin = F.greatest(F.col("_first") - F.col("chunk").cast("long") * size, F.lit(0))
    end = F.least(F.col("_last") - F.col("chunk").cast("long") * size, F.lit(size - 1))
    pieces = wanted.join(chunks, [on, "chunk"]).select("_event", "chunk", F.slice("x", (begin + 1).cast("int"), (end - begin + 1).cast("int")).alias("x"))
    whole = pieces.groupBy("_event").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "x"))), lambda p: p["x"])).alias("x"))
    return asked.drop("x").join(whole, "_event", "left").withColumn("x", F.coalesce("x", F.array().cast("array<double>"))).drop("_event", "_first", "_last")


def slices(events: DataFrame, recordings: DataFrame, start: str, length: str, on: str = "file", size: int = CHUNK) -> DataFrame:
    """``slices_of_chunks`` of recordings (file, x)."""
    return slices_of_chunks(events, chunked(recordings, on, size), start, length, on, size)


def slices_in_rows(recordings: DataFrame, start: str, length: str, keep: tuple[str, ...] = (), on: str = "file") -> DataFrame:
    """``slices`` of recordings (file, x, start, length, keep) that have their events with them, as arrays of equal length.

    (file, start, length, keep, x), a row for each event: it is cut out where its recording lies, which goes nowhere.
    """
    columns = (start, length, *keep)
    first = lambda e: F.least(F.greatest(e[start], F.lit(0)), F.size("x")).cast("int")
    many = lambda e: F.least(F.greatest(e[length], F.lit(0)), F.size("x")).cast("int")
    cut_out = lambda e: F.struct(*[e[c].alias(c) for c in columns], F.slice("x", first(e) + 1, many(e)).alias("x"))
    return recordings.where(F.size("x") > 0).select(on, F.inline(F.transform(F.arrays_zip(*columns), cut_out)))


def riff_facts(f: IO[bytes]) -> dict[str, int] | None:
    """rate, channels, bits and frames of a WAV file, by walking the headers of its chunks; None: no such file.

    Only headers are read, and what a chunk holds is skipped; chunks of odd length are padded, and a data chunk whose length isn't
    known, or that was cut off, ends with the file.
    """
    end = f.seek(0, 2)
    f.seek(0)
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    out: dict[str, int] = {}
    at = 12
    while at + 8 <= end:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"fmt " and size >= 16:
            _, out["channels"], out["rate"], _, out["step"], out["bits"] = struct.unpack("<HHIIHH", f.read(16))
        elif name == b"data" and out.get("step"):
            out["frames"] = min(size, end - at - 8) // out["step"]
            return out
        at += 8 + size + size % 2
    return None


def _facts(found: list[dict[str, int] | None]) -> pd.DataFrame:
    column = lambda c: pd.array([None if r is None else r[c] for r in found], "Int64")
    seconds = [None if r is None or not r["rate"] else r["frames"] / r["rate"] for r in found]
    return pd.DataFrame({"rate": column("rate"), "channels": column("channels"), "bits": column("bits"), "frames": column("frames"), "seconds": seconds})


FACTS = "rate long, channels long, bits long, frames long, seconds double"


def with_facts(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds rate, channels, bits, frames and seconds of WAV bytes, null where they are none."""

    @F.pandas_udf(FACTS)
    def run(rows: pd.Series) -> pd.DataFrame:
        return _facts([None if b is None else riff_facts(io.BytesIO(bytes(b))) for b in rows])

    return df.withColumn("_facts", run(content)).select(*df.columns, "_facts.*")


def wav_facts(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, rate, channels, bits, frames, seconds) of all WAV files under a path; of each only the chunk headers are read.

    The paths are opened by pyarrow's file systems, which know local and common remote ones.
    """
    from pyarrow import fs

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path).select(F.col("path").alias("file"), "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for file in rows["file"]:
                system, inner = fs.FileSystem.from_uri(file)
                with system.open_input_file(inner) as f:
                    found.append(riff_facts(f))
            yield pd.concat([rows.reset_index(drop=True), _facts(found)], axis=1)

    return files.mapInPandas(run, f"file string, length long, {FACTS}")


def rates_and_durations(facts: DataFrame) -> DataFrame:
    """(rate, channels, bits, files, least_s, median_s, most_s, total_s) of a table with WAV facts."""
    return facts.where("frames is not null").groupBy("rate", "channels", "bits").agg(F.count("*").alias("files"), F.min("seconds").alias("least_s"), F.median("seconds").alias("median_s"), F.max("seconds").alias("most_s"), F.sum("seconds").alias("total_s"))


def band_levels(recordings: DataFrame, band_hz: int = 10_000, window: int = 1024) -> DataFrame:
    """(low_hz, high_hz, level_db): mean level of each band of the recordings' (fs, x) summed power spectrum, below its peak of 0 dB.

    The spectrum of a recording is the mean over half-overlapping windows, each less its mean and tapered. Recordings of the commonest
    rate count (the smallest of equals), and those of at least a window.
    """
    rate = recordings.where(F.size("x") >= window).groupBy("fs").count().orderBy(F.desc("count"), "fs").limit(1).select("fs")

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taper = np.hanning(window + 1)[:-1]
        for rows in batches:
            for fs, x in zip(rows["fs"], rows["x"], strict=True):
                power, n = 0.0, 0
                for a in range(0, len(x) - window + 1, window // 2):
                    part = np.asarray(x[a : a + window], float)
                    power, n = power + np.abs(np.fft.rfft((part - part.mean()) * taper)) ** 2, n + 1
                density = 2 * power / n / (fs * (taper**2).sum())
                density[[0, -1]] /= 2
                yield pd.DataFrame({"hz": np.fft.rfftfreq(window, 1 / fs), "p": density})

    total = recordings.where(F.size("x") >= window).join(F.broadcast(rate), "fs").select("fs", "x").mapInPandas(spectra, "hz double, p double").groupBy("hz").agg(F.sum("p").alias("p"))
    level = cut(total.select("hz", (10 * F.log10(F.col("p") + 1e-20)).alias("db")))
    peak = level.agg(F.max("db").alias("peak"))
    low = (F.floor(F.col("hz") / band_hz) * band_hz).cast("long")
    return level.crossJoin(peak).groupBy(low.alias("low_hz"), (low + band_hz).alias("high_hz")).agg(F.avg(F.col("db") - F.col("peak")).alias("level_db"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(wav, seq, note, start, length, label, overruns) of XML files: a row for each note, its start counted from the file's.

    ``overruns`` tells notes that end after their sequence does.
    """
    schema = "WaveFileName string, Position long, Length long, Note array<struct<Position: long, Length: long, Label: string>>"
    rows = spark.read.format("xml").option("rowTag", "Sequence").schema(schema).load(path)
    notes = rows.select(F.col("WaveFileName").alias("wav"), F.col("Position").alias("seq"), F.col("Length").alias("_room"), F.posexplode("Note").alias("note", "_n"))
    return notes.select("wav", "seq", "note", (F.col("seq") + F.col("_n.Position")).alias("start"), F.col("_n.Length").alias("length"), F.col("_n.Label").alias("label"), (F.col("_n.Position") + F.col("_n.Length") > F.col("_room")).alias("overruns"))


def with_context(notes: DataFrame) -> DataFrame:
    """Notes that fit their sequence, with prev, run_pos, pos_bin, wav_num and recording."""
    by, order = ["wav", "seq"], ["note"]
    out = notes.where("not overruns").drop("overruns")
    out = sequence.previous_label(out, "label", by, order)
    out = sequence.run_position(out, "label", by, order)
    out = sequence.position_tercile(out, by, order)
    out = out.withColumn("wav_num", F.coalesce(F.regexp_replace(F.element_at(F.split("wav", "/"), -1), "[^0-9]", "").try_cast("long"), F.lit(0)))
    return sequence.rank_quartile(out, ["bird"] if "bird" in notes.columns else [], ["wav_num", "wav", "seq", "note"])
