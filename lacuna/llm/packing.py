"""Best-fit packing of documents into training sequences, with conflicts.

Documents are cut into pieces of at most ``CAPACITY`` words, and the pieces, longest first, go each into the fullest bin
that has room and no conflict. A bin never holds two pieces of one duplicate cluster (copies would be seen together) and at
most ``PER_SOURCE`` pieces of one source. Open bins stand in order of their residual room and carry two bitmaps: the
clusters they hold (a bit for each cluster with more than one piece in the batch) and their sources (``PER_SOURCE`` bits
each, filled one by one). The search begins at the smallest residual that takes the piece and goes on to the successor until
both bitmaps are clear, so the bin found is the tightest compatible one; failing that a bin is opened.

Batches of about ``BATCH`` pieces, dealt by a hash of the document, are packed in tasks of their own; a hot source or a
large group of copies is spread over all of them. Only lengths move, no texts. A text without words, or null, is one piece of
length 0 and of no cluster, which goes into a bin like any other and so is kept. Rows without a source share none of its limits. Repeated rows
are pieces like others; being copies they never share a bin, and where more than ``ALIKE`` rows are equal in all that the hash sees
they are dealt by their place in the saved table as well. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import looked_up, n_words, saved

CAPACITY = 2048
#: Of a bin's words a source may have this share, or so many times its share of the batch, before the bin is closed to it.
LEAST_SHARE, SHARE_TIMES = 0.5, 2
BATCH = 4096
ALIKE = 64


def best_fit(lengths: list[int], clusters: list[int | None], sources: list[int | None], capacity: int = CAPACITY, per_source: int | None = None, shares: list[float] | None = None) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given, which should be longest first. Clusters and sources are small numbers.

    ``shares`` has the words of a bin after which it is closed to each source.
    """
    bins: list[list] = []  # for each bin: room, cluster bitmap, source bitmap, words by source
    order: list[tuple[int, int]] = []  # (room, bin), in order of room
    width = per_source or 1
    seats = (1 << width) - 1
    out = []
    for length, cluster, source in zip(lengths, clusters, sources, strict=True):
        own = 0 if cluster is None else 1 << cluster
        full = 0 if source is None or not (per_source or shares) else seats << source * width
        at = bisect_left(order, (length, -1))
        while at < len(order):
            held = bins[order[at][1]]
            if not held[1] & own and (not full or held[2] & full != full):
                break
            at += 1
        if at < len(order):
            b = order.pop(at)[1]
        else:
            b = len(bins)
            bins.append([capacity, 0, 0, {}])
        held = bins[b]
        out.append((b, capacity - held[0]))
        held[0] -= length
        held[1] |= own
        if full and per_source:
            taken = (held[2] >> source * width) & seats
            held[2] |= (taken + 1) << source * width
        elif full:
            held[3][source] = held[3].get(source, 0) + length
            if held[3][source] >= shares[source]:
                held[2] |= full
        insort(order, (held[0], b))
    return out


def source_shares(lengths: list[int], sources: list[int | None], capacity: int = CAPACITY) -> list[float]:
    """The words of a bin after which it is closed to each source, from what each has of all words."""
    words: dict[int, int] = {}
    for length, source in zip(lengths, sources, strict=True):
        if source is not None:
            words[source] = words.get(source, 0) + length
    total = sum(lengths) or 1
    return [capacity * min(1.0, max(LEAST_SHARE, SHARE_TIMES * words.get(k, 0) / total)) for k in range(max(words, default=-1) + 1)]


def pieces(documents: DataFrame, capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, start_word, n_words, source, cluster. ``cluster`` names a column; else equal texts are a cluster."""
    text = F.col("text").cast("string")
    alike = F.col(cluster).cast("string") if cluster else F.when(n_words(text) > 0, F.hex(F.xxhash64(text)))
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), alike.alias("cluster"), n_words(text).alias("total"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("total") / capacity) - 1, F.lit(0)).cast("long"))
    rows = rows.select("*", F.explode(cuts).alias("piece"))
    start = F.col("piece") * capacity
    return rows.select("doc_id", "piece", start.alias("start_word"), F.least(F.col("total") - start, F.lit(capacity)).alias("n_words"), "source", "cluster")


def packed(documents: DataFrame, capacity: int = CAPACITY, per_source: int | None = None, batch: int = BATCH, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, start_word, n_words, source, cluster, bin, offset: where each piece of each document goes."""
    items = saved(pieces(documents, capacity, cluster))
    batches = max(1, -(-items.count() // batch))
    items = items.withColumn("batch", F.xxhash64("doc_id", "piece", "cluster"))
    often = items.groupBy("batch").agg(F.count("*").alias("alike")).where(F.col("alike") > ALIKE)
    items = looked_up(items, often, ["batch"], "left")
    place = F.when(F.col("alike").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    items = items.select("*", place.alias("place")).withColumn("batch", F.pmod(F.xxhash64("batch", "place"), F.lit(batches))).drop("alike", "place")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_words", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="stable")
        size = rows.groupby("cluster")["cluster"].transform("size")
        clusters = pd.factorize(rows["cluster"].where(size > 1))[0].tolist()
        sources = pd.factorize(rows["source"])[0].tolist()
        none = lambda codes: [None if c < 0 else c for c in codes]
        lengths, sources = rows["n_words"].tolist(), none(sources)
        found = best_fit(lengths, none(clusters), sources, capacity, per_source, None if per_source else source_shares(lengths, sources, capacity))
        first = int(rows["batch"].iloc[0]) << 24
        return rows.drop(columns="batch").assign(bin=[first + b for b, _ in found], offset=[o for _, o in found])

    kind = items.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece long, start_word long, n_words long, source string, cluster string, bin long, offset long"
    return items.groupBy("batch").applyInPandas(pack, schema)
