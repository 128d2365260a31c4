"""Shards that each hold the mixture of sources, by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the row of rank r (from 0) of n has the fractional rank
(r + t) / n, where t in [0, 1) is a hash of the source, so that many small sources don't all fall in the middle. In order of
it the sources interleave in proportion, and the order is cut into shards of equal counts: the ``rows`` law. Any stretch
holds each source to within a row of its share.

Ranks come from bucket totals and one bucket at a time (``running``), so a source with a third of all rows is no task of its
own. A null text has 0 bytes and the checksum of no bytes, 0. Null sources are a source. Rows equal in doc_id and text may
swap places; they are numbered for the shuffle, so that thousands of them don't meet in one task. Fewer rows than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import free_name, looked_up, n_bytes, numbered, quoted, running, saved, told_apart, unit_hash

SHARDS = 40
SEED = "shard-1"
OVERHEAD = 16
#: Of a shard, about so many bytes of text are sorted in one task and written as one file.
FILE_BYTES = 256_000_000


def placed(documents: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for each row of ``documents``."""
    text = F.col("text").cast("string")
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), (n_bytes(text) + OVERHEAD).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"))
    rows = saved(rows.withColumn("one", F.lit(1).cast("long")))
    total = rows.count()
    key = [F.col("doc_id"), F.col("text_crc32")]
    rows = told_apart(rows, ["doc_id", "text_crc32"], "number")
    rows = rows.withColumn("u", F.when(F.col("number").isNull(), unit_hash(seed, *key)).otherwise(unit_hash(seed, *key, F.col("number")))).drop("number")
    of_source = rows.groupBy("source").agg(F.count("*").alias("of"))
    ranked = running(rows, ["source"], "u", ["doc_id", "text_crc32"], {"rank": "one"}, total)
    ranked = looked_up(ranked, of_source, ["source"]).withColumn("turn", unit_hash(seed, F.col("source")))
    ranked = saved(ranked.withColumn("fraction", (F.col("rank") + F.col("turn")) / F.col("of")))
    lined = running(ranked, [], "fraction", ["turn", "source", "rank"], {"place": "one"}, total)
    shard = F.floor(F.col("place") * shards / total).cast("int") if total else F.lit(0)
    first = F.floor((shard * F.lit(total) + (shards - 1)) / shards).cast("long")
    return lined.select("doc_id", "source", "size", "text_crc32", shard.alias("shard"), (F.col("place") - first).alias("slot"))


def shard_digest(documents: DataFrame) -> DataFrame:
    """The contract's columns under the ``rows`` law."""
    out = placed(documents)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED) -> None:
    """Writes the documents with all their columns, but ones called ``shard`` or ``slot`` (in any case), to ``path``/shard=k, with their slots.

    A shard has as many files as its bytes ask for; each holds a range of its slots, sorted, and the files' names are in the order of the
    ranges, so that no task holds a whole shard. Rows equal in doc_id and text take their places in the order in which they were saved.
    """
    documents = documents.drop("shard", "slot")
    crc, number = free_name(documents, "crc"), free_name(documents, "number")
    text = F.coalesce(F.crc32(F.col("text").cast("string").cast("binary")), F.lit(0))
    both = documents.withColumn(crc, text)
    keys = saved(placed(documents, shards, seed).select("doc_id", F.col("text_crc32").alias(crc), "shard", "slot", "size"))
    often = saved(keys.groupBy("doc_id", crc).agg(F.count("*").alias(number)).where(F.col(number) > 1).drop(number))

    def matched(rows: DataFrame, places: DataFrame, by: list[str]) -> DataFrame:
        places = places.select(*[F.col(k).alias(f"_at_{j}") for j, k in enumerate(by)], "shard", "slot")
        match = None
        for j, k in enumerate(by):
            same = rows[k].eqNullSafe(places[f"_at_{j}"])
            match = same if match is None else match & same
        return rows.join(places, match).select(*quoted(documents.columns), "shard", "slot")

    on = ["doc_id", crc]
    others = often.select(F.col("doc_id").alias("_id"), F.col(crc).alias("_crc"))
    alone = lambda t: t.join(others, t["doc_id"].eqNullSafe(others["_id"]) & (t[crc] == others["_crc"]), "left_anti")
    out = matched(alone(both), alone(keys), on)
    if often.limit(1).count():
        again = lambda t: numbered(looked_up(t, often, on, "left_semi"), on, number)
        out = out.unionByName(matched(again(both), again(keys), [*on, number]))
    files = max(shards, -(-(keys.agg(F.sum("size")).first()[0] or 0) // FILE_BYTES))
    out.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
