"""Mixing sources to target weights by Pareto order sampling.

Sources in code-point order (null last) weigh 1, 2, 3 and so on again; by these weights they share the words of the whole
corpus. A target stops at ``MAX_COPIES`` times the words of its source, and the excess is shared by the others by weight
until none is above.

Within a source documents have unequal odds: by default those of ``LENGTH_ODDS``, so that a document of 50 words is wanted twice,
and one of 500 words four times as often as a scrap; or those of a column. A document is wanted ``least(3, level * odds)`` times,
the level being the one at which the words wanted come to the target; it is found from the totals of the odds of a source, of
which there are few (odds of a column are taken in steps of an eighth of an octave). The whole part of that is certain. For the rest,
its inclusion odds p / (1 - p), documents are ranked by their random odds divided by them, ``(u / (1 - u)) / (p / (1 - p))``
with u fixed by the seed and the document, and taken in that order. The sample's size is fixed in words, the unit of the targets:
the cut is where the words taken come nearest to the target, so it misses it by half a document at most.

A null text has no words; its document is copied like others of its odds, at no cost in words. Rows with the same doc_id share u
and follow each other in the order. Empty table: empty result. A source without words: target 0, and no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import free_name, looked_up, n_words, numbered, quoted, running, saved, told_apart, unit_hash

MAX_COPIES = 3
WEIGHTS = 3
SEED = "mix-1"
#: (words from which on, odds), in descending order; below the last: odds of 1.
LENGTH_ODDS = ((500, 4.0), (50, 2.0))


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES, weights: int = WEIGHTS) -> DataFrame:
    """source, source_size, target, from (source, size): one row for each source.

    Only the totals of sources are ranked. Filling up: in order of cap per weight, sources are at their cap as long as the
    even share of what is left, by weight, would be above it.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = totals.withColumn("weight", F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(weights)) + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * max_copies)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    filled = ranked.select("*", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(below), F.lit(0))).alias("left"), F.sum("weight").over(rest).alias("of"))
    level = F.min(F.when(F.col("left") * F.col("weight") <= F.col("cap") * F.col("of"), F.struct(F.col("cap") / F.col("weight"), "left", "of"))).over(whole)
    filled = filled.withColumn("level", level)
    share = F.col("level.left") * F.col("weight") / F.col("level.of")
    return filled.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), share.cast("double")), F.lit(0.0)).alias("target"))


def length_odds(size: Column) -> Column:
    """The odds of ``LENGTH_ODDS`` for a number of words."""
    out = F.lit(1.0)
    for least, odds in reversed(LENGTH_ODDS):
        out = F.when(size >= least, F.lit(odds)).otherwise(out)
    return out


def stepped(odds: Column) -> Column:
    """Odds above 0 to the nearest step of an eighth of an octave; null, and what is no such number: 1."""
    usable = odds.isNotNull() & ~F.isnan(odds) & (odds > 0) & (odds < float("inf"))
    return F.pow(F.lit(2.0), F.round(8 * F.log2(F.when(usable, odds).otherwise(F.lit(1.0)))) / 8)


def levels(sizes: DataFrame, aims: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, level: documents wanted ``least(max_copies, level * odds)`` times come to the target in words.

    From (source, odds, size) only the totals by source and odds are ranked: the highest odds stand at ``max_copies`` as long as the
    level that would serve the rest is above it for them.
    """
    totals = sizes.groupBy("source", "odds").agg(F.sum("size").cast("double").alias("words"))
    totals = totals.join(aims.select(F.col("source").alias("_s"), "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    by = Window.partitionBy("source").orderBy(F.desc("odds"))
    capped = F.coalesce(F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("odds") * F.col("words")).over(by.rowsBetween(0, Window.unboundedFollowing))
    steps = totals.select("source", "odds", F.try_divide(F.col("target") - max_copies * capped, rest).alias("level"))
    fits = F.when(F.col("level") * F.col("odds") <= max_copies, F.struct((-F.col("odds")).alias("first"), F.col("level").alias("level")))
    # none fits only if every document is wanted max_copies times
    return steps.groupBy("source").agg(F.min(fits).alias("m"), F.max("level").alias("most")).select("source", F.coalesce("m.level", F.when(F.col("most") > 0, F.lit(float("inf"))), F.lit(0.0)).alias("level"))


def mixed(documents: DataFrame, odds: str | None = None, seed: str = SEED, max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, odds, copies: how often the mix takes each row of ``documents``.

    ``odds`` names a column of relative odds above 0 (null: 1), in place of those by length: of two documents of a source, the one
    with twice the odds is wanted twice as often, up to ``max_copies``.
    """
    text = F.col("text").cast("string")
    base = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), n_words(text).alias("size"), *([F.col(odds).cast("double").alias("odds")] if odds else []))
    base = base.withColumn("odds", stepped(F.col("odds")) if odds else length_odds(F.col("size")))
    base = saved(base)
    aims = saved(targets(base))
    facts = aims.join(levels(base, aims, max_copies).withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # rows that share a doc_id, or have none, are drawn one by one, so that their numbers don't all fall together
    drawn = told_apart(base, ["doc_id"], "number", among=["doc_id", "text_hash"])
    one = F.when(F.col("number").isNull(), unit_hash(seed, F.col("doc_id"))).otherwise(unit_hash(seed, F.col("doc_id"), F.col("text_hash"), F.col("number")))
    wanted = looked_up(drawn.withColumn("u", one).drop("number"), facts, ["source"])
    times = F.least(F.col("level") * F.col("odds"), F.lit(float(max_copies)))
    wanted = wanted.withColumn("times", times).withColumn("whole", F.floor("times").cast("long")).withColumn("p", F.col("times") - F.col("whole"))
    certain = wanted.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("certain_words"), F.least(F.greatest(F.round(F.avg(F.when(F.col("p") > 0, F.col("p"))), 6), F.lit(1e-6)), F.lit(1 - 1e-6)).alias("mean_p"))
    wanted = looked_up(wanted, certain, ["source"])
    # Rank odds r, times the source's mean odds, as r / (1 + r): this orders alike and spreads over [0, 1]. Rows without a chance
    # add nothing, wherever they are.
    scale = F.col("mean_p") * (1 - F.col("p"))
    ratio = (F.col("u") * scale) / (F.col("u") * scale + F.col("p") * (1 - F.col("mean_p")) * (1 - F.col("u")))
    wanted = wanted.withColumn("rank_odds", F.when(F.col("p") > 0, ratio).otherwise(F.col("u")))
    wanted = wanted.withColumn("free", F.when(F.col("p") > 0, F.col("size")).otherwise(F.lit(0)))
    placed = running(wanted, ["source"], "rank_odds", ["doc_id", "text_hash"], {"before": "free"}, base.count())
    extra = (F.col("p") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("target") - F.col("certain_words"))
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", "odds", (F.col("whole") + extra.cast("long")).alias("copies"))


def mix_digest(documents: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, source_size, target, taken, and odds and copies."""
    return mixed(documents).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "odds", "copies")


def mix(documents: DataFrame) -> DataFrame:
    """The mixture itself: each document of ``documents`` as often as the mix takes it, with all its columns.

    Rows equal in doc_id, text and source share the copies that fall to them: each has the whole part of its share, and the first
    of them, by the order in which they were saved, one more.
    """
    taken = mixed(documents).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    names = {c: free_name(documents, c) for c in ("text_hash", "mix_source", "copies", "rows", "number", "copy")}
    keys = ["doc_id", names["text_hash"], names["mix_source"]]
    keyed = documents.select("*", F.xxhash64(F.col("text").cast("string")).alias(names["text_hash"]), F.col("source").cast("string").alias(names["mix_source"]))
    taken = saved(taken.where("copies > 0")).select(*[F.col(c).alias(f"_mix_{k}") for k, c in enumerate(("doc_id", "text_hash", "source"))], F.col("copies").alias(names["copies"]), F.col("rows").alias(names["rows"]))

    def with_copies(rows: DataFrame, counts: DataFrame) -> DataFrame:
        match = [rows[k].eqNullSafe(counts[f"_mix_{j}"]) for j, k in enumerate(keys)]
        return rows.join(counts, match[0] & match[1] & match[2]).drop("_mix_0", "_mix_1", "_mix_2")

    def as_often(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*quoted(documents.columns))

    single = as_often(with_copies(keyed, taken.where(F.col(names["rows"]) == 1)), F.col(names["copies"]))
    several = taken.where(F.col(names["rows"]) > 1)
    if not several.limit(1).count():
        return single
    # a row that is repeated very often is numbered, and given its copies, where it lies
    counts = several.select(*[F.col(f"_mix_{j}").alias(k) for j, k in enumerate(keys)], names["copies"], names["rows"])
    repeated = numbered(looked_up(keyed, counts, keys), keys, names["number"])
    copies, among = F.col(names["copies"]), F.col(names["rows"])
    share = F.floor(copies / among) + F.when(F.col(names["number"]) < F.pmod(copies, among), 1).otherwise(0)
    return single.unionByName(as_often(repeated, share))
