"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

A document's set holds its distinct 5-word shingles, A-Z lower-cased; a text of fewer words is one shingle; a null or blank
text has the empty set and links with nothing. Two documents are linked if 100 * intersection >= 75 * union of their sets.

1. Documents with equal sets (two 64-bit sums over the set and its size) become one *class*, the smallest doc_id its name, so
   that a group of copies, however large, goes on as one row.
2. Each class is posted under all its (coordinate, value) pairs. A pair over the threshold shares at least ``MATCHES`` of
   ``COORDINATES`` values (all but about 3 of a million do at a similarity of just 0.75). In order of frequency, rarest
   first, it must then share one of the first ``COORDINATES - MATCHES + 1``: only these prefixes are joined, and the long
   lists at the end of the order are skipped; the count over them is made from the signatures the postings carry.
3. Pairs with enough matches aren't listed. Each list gives a spanning forest of them, and the components of all forests are
   *families*: every pair that may be linked lies within one.
4. The texts of each family meet. There pairs with enough matches are confirmed on their full sets, best matches first; pairs
   that are linked up already are left out, and what comes out is a spanning forest of the links. Its components are the result.

Lists and families are linked in the same way (``linked``). One of up to ``BLOCK`` rows and ``BLOCK_BYTES`` is one group. The rows
of a larger one are dealt into such blocks, and ``REPRESENTATIVES`` of them go to every block: what links with one of these is
contracted, and that is all for a group of copies of any size. Where several components are left, the rows outside the largest
one meet all rows, again block by block, so that no pair of different components goes without its comparison.

The sets are held as 64-bit hashes of their shingles. Rows of one doc_id whose texts have the same set count as one document; a
row without doc_id is kept, in no component. An empty table gives an empty result; other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import looked_up, saved
from lacuna.llm.components import components
from lacuna.llm.textbatch import mix, slices

COORDINATES = 64
MATCHES = 31
PREFIX = COORDINATES - MATCHES + 1
SIMILARITY = 75
BLOCK = 512
BLOCK_BYTES = 16_000_000
REPRESENTATIVES = 8
_random = np.random.default_rng(75)
_FACTORS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``COORDINATES`` 32-bit minima for each set; an empty set has zeros."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k in range(COORDINATES):
            out[full, k] = np.minimum.reduceat(flat * _FACTORS[k] + _TERMS[k], starts) >> np.uint64(32)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in slices(batch.column("text")):
            sets = texts.shingles()
            sums = np.array([[s.sum(), mix(s).sum()] if len(s) else [0, 0] for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array([x.tobytes() for x in signatures(sets)], pa.binary())],
                names=["doc_id", "n_shingles", "sum_a", "sum_b", "signature"],
            )


def described(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two sums that name the set, and the signature, from whole texts."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_describe, "doc_id long, n_shingles long, sum_a long, sum_b long, signature binary")


def _coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.int64)
        keys = (values + (np.arange(COORDINATES, dtype=np.int64) << 32)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), COORDINATES)), pa.array(keys)], names=["id", "posting"])


def postings(classes: DataFrame) -> DataFrame:
    """(posting, id) of the rarest ``PREFIX`` coordinates of each class, as far as another class has the same value.

    The list lengths, not the lists, are joined back; a class with too few shared values to reach ``MATCHES`` drops out.
    """
    every = classes.mapInArrow(_coordinates, "id long, posting long")
    length = every.groupBy("posting").agg(F.count("*").alias("length")).where("length > 1")
    shared = every.join(length, "posting").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("length", "posting"))).alias("own"))
    alone = F.lit(COORDINATES) - F.size("own")
    kept = shared.where(F.size("own") >= MATCHES).select("id", F.explode(F.slice("own", 1, F.greatest(F.lit(PREFIX) - alone, F.lit(0)))).alias("own"))
    return kept.select("id", F.col("own.posting").alias("posting"))


class _Sets:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key together; they come sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = np.stack([batch.column(c).to_numpy() for c in keys])
        at = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b > a:
                key = tuple(values[:, a])
                if held and key != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
    if held:
        yield pa.Table.from_batches(held)


def _pairs(group: pa.Table) -> tuple[_Sets, Iterator[tuple[int, np.ndarray]]]:
    """Rows of one component joined, and for each row on the left the rows on the right that it has to be compared with."""
    left, right = (group.column(c).to_numpy(zero_copy_only=False) for c in ("is_left", "is_right"))
    _, own = np.unique(group.column("component").to_numpy(), return_inverse=True)
    sets, first = _Sets(group.num_rows), {}
    for row, k in enumerate(own.tolist()):
        sets.join(first.setdefault(k, row), row)
    others = np.flatnonzero(right)

    def each() -> Iterator[tuple[int, np.ndarray]]:
        for i in np.flatnonzero(left):
            # rows that are on both sides meet once
            yield i, others[(others > i) | ~left[others]] if right[i] else others

    return sets, each()


def _candidates(i: int, others: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the others with enough matches and a size that fits, and their matches."""
    others = others[100 * np.minimum(sizes[others], sizes[i]) >= SIMILARITY * np.maximum(sizes[others], sizes[i])]
    n = (signs[others] == signs[i]).sum(axis=1)
    return others[n >= MATCHES], n[n >= MATCHES]


def _edges(group: pa.Table, links: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(links, np.int64).reshape(-1, 2)
    key = np.full(len(table), group.column("key")[0].as_py(), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(table[:, 0]), pa.array(table[:, 1])], names=["key", "a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a block of a list, a spanning forest of the pairs with enough matches."""
    for group in _groups(batches, ["key", "p", "q"]):
        nodes, sizes = group.column("id").to_numpy(), group.column("n_shingles").to_numpy()
        signs = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        (sets, pairs), out = _pairs(group), []
        for i, others in pairs:
            others = _candidates(i, others[sets.roots()[others] != sets.find(i)], sizes, signs)[0]
            for j in others[np.unique(sets.roots()[others], return_index=True)[1]]:
                if sets.join(i, j):
                    out.append((nodes[i], nodes[j]))
        yield _edges(group, out)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a block of a family, a spanning forest of the links between the full sets of their texts."""
    for group in _groups(batches, ["key", "p", "q"]):
        nodes = group.column("id").to_numpy()
        shingles = [s for _, _, texts in slices(group.column("text")) for s in texts.shingles()]
        sizes, signs = np.array([len(s) for s in shingles]), signatures(shingles)
        (sets, pairs), out = _pairs(group), []
        for i, others in pairs:
            others, n = _candidates(i, others[sets.roots()[others] != sets.find(i)], sizes, signs)
            others = others[np.argsort(-n, kind="stable")]
            while len(others):
                others = others[sets.roots()[others] != sets.find(i)]
                now, others = others[:16], others[16:]
                for j in now:
                    if sets.find(i) != sets.find(j):
                        at = np.searchsorted(shingles[i], shingles[j])
                        common = int((shingles[i][np.minimum(at, sizes[i] - 1)] == shingles[j]).sum())
                        if 100 * common >= SIMILARITY * (sizes[i] + sizes[j] - common):
                            sets.join(i, j)
                            out.append((nodes[i], nodes[j]))
        yield _edges(group, out)


def _roots(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of one key's pairs of representatives, which are few, the smallest one that each hangs together with."""
    ids = sorted(set(pairs["rep"]) | set(pairs["other"]))
    sets = _Sets(len(ids))
    for a, b in zip(pairs["rep"], pairs["other"], strict=True):
        sets.join(ids.index(a), ids.index(b))
    return pd.DataFrame({"key": pairs["key"].iloc[0], "rep": ids, "root": [ids[sets.find(i)] for i in range(len(ids))]})


def linked(rows: DataFrame, key: str, columns: list[str], size: Column, compare: Callable) -> DataFrame:
    """(a, b): a spanning forest of the links that ``compare`` finds within each key. ``rows`` are saved; ``size`` is a row's bytes.

    The groups given to ``compare`` have key, p, q, id, component, is_left, is_right and ``columns``, sorted by (key, p, q); rows on
    the left are to be compared with those on the right.
    """
    columns = [c for c in columns if c != "id"]
    rows = rows.select(F.col(key).alias("key"), "id", size.cast("long").alias("_size"), *columns)
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("_size") / BLOCK_BYTES)).cast("int")
    large = saved(rows.groupBy("key").agg(blocks.alias("_blocks")).where("_blocks > 1"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)

    def grouped(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select("key", "p", "q", "id", "component", "is_left", "is_right", *columns)
        return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(compare, "key long, a long, b long")

    some = large.limit(1).count() > 0
    # the rows themselves are shuffled once, to their groups; only those of large keys, which are few, go further
    sized = looked_up(rows, large, ["key"], "left") if some else rows
    small = sized.where("_blocks is null") if some else rows
    links = grouped(small.select("*", zero.alias("p"), zero.alias("q"), F.col("id").alias("component"), yes.alias("is_left"), yes.alias("is_right")))
    if not some:
        return links.select("a", "b")
    dealt = sized.where("_blocks is not null").withColumn("block", F.pmod(F.xxhash64("id"), "_blocks").cast("int"))
    everywhere = F.explode(F.sequence(zero, F.col("_blocks") - 1))

    # the rows with the smallest of several hashes stand for their key
    stand = dealt.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id")).alias(f"r{k}") for k in range(REPRESENTATIVES)])
    stand = saved(stand.select("key", F.explode(F.array_distinct(F.array(*[F.col(f"r{k}.id") for k in range(REPRESENTATIVES)]))).alias("id")))
    left = dealt.join(stand, ["key", "id"]).select("*", everywhere.alias("q"))
    left = left.select("key", "id", *columns, zero.alias("p"), "q", F.col("id").alias("component"), yes.alias("is_left"), no.alias("is_right"))
    right = dealt.select("key", "id", *columns, zero.alias("p"), F.col("block").alias("q"), F.col("id").alias("component"), no.alias("is_left"), yes.alias("is_right"))
    stars = saved(grouped(left.unionByName(right)))

    # a row hangs on the smallest representative it links with, and representatives that share a row hang together
    met = stars.unionByName(stand.select("key", F.col("id").alias("a"), F.col("id").alias("b")))
    met = saved(met.groupBy("key", F.col("b").alias("id")).agg(F.min("a").alias("rep"), F.collect_set("a").alias("reps")))
    pairs = met.where(F.size("reps") > 1).select("key", "rep", F.explode("reps").alias("other")).distinct()
    roots = pairs.groupBy("key").applyInPandas(_roots, "key long, rep long, root long")
    hung = met.select("key", "id", "rep").join(roots, ["key", "rep"], "left").select("key", "id", F.coalesce("root", "rep").alias("hung"))
    labelled = dealt.select("key", "id", "_size", "_blocks", "block").join(hung, ["key", "id"], "left")
    labelled = saved(labelled.withColumn("component", F.coalesce("hung", "id")).drop("hung"))

    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes"))
    parts = parts.groupBy("key").agg(F.max(F.struct("n", "component", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts")).where("parts > 1")
    outer = F.greatest(F.ceil((F.col("n") - F.col("top.n")) / BLOCK), F.ceil((F.col("bytes") - F.col("top.bytes")) / BLOCK_BYTES)).cast("int")
    apart = saved(parts.select("key", F.col("top.component").alias("most"), outer.alias("_outer")))
    found = links.unionByName(stars)
    if not apart.limit(1).count():
        return found.select("a", "b")
    marks = looked_up(labelled.select("key", "id", "component"), apart, ["key"])
    marked = looked_up(dealt, apart.select("key"), ["key"], "left_semi").join(marks, ["key", "id"])
    left = marked.where("component <> most").withColumn("p", F.pmod(F.xxhash64("id", zero), "_outer").cast("int")).select("*", everywhere.alias("q"))
    left = left.select("key", "id", *columns, "p", "q", "component", yes.alias("is_left"), no.alias("is_right"))
    right = marked.select("*", F.explode(F.sequence(zero, F.col("_outer") - 1)).alias("p"))
    right = right.select("key", "id", *columns, "p", F.col("block").alias("q"), "component", no.alias("is_left"), yes.alias("is_right"))
    return found.unionByName(grouped(left.unionByName(right))).select("a", "b")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``documents`` (columns doc_id and text are used)."""
    rows = saved(described(documents))
    sets = ["n_shingles", "sum_a", "sum_b"]
    named = rows.where("n_shingles > 0 and doc_id is not null")
    classes = saved(named.groupBy(*sets).agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")))

    lists = saved(postings(classes.select("id", "signature")).join(classes.select("id", "n_shingles", "signature"), "id"))
    forests = linked(lists, "posting", ["id", "n_shingles", "signature"], F.lit(4 * COORDINATES + 16), _forest)
    families = components(forests).withColumnRenamed("component", "family").withColumnRenamed("node", "id")

    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    members = saved(texts.join(saved(families), "id").dropDuplicates(["id", "text"]))
    joined = components(linked(members, "family", ["id", "text"], F.octet_length("text"), _confirmed))

    names = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").select(*sets, F.coalesce("component", "id").alias("component_id"))
    out = rows.select("doc_id", *sets).join(names, sets, "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
