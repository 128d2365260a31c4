"""The trie of conversation prefixes, built level by level, and what sharing its nodes would save.

A node of depth d is a distinct sequence of first d turns (role, text); its members are the conversations that begin with it, and
the smallest member's conv_id names it within its depth. Going down, the live conversations of a level are grouped by (parent
node, next turn); each group is a node, named by the minimum of conv_id. Going up, each level is joined with the sums over its
children: leaves and saved tokens roll up from the deepest level to the root.

How it runs. Turns travel as their place, a SHA-256 of role and text, and their number of words; no text is shuffled. A level is
one grouping with map-side sums and one join back, so a first turn shared by a third of all conversations makes no large task.
As soon as the turns below a node, its own included, are at most ``SUBTREE`` rows, its whole subtree goes to a task, some
``SUBTREE`` rows of subtrees together, which does the same level by level on arrays, down and up, and hands back what its top
passes on. Larger nodes go on as levels of Spark jobs, as many as the longest prefix that so many conversations share. The
ids of the conversations that end at a large node are sorted by ranges, joined to long strings in their ranges, and only these
strings stream through the task that hashes the node.

Defined results. Null role or text: empty. Null turns come first; turns of equal number go by role and text. Rows without
conv_id belong to no conversation and are left out. Conversations without turns are members of the root. An empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import looked_up, n_words, numbered, saved, shared_folder, written

#: Rows of turns in a subtree from which on a task takes the whole subtree.
SUBTREE = 50_000
#: Conversations c - c % BASE to the next such share a base; of it they take the first crc32(c) % HEADS turns.
BASE, HEADS = 20, 4
#: Sort keys carry so much of a text; a longer common prefix only keeps rows in one partition.
KEY_CHARS = 64
#: Ids in one string of those that are hashed.
CHUNK = 50_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in NODE.split(", ")])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), turn_sha, words: the turns of each conversation in order."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text")).where("conv_id is not null")
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    rows = rows.repartitionByRange(*keys, F.substring("text", 1, KEY_CHARS)).sortWithinPartitions(*keys, "text")
    sha = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.select("conv_id", sha.alias("turn_sha"), n_words(F.col("text")).alias("words"))
    return numbered(rows, ["conv_id"], "place").select("conv_id", (F.col("place") + 1).alias("depth"), "turn_sha", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and their turns after each took its first turns from its base, as ``turns`` gives them."""
    own = saved(turns(conversations))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    ids = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"), heads.alias("heads"))
    first = own.where(F.col("depth") < HEADS).select(F.col("conv_id").alias("base"), "depth", "turn_sha", "words")
    taken = ids.join(first, "base").where(F.col("depth") <= F.col("heads")).select("conv_id", "depth", "turn_sha", "words")
    lengths = first.groupBy("base").agg(F.count("*").alias("has"))
    shift = ids.join(lengths, "base", "left").select("conv_id", "heads", (F.least(F.coalesce("has", F.lit(0)), F.col("heads")) - F.col("heads")).alias("shift"))
    rest = looked_up(own, shift, ["conv_id"]).where(F.col("depth") > F.col("heads")).select("conv_id", (F.col("depth") + F.col("shift")).alias("depth"), "turn_sha", "words")
    return ids.select("conv_id"), taken.unionByName(rest)


def trie(ids: DataFrame, steps: DataFrame, subtree: int = SUBTREE, chunk: int = CHUNK) -> DataFrame:
    """The nodes over all conversations of ``ids`` (conv_id) with the turns ``steps`` (conv_id, depth from 1 without gaps, turn_sha, words)."""
    spark = steps.sparkSession
    folder = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
    steps = saved(steps)
    lengths = steps.groupBy("conv_id").agg(F.count("*").alias("turns"))
    live = ids.distinct().join(lengths, "conv_id", "left").select("conv_id", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"))
    live = saved(live)
    least, n_convs, n_turns = live.agg(F.min("conv_id"), F.count("*"), F.sum("turns")).first()
    if not n_convs:
        return spark.createDataFrame([], NODE)
    top = [F.lit(least).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("words")]
    live = live.select("conv_id", "turns", *top, (F.lit(n_turns) > subtree).alias("large"))
    level = spark.range(1).select(*top, F.lit(n_convs).cast("long").alias("n_convs"))
    large: list[DataFrame] = []  # the nodes of each depth that Spark handles
    tops: list[DataFrame] = []  # conversations whose subtree goes to a task, with what is known of its top
    ends: list[DataFrame] = []  # conversations that end at large nodes
    n_large, n_small, n_ends = (int(n_turns > subtree), int(n_turns <= subtree), 1)
    while True:
        depth = len(large)
        if n_small:
            tops.append(live.where("not large").select("conv_id", "node", "parent", F.col("words").alias("top_words"), F.lit(depth).cast("long").alias("top_depth")))
        if not n_large:
            break
        live = live.where("large")
        large.append(level)
        if n_ends:
            ends.append(live.where(F.col("turns") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        depth += 1
        next_turns = steps.where(F.col("depth") == depth).select("conv_id", "turn_sha", F.col("words").alias("said"))
        on = live.select("conv_id", "turns", "node").join(next_turns, "conv_id")
        rows, ending = (F.col("turns") - depth + 1).cast("long"), F.when(F.col("turns") == depth, 1)
        groups = on.groupBy("node", "turn_sha").agg(F.min("conv_id").alias("child"), F.count("*").alias("n_convs"), F.max("said").alias("words"), (F.sum(rows) > subtree).alias("large"), F.count(ending).alias("n_ends"))
        groups = written(groups, f"{folder}/groups-{depth}")
        count = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0))
        n_all, n_large, n_ends = groups.agg(F.count("*"), count(F.col("large")), count(F.col("large") & (F.col("n_ends") > 0))).first()
        n_small = n_all - n_large
        level = groups.where("large").select(F.col("child").alias("node"), F.col("node").alias("parent"), "words", "n_convs")
        found = looked_up(on.select("conv_id", "turns", "node", "turn_sha"), groups.select("node", "turn_sha", "child", "words", "large"), ["node", "turn_sha"], size=100 * n_all)
        live = written(found.select("conv_id", "turns", F.col("child").alias("node"), F.col("node").alias("parent"), "words", "large"), f"{folder}/live-{depth}")
    done = _subtrees(tops, steps, subtree)
    return _rolled_up(large, saved(done), ends, chunk, folder) if large else done


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _subtrees(tops: list[DataFrame], steps: DataFrame, subtree: int) -> DataFrame:
    """The nodes of all small subtrees, their tops included."""
    if not tops:
        return steps.sparkSession.createDataFrame([], NODE)
    columns = ["conv_id", "node", "parent", "top_words", "top_depth"]
    members = saved(_all(tops))
    rows = members.select(*columns, F.lit(None).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn_sha"), F.lit(0).cast("long").alias("words"))
    deeper = members.join(steps, "conv_id").where(F.col("depth") > F.col("top_depth"))
    rows = rows.unionByName(deeper.select(*columns, "depth", "turn_sha", "words"))
    tasks = max(1, -(-rows.count() // subtree))

    def build(table: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(levels(table.to_pandas(integer_object_nulls=True)), schema=_NODE, preserve_index=False)

    return rows.withColumn("part", F.pmod(F.xxhash64("node", "top_depth"), F.lit(tasks))).groupBy("part").applyInArrow(build, NODE)


def levels(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of some whole subtrees. A row without depth names a conversation of a subtree, the others are its turns below the top."""
    members = rows[rows["depth"].isna()].sort_values("conv_id", kind="stable")
    conv = members["conv_id"].to_numpy(np.int64)
    top_key = pd.MultiIndex.from_arrays([members["top_depth"].to_numpy(np.int64), members["node"].to_numpy(np.int64)])
    top_of, _ = pd.factorize(top_key)
    _, at = np.unique(top_of, return_index=True)
    # nodes so far: name, depth, parent's number (-1: outside), parent's name, words; and each conversation's node of the level
    name, deep = [members["node"].to_numpy(np.int64)[at]], [members["top_depth"].to_numpy(np.int64)[at]]
    up, words = [np.full(len(at), -1)], [members["top_words"].to_numpy(np.int64)[at]]
    outside = members["parent"].to_numpy()[at]
    size = [np.bincount(top_of, minlength=len(at))]
    starts, total = [0], len(at)
    own_depth = deep[0][top_of]
    steps = rows[rows["depth"].notna()]
    step_conv = np.searchsorted(conv, steps["conv_id"].to_numpy(np.int64))
    step_level = steps["depth"].to_numpy(np.int64) - own_depth[step_conv]
    sha, _ = pd.factorize(steps["turn_sha"].to_numpy())
    step_words = steps["words"].to_numpy(np.int64)
    order = np.argsort(step_level, kind="stable")
    bounds = np.searchsorted(step_level[order], np.arange(1, (step_level.max() if len(steps) else 0) + 2))
    node_of = top_of.astype(np.int64)  # of each conversation, the deepest node it has reached
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        take = order[a:b]
        who, parent = step_conv[take], node_of[step_conv[take]]
        key, first, number, count = np.unique(parent * (sha.max() + 1) + sha[take], return_index=True, return_inverse=True, return_counts=True)
        least = np.full(len(key), len(conv))
        np.minimum.at(least, number, who)  # conversations stand in order of their ids
        starts.append(total)
        name.append(conv[least])
        up.append(parent[first])
        deep.append(deep_of(deep, starts, parent[first]) + 1)
        words.append(step_words[take][first])
        size.append(count)
        node_of[who] = total + number
        total += len(key)
    name, deep, up, words, size = map(np.concatenate, (name, deep, up, words, size))
    children = np.bincount(up[up >= 0], minlength=total)
    leaves, saved_tokens = (children == 0).astype(np.int64), (size - 1) * words
    for a, b in zip(starts[:0:-1], [*starts[1:], total][:0:-1], strict=True):
        np.add.at(leaves, up[a:b], leaves[a:b])
        np.add.at(saved_tokens, up[a:b], saved_tokens[a:b])
    ends = [EMPTY_SHA] * total
    by_node = np.argsort(node_of, kind="stable")
    cuts = np.flatnonzero(np.diff(node_of[by_node])) + 1
    for group in np.split(by_node, cuts):
        if len(group):
            ends[node_of[group[0]]] = hashlib.sha256(",".join(map(str, conv[group].tolist())).encode()).hexdigest()
    parents = np.where(up >= 0, name[up], None)
    parents[: len(outside)] = outside
    return pd.DataFrame({"conv_id": name, "depth": deep, "parent_conv_id": parents, "n_convs": size, "n_children": children, "n_leaves": leaves, "saved_tokens": saved_tokens, "ends_sha256": ends})


def deep_of(deep: list[np.ndarray], starts: list[int], nodes: np.ndarray) -> np.ndarray:
    """Depths of nodes of the level before the one that begins last."""
    return deep[-1][nodes - starts[-2]]


def _rolled_up(large: list[DataFrame], done: DataFrame, ends: list[DataFrame], chunk: int, folder: str) -> DataFrame:
    """``done`` and the nodes of the large levels, from the deepest to the root, each written before the next reads it."""
    spark = done.sparkSession
    hashes = saved(_hashed(_all(ends), chunk)) if ends else spark.createDataFrame([], "depth long, node long, ends_sha256 string")
    zero = lambda c, d=0: F.coalesce(F.col(c), F.lit(d).cast("long"))
    children = done
    for depth in range(len(large) - 1, -1, -1):
        children = children.where(F.col("depth") == depth + 1)
        if depth < len(large) - 1:
            children = children.unionByName(done.where(F.col("depth") == depth + 1))
        sums = children.groupBy(F.col("parent_conv_id").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        ended = hashes.where(F.col("depth") == depth).select("node", "ends_sha256")
        level = large[depth].join(sums, "node", "left").join(ended, "node", "left").select(
            F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
            zero("n_children").alias("n_children"), zero("n_leaves", 1).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + zero("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
        children = written(level, f"{folder}/nodes-{depth}")
    return done.unionByName(spark.read.schema(NODE).parquet(*(f"{folder}/nodes-{d}" for d in range(len(large)))))


def _hashed(ends: DataFrame, chunk: int) -> DataFrame:
    """depth, node, ends_sha256 of the ids (depth, node, conv_id) that end at each node, in numeric order, joined by commas."""
    key = ["depth", "node", "conv_id"]
    strings = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    digests = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in key), strict=True):
                if ids and (row[:2] != node or len(ids) >= chunk):
                    yield batch_of([(*node, ids[0], ",".join(map(str, ids)))], strings)
                    ids = []
                node = row[:2]
                ids.append(row[2])
        if ids:
            yield batch_of([(*node, ids[0], ",".join(map(str, ids)))], strings)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["depth"], row["node"]) != node:
                    if digest:
                        yield batch_of([(*node, digest.hexdigest())], digests)
                    node, digest = (row["depth"], row["node"]), hashlib.sha256(row["ids"].encode())
                else:
                    digest.update(b"," + row["ids"].encode())
        if digest:
            yield batch_of([(*node, digest.hexdigest())], digests)

    joined = ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(join, "depth long, node long, first long, ids string")
    return joined.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(hash_all, "depth long, node long, ends_sha256 string")


def trie_digest(conversations: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """The contract's columns for the rebuilt conversations."""
    return trie(*rebuilt(conversations), subtree=subtree)

