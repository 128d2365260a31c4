"""Removing repeated passages by a suffix array to a depth of ``LENGTH`` bytes, refined bucket by bucket.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts elsewhere. Suffixes are put into buckets by their first
``GRAM`` bytes, and buckets of more than one suffix are refined: suffixes are sorted by the identifiers of the buckets that their
later offsets are in, the new identifiers take the place of the old, and the next pass, of double depth, sorts on those.

How it runs. Sorting every suffix of a corpus would move far more than the corpus. Of each string of ``LENGTH`` bytes one
``GRAM`` is its anchor: the one whose hash is least, the leftmost of ties. Equal strings have equal anchors at equal places, so
only suffixes at anchors (about one in 85 bytes) go into the initial buckets, and a bucket with one suffix is settled.

1. Copies of a text are counted by their SHA-256 and go whole; one of them stays for comparison with others.
2. Each text's anchors are found on flat arrays: anchor, place, and which strings it anchors (``lo`` to ``hi`` bytes before it).
3. Buckets of one suffix are dropped after a grouping with map-side counts.
4. The others take along the bytes that their strings cover (their context), each kind of context once a batch: if the same bytes come again, all their strings are repeated, as is said at once.
5. Buckets go to tasks by their anchor, whole. The bytes after the anchors are sorted by refinement, and so are those before them, backwards. Where neighbours in both orders share enough bytes, strings are equal; this is exact, no hash decides it.
   A bucket of more than ``HOT`` contexts would be too much for a task: its strings are counted by 128-bit hashes instead, each as a row, with map-side sums.
6. Runs of repeated strings come together by text and are cut out.

Defined results. A null text is empty. Texts shorter than ``LENGTH`` bytes stay. Rows with equal texts of ``LENGTH`` bytes or more
lose all of them, also where doc_id is null or repeated. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import looked_up, saved
from lacuna.llm.textbatch import mix, powers

LENGTH = 200
GRAM = 32
HOT = 50_000
#: Contexts that a task refines together, unless one bucket has more.
TOGETHER = 16_384
SLICE = 2_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_random = np.random.default_rng(12)
_CODES = _random.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 2**64)) for b in _BASES)


def rolling(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each place."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[which][data] * powers(_BASES[which], n), out=total[1:])
    return mix((total[length:] - total[:-length]) * powers(_INVERSES[which], n - length + 1))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row: running minima of blocks, from both sides."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor's hash, place, lo, hi) of texts that lie in ``data`` one after the other: the strings that begin ``lo`` to ``hi`` bytes before the place have it as their anchor."""
    hashes = rolling(data, gram)
    width = length - gram + 1
    if len(hashes) < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    # the first half of the hash decides, then the place
    packed = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    at = (sliding_least(packed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    inside = np.arange(len(at)) + length <= bounds[1:][text]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    place = at[first]
    return text[first], hashes[place], place - bounds[:-1][text[first]], place - ends, place - first


def _slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of a column of texts without nulls; a text is never cut."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield a, b, data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        a = b


def _batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _anchored(length: int, gram: int):
    schema = pa.schema([("sha", pa.binary()), ("anchor", pa.list_(pa.int64())), ("place", pa.list_(pa.int32())), ("lo", pa.list_(pa.int16())), ("hi", pa.list_(pa.int16()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in _slices(batch.column("text")):
                text, value, place, lo, hi = anchors(data, bounds, length, gram)
                cuts = pa.array(np.searchsorted(text, np.arange(b - a + 1)), pa.int32())
                lists = {k: pa.ListArray.from_arrays(cuts, pa.array(v)) for k, v in (("anchor", value.view(np.int64)), ("place", place.astype(np.int32)), ("lo", lo.astype(np.int16)), ("hi", hi.astype(np.int16)))}
                yield _batch({"sha": batch.column("sha").slice(a, b - a).cast(pa.binary()), **lists}, schema)

    return run


def _contexts(length: int):
    """Each anchor's context, or, where the same bytes were seen before in the task's batch, the runs of strings that are thus repeated (``bytes`` null)."""
    schema = pa.schema([("anchor", pa.int64()), ("uid", pa.int64()), ("place", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[tuple, list] = {}
            out: list[list] = []
            for row in batch.to_pylist():
                text = row["text"]
                for s in row["suffixes"]:
                    key = (s["anchor"], s["lo"], s["hi"], text[s["place"] - s["hi"] : s["place"] - s["lo"] + length])
                    made = [s["anchor"], row["uid"], s["place"], s["lo"], s["hi"], None]
                    if key not in first:
                        first[key] = [*made[:5], False]
                        out.append([*made[:5], key[3]])
                    else:
                        found = first[key]
                        if not found[5]:
                            found[5] = True
                            out.append([*found[:5], None])
                        out.append(made)
            yield _batch({f.name: [r[k] for r in out] for k, f in enumerate(schema)}, schema)

    return run


def refined(words: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (bucket, words), and the pass's last bucket identifiers.

    ``words`` holds, for each suffix, its first 8-grams, read as numbers: their ranks are the initial buckets. A bucket at depth
    2d is a pair of buckets at depth d, of a place and of the place d later; only the pairs' ranks are kept, for the next pass.
    """
    _, ids = np.unique(words, return_inverse=True)
    ids = ids.reshape(words.shape).astype(np.int64)
    n_words, depth = words.shape[1], 1
    parts, rest = [], n_words  # the suffix as buckets of the depths that add up to its length
    levels = [ids]
    while 2 * depth <= n_words:
        pairs = ids[:, : ids.shape[1] - depth] * (ids.max() + 1) + ids[:, depth:]
        _, ids = np.unique(pairs, return_inverse=True)
        ids = ids.reshape(pairs.shape).astype(np.int64)
        levels.append(ids)
        depth *= 2
    place = 0
    for k in range(len(levels) - 1, -1, -1):
        if rest >= 1 << k:
            parts.append(levels[k][:, place])
            place, rest = place + (1 << k), rest - (1 << k)
    for part in parts:
        _, bucket = np.unique(bucket * (part.max() + 1) + part, return_inverse=True)
    return np.argsort(bucket, kind="stable"), bucket


def _side(rows: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row among all by (bucket, bytes), and how many first bytes each, in that order, shares with the one before (-1: another bucket)."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, _ = refined(words, bucket)
    shared = np.full(len(rows), -1)
    a, b = rows[order[:-1]], rows[order[1:]]
    differs = a != b
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    same = bucket[order[:-1]] == bucket[order[1:]]
    shared[1:][same] = common[same]
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    return rank, shared


def repeated(bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray, contexts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset before the anchor) of each string that equals one of another row of the same bucket."""
    n, most = len(contexts), length - gram
    eights = lambda k: -(-max(k, 1) // 8) * 8
    after, before = np.zeros((n, eights(length)), np.uint8), np.zeros((n, eights(most)), np.uint8)
    for k, (c, h) in enumerate(zip(contexts, hi.tolist(), strict=True)):
        row = np.frombuffer(c, np.uint8)
        after[k, : len(row) - h] = row[h:]  # the anchor's own bytes too: equal hashes alone prove nothing
        before[k, :h] = row[:h][::-1]
    rank_after, shared_after = _side(after, bucket)
    rank_before, shared_before = _side(before, bucket)
    rows, offsets = [], []
    for offset in range(most + 1):
        live = np.flatnonzero((lo <= offset) & (hi >= offset))
        if len(live) < 2:
            continue
        # buckets at this depth: they end where neighbours in order share less
        pair = np.cumsum(shared_after < length - offset)[rank_after[live]] * (n + 1) + np.cumsum(shared_before < offset)[rank_before[live]]
        order = np.argsort(pair, kind="stable")
        same = pair[order[1:]] == pair[order[:-1]]
        hit = np.zeros(len(live), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        rows.append(live[hit])
        offsets.append(np.full(int(hit.sum()), offset))
    return (np.concatenate(rows), np.concatenate(offsets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


RUNS = "uid long, first long, last long"
_RUNS = pa.schema([("uid", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])


def _runs(uid: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive starts of strings in a text."""
    order = np.lexsort((first, uid))
    uid, first = uid[order], first[order]
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (first[1:] > first[:-1] + 1)
    at = np.flatnonzero(new)
    return _batch({"uid": uid[at], "first": first[at], "last": first[np.append(at[1:], len(uid)) - 1] if len(at) else first[:0]}, _RUNS)


def _refined_buckets(length: int, gram: int, together: int):
    """Runs of repeated strings of whole buckets; what is known to be repeated (``bytes`` null) passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def work(rows: list[dict]) -> pa.RecordBatch:
            bucket = np.unique([r["anchor"] for r in rows], return_inverse=True)[1]
            at = lambda c: np.array([r[c] for r in rows], np.int64)
            row, offset = repeated(bucket, at("lo"), at("hi"), [r["bytes"] for r in rows], length, gram)
            return _runs(at("uid")[row], at("place")[row] - offset)

        for batch in batches:
            known = batch.filter(batch.column("bytes").is_null())
            if len(known):
                yield _batch({"uid": known.column("uid"), "first": pc.subtract(known.column("place"), known.column("hi")), "last": pc.subtract(known.column("place"), known.column("lo"))}, _RUNS)
            for row in batch.filter(batch.column("bytes").is_valid()).to_pylist():
                if len(held) >= together and row["anchor"] != held[-1]["anchor"]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    return run


def _hashed_strings(length: int):
    """Each string of a context by a 128-bit hash of its bytes."""
    schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("uid", pa.int64()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                start = row["place"] - row["hi"]
                one, two = (rolling(data, length, k).view(np.int64) for k in (0, 1))
                yield _batch({"one": one, "two": two, "uid": np.full(len(one), row["uid"]), "first": start + np.arange(len(one))}, schema)

    return run


def _cut_out(length: int):
    schema = pa.schema([("sha", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                spans: list[list[int]] = []
                for first, last in sorted((r["first"], r["last"]) for r in row["runs"]):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + length)
                    else:
                        spans.append([first, last + length])
                digest, at = hashlib.sha256(), 0
                for a, b in spans:
                    digest.update(row["text"][at:a])
                    at = b
                digest.update(row["text"][at:])
                out.append([row["sha"], sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [a for a, _ in spans], [b for _, b in spans]])
            yield _batch({f.name: [r[k] for r in out] for k, f in enumerate(schema)}, schema)

    return run


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends: for each row the byte spans that go, and what is left's digest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = documents.select("doc_id", text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    ids = saved(keyed.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")))
    copies = saved(ids.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1"))
    texts = keyed.where(F.octet_length("text") >= length).select("sha", "text")
    single = looked_up(texts, copies.select("sha"), ["sha"], "left_anti")
    several = looked_up(texts, copies.select("sha"), ["sha"], "left_semi").groupBy("sha").agg(F.first("text").alias("text"))
    texts = single.unionByName(several)

    found = texts.mapInArrow(_anchored(length, gram), "sha binary, anchor array<long>, place array<int>, lo array<smallint>, hi array<smallint>")
    found = saved(found.withColumn("uid", F.monotonically_increasing_id()))
    suffix = found.select("uid", F.explode(F.arrays_zip("anchor", "place", "lo", "hi")).alias("s")).select("uid", "s.*")
    # saved, so that the join below reads two plain shuffles and Spark may split an anchor with very many suffixes
    buckets = saved(suffix.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    live = suffix.join(buckets.select("anchor"), "anchor").groupBy("uid").agg(F.collect_list(F.struct("anchor", "place", "lo", "hi")).alias("suffixes"))
    live = saved(live.join(found.select("uid", "sha"), "uid"))
    contexts = live.join(texts, "sha").select("uid", "suffixes", "text").mapInArrow(_contexts(length), "anchor long, uid long, place long, lo int, hi int, bytes binary")
    # an anchor's contexts are at most its suffixes; as a rule no anchor has too many, and contexts go straight to their buckets
    hot_anchors = saved(buckets.where(F.col("n") > hot).select("anchor"))
    told = None
    if hot_anchors.limit(1).count():
        contexts = saved(contexts)
        too_many = looked_up(contexts.where("bytes is not null"), hot_anchors, ["anchor"], "left_semi")
        strings = saved(too_many.mapInArrow(_hashed_strings(length), "one long, two long, uid long, first long"))
        several = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1")
        told = strings.join(several, ["one", "two"]).select("uid", "first", F.col("first").alias("last"))
        contexts = contexts.where("bytes is null").unionByName(looked_up(contexts.where("bytes is not null"), hot_anchors, ["anchor"], "left_anti"))
    dealt = contexts.withColumn("part", F.when(F.col("bytes").isNull(), F.col("uid")).otherwise(F.col("anchor")))
    runs = dealt.repartition("part").sortWithinPartitions("anchor").drop("part").mapInArrow(_refined_buckets(length, gram, together), RUNS)
    runs = (runs if told is None else runs.unionByName(told)).groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    cut = saved(runs).join(found.select("uid", "sha"), "uid").join(copies, "sha", "left_anti").join(single, "sha")
    cut = cut.select("sha", "text", "runs").mapInArrow(_cut_out(length), "sha binary, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
    twice = copies.select("sha", F.lit(True).alias("twice"))
    out = looked_up(ids, twice, ["sha"], "left").join(cut, "sha", "left")
    whole = F.col("twice").isNotNull()
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<long>")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, F.array(zero)).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(whole, F.array("n_bytes")).otherwise(F.coalesce("ends", none)).alias("ends"),
    )


def kept_texts(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, kept: the bytes of each text that ``repeated_spans`` left, for tables in which doc_id is unique."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", text.alias("text")).join(spans.select("doc_id", "starts", "ends"), "doc_id")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.col("ends"))
    stops = F.concat(F.col("starts"), F.array(F.octet_length("text").cast("long")))
    pieces = F.transform(F.arrays_zip(begins.alias("a"), stops.alias("b")), lambda p: F.substring(F.col("text"), (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    return rows.select("doc_id", F.aggregate(pieces, F.lit(b""), lambda x, y: F.concat(x, y)).alias("kept"))


def suffix_digest(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return repeated_spans(documents).drop("starts", "ends")
