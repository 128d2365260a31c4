"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy.

The statistics are counts and ratios over the whole text: length, letter case, symbols, punctuation, stop words, distinct
words and word pairs, repeated neighbours and equal lines. Labels, language, source and doc_id are no inputs.

Training takes at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of their doc_id, from the rows whose
``crc32(doc_id as text) mod 4`` is not ``HELD_OUT``; of rows that repeat a doc_id and label the text with the smallest hash is
taken. Their statistics, a few numbers a row, are fitted on the driver. Each
level of a tree is chosen from one gradient histogram a feature. Trees are complete, so a forest is three arrays: feature,
threshold and leaf value by (tree, node), and a batch of documents walks all trees at once.

A null or empty text has all statistics 0 and gets the score of the leaf it falls in. Without usable labels, or with labels
of one kind only, every score is the share of label 1, or 0.5. Repeated rows have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import free_name, quoted
from lacuna.llm.textbatch import Texts, mix, slices

TRAIN_ROWS = 10_000
HELD_OUT = 2
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, SMOOTH = 80, 4, 64, 0.15, 5.0

# Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on as was are this by from or an at not "
    "der die das und ein eine ist zu den von mit dem auf für als im nicht "
    "le la les de des du et un une en que qui est au pour par pas dans il elle "
    "el los las y con por una su para es lo se del como"
).split()
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "line": (10,),
    "stop": b".", "comma": b",", "shout": b"!?", "bar": b"|", "mark": b"#*$%&<>@^~_=+\\", "bracket": b"()[]{}\"'", "wide": range(128, 256),
}
_OF_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _OF_CLASS[list(_bytes), _k] = 1
FEATURES = ["log_words", "mean_word_bytes", "log_bytes", *(f"{c}_share" for c in _CLASSES), "upper_of_letters", "stop_word_share", "distinct_share", "distinct_pair_share", "repeat_share", "top_word_share", "equal_line_share", "words_a_line", "long_word_share"]


def _stop_hashes() -> np.ndarray:
    data = " ".join(dict.fromkeys(STOP_WORDS)).encode()
    return np.sort(Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)])).word_hashes())


def statistics(texts: Texts) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    words, stops = texts.word_hashes(), _stop_hashes()
    is_stop = stops[np.minimum(np.searchsorted(stops, words), len(stops) - 1)] == words
    length = texts.end - texts.start
    pairs = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) else words
    out = np.zeros((len(texts), len(FEATURES)))
    for i, (a, b, p, q) in enumerate(zip(texts.first_word[:-1], texts.first_word[1:], texts.bounds[:-1], texts.bounds[1:], strict=True)):
        if a == b:
            continue
        n, size, own = b - a, q - p, words[a:b]
        counts = np.bincount(texts.data[p:q], minlength=256) @ _OF_CLASS
        _, times = np.unique(own, return_counts=True)
        lines = [x for x in texts.data[p:q].tobytes().split(b"\n") if x.strip()]
        letters = counts[0] + counts[1]
        out[i] = [
            np.log1p(n), length[a:b].mean(), np.log1p(size), *(counts / size), counts[0] / max(letters, 1), is_stop[a:b].mean(), len(times) / n,
            len(np.unique(pairs[a : b - 1])) / max(n - 1, 1), (own[1:] == own[:-1]).sum() / n, times.max() / n, 1 - len(set(lines)) / len(lines), n / len(lines), (length[a:b] > 20).mean(),
        ]
    return out


@dataclass
class Forest:
    """``feature`` and ``threshold`` by (tree, inner node), ``leaf`` by (tree, leaf); node k has children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        for _ in range(int(np.log2(self.leaf.shape[1])) if len(self.feature) else 0):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        raw = self.base + (self.leaf[tree, node - self.feature.shape[1]].sum(axis=1) if len(self.feature) else 0)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40) * np.ones(len(x))))


def fitted(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosts logistic loss; splits are searched over at most ``BINS`` quantile bins of each feature."""
    share = y.mean() if len(y) else 0.5
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if len(y) == 0 or share in (0.0, 1.0):
        trees = 0
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T] if trees else []
    binned = [np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)] if trees else []
    inner = 2**depth - 1
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            for f, (e, c) in enumerate(zip(edges, binned, strict=True)):
                if not len(e):
                    continue
                cell, n = at * (len(e) + 1) + c, width * (len(e) + 1)
                gs, hs = (np.bincount(cell, v, n).reshape(width, -1) for v in (g, h))
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + SMOOTH) + (ga - gl) ** 2 / (ha - hl + SMOOTH) - ga**2 / (ha + SMOOTH)
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                forest.feature[t, first : first + width][better] = f
                forest.threshold[t, first : first + width][better] = e[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), forest.feature[t, node]] > forest.threshold[t, node])
        node -= inner
        forest.leaf[t] = RATE * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + SMOOTH)
        raw += forest.leaf[t, node]
    return forest


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32(doc_id as text) mod 4 says that a row's label is for testing only; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, texts in slices(batch.column("text")):
            rows = pa.array(list(statistics(texts)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(a, b - a), rows], names=["quality", "x"])


def trained(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """The forest fitted on at most ``rows`` labelled documents that aren't held out."""
    usable = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    once = chosen.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = once.select("quality", "text").mapInArrow(_statistics, "quality int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(got.column("quality").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same forest, however the rows arrive
    return fitted(x[order], (y[order] > 0).astype(float))


def scored(documents: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """``documents`` with all columns and the chance that a text's quality label is 1, in place of any column ``name``."""
    documents = documents.drop(name)
    names, text = documents.columns, free_name(documents, "scored_text")
    where = documents.sparkSession.sparkContext.broadcast(forest)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in slices(batch.column(len(names))):
                part = batch.slice(a, b - a)
                score = pa.array(where.value.score(statistics(texts)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], score], names=[*names, name])

    fields = documents.select(*quoted(documents.columns), F.lit(0.0).alias(name)).schema
    # numbered names on the way in, as any name may come
    whole = documents.select("*", F.col("text").cast("string").alias(text))
    return whole.toDF(*[f"c{k}" for k in range(len(names) + 1)]).mapInArrow(walk, fields)


def score_digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, score, predicted."""
    forest = trained(documents, labels)
    out = scored(documents.select("doc_id", "text"), forest)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score reaches ``THRESHOLD``, with their own columns."""
    name = free_name(documents, "quality_score")
    out = scored(documents, trained(documents, labels), name)
    return out.where(F.col(name) >= THRESHOLD).select(*quoted(documents.columns))
