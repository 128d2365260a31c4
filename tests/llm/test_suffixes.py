"""Removal of repeated passages against its definition: every string of the length, from everywhere."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import suffix_dedup

SCHEMA = "doc_id long, text string"


def removed(rows, length=suffix_dedup.LENGTH):
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = {}
    for _, b in texts:
        for p in range(len(b) - length + 1):
            times[b[p : p + length]] = times.get(b[p : p + length], 0) + 1
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if times[b[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def digest(df, **more):
    return sorted((tuple(r)[:5] for r in suffix_dedup.repeated_spans(df, **more).collect()), key=repr)


def some_rows():
    r = random.Random(2)
    words = ["ab", "c\u00e9", "x", "yz ", "\n", "q"]
    base = ["".join(r.choice(words) for _ in range(400)) for _ in range(6)]
    rows = []
    for k in range(120):
        text = ""
        for _ in range(r.choice([0, 1, 3, 6])):
            b = r.choice(base)
            a = r.randrange(len(b))
            text += b[a : a + r.randrange(1, 300)] + "".join(r.choice(words) for _ in range(r.randrange(30)))
        rows.append((r.choice([None, k, k]), text))
    return rows + [(1, None), (2, ""), (3, "a" * 5000), (4, "ab" * 3000), (5, "z" * 199), (6, "z" * 200), (7, base[0]), (7, base[0]), (8, base[0]), (9, "\0" * 700 + "k" * 50), (10, "\0" * 300)]


@pytest.mark.parametrize("more", [{}, {"hot": 3}, {"together": 5}, {"length": 40, "gram": 8}])
def test_spans_equal_brute_force(spark, more):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sha", F.lit("a column")).withColumn("a.b", F.lit(1))
    assert digest(df, **more) == removed(rows, more.get("length", suffix_dedup.LENGTH))


def test_given_tables_and_none(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert digest(df) == removed([tuple(r) for r in df.collect()])
    assert suffix_dedup.suffix_digest(df.limit(0)).count() == 0


def test_a_long_text_and_a_passage_in_every_document(spark):
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage = noise(450)
    rows = [(k, noise(r.randrange(80)) + passage + noise(r.randrange(80))) for k in range(300)] + [(500, noise(700_000) + passage + noise(60)), (501, noise(900))]
    out = {d: x for d, *x in digest(spark.createDataFrame(rows, SCHEMA))}
    want = {d: x for d, *x in removed(rows)}
    assert out == want and out[501][1] == 0 and all(out[k][1] >= 450 for k in range(300))


def test_anchors_cover_every_string_once():
    r = np.random.default_rng(1)
    for letters in (2, 26):
        texts = [r.integers(97, 97 + letters, n, dtype=np.uint8) for n in (0, 199, 200, 201, 5000, 200, 0, 900)]
        bounds = np.cumsum([0] + [len(t) for t in texts])
        text, _, place, lo, hi = suffix_dedup.anchors(np.concatenate(texts), bounds)
        found = sorted((int(t), p) for t, a, x, y in zip(text, place, lo, hi, strict=True) for p in range(a - y, a - x + 1))
        assert found == [(t, p) for t, b in enumerate(texts) for p in range(len(b) - 199)]


def test_kept_texts_hash_as_told(spark):
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(some_rows())], SCHEMA)
    spans = suffix_dedup.repeated_spans(df)
    kept = suffix_dedup.kept_texts(df, spans).join(spans.select("doc_id", "kept_sha256"), "doc_id").collect()
    assert len(kept) == df.count() and all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept)


def test_refinement_sorts_suffixes():
    r = np.random.default_rng(3)
    words = r.integers(0, 3, (500, 21)).astype(np.uint64)
    bucket = r.integers(0, 4, 500)
    order, _ = suffix_dedup.refined(words, bucket)
    keys = [(bucket[k], *words[k]) for k in order]
    assert keys == sorted(keys)
