"""Cases that the tests before missed: bins of short texts, country codes, written dates, addresses alike in form, words behind colons."""

import math
import re
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm import common, exact_topk, language_evidence, mixing, packing, pseudonyms, sharding


@pytest.mark.parametrize("sources", [1, 2, 3, 12])
def test_short_texts_fill_their_bins(spark, sources):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c d "), F.col("id").cast("string")).alias("text"), F.concat(F.lit("s"), (F.col("id") % sources).cast("string")).alias("source"))
    out = packing.packed(docs).collect()
    bins = {r.bin for r in out}
    assert len(out) == 8000 and sum(r.n_words for r in out) / (packing.CAPACITY * len(bins)) >= 0.95


def test_packing_of_the_query_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = packing.packed(docs, batch=100).collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    cut = defaultdict(list)
    for r in out:
        cut[r.doc_id].append((r.piece, r.start_word, r.n_words))
    for i, n in words.items():  # each text is cut into pieces of the capacity and a rest
        assert sorted(cut[i]) == [(k, a, min(packing.CAPACITY, n - a)) for k, a in enumerate(range(0, max(n, 1), packing.CAPACITY))]
    batches = defaultdict(list)
    for r in out:
        batches[r.bin >> 24].append(r)
    for held in batches.values():
        held.sort(key=lambda r: (-r.n_words, r.doc_id, r.piece))
        total, by = sum(r.n_words for r in held), Counter()
        for r in held:
            by[r.source] += r.n_words
        often = Counter(r.cluster for r in held if r.cluster is not None)
        bins: dict = {}
        for r in held:
            closed = lambda b, s=r.source: s is not None and sum(x.n_words for x in b if x.source == s) >= packing.CAPACITY * min(1, max(0.5, 2 * by[s] / total))
            room = lambda b: packing.CAPACITY - sum(x.n_words for x in b)
            fits = [room(b) for b in bins.values() if room(b) >= r.n_words and not closed(b) and not (r.cluster is not None and often[r.cluster] > 1 and any(x.cluster == r.cluster for x in b))]
            if r.bin not in bins:
                assert not fits
                bins[r.bin] = []
            else:
                assert fits and room(bins[r.bin]) == min(fits)
            assert r.offset == sum(x.n_words for x in bins[r.bin])
            bins[r.bin].append(r)


def renamed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pseudonyms.pseudonymised(rows, "K").orderBy("doc_id").collect()]


def test_country_codes_and_trunk_zeros_stay(spark):
    numbers = ["+351 912 345 678", "+353 1 234 5678", "+971 50 123 4567", "+7 495 123-45-67", "+49 30 1234567", "+44 (0)20 7946 0958", "+420 601 123 456"]
    out = renamed(spark, numbers)
    shape = lambda s: re.sub("[0-9]", "9", s)
    assert [shape(a) for a in out] == [shape(b) for b in numbers] and all(a != b for a, b in zip(out, numbers, strict=True))
    for a, code in zip(out, ("+351 ", "+353 ", "+971 ", "+7 ", "+49 ", "+44 (0)", "+420 "), strict=True):
        assert a.startswith(code)


def test_addresses_of_equal_form_stay_apart(spark):
    names = [f"{a}@x.com" for a in "abcdefghijklmnopqrstuvwxyz0123456789"] + [f"{a}{b}.{c}9@mail.example.org" for a in "abcdef" for b in "xyz" for c in "pqr"] + [f"a@{h}.com" for h in "xyzuvw"]
    out = renamed(spark, names)
    assert len(set(out)) == len(set(names))
    form = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", s))
    assert [form(a) for a in out] == [form(b) for b in names] and sum(a == b for a, b in zip(out, names, strict=True)) <= 4
    assert renamed(spark, ["Ann@X.com", "ann@x.com"])[0] == renamed(spark, ["ann@x.com"])[0]
    long = "a" * 300 + "@" + "b" * 300 + ".com"
    assert form(renamed(spark, [long])[0]) == form(long)


def test_prose_behind_a_colon_stays(spark):
    prose = ["the token: information is lost", "Secret: everything is fine", "password: Something"]
    assert renamed(spark, prose) == prose
    secrets = ['token: "abcdefghij"', "password: hunter2abc", "api_key: abcDefghij", "pwd=abcdefghij", "token = abcdefgh1"]
    assert all(a != b and len(a) == len(b) for a, b in zip(renamed(spark, secrets), secrets, strict=True))


def moved(spark, day):
    return renamed(spark, [str(day)])[0]


def test_written_dates_move_like_plain_ones(spark):
    for day in (date(2024, 3, 5), date(1999, 12, 31)):
        new = date.fromisoformat(moved(spark, day))
        texts = [f"{day}T10:00:00Z", f"{day.day} {day:%B} {day.year}", f"{day:%B} {day.day}, {day.year}", f"on {day.day}.{day.month}.{day.year}."]
        assert renamed(spark, texts) == [f"{new}T10:00:00Z", f"{new.day} {new:%B} {new.year}", f"{new:%B} {new.day}, {new.year}", f"on {new.day:02d}.{new.month:02d}.{new.year}." if day.day > 9 and day.month > 9 else f"on {new.day}.{new.month}.{new.year}."]
    assert renamed(spark, ["30 February 2024", "45.1.2024", "March 2024"]) == ["30 February 2024", "45.1.2024", "March 2024"]


def test_dates_of_other_centuries_move_apart(spark):
    days = [date(1799, 12, 31), date(2200, 1, 1), date(1492, 10, 12), date(9799, 1, 1), date(200, 1, 1)] + [date(1700, 1, 1) + timedelta(k) for k in range(40)]
    out = renamed(spark, [str(d) for d in days])
    assert len(set(out)) == len(days) and all(a != str(d) for a, d in zip(out, days, strict=True))
    cycle = lambda year: (year - 1800) // 400
    assert all(cycle(date.fromisoformat(a).year) == cycle(d.year) for a, d in zip(out, days, strict=True))
    assert renamed(spark, ["0199-12-31", "9800-01-01"]) == ["0199-12-31", "9800-01-01"]


def test_fused_evidence_by_plain_sums(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    strays = [(10_000 + k, None if k % 2 else "", f"<p>{t}</p>") for k, t in enumerate(["der", "the", "", "le la les", "und die", "of and to"])] + [(20_000, "http://localhost/x", "<p>und</p>"), (20_001, None, None)]
    pages = pages.unionByName(spark.createDataFrame(strays, "page_id long, url string, html string"))
    langs, table = language_evidence._trained(docs, 300)
    out = language_evidence.identified(pages, docs, 300).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    n, smooth = len(langs), language_evidence.SMOOTHING
    own, keys = {}, {}
    for r in out:
        counts = np.array(language_evidence.trigrams(language_evidence._HIDDEN.sub(b" ", (html[r.page_id] or "").encode())), float)
        score = table @ counts / language_evidence.DAMPING
        for said, trust in ((r.declared, language_evidence.TRUST_MARKUP), (r.address, language_evidence.TRUST_ADDRESS)):
            if said in langs:
                score += [math.log(trust if x == said else (1 - trust) / (n - 1)) for x in langs]
        score = np.exp(score - score.max())
        own[r.page_id] = score / score.sum()
        host = re.match(r"[a-z]+://([^/:?#]+)", r.url or "")
        host = host[1].lower() if host else ""
        parts = host.split(".")
        cut = 3 if len(parts) > 2 and parts[-2] in ("co", "com", "org", "ac", "gov") else 2
        keys[r.page_id] = [("all",), ("suffix", parts[-1]), ("domain", ".".join(parts[-cut:]) if len(parts) > 1 else ""), ("host", host)]
    sums = defaultdict(lambda: np.zeros(n))
    for i, x in own.items():
        for k in keys[i]:
            sums[k] += x
    for r in out:
        prior = np.full(n, 1 / n)
        for k in keys[r.page_id]:
            if k[-1] != "":
                without = np.maximum(sums[k] - own[r.page_id], 0)
                prior = (without + smooth * prior) / (without.sum() + smooth)
        want = own[r.page_id] * prior
        assert math.isclose(r.confidence, want.max() / want.sum(), rel_tol=1e-3), r
        if np.sort(want)[-1] > 1.01 * np.sort(want)[-2]:
            assert r.language == langs[int(want.argmax())]
    alone = {r.page_id: r for r in out}
    assert alone[10_002].confidence < 0.9 and alone[20_001].confidence < 0.9


def most_in_a_bucket(monkeypatch, module):
    """Takes down how many rows the fullest bucket of each running sum has."""
    found = []
    plain = common.running

    def watched(df, group, unit, ties, sums, rows, bucket_rows=500):
        cell = F.floor(F.col(unit) * max(1, -(-rows // bucket_rows)))
        found.append(df.groupBy(*[F.col(g) for g in group], cell.alias("cell")).count().agg(F.max("count")).first()[0])
        return plain(df, group, unit, ties, sums, rows, bucket_rows)

    monkeypatch.setattr(module, "running", watched)
    return found


def test_rows_without_an_id_or_of_one_id_share_no_bucket(spark, monkeypatch):
    ids = F.when(F.col("id") % 4 == 0, F.col("id")).when(F.col("id") % 4 == 1, F.lit(7))
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("a b "), F.col("id").cast("string"))).otherwise(F.lit("one two three"))
    docs = common.saved(spark.range(20_000).select(ids.alias("doc_id"), text.alias("text"), F.lit("s").alias("source")))
    found = most_in_a_bucket(monkeypatch, mixing)
    mix = mixing.mixed(docs, seed="x")
    assert mix.count() == 20_000 and max(found) < 1500
    found = most_in_a_bucket(monkeypatch, sharding)
    assert sorted(r.slot + 500 * r.shard for r in sharding.placed(docs).collect()) == list(range(20_000)) and max(found) < 1500
    # the numbers as a whole don't follow from where the rows lie
    turned = common.saved(docs.orderBy(F.desc("text"), F.xxhash64("doc_id")).repartition(3))
    totals = [sorted(Counter((r.doc_id, r.text_hash, r.copies) for r in x.collect()).items(), key=str) for x in (mix, mixing.mixed(turned, seed="x"))]
    assert totals[0] == totals[1]


def test_search_deals_rows_of_one_id(spark):
    rng = np.random.default_rng(5)
    rows = [(1 if k % 2 else k, [float(x) for x in rng.integers(-9, 9, 4)]) for k in range(400)]
    candidates = spark.createDataFrame(rows, "id long, v array<double>")
    out = exact_topk.top_k(candidates.where("id < 40"), candidates, cell_queries=7, cell_candidates=30).collect()
    expected = Counter()
    for q, v in {(i, tuple(v)) for i, v in rows if i < 40}:
        best = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q)[:5]
        expected.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter(map(tuple, out)) == expected


def test_large_shards_are_written_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_BYTES", 1000)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"), F.lit(1).alias("a.b"))
    sharding.write_shards(docs, str(tmp_path / "out"), shards=2)
    for k in range(2):
        files = sorted((tmp_path / "out" / f"shard={k}").glob("*.parquet"))
        slots = [s for f in files for s in spark.read.parquet(str(f)).toPandas()["slot"].tolist()]
        assert len(files) > 1 and slots == list(range(150))


def test_pipeline_of_columns_with_dots_and_clashing_names(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.select("*", (F.col("doc_id") * 2).alias("a.b"), F.lit("x").alias("key"), F.lit(3).alias("copies"), F.lit("`").alias("tick`s"))
    more.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    kept = more
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.saved(stage(spark, kept, str(tmp_path)))
        assert kept.columns == more.columns
        assert not kept.where("`a.b` <> 2 * doc_id or key <> 'x' or copies <> 3").count()
    rows = lambda df: sorted(tuple(r[c] for c in ("doc_id", "piece", "n_words", "source")) for r in df.collect())
    assert rows(corpus_pipeline.packing(spark, kept, str(tmp_path))) == rows(corpus_pipeline.run(spark, sf))
