"""Cases that the first tests missed: hostile and very long texts, repeated rows, clashing names, large values, independent versions."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import common, exact_topk, language_evidence, mixing, packing, pseudonyms, quality_trees, sharding
from lacuna.llm.textbatch import Texts

DOCS = "doc_id long, text string, source string"


def test_hostile_texts_keep_pseudonyms_quick(spark):
    hostile = ["x@" + "a." * 100_000 + "1", "1-" * 100_000, "a@b" * 100_000, "+2 " * 100_000, "DE89 " + "1234 " * 100_000, "1.2." * 100_000, "password=" + "a" * 300_000, "1:" * 100_000]
    begin = time.time()
    out = pseudonyms.pseudonymised(spark.createDataFrame(list(enumerate(hostile)), "doc_id long, text string"), "k", count="n").collect()
    assert [r.n for r in out] == [0, 0, 0, 0, 0, 0, 1, 0] and all(len(r.text) == len(t) for r, t in zip(out, hostile, strict=True))
    assert time.time() - begin < 120


def test_hostile_pages_keep_language_evidence_quick(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hostile = ["<" * 1_000_000, "<a" * 300_000, "<html" * 100_000, "<meta content-language" * 30_000, "<script" * 100_000, "<!--" * 100_000, "</script " * 100_000]
    rows = [(k, "http://" + "a" * 50_000 + "/", h) for k, h in enumerate(hostile)]
    begin = time.time()
    out = language_evidence.identified(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()
    assert len(out) == len(hostile) and time.time() - begin < 90


def feistel(key, kind, a, b, m, n):
    """The permutation of pairs, from its definition."""
    for r in range(8):
        f = int(hashlib.sha256(f"{key}|{kind}|{r}|{b}".encode()).hexdigest()[:12], 16)
        a, b, m, n = b, (a + f) % m, n, m
    return a, b


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mod97(iban):
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def test_pseudonyms_equal_an_independent_version(spark):
    r = random.Random(4)
    day = lambda: date(1800, 1, 1) + timedelta(r.randrange(189 * 773))
    rows, want = [], []
    for k in range(60):
        ip = [r.randrange(256) for _ in range(4)]
        d, e = day(), day()
        a, b = feistel("K", "ip", ip[0] * 256 + ip[1], ip[2] * 256 + ip[3], 65536, 65536)
        moved = []
        for x in (d, e):
            x = (x - date(1800, 1, 1)).days
            p, q = feistel("K", "date", x // 773, x % 773, 189, 773)
            moved.append(date(1800, 1, 1) + timedelta(p * 773 + q))
        area, exchange, line = r.randrange(200, 1000), r.randrange(200, 1000), r.randrange(10000)
        p, q = feistel("K", "phone", (area - 200) * 800 + exchange - 200, line, 640000, 10000)
        rows.append((k, f"{'.'.join(map(str, ip))} and {d} or {e:%d.%m.%Y}, tel {area}-{exchange}-{line:04d}"))
        want.append(f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255} and {moved[0]} or {moved[1]:%d.%m.%Y}, tel {p // 800 + 200}-{p % 800 + 200}-{q:04d}")
    out = pseudonyms.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "K", count="n").orderBy("doc_id").collect()
    assert [x.text for x in out] == want and {x.n for x in out} == {4}


def test_numbers_stay_valid_linked_and_apart(spark):
    r = random.Random(5)
    cards, ibans = [], []
    while len(cards) < 40:
        c = str(r.randrange(10**15, 10**16))
        if luhn(c):
            cards.append(c)
    for _ in range(40):
        rest = "".join(r.choice("0123456789") for _ in range(18))
        ibans.append(f"DE{98 - int(rest + '131400') % 97:02d}{rest}")
    ibans += ["GB82WEST12345698765432", "FR1420041010050500013M02606"]
    phones = [f"+44 20 {r.randrange(10**8):08d}" for _ in range(40)]
    values = cards + ibans + phones
    rows = [(k, f"a {v} b") for k, v in enumerate(values)] + [(k, f"again {v}, twice {v}") for k, v in enumerate(values)]
    rows += [(900, "GB82 WEST 1234 5698 7654 32"), (901, "GB82 WEST 1234 5698 7654 33 is wrong")]
    out = pseudonyms.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string"), "K").collect()
    once = {x.doc_id: x.text[2:-2] for x in out[: len(values)]}
    for x in out[len(values) : -2]:
        assert x.text == f"again {once[x.doc_id]}, twice {once[x.doc_id]}"
    got = [once[k] for k in range(len(values))]
    assert len(set(got)) == len(values) and all(a != b and len(a) == len(b) for a, b in zip(got, values, strict=True))
    assert all(luhn(c) and c[0] == v[0] for c, v in zip(got[:40], values[:40], strict=True))
    assert all(mod97(i) == 1 and i[:2] == v[:2] for i, v in zip(got[40:82], values[40:82], strict=True)) and "WEST" in got[80]
    assert all(p.startswith("+44 ") and re.fullmatch(r"\+44 \d\d \d{8}", p) for p in got[82:])
    assert out[-2].text.replace(" ", "") == got[80] and out[-1].text == "GB82 WEST 1234 5698 7654 33 is wrong"


def test_key_comes_from_the_session(spark):
    docs = spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string")
    plain = pseudonyms.pii_report(docs).first()
    spark.conf.set(pseudonyms.KEY_SETTING, "other")
    try:
        assert pseudonyms.pii_report(docs).first().text not in (plain.text, "4111111111111111")
    finally:
        spark.conf.unset(pseudonyms.KEY_SETTING)


def test_large_components_saturate(spark):
    data = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [3.0, 4.0]), (3, [1e30, 5.0]), (4, [1e308, 1.0]), (5, [1e200, 1e200]), (6, [-3.0, 4.0]), (50, [1.0, 1.0]), (50, [-1.0, 1.0])]
    vectors = exact_topk.integers(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    out = exact_topk.top_k(vectors.where("id % 50 = 0"), vectors).collect()
    top, low = 2**63 - 1, -(2**63)
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in data if all(math.isfinite(256 * x) for x in v)]
    want = Counter()
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-max(low, min(top, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in usable if i != q)[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert Counter((x.query_id, x["rank"], x.vec_id, x.score) for x in out) == want


def test_one_large_vector_does_not_change_the_search():
    r = np.random.default_rng(1)
    small = np.floor(r.normal(size=(400, 48)) * 256)
    both = np.concatenate([small, [[2.0**90] * 48]])
    plain = exact_topk.best_of_cell(small[:5], np.arange(5), small, np.arange(400))
    mixed = exact_topk.best_of_cell(both[:5], np.arange(5), both, np.arange(401))
    assert [x for x in mixed if x[1] != 400 and x in plain] == [x for x in plain if x in mixed] and len(mixed) == 25
    for row in range(5):
        scores = [(-max(-(2**63), min(2**63 - 1, int(sum(int(a) * int(b) for a, b in zip(both[row], c, strict=True))))), i) for i, c in enumerate(both) if i != row]
        assert [(i, -s) for s, i in sorted(scores)[:5]] == [(i, s) for q, i, s in mixed if q == row]


def test_mix_is_pareto_sampling_with_unequal_odds(spark):
    r = random.Random(3)
    sizes = {i: r.choice((0, 20, 100, 700)) for i in range(3000)}
    rows = [(i, " ".join(["w"] * n), "a" if i < 1500 else "b") for i, n in sizes.items()]
    out = {x.doc_id: x for x in mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()}
    odds = {i: 4 if n >= 500 else 2 if n >= 50 else 1 for i, n in sizes.items()}
    u = {i: int(hashlib.md5(f"{mixing.SEED}|{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in sizes}
    for s in "ab":
        own = [i for i in sizes if rows[i][2] == s]
        target = sum(sizes.values()) * (1 if s == "a" else 2) / 3
        low, high = 0.0, 100.0  # the level, by bisection
        for _ in range(200):
            level = (low + high) / 2
            low, high = (level, high) if sum(min(3, level * odds[i]) * sizes[i] for i in own) < target else (low, level)
        times = {i: min(3, level * odds[i]) for i in own}
        copies = {i: int(times[i]) for i in own}
        room = target - sum(copies[i] * sizes[i] for i in own)
        chance = {i: times[i] - copies[i] for i in own if times[i] < 3}
        before = 0
        for i in sorted(chance, key=lambda i: u[i] / (1 - u[i]) / (chance[i] / (1 - chance[i]))):
            copies[i] += before + sizes[i] / 2 <= room
            before += sizes[i]
        assert {i: out[i].copies for i in own} == copies
        assert {odds[i] for i in own if copies[i] < 2} == {1, 2, 4} or s == "b"
        assert all(out[i].odds == odds[i] and math.isclose(out[i].target, target) for i in own)


def test_mix_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c", "s", 7, 0)] * 3 + [(2, "a b c", "s", 7, 0)] + [(i, "w " * 30, "t", 7, 0) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, text_hash int")
    copies = Counter()
    for x in mixing.mixed(docs).collect():
        copies[x.doc_id] += x.copies
    out = mixing.mix(docs)
    assert out.columns == docs.columns and Counter(x.doc_id for x in out.collect()) == +copies


def test_numbered_rows(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 800, 1).otherwise(F.col("id")).alias("k"), "id").repartition(7)
    out = common.numbered(rows, ["k"], "n").collect()
    assert sorted(x.n for x in out if x.k == 1) == list(range(800)) and {x.n for x in out if x.k != 1} == {0} and len(out) == 1000


@pytest.mark.parametrize("most", [10**9, 0])
def test_looked_up_joins_nulls_and_hot_keys(spark, most):
    rows = spark.createDataFrame([(None, i) for i in range(5)] + [(1, i) for i in range(50)] + [(2, 0), (9, 0)], "k int, v int")
    table = spark.createDataFrame([(None, "n"), (1, "one"), (2, "two")], "k int, name string")
    assert Counter(x.name for x in common.looked_up(rows, table, ["k"], most=most).collect()) == {"n": 5, "one": 50, "two": 1}
    assert common.looked_up(rows, table, ["k"], "left", most).where("name is null").count() == 1
    assert common.looked_up(rows, table.select("k"), ["k"], "left_semi", most).columns == ["k", "v"]


def test_packing_deals_rows_that_are_all_alike(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("batch"))
    out = packing.packed(docs, batch=200).withColumn("b", F.shiftright("bin", 24)).groupBy("b").count().collect()
    assert sum(x["count"] for x in out) == 3000 and max(x["count"] for x in out) < 400


def shards_of(rows, shards):
    """The rows law from its definition: seeded shuffle within each source, fractional ranks, cut into equal counts."""
    u = lambda *parts: int(hashlib.md5("|".join([sharding.SEED, *map(str, parts)]).encode()).hexdigest()[:13], 16) / 2**52
    crc = {i: zlib.crc32((t or "").encode()) for i, t, _ in rows}
    by_source: dict = {}
    for i, _, s in rows:
        by_source.setdefault(s, []).append((u(i, crc[i]), i))
    line = []
    for s, members in by_source.items():
        turn = u(s if s is not None else "\0")
        line += [((rank + turn) / len(members), turn, i) for rank, (_, i) in enumerate(sorted(members))]
    n = len(rows)
    out = {}
    for place, (_, _, i) in enumerate(sorted(line)):
        shard = place * shards // n
        out[i] = (shard, place - -(-shard * n // shards))
    return out


def test_shards_equal_brute_force(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, r.choice((None, "", f"text {i}", "same text é")), r.choice(("hot", "hot", "b", None, f"s{i % 9}"))) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: (x.shard, x.slot) for x in sharding.placed(docs, 7).collect()}
    assert got == shards_of(rows, 7)
    again = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 3")).withColumn("crc", F.lit(1))
    sharding.write_shards(again, str(tmp_path / "out"), 7)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(x.doc_id for x in back.collect()) == Counter([i for i, *_ in rows] + [3, 3])
    assert back.groupBy("shard", "slot").count().where("count > 1").count() == 0 and set(back.columns) == {"doc_id", "text", "source", "crc", "shard", "slot"}


def test_statistics_equal_plain_counts():
    texts = ["The cat sat. The cat, 12 DOGS!\nThe cat sat.\n\nA very-long-word-beyond-twenty-bytes é (x) | #", "", "a", "b b b b"]
    raw = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    rows = quality_trees.statistics(Texts(np.frombuffer(b"".join(raw), np.uint8), bounds))
    for text, data, row in zip(texts, raw, rows, strict=True):
        got = dict(zip(quality_trees.FEATURES, row, strict=True))
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        if not w:
            assert not row.any()
            continue
        low = [x.lower() if x.isascii() else x for x in w]
        lines = [x for x in text.split("\n") if x.strip()]
        count = lambda f: sum(map(f, data)) / len(data)
        upper, lower = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
        want = {
            "log_words": math.log1p(len(w)), "mean_word_bytes": sum(len(x.encode()) for x in w) / len(w), "log_bytes": math.log1p(len(data)), "upper_share": upper / len(data), "lower_share": lower / len(data),
            "digit_share": count(lambda c: 48 <= c <= 57), "wide_share": count(lambda c: c > 127), "line_share": count(lambda c: c == 10), "upper_of_letters": upper / max(upper + lower, 1),
            "stop_word_share": sum(x in quality_trees.STOP_WORDS for x in low) / len(w), "distinct_share": len(set(low)) / len(w), "distinct_pair_share": len(set(zip(low, low[1:], strict=False))) / max(len(w) - 1, 1),
            "repeat_share": sum(a == b for a, b in zip(low, low[1:], strict=False)) / len(w), "top_word_share": max(Counter(low).values()) / len(w), "equal_line_share": 1 - len(set(lines)) / len(lines),
            "words_a_line": len(w) / len(lines), "long_word_share": sum(len(x.encode()) > 20 for x in w) / len(w),
        }
        assert {k: round(got[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}


def test_first_split_is_the_best_one():
    r = np.random.default_rng(2)
    x, y = r.normal(size=(300, 3)), None
    y = (x[:, 1] + 0.3 * r.normal(size=300) > 0.2).astype(float)
    forest = quality_trees.fitted(x, y, trees=1, depth=1)
    g, h = y - y.mean(), np.full(300, y.mean() * (1 - y.mean()))
    best = max(
        (sum(g[s].sum() ** 2 / (h[s].sum() + quality_trees.SMOOTH) for s in (x[:, f] <= e, x[:, f] > e)), f, e)
        for f in range(3)
        for e in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality_trees.BINS)[1:-1]))
    )
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == best[1:]
    for k, s in enumerate((x[:, best[1]] <= best[2], x[:, best[1]] > best[2])):
        assert math.isclose(forest.leaf[0, k], quality_trees.RATE * g[s].sum() / (h[s].sum() + quality_trees.SMOOTH))


def test_training_rows_are_bounded_and_repeat(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one = quality_trees.trained(docs, labels, 60)
    two = quality_trees.trained(docs.unionByName(docs).repartition(5), labels, 60)
    assert np.array_equal(one.threshold, two.threshold) and np.array_equal(one.leaf, two.leaf)
    clash = docs.select("doc_id", "text", F.lit(1).alias("scored_text"), F.lit(2).alias("_scored_text"))
    assert quality_trees.scored(clash, one).columns == ["doc_id", "text", "scored_text", "_scored_text", "score"]


def test_language_of_texts_not_trained_on(spark, sf):
    """Text evidence alone: pages without address or declaration, made of documents that the sample leaves out."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").where("text is not null and lang is not null")
    ranked = docs.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").limit(500)
    rest = docs.join(ranked, "doc_id", "left_anti").where(F.length("text") > 200)
    pages = rest.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    out = language_evidence.identified(pages, docs, 500).join(docs.select(F.col("doc_id").alias("page_id"), "lang"), "page_id")
    right, total = out.where("text_language = lang").count(), out.count()
    assert total > 200 and right >= 0.97 * total


def test_large_families_of_several_components(spark, monkeypatch):
    """Blocks of 8: two chains of near copies, strays that are near in signature only, and a family in one star."""
    from lacuna.llm import minhash_dedup

    r = random.Random(11)
    word = lambda: f"v{r.randrange(9000)}"
    rows, base = [], [word() for _ in range(120)]
    for k in range(2):
        own = list(base) if k == 0 else base[:70] + [word() for _ in range(50)]
        for i in range(40):
            own[r.randrange(120)] = f"x{k}_{i}"
            rows.append(" ".join(own))
    rows += [" ".join(base[:60] + [word() for _ in range(60)]) for _ in range(20)]
    star = [word() for _ in range(200)]
    rows += [" ".join(star[:i] + ["y%d" % i] + star[i + 1 :]) for i in range(50)]
    r.shuffle(rows)
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    monkeypatch.setattr(minhash_dedup, "REPRESENTATIVES", 2)
    out = minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in out} == {i: find(i) for i in range(len(rows))}
    assert 3 < len({x.component_id for x in out}) < len(rows)


def test_recall_of_candidates_near_the_threshold():
    """Pairs at a similarity of 0.75 to 0.8 have enough matches."""
    from lacuna.llm import minhash_dedup

    r = np.random.default_rng(7)
    missed = total = 0
    for _ in range(2000):
        n = int(r.integers(60, 400))
        union = r.integers(1, 2**63, n, dtype=np.uint64)
        common = int(np.ceil(n * r.uniform(0.75, 0.8)))
        cut = common + (n - common) // 2
        a, b = minhash_dedup.signatures([union[:cut], np.concatenate([union[:common], union[cut:]])])
        missed, total = missed + ((a == b).sum() < minhash_dedup.MATCHES), total + 1
    assert missed <= 1
