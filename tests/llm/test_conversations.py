"""The conversation operators against brute force: every repair by dynamic programming over places, every trie by its definition."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lacuna.llm import conversation_repair, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = "\x20\x09-\x0d"


def damage(rows):
    out = {}
    for c, t, r, x in rows:
        turns = out.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        turns += [(t, "user" if fault == 4 else r, x)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: sorted(v, key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2])) for c, v in out.items()}


def repair(turns):
    """The contract's row for the turns of one conversation, in order."""
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    seen, faults = set(), []
    for _, r, x in turns:
        chars = re.findall(f"[^{BLANK}]", x)
        faults.append("blank" if not chars else "duplicate" if (r, x) in seen else "truncated" if chars[-1] not in ".!?" else "")
        seen.add((r, x))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))

    def inserting(best):
        for _ in range(3):
            for a, b, role in (("E", "U", "user"), ("S", "U", "user"), ("A", "U", "user"), ("U", "A", "assistant")):
                if a in best:
                    way = (best[a][0] + 5, best[a][1] + "I", best[a][2] + ((role, ""),))
                    best[b] = min(best.get(b, way), way, key=lambda w: w[:2])
        return best

    best = inserting({"E": (0, "", ())})
    for (_, r, x), fault in zip(turns, faults, strict=True):
        new = {}
        for place, (cost, audit, made) in best.items():
            options = [(place, (cost + 2, audit + "D", made))]
            for symbol in {"E": "su", "S": "u", "U": "a", "A": "u"}[place] if fault not in ("blank", "duplicate") else "":
                more = 5 * (fault == "truncated")
                if r[:1] == symbol:
                    options.append((symbol.upper(), (cost + more, audit + "K", made + ((r, x),))))
                if symbol in "ua":
                    options.append((symbol.upper(), (cost + 1 + more, audit + "R", made + (({"u": "user", "a": "assistant"}[symbol], x),))))
            for to, way in options:
                new[to] = min(new.get(to, way), way, key=lambda w: w[:2])
        best = inserting(new)
    cost, audit, made = min(best[k] for k in "EA" if k in best)
    text = "\n".join(f"{r}:{x}" for r, x in made)
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), made


def some_conversations(seed, sizes=(0, 1, 3, 9, 40)):
    r = random.Random(seed)
    rows = []
    for c in [None, *range(40)]:
        for _ in range(r.choice(sizes)):
            rows.append((c, r.choice([None, *range(8)]), r.choice([None, "user", "assistant", "system", "tool", "", "u", "User"]), r.choice([None, "", " ", "a.", "b!", "c", "d?  \n", "é.", "\x0b"])))
    return rows


@pytest.mark.parametrize("segment", [1, 2, 5, 2048])
def test_repairs_equal_brute_force(spark, segment):
    rows = some_conversations(3)
    df = spark.createDataFrame(rows, SCHEMA)
    out = conversation_repair.repaired(conversation_repair.damaged(df), F.col("n"), segment_turns=segment, fan_in=3).collect()
    want = {c: repair(v)[0] for c, v in damage(rows).items()}
    assert len(out) == len(want) and {r[0]: tuple(r)[1:] for r in out} == want


def test_repairs_cut_by_length_and_of_given_tables(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = {c: repair(v)[0] for c, v in damage([tuple(r) for r in df.collect()]).items()}
    damaged = conversation_repair.damaged(df)
    for chars in (100, conversation_repair.SEGMENT_CHARS):
        assert {r[0]: tuple(r)[1:] for r in conversation_repair.repaired(damaged, F.col("n"), segment_chars=chars).collect()} == want


def test_repaired_turns_are_well_formed(spark):
    rows = some_conversations(5)
    damaged = conversation_repair.damaged(spark.createDataFrame(rows, SCHEMA))
    repairs = conversation_repair.repaired(damaged, F.col("n"))
    out = {}
    for r in conversation_repair.repaired_turns(damaged, repairs, F.col("n")).orderBy("conv_id", "position").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {c: list(repair(v)[1]) for c, v in damage(rows).items()}
    assert out == {c: v for c, v in want.items() if v}
    assert all(re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in v)) for v in out.values())


def test_chart_settles_least_cost_then_least_audit():
    keep = lambda initial: (initial, False, False)
    assert conversation_repair.parse([])["C"] == (0, "")
    assert conversation_repair.parse([keep("u"), keep("a")])["C"] == (0, "KK")
    assert conversation_repair.parse([keep("s")])["C"] == (2, "D")
    assert conversation_repair.parse([keep("u"), keep("u")])["C"] == (1, "KR")
    assert conversation_repair.parse([keep("a")] * 4)["C"] == (2, "RKRK")
    assert conversation_repair.parse([("u", True, False), ("u", False, True)])["C"] == (4, "DD")
    assert conversation_repair.parse([keep("u"), keep("a"), keep("s"), keep("u")])["C"] == (2, "KKRR")


def test_one_conversation_of_all_rows_and_odd_tables(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + "x" * (200_000 if t == 11 else 3) + ".") for t in range(5000)] + [(7, 3, "assistant", "again.")] * 3000
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("a column")).withColumn("conv.id", F.lit(1))
    (row,) = conversation_repair.repaired(conversation_repair.damaged(df), F.col("n"), segment_turns=512, fan_in=4).collect()
    assert tuple(row)[1:] == repair(damage(rows)[7])[0]
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.repair_digest(empty).count() == 0
    lone = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = conversation_repair.repair_digest(spark.createDataFrame([(lone, 0, "user", "a.")], SCHEMA)).collect()
    assert tuple(row) == (lone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def trie(rows):
    """{(conv_id, depth): the contract's other columns}."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [q[2:] for q in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members, children = {}, {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids, m = children.get(p, []), members[p]
        leaves[p] = sum(leaves[k] for k in kids) or 1
        saved[p] = sum(saved[k] for k in kids) + (len(m) - 1) * (len(re.findall(f"[^{BLANK}]+", p[-1][1])) if p else 0)
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes(df):
    rows = df.collect()
    out = {(r[0], r[1]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("subtree", [1, 5, 50, 10**6])
def test_trie_equals_brute_force(spark, subtree):
    r = random.Random(3)
    rows = []
    for c in [None, *range(-30, 60), *range(1000, 1100)]:
        for t in range(r.choice([0, 1, 3, 9])):
            rows.append((c, r.choice([None, t, t]), r.choice([None, "user", "a"]), r.choice([None, "", " ", "a b c", "b!"])))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("a column")).withColumn("a.b", F.lit(1))
    assert nodes(prefix_trie.trie_digest(df, subtree)) == trie(rows)


def test_trie_of_given_tables_and_of_none(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    want = trie([tuple(r) for r in df.collect()])
    assert nodes(prefix_trie.trie_digest(df)) == want and nodes(prefix_trie.trie_digest(df, 10)) == want
    assert prefix_trie.trie_digest(df.limit(0)).count() == 0


def test_trie_of_copies_and_long_texts_in_small_chunks(spark):
    rows = [(c, t, "user", ("long " * 50_000 if t == 1 else f"word {t}")) for c in range(20, 120) for t in range(3)]
    rows += [(c, t, "user", f"{t}") for c in (400, 405) for t in range(40)]
    steps = prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    assert nodes(prefix_trie.trie(*steps, subtree=20, chunk=7)) == trie(rows)
