import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cardloom.llm import prefix_trie

CHATS = "conv_id long, turn long, role string, text string, depth long, a long, sid long, rep long"


def brute(rows):
    """Nodes of the prefix tree, by dictionaries of whole sequences."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, len(whole) == d))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def under(p):
        stack, leaves, saved = [p], 0, 0
        while stack:
            q = stack.pop()
            stack += kids.get(q, [])
            leaves += q not in kids
            saved += (len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0)
        return leaves, saved

    least = {p: min(c for c, _ in m) for p, m in members.items()}
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c, e in m if e)))
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(m), len(kids.get(p, [])), *under(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], CHATS)
    got = prefix_trie.prefix_trie(df, **more)
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_trie_is_the_brute_force_one(spark, seed):
    """Few words and long shared runs: splits within edges, ends inside others, forks, whole copies, conversations without turns."""
    r = random.Random(seed)
    rows = []
    for c in range(60):
        base = ["abcab"[k % 5] * (k % 3) for k in range(r.randrange(20))]
        turns = base[: r.randrange(len(base) + 1)] + [r.choice("xy") for _ in range(r.randrange(4))]
        rows += [(c * r.choice((1, 1, 3)), k, r.choice(("user", None)) if k > 12 else "user", t or None) for k, t in enumerate(turns)]
    assert found(spark, rows, batches=3) == brute(rows)


def test_odd_conversations(spark):
    long = "é" * 100_000
    rows = [(0, 1, "user", "q"), (0, 1, "user", "q"), (0, None, None, None), (1, 5, "user", long), (2, 0, "a", "b"), (None, 0, "user", "lost"), (5, 0, "user", ""), (10**15, 0, "user", long), (10**15 + 1, None, "", "x")]
    rows += [(7, k, "user", "same") for k in range(30)] + [(8, k, "user", "same") for k in range(30)] + [(9, k, "user", "same") for k in range(12)]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    alone = [(3, 0, "user", "only")]  # its first turns are those of a conversation that there is not
    assert found(spark, alone) == brute(alone)


def test_heavy_prefixes_and_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HEAVY", 4)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, k, "user", "hello" if k < 3 else f"{c % 7} {k}") for c in range(0, 200, 2) for k in range(9 + c % 5)]
    assert found(spark, rows) == brute(rows)


def test_two_fattest(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(40) for b in range(40)], "a long, b long")
    for r in pairs.withColumn("f", prefix_trie.two_fattest(F.col("a"), F.col("b"))).collect():
        inside = range(r.a + 1, r.b + 1)
        assert r.f == (max(inside, key=lambda x: x & -x) if inside else None)


def test_a_long_conversation_is_spread_over_tasks(spark):
    turns = spark.range(0, 40_000, 1, 4).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = prefix_trie.paths(prefix_trie.rebuilt_turns(turns)[1])
        spread = rows.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(spread) < 30_000
    assert rows.count() == 40_000 and rows.select("a", "b").distinct().count() == 40_000
    last = rows.orderBy(F.desc("depth")).first()
    assert last.depth == 40_000 and last.upto == sum(len(str(i)) for i in range(40_000))
