import collections
import zlib

import pytest
from pyspark.sql import functions as F

from cardloom.llm import sharding


def placed(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, 2, 3, 0.5) for i, t in rows], "doc_id long, text string, key long, n long, shard long, place double")
    return sharding.shard_documents(df, **more).collect()


def lawful(rows, got, shards=sharding.SHARDS):
    """Every row once, with its own size and digest; counts at most one apart; slots without gaps."""
    say = lambda t: (t or "").encode()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((i, len(say(t)) + 1, zlib.crc32(say(t))) for i, t in rows), key=repr)
    of = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        of[r.shard].append(r.slot)
    counts = [len(of[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in of.values())


def links(rows, got):
    """All links and those within a shard, pair by pair counted."""
    text = {i: t or "" for i, t in rows}
    whole, cells = collections.Counter(text[r.doc_id] for r in got), collections.Counter((text[r.doc_id], r.shard) for r in got)
    pairs = lambda c: sum(n * (n - 1) // 2 for n in c.values())
    return pairs(whole), pairs(cells)


def test_small_groups_are_never_cut(spark):
    rows = [(i, f"text {i // 3}" if i < 900 else f"alone {i}") for i in range(2_000)]
    got = placed(spark, rows)
    lawful(rows, got)
    assert links(rows, got) == (900, 900)


def by_hash(rows):
    """Links within a shard that a hash of the id would leave."""
    return sum(n * n / 16 for n in collections.Counter(t or "" for _, t in rows).values() if n > 1) / 2


def test_a_hot_text_fills_whole_shards(spark):
    """A third of all rows have one text, which needs 5.3 of 16 shards."""
    rows = [(i, f"{i}" if i % 3 else "hot") for i in range(3_000)]
    got = placed(spark, rows)
    lawful(rows, got)
    full = sorted(collections.Counter(r.shard for r in got if r.doc_id % 3 == 0).values())[-5:]
    assert min(full) >= 180 and links(rows, got)[1] > 2.5 * by_hash(rows)


def test_hot_texts_among_many_links(spark):
    """Nearly every document is linked, so that shards can only swap: pairs stay whole for the most part, hot texts gather."""
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 6}" if i % 3 == 1 else None if i % 2 else f"{i}") for i in range(3_000)]
    got = placed(spark, rows)
    lawful(rows, got)
    pairs = collections.defaultdict(set)
    for r in got:
        if r.doc_id % 3 == 1:
            pairs[r.doc_id // 6].add(r.shard)
    assert sum(len(x) == 1 for x in pairs.values()) > 0.7 * len(pairs) and links(rows, got)[1] > 1.3 * by_hash(rows)


def test_admitted():
    """Two full shards swap what both want; a full one that nobody leaves grants nothing; room is shared evenly."""
    assert sharding.admitted({(0, 1): 10, (1, 0): 4}, {0: 100, 1: 100}, 100) == pytest.approx({0: 1.0, 1: 0.4}, abs=1e-4)
    assert sharding.admitted({(0, 1): 10}, {0: 50, 1: 100}, 100) == {1: 0.0}
    assert sharding.admitted({(0, 1): 10, (2, 1): 30}, {1: 80}, 100) == {1: 0.5}


def test_documents_dataset(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sharding.shard_documents(docs).collect()
    lawful(rows, got)
    every, kept = links(rows, got)
    assert every and kept == every


def test_odd_rows(spark, odd, no_docs):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    lawful(rows, sharding.shard_documents(odd).collect())
    assert sharding.shard_documents(no_docs).count() == 0
    lawful([(1, None)], placed(spark, [(1, None)]))


@pytest.mark.parametrize("shards", (1, 3))
def test_other_counts_of_shards(spark, shards):
    rows = [(i % 50, "same" if i % 2 else f"{i}") for i in range(101)]
    lawful(rows, placed(spark, rows, shards=shards), shards)


def test_bounds_change_no_law(spark, monkeypatch):
    for name, v in (("CHUNK", 5), ("NUMBERED", 7), ("HEAVY", 2)):
        monkeypatch.setattr(sharding, name, v)
    rows = [(i, f"{i % 11}" if i % 3 else "hot") for i in range(500)]
    lawful(rows, placed(spark, rows))


def test_cut_links(spark):
    cells = spark.createDataFrame([("a", 0)] * 3 + [("a", 1)] * 2 + [("b", 1)], "key string, shard int")
    r = sharding.cut_links(cells, "key").first()
    assert (r.links, r.cut_links) == (10, 6)
    assert tuple(sharding.cut_links(cells.filter(F.lit(False)), "key").first()) == (0, 0)


def test_rounds_only_mend(spark):
    """A round never has more cut links than the start, and more rounds never undo what a text has gathered."""
    rows = spark.range(4_000).select(F.col("id").alias("row"), (F.col("id") % 700).cast("string").cast("binary").alias("key")).withColumn("n", F.lit(6).cast("long"))
    start = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(16)).cast("int"))
    cuts = [sharding.cut_links(sharding.propagate(start, 250.0, 16, k, 1_000), "key").first().cut_links for k in (0, 1, 3)]
    assert cuts[0] > cuts[1] >= cuts[2]
