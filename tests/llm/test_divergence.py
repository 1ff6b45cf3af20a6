import collections
import re

import duckdb
import pytest

from cardloom.llm import divergence, queries, sql

DOCS = "text string, lang string, source string, g long, term string, n long, value long, item string"


def brute(rows, least, top=50):
    """Every group against every other, term by term."""
    of, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        of[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    kept = {lang: sorted((t for t, n in docs[lang].items() if n >= least), key=lambda t: t.encode()) for lang in {g[0] for g in of}}
    share = lambda counts, t, lang: 1 + 10**9 * (counts[t] + 5) // (sum(counts[x] for x in kept[lang]) + 5 * len(kept[lang]))
    out = []
    for lang, source in of:
        mine, every = of[lang, source], sum((c for g, c in of.items() if g[0] == lang), collections.Counter())
        pairs = [(s, sum(abs(share(mine, t, lang) - share(of[lang, s], t, lang)) for t in kept[lang])) for x, s in of if x == lang and s != source]
        more = [(t, share(mine, t, lang) - share(every, t, lang)) for t in kept[lang] if mine[t]]
        for part, found in (("pair", pairs), ("term", [x for x in more if x[1] > 0])):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, k) for k, (item, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def found(spark, rows, least, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], DOCS)
    got = divergence.source_divergence(df, least_docs=least, **more)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


ROWS = [
    *(("The cat sat, the mat! " + "dog " * (k % 4), "en", f"s{k % 3}") for k in range(40)), *(("el gato y Él ÉL el", "es", "s0") for _ in range(6)), ("El perro", "es", "s1"), ("", "es", "s2"), (None, "es", None), ("123 456", "es", "s3"),
    ("lonely words here", "fr", "only"), ("rare one", "de", "a"), ("rare two", "de", "b"), ("no lang", None, "s0"), ("no lang no", "", "s1"), ("x" * 200_000 + " the " * 3, "en", "s0"), ("the the", "en", "s9"), ("日本 語 The", "en", "s9"), ("日本\x00語", "en", "s9"),
]


@pytest.mark.parametrize("bits", (1, 3))
def test_divergence_is_the_brute_force_one(spark, bits):
    assert found(spark, ROWS, 3, fan_bits=bits) == brute(ROWS, 3)


def test_ranks_of_terms_end_at_the_top(spark):
    assert found(spark, ROWS, 1, top_terms=2) == brute(ROWS, 1, 2)


def test_no_rows_and_no_terms(spark):
    assert found(spark, [], 30) == []
    assert found(spark, [("a b", "en", "x"), ("c", "en", "y")], 30) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_flushes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    assert found(spark, ROWS, 3) == brute(ROWS, 3)


def test_equal_subtrees_are_one_node(spark):
    """Two groups with equal counts share a root, and a segment that repeats is one node."""
    leaves = [(g, pos, 1 + pos % 2) for g in (1, 2) for pos in range(64)] + [(3, 5, 7)]
    trees = divergence.Trees(spark.createDataFrame(leaves, "g long, pos long, n long"), 6, 1)
    roots = {r.g: r.node for r in trees.roots.collect()}
    assert roots[1] == roots[2] != roots[3]
    assert [level.count() for level in trees.levels] == [2] * 6


def test_wide_counts_stay_exact(spark):
    df = spark.createDataFrame([(10**15, 3 * 10**15, 7)], "c long, t long, k long")
    got = df.select(divergence.scaled_share(df["c"], df["t"], df["k"]).alias("p")).first().p
    assert got == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 35)


def test_sql_twin_on_odd_rows(spark):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    rows = ROWS * 16
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = c.sql(f"SELECT lang, source, part, item, value, rank FROM ({sql.ORACLES['op13_source_divergence']})").fetchall()
    assert sorted(want) == brute(rows, 30) == found(spark, rows, 30)
    assert "op13_source_divergence" in queries.queries()
