import itertools

import numpy as np
import xxhash

from cardloom.llm import near_copies, simhash
from cardloom.llm.components import components


def reference_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def joined(prints, radius=3):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {p: find(p) for p in root}


def same(rows, texts):
    prints = [(doc, reference_print(text or "")) for doc, text in texts]
    root = joined({p for _, p in prints})
    low = {}
    for doc, p in prints:
        if doc is not None:
            low[root[p]] = min(doc, low.get(root[p], doc))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in rows) == sorted((str(doc), f"{p:016x}", low.get(root[p])) for doc, p in prints)


def test_documents(docs):
    short = [(r.doc_id, r.text) for r in docs.collect()]
    same(simhash.near_duplicates(docs).collect(), short)


def test_odd_rows(odd, no_docs):
    same(simhash.near_duplicates(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(no_docs).count() == 0


def test_masks_cover():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    for some in itertools.combinations(range(64), 3):
        bits = sum(1 << i for i in some)
        assert any(not m & bits for m in masks)
    for m in masks[:2]:
        open_bits = [i for i in range(64) if not m >> i & 1]
        finer = simhash.finer_masks(m)
        for some in itertools.combinations(open_bits, 3):
            assert any(not f & sum(1 << i for i in some) for f in finer)
        assert max(64 - f.bit_count() for f in finer) <= 12


def test_large_buckets_lose_no_link(spark):
    r = np.random.default_rng(3)
    center = int(r.integers(0, 2**63))
    prints = {center} | {center ^ sum(1 << int(b) for b in r.choice(64, r.integers(1, 9), replace=False)) for _ in range(250)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    for rows in (4096, 6):
        links = simhash.near_links(spark.createDataFrame(signed, "fp long"), bucket_rows=rows)
        got = {(x.node) % (1 << 64): x.root % (1 << 64) for x in components(links).collect()}
        want = joined(prints)
        groups = lambda m: {frozenset(k for k in prints if m.get(k, k) == v) for v in {m.get(k, k) for k in prints}}
        assert groups(got) == groups(want)


def test_components_of_a_long_chain(spark):
    got = components(spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (7, 7)], "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == {(i, 0) for i in range(101)} | {(200, 200), (201, 200)}


def test_dropping(odd):
    left = near_copies.drop_near_copies(odd)
    assert left.columns == odd.columns
    ids = sorted(r.doc_id for r in left.filter("doc_id IS NOT NULL").collect())
    assert ids == [1, 2, 5, 7]
