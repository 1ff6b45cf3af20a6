import itertools

import numpy as np

import corpus_pipeline
from cardloom.llm import near_copies


def reference(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8


def edited(words, n, r):
    out = list(words)
    for i in r.choice(len(out), n, replace=False):
        out[i] = f"new{r.integers(1 << 40)}"
    return " ".join(out)


def test_stage_drops_every_near_copy(spark, sf_dir):
    r = np.random.default_rng(5)
    texts = []
    for k in range(60):
        base = [f"w{x}" for x in r.integers(0, 400, int(r.integers(100, 400)))]
        texts += [" ".join(base), edited(base, int(r.integers(1, 9)), r)]
    hub = [f"h{x}" for x in r.integers(0, 400, 300)]  # a large group, some of it too far from its leaders
    texts += [edited(hub, int(n), r) for n in r.integers(1, 9, 80)]
    sets = [reference(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if alike(sets[i], sets[j]) and root[i] != root[j]:
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if x == old else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = corpus_pipeline.simhash_stage(spark, docs, sf_dir)
    assert sorted(x.doc_id for x in left.collect()) == sorted(set(root))
    assert len(set(root)) < 110


def test_rows_that_share_a_doc_id(spark, sf_dir):
    words = [f"w{i}" for i in range(100)]
    near = " ".join(["other", *words[1:]])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, near), (2, "a text of its own that nothing else is like"), (None, near)], "doc_id long, text string")
    left = corpus_pipeline.simhash_stage(spark, docs, sf_dir)
    assert sorted((str(x.doc_id), x.text[:6]) for x in left.collect()) == [("1", "w0 w1 "), ("2", "a text"), ("None", "other ")]


def test_bands_find_pairs_at_the_bound():
    """512 of 640 shingles shared: similarity 0.8 exactly."""
    r = np.random.default_rng(7)
    for _ in range(200):
        some = r.integers(0, 2**64, 640, np.uint64)
        a, b = np.unique(some[:576]), np.unique(some[64:])
        assert near_copies.jaccard(a, b) == 0.8
        assert set(near_copies.band_keys(a)) & set(near_copies.band_keys(b))


def test_slices_and_blocks_find_every_pair(spark, sf_dir, monkeypatch):
    """A bucket in many slices, compared in small blocks, loses no pair and finds none twice over."""
    r = np.random.default_rng(9)
    hub = [f"h{x}" for x in r.integers(0, 400, 120)]
    texts = [edited(hub, int(n), r) for n in r.integers(1, 7, 90)]
    sets = [near_copies.shingles(t) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(90), 2) if near_copies.jaccard(sets[i], sets[j]) >= 0.8}
    monkeypatch.setattr(near_copies, "CELLS", 3000)
    a, b = near_copies.alike_members(sets, np.arange(90), np.zeros(90, np.int64))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want) > 50
    monkeypatch.setattr(near_copies, "SLICE", 16)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid long, text string")
    members = spark.createDataFrame([(1, i, i) for i in range(90)], "key long, rid long, root long")
    assert {(x.b, x.a) for x in near_copies._apart(members, rows).collect()} == want
