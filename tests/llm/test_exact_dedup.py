import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cardloom.llm.exact_dedup import FuseFilter, drop_exact_copies, exact_dedup


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=2000))
def test_filter_has_no_false_negatives(keys):
    keys = np.array(sorted(keys), np.int64)
    assert FuseFilter.build(keys).contains(keys).all()


def test_filter_has_few_false_positives():
    r = np.random.default_rng(1)
    f = FuseFilter.build(r.integers(-(2**63), 2**63 - 1, 100_000))
    assert f.contains(r.integers(-(2**63), 2**63 - 1, 200_000)).mean() < 0.006
    assert len(f.cells) < 1.3 * 100_000


def check(rows, texts):
    """``texts`` maps row to (doc_id, text) in any order; results as a multiset."""
    groups = {}
    for doc, text in texts:
        groups.setdefault(text or "", []).append(doc)
    want = sorted((str(doc), str(max((x for x in groups[text or ""] if x is not None), default=None)), len(groups[text or ""]), hashlib.sha256((text or "").encode()).hexdigest()) for doc, text in texts)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == want
    kept = [r for r in rows if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows(odd):
    check(exact_dedup(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()])


def test_many_filters(odd, docs):
    check(exact_dedup(docs, keys_per_filter=16).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_unequal_bytes_with_equal_digests_stay_apart(docs):
    check(exact_dedup(docs, digest_hex=1).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0


def test_dropping_keeps_columns_and_one_row_of_each(odd):
    left = drop_exact_copies(odd)
    assert left.columns == odd.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert len(got) == len({t or "" for _, t in got}) == len({r.text or "" for r in odd.collect()})
    assert (6, "a b c d") in got and (3, "") in got
