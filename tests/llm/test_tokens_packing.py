import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cardloom.llm import packing
from cardloom.llm.queries import tokenizer_path
from cardloom.llm.shared import new_folder
from cardloom.llm import tokens
from cardloom.llm.tokens import encoder, read_token_files, write_token_files


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


PARTS = [" ", " ", "  ", "\n", "\t", "\r", "'s", "a", "Z", "é", "1", "!", "\u3000", "\x0b", "漢", "<|endoftext|>", "\x00", "😀", "\xa0", "the", "..", "x" * 70]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=5))
def test_encoder_equals_the_library(texts):
    t = Tokenizer.from_file(tokenizer_path()) if not hasattr(test_encoder_equals_the_library, "t") else test_encoder_equals_the_library.t
    test_encoder_equals_the_library.t = t
    assert [x.tolist() for x in encoder(tokenizer_path()).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_files_round_trip(spark, docs, odd, plain):
    for table in (docs, odd):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "", r.doc_id) for r in table.collect())
        want, base = [], 0
        for _, text, doc in rows:
            ids = np.array([*plain(text), 0], "<u4")
            want.append((doc, base, len(ids), zlib.crc32(ids.tobytes())))
            base += len(ids)
        got = read_token_files(write_token_files(table, new_folder(spark, "t"), tokenizer_path(), partitions=5)).orderBy("start").collect()
        assert [tuple(r) for r in got] == want


def test_files_of_nothing(spark, no_docs):
    assert read_token_files(write_token_files(no_docs, new_folder(spark, "t"), tokenizer_path())).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_bound_and_packing_against_brute_force(lengths):
    lengths, capacity = np.array(lengths), 12

    def fits(items, bins):
        if not items:
            return True
        seen = set()
        for k, b in enumerate(bins):
            if b not in seen and b + items[0] <= capacity:
                seen.add(b)
                if fits(items[1:], [*bins[:k], b + items[0], *bins[k + 1 :]]):
                    return True
        return False

    best = next(n for n in range(1, 10) if fits(sorted(lengths.tolist(), reverse=True), [0] * n))
    sequence, place, fill = packing.best_fit_decreasing(lengths, capacity)
    assert packing.lower_bound(lengths, capacity) <= best <= len(fill) <= np.ceil(11 / 9 * best + 6 / 9)
    for b in range(len(fill)):
        at = sorted((place[i], lengths[i]) for i in np.flatnonzero(sequence == b))
        assert [p for p, _ in at] == np.cumsum([0, *(n for _, n in at)])[:-1].tolist() and fill[b] == sum(n for _, n in at) <= capacity


def sound(rows, texts, plain, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.piece), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    want = []
    for doc, text in texts:
        ids = np.array([*plain(text or ""), 0], "<u4")
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids), capacity), len(ids)]
        want += [(str(doc), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    for some in by_sequence.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == np.cumsum([0, *(r.length for r in some)])[:-1].tolist() and sum(r.length for r in some) <= capacity


def test_packing_documents(docs, odd, no_docs, plain):
    for table in (docs, odd):
        packed = packing.pack_documents(table, tokenizer_path(), 256)
        sound(packed.collect(), [(r.doc_id, r.text) for r in table.collect()], plain, 256)
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_exchange_of_many_groups_meets_the_bound(spark):
    r = np.random.default_rng(2)
    lengths = r.integers(1, 200, 4000)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "row long, length long")
    packed = packing.pack_pieces(pieces, 1024, group_pieces=100)
    assert packed.count() == 4000
    used, bound = packing.certificate(packed, 1024)
    assert bound == packing.lower_bound(lengths, 1024) and used <= bound + 1


def test_any_doc_id_comes_back(spark):
    ids = [None, None, -(1 << 63), -1, 0, (1 << 63) - 1]
    rows = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    got = read_token_files(write_token_files(rows, new_folder(spark, "t"), tokenizer_path(), partitions=3)).orderBy("start").collect()
    assert [r.doc_id for r in got] == ids


def test_strings_of_added_tokens_are_the_librarys(plain):
    text = "a <|endoftext|> b"
    assert encoder(tokenizer_path()).encode([text, "a b"])[0].tolist() == plain(text) and 50256 in plain(text)


def test_certified_groups_lose_only_their_rounding(spark):
    r = np.random.default_rng(3)
    lengths = r.integers(700, 1100, 6000)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "row long, length long")
    used, bound = packing.certificate(packing.pack_pieces(pieces, 2048, group_pieces=500))
    assert bound <= used <= bound + 1


def test_more_text_makes_more_files(spark, no_docs):
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('word ', 200) AS text").unionByName(spark.createDataFrame([(None, None)], "doc_id long, text string"))
    least = tokens.file_count(no_docs)
    assert tokens.file_count(docs, 200_000) == least and tokens.file_count(docs, 1_000) == 200 and tokens.file_count(docs.unionByName(docs), 1_000) == 400
