import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from cardloom.llm import lm_score as lm


def brute(texts):
    """Context-tree weighting by its definition, over dictionaries. ``texts`` are (doc_id, text); gives a scorer."""
    nodes, kids = defaultdict(lambda: [0, 0]), defaultdict(set)

    def decisions(text):
        s = lm.START + b" ".join(lm.words_of(text)) + lm.END
        for i in range(lm.DEPTH, len(s)):
            for k in range(8):
                yield s[i - lm.DEPTH : i], (1 << k) | s[i] >> (8 - k), s[i] >> (7 - k) & 1

    for _, text in texts:
        for context, bits, bit in decisions(text):
            for d in range(lm.DEPTH + 1):
                nodes[context[lm.DEPTH - d :], bits][bit] += 1
    for context, bits in nodes:
        if context:
            kids[context[1:], bits].add((context, bits))
    weighted, own = {}, {}
    for s in sorted(nodes, key=lambda s: -len(s[0])):
        a, b = nodes[s]
        kt = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        below = sum(weighted[k] for k in kids[s])
        top = max(kt, below)
        leaf = len(s[0]) == lm.DEPTH
        weighted[s] = kt if leaf else top + math.log(math.exp(kt - top) + math.exp(below - top)) - math.log(2)
        own[s] = 1.0 if leaf else 1 / (1 + math.exp(min(700, max(-700, below - kt))))

    def score(text):
        total = 0.0
        for context, bits, bit in decisions(text):
            p = 0.5
            for d in range(lm.DEPTH, -1, -1):
                s = (context[lm.DEPTH - d :], bits)
                if s in nodes:
                    p = own[s] * (nodes[s][1] + 0.5) / (sum(nodes[s]) + 1) + (1 - own[s]) * p
            total += math.log10(p if bit else 1 - p)
        return total

    return score


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def same(got, rows):
    training = [(d, t or "") for d, t in rows if not held(d)]
    counts = Counter(w for _, t in training for w in lm.words_of(t))
    tokens, kinds = sum(counts.values()) + len(training), len(counts) + bool(training)
    score = brute(training)
    want = []
    for d, t in rows:
        words = lm.words_of(t or "")
        base = sum(math.log10((c + 1) / (tokens + kinds + 1)) for c in [*map(counts.__getitem__, words), len(training)])
        want.append((str(d), held(d), len(words) + 1, sum(counts[w] > 0 for w in words) + bool(training), tokens, base, score(t or "")))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("heavy", [{}, {"heavy_words": 3, "heavy_keys": 5}, {"heavy_words": 0, "heavy_keys": 0}])
def test_against_brute_force(docs, heavy):
    some = docs.filter("length(text) < 800").limit(60).cache()
    same(lm.score_documents(some, **heavy).collect(), [(r.doc_id, r.text) for r in some.collect()])


def test_small_chunks_change_nothing(spark, docs, monkeypatch):
    some = docs.limit(80).cache()
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm.score_documents(some).collect())
    text = b"".join(lm.START + b" ".join(lm.words_of(r.text or "")) + lm.END for r in some.collect())
    keys = lm.keys_of(text)
    u, n = np.unique(keys[lm.scored(keys)], return_counts=True)
    whole, _ = lm.weigh_below(u, n)
    monkeypatch.setattr(lm, "KEY_ROWS", 500)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(u[a : a + 77].view(np.int64)), pa.array(n[a : a + 77])], ["packed", "n"]) for a in range(0, len(u), 77)]
    parts = [b"".join(b.column("mixed").drop_null().to_pylist()) for b in lm._below(iter(batches))]
    assert b"".join(parts) == whole.astype("<f4").tobytes() and len(parts) > 4
    got = sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm.score_documents(some.repartition(7), heavy_words=100, heavy_keys=1000).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [x for g in got for x in g[2:]] == pytest.approx([x for w in want for x in w[2:]], rel=1e-5)


def test_odd_rows(spark, odd, no_docs):
    small = odd.filter("text IS NULL OR length(text) < 1000")
    same(lm.score_documents(small).collect(), [(r.doc_id, r.text) for r in small.collect()])
    assert lm.score_documents(no_docs).count() == 0
    long = lm.score_documents(odd).filter("doc_id IN (5, 8)").collect()
    assert len({r.score for r in long}) == 1 and long[0].n_tokens == 120_001


def test_nothing_to_learn_from(spark):
    held_ids = [i for i in range(100) if held(i)][:3]
    got = lm.score_documents(spark.createDataFrame([(i, "ab c") for i in held_ids], "doc_id long, text string")).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(-5 * 8 * math.log10(2)) for r in got)


def test_byte_probabilities_sum_to_one(spark, docs):
    text = b"".join(lm.START + b" ".join(lm.words_of(r.text or "")) + lm.END for r in docs.limit(50).collect())
    seen = Counter(lm.keys_of(text).tolist())
    contexts = (b"\r\r\r\r\r", b" the ", b"zzzzz", b"\xff\x00 qu")
    for c in contexts:
        for b in range(256):
            seen[int.from_bytes(c[::-1], "big") << 8 | b] += 0
    rows = spark.createDataFrame([(k, n) for k, n in seen.items()], "packed long, n long")
    logs = {r.packed: r.log for r in lm.byte_logs(rows).collect()}
    for c in contexts:
        assert sum(10 ** logs[int.from_bytes(c[::-1], "big") << 8 | b] for b in range(256)) == pytest.approx(1, abs=1e-5)


def test_scores_do_not_depend_on_what_else_is_scored(spark, docs):
    """Held-out rows teach nothing, however many there are."""
    rows = [(r.doc_id, r.text) for r in docs.limit(150).collect()]
    few = [r for r in rows if not held(r[0])] + [r for r in rows if held(r[0])][:2]
    got = [{r.doc_id: (r.base_score, r.score) for r in lm.score_documents(spark.createDataFrame(x, "doc_id long, text string")).collect()} for x in (rows, few)]
    assert len(few) < len(rows) and all(got[0][d] == pytest.approx(got[1][d], rel=1e-9) for d, _ in few)
