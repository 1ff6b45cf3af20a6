"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

A text is its lower-cased words joined by one space, and an end byte; before it stand start bytes, which
are never scored and no word can hold. Each byte is eight binary
decisions; a node of the tree is a context of 0 to DEPTH preceding bytes and the bits decided so far.
A node's Krichevsky-Trofimov estimate and the product of its children's weighted probabilities are mixed
half and half, at all depths; what this says of the training corpus gives each node the weight of its own estimate.
Counts and weights are those of the training corpus and stay as they are while texts are scored.

The tree has no bound and is never held as a whole. It is a table of keys: a byte and the DEPTH bytes before it, for every
such piece of any text. Nodes that share their last three context bytes are weighed together in one task, as a
stream over sorted keys; above them are at most 256 ** 2 contexts of two bytes, 255 nodes each, whatever the corpus. So
every key gets the log probability of its byte. A text's score is a sum over its keys: the HEAVY_KEYS most frequent keys
travel to the texts, all others meet them by a join. Word counts are met in the same two ways. Where the line is drawn changes no result.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import cut, held_out

#: Bytes of context; a key, these and the next byte, fits in 48 bits.
DEPTH = 5
#: Depth from which on a task weighs all nodes below one context; the contexts above are few.
SPLIT = 3
#: Keys and words at most that travel to the texts: 12 MB and about 20 MB.
HEAVY_KEYS, HEAVY_WORDS = 1 << 20, 250_000
#: Bytes of text, and rows of keys, handled at a time.
CHUNK, KEY_ROWS = 1 << 20, 1 << 18
START, END = b"\r" * DEPTH, b"\n"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().translate(_LOWER).split()


def keys_of(stream: bytes) -> np.ndarray:
    """For each byte from the DEPTH-th on, the DEPTH bytes before it, the last one highest, and the byte lowest."""
    eight = np.ndarray(len(stream) - DEPTH, "<u8", stream + b"\0\0", strides=(1,))
    return ((eight & _U((1 << 40) - 1)) << _U(8)) | ((eight >> _U(40)) & _U(255))


def scored(keys: np.ndarray) -> np.ndarray:
    """Start bytes are not."""
    return (keys & _U(255)) != _U(START[0])


# ---------------------------------------------------------------- counting


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(n, first)


COUNTS = "word binary, packed long, n long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training words, and keys of all texts, with their counts in training texts; a task's own sums, let go of in between where they grow."""
    words: Counter = Counter()
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    streams: tuple[list[bytes], list[bytes]] = [], []
    size = held = 0

    def rows(w: pa.Array, k: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([w, k, n], ["word", "packed", "n"])

    def word_rows() -> Iterator[pa.RecordBatch]:
        items = list(words.items())
        for at in range(0, len(items), 50_000):
            some = items[at : at + 50_000]
            yield rows(pa.array([w for w, _ in some], pa.binary()), pa.nulls(len(some), pa.int64()), pa.array([n for _, n in some], pa.int64()))
        words.clear()

    def take() -> None:
        nonlocal held, size, parts
        for stream, weight in zip(streams, (1, 0), strict=True):
            flat = b"".join(stream)
            for at in range(0, len(flat) - DEPTH, CHUNK):
                k = keys_of(flat[at : at + CHUNK + DEPTH])
                u, n = np.unique(k[scored(k)], return_counts=True)
                parts.append((u, n.astype(np.int64) * weight))
                held += len(u)
                if held > 3_000_000:
                    parts = [_merged(parts)]
                    held = len(parts[0][0]) // 2
            stream.clear()
        size = 0

    def key_rows() -> Iterator[pa.RecordBatch]:
        k, n = _merged(parts)
        for at in range(0, len(k), 100_000):
            some = k[at : at + 100_000].view(np.int64)
            yield rows(pa.nulls(len(some), pa.binary()), pa.array(some), pa.array(n[at : at + 100_000]))

    for batch in batches:
        for text, held_text in zip(batch.column("text"), batch.column("held").to_pylist(), strict=True):
            found = words_of(text.as_py())
            if not held_text:
                words.update(found)
            streams[held_text].append(START + b" ".join(found) + END)
            size += len(streams[held_text][-1])
            if size > CHUNK:
                take()
                if len(words) > 400_000:
                    yield from word_rows()
                if held > 6_000_000:
                    yield from key_rows()
                    parts, held = [], 0
    take()
    yield from word_rows()
    if parts:
        yield from key_rows()


# ---------------------------------------------------------------- the tree


def _log_gamma_half(n: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift) for whole n >= 0 and shift 0.5 or 1, exact to the last digits."""
    x = n + shift
    small = np.array([math.lgamma(i + shift) for i in range(16)])
    big = np.maximum(x, 8.0)
    series = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(n < 16, small[np.minimum(n, 15).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of so many zeros and ones by the Krichevsky-Trofimov estimator."""
    return _log_gamma_half(zeros, 0.5) + _log_gamma_half(ones, 0.5) - _log_gamma_half(zeros + ones, 1.0) - math.log(math.pi)


def _nodes(key: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of decision ``k`` over sorted keys of one depth: node of each key, first key of each node, zeros and ones of each."""
    prefix = key >> _U(8 - k)
    new = np.r_[True, prefix[1:] != prefix[:-1]]
    first = np.flatnonzero(new)
    ones = np.add.reduceat(n * ((key >> _U(7 - k)) & _U(1)).astype(np.int64), first)
    return np.cumsum(new) - 1, first, np.add.reduceat(n, first) - ones, ones


def _mix(below: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of a node's weighted probability, and the weight of its own estimate, given the sum of its children's logs."""
    kt = log_kt(zeros, ones)
    return np.logaddexp(kt, below) - math.log(2), 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))


def _estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability of a one."""
    return (ones + 0.5) / (zeros + ones + 1.0)


def weigh_below(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """From sorted keys with all keys of their contexts of SPLIT bytes: mixed probability of each of a byte's decisions
    from that depth down, and of the parents' nodes their number, zeros, ones and sum of logs."""
    rows = [(key, n)]  # of depth DEPTH first
    up: list[np.ndarray] = []  # place of a row in the depth above
    for _ in range(DEPTH, SPLIT, -1):
        k, c = rows[-1]
        short, where = np.unique(((k >> _U(16)) << _U(8)) | (k & _U(255)), return_inverse=True)
        up.append(where)
        rows.append((short, np.bincount(where, c, len(short)).astype(np.int64)))
    mixed = np.empty((len(key), 8))
    sums = []
    for k in range(8):
        bit = ((key >> _U(7 - k)) & _U(1)) == 1
        at = np.arange(len(key))
        below = parent_of = None
        for d, (rk, rn) in enumerate(rows):
            node, first, zeros, ones = _nodes(rk, rn, k)
            one = _estimate(zeros, ones)
            if below is None:
                weighted, own = log_kt(zeros, ones), np.ones(len(zeros))
            else:
                weighted, own = _mix(np.bincount(node[parent_of], below, len(zeros)), zeros, ones)
            mine = node[at]
            p = np.where(bit, one[mine], 1 - one[mine])
            mixed[:, k] = p if d == 0 else own[mine] * p + (1 - own[mine]) * mixed[:, k]
            below = weighted
            if d < len(up):
                parent_of, at = up[d][first], up[d][at]
        parent = ((rk[first] >> _U(16)) << _U(8)) | _U(1 << k) | ((rk[first] & _U(255)) >> _U(8 - k))
        sums.append((parent, zeros, ones, below))
    parent, zeros, ones, logs = (np.concatenate(x) for x in zip(*sums, strict=True))
    u, where = np.unique(parent, return_inverse=True)
    total = lambda x: np.bincount(where, x, len(u))
    return mixed, (u, total(zeros).astype(np.int64), total(ones).astype(np.int64), total(logs))


BELOW = "packed long, n long, mixed binary, node long, zeros long, ones long, logs double"


def _below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted keys: a row for each key, and rows for the nodes above; holds some contexts of SPLIT bytes at a time."""
    names = [c.split()[0] for c in BELOW.split(", ")]

    def out(key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        mixed, (node, zeros, ones, logs) = weigh_below(key, n)
        data = pa.py_buffer(mixed.astype("<f4").tobytes())
        offsets = pa.py_buffer(np.arange(0, 32 * len(key) + 1, 32, dtype=np.int32).tobytes())
        some = pa.Array.from_buffers(pa.binary(), len(key), [None, offsets, data])
        nothing = [pa.nulls(len(key), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), some, *nothing], names)
        nothing = [pa.nulls(len(node), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(node.view(np.int64)), pa.array(zeros), pa.array(ones), pa.array(logs)], names)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column("packed").to_numpy().view(_U), batch.column("n").to_numpy()))
        size += batch.num_rows
        if size >= KEY_ROWS:
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            context = key >> _U(8 * (DEPTH + 1 - SPLIT))
            last = int(np.searchsorted(context, context[-1]))
            if last:
                yield from out(key[:last], n[:last])
            held, size = [(key[last:], n[last:])], 0
    if held:
        yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def weigh_above(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, logs: np.ndarray) -> dict[str, np.ndarray]:
    """From all nodes of depth SPLIT - 1: for each, what it and those above it give to the probability of a zero and of a one, and the weight that is left for what is below."""
    order = np.argsort(node)
    levels = [(node[order], zeros[order], ones[order], logs[order])]
    up, owns = [], []
    while True:
        v, z, o, below = levels[-1]
        weighted, own = _mix(below, z, o)
        owns.append((own, _estimate(z, o)))
        if len(levels) == SPLIT:
            break
        short, where = np.unique(((v >> _U(16)) << _U(8)) | (v & _U(255)), return_inverse=True)
        up.append(where)
        levels.append((short, *(np.bincount(where, x, len(short)) for x in (z, o, weighted))))
    left, zero, one = np.ones(len(owns[-1][0])), np.zeros(len(owns[-1][0])), np.zeros(len(owns[-1][0]))
    for d in range(SPLIT - 1, -1, -1):
        own, p = owns[d]
        zero, one, left = zero + left * own * (1 - p), one + left * own * p, left * (1 - own)
        if d:
            zero, one, left = zero[up[d - 1]], one[up[d - 1]], left[up[d - 1]]
    return {"node": levels[0][0], "zero": zero, "one": one, "left": left}


def _logs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("packed").to_numpy().view(_U)
            mixed = np.frombuffer(b"".join(batch.column("mixed").to_pylist()), "<f4").reshape(-1, 8).astype(np.float64)
            total = np.zeros(len(key))
            for k in range(8):
                at = np.searchsorted(above["node"], ((key >> _U(8 * (DEPTH + 2 - SPLIT))) << _U(8)) | _U(1 << k) | ((key & _U(255)) >> _U(8 - k)))
                own = np.where((key >> _U(7 - k)) & _U(1) == 1, above["one"][at], above["zero"][at])
                total += np.log10(own + above["left"][at] * mixed[:, k])
            yield pa.RecordBatch.from_arrays([batch.column("packed"), batch.column("n"), pa.array(total)], ["packed", "n", "log"])

    return run


def byte_logs(keys: DataFrame) -> DataFrame:
    """``packed, n, log``: log probability, base 10, of the byte of each of the distinct ``keys (packed, n)``, given the bytes before it.

    ``n`` counts a key in training texts; keys with 0 of these get the tree's estimate of what it has not seen. At most 256 ** (SPLIT - 1) * 255
    nodes reach the driver and are broadcast, 32 bytes each: contexts of two bytes.
    """
    dealt = keys.repartition(F.shiftright("packed", 8 * (DEPTH + 1 - SPLIT))).sortWithinPartitions("packed")
    below = cut(dealt.mapInArrow(_below, BELOW))
    nodes = below.filter("node IS NOT NULL").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("logs").alias("logs")).toArrow()
    above = weigh_above(nodes.column("node").to_numpy().view(_U), *(nodes.column(c).to_numpy() for c in ("zeros", "ones", "logs"))) if nodes.num_rows else {}
    return below.filter("packed IS NOT NULL").select("packed", "n", "mixed").mapInArrow(_logs(keys.sparkSession.sparkContext.broadcast(above)), "packed long, n long, log double")


# ---------------------------------------------------------------- scoring


class Table:
    """Values of keys, in a hash table with open places; NaN for unknown keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * max(len(keys), 1) - 1).bit_length())
        self.keys, self.values, self.shift = np.full(size, _FREE), np.full(size, np.nan, np.float32), _U(65 - size.bit_length())
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.keys[slot] == _FREE
            self.keys[slot[free]] = keys[waiting[free]]
            mine = self.keys[slot] == keys[waiting]
            self.values[slot[mine]] = values[waiting[mine]]
            waiting, slot = waiting[~mine], (slot[~mine] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out, seen = self.values[slot], self.keys[slot]
        waiting = np.flatnonzero((seen != keys) & (seen != _FREE))
        slot = slot[waiting]
        while len(waiting):
            slot = (slot + 1) & (len(self.keys) - 1)
            seen = self.keys[slot]
            out[waiting] = np.where(seen == keys[waiting], self.values[slot], np.float32(np.nan))
            more = (seen != keys[waiting]) & (seen != _FREE)
            waiting, slot = waiting[more], slot[more]
        return out


_FREE = _U((1 << 64) - 1)
ROWS = "uid long, doc_id long, word binary, tf long, n_tokens long, n_known long, base double, score double"
_HELD: dict[str, tuple[Table, dict[bytes, float]]] = {}


def key_word(packed: Column) -> Column:
    """A key among the words that light rows join on; no word holds a line end."""
    return F.unhex(F.concat(F.lit("0A"), F.lpad(F.hex(packed), 16, "0")))


def _score(shared):
    """A row for each document, and one for each of its words and keys that are not among the heavy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        if told["mark"] not in _HELD:
            _HELD.clear()
            _HELD[told["mark"]] = (Table(told["keys"], told["logs"]), told["words"])
        table, heavy = _HELD[told["mark"]]
        for batch in batches:
            docs, size = [], 0
            for uid, doc, text in zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                docs.append((uid, doc, words_of(text.as_py())))
                size += len(text.as_py())
                if size > CHUNK:
                    yield out(docs, table, heavy)
                    docs, size = [], 0
            if docs:
                yield out(docs, table, heavy)

    def out(docs: list, table: Table, heavy: dict[bytes, float]) -> pa.RecordBatch:
        streams = [START + b" ".join(w) + END for _, _, w in docs]
        flat = b"".join(streams)
        owners = np.repeat(np.arange(len(docs)), [len(s) for s in streams])[DEPTH:]
        score, rare = np.zeros(len(docs)), [np.zeros((2, 0), _U)]
        for at in range(0, len(flat) - DEPTH, CHUNK):
            k = keys_of(flat[at : at + CHUNK + DEPTH])
            found = table.find(k)
            inner = scored(k)
            owner = owners[at : at + len(k)]
            missed = np.flatnonzero(np.isnan(found) & inner)
            rare.append(np.stack([owner[missed].astype(_U), k[missed]]))
            found[~inner | np.isnan(found)] = 0
            score += np.bincount(owner, found, len(docs))
        uids, doc_ids = [u for u, _, _ in docs], [d for _, d, _ in docs]
        n_tokens, n_known, base = [len(w) + 1 for _, _, w in docs], [], []
        light_uid, light, tf = [], [], []
        for uid, _, words in docs:
            logs = list(map(heavy.get, words))
            known = [x for x in logs if x is not None]
            n_known.append(len(known))
            base.append(math.fsum(known))
            if len(known) < len(words):
                some = Counter([w for w, x in zip(words, logs, strict=True) if x is None])
                light += some
                tf += some.values()
                light_uid += [uid] * len(some)
        own, keys = np.concatenate(rare, axis=1)
        order = np.lexsort((keys, own))
        own, keys = own[order], keys[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])]) if len(keys) else np.zeros(0, np.int64)
        light += [b"\n" + x.to_bytes(8, "big") for x in keys[first].tolist()]
        tf += np.diff(np.append(first, len(keys))).tolist()
        light_uid += [uids[i] for i in own[first].tolist()]
        n = len(light)
        columns = [uids + light_uid, doc_ids + [None] * n, [b" %d" % u for u in uids] + light, [0] * len(uids) + tf, n_tokens + [0] * n, n_known + [0] * n, base + [0.0] * n, score.tolist() + [0.0] * n]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in ROWS.split(", ")])

    return run


def least_count(counts: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows of ``counts (n)`` reach, as small as sixteen steps an octave tell."""
    step = F.floor(F.log2("n") * 16)
    room = most
    for r in counts.filter("n > 0").groupBy(step.alias("step")).agg(F.count("n").alias("rows"), F.max("n").alias("top")).orderBy(F.desc("step")).collect():
        room -= r.rows
        if room < 0:
            return r.top + 1
    return 1


def score_documents(docs: DataFrame, heavy_words: int = HEAVY_WORDS, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Scores every row of ``docs (doc_id, text, ...)``, learning from the rows that are not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; ``score`` is the tree's
    log10 probability of the text, and ``-score * log2(10) / bytes`` its code length per byte.

    * A null or empty text is the end alone. A null doc_id is training. Repeated rows count and are scored each.
    * Without training documents every bit has probability one half and the base knows no word.
    * Texts of any length are scored whole. No documents give no rows. Other columns are ignored.
    * ``heavy_words`` and ``heavy_keys`` bound what is broadcast; they change no result.
    """
    spark = docs.sparkSession
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = told.select("text", held_out(F.col("doc_id"), 7, 2).cast("int").alias("held"))
    counted = cut(marked.mapInArrow(_counts, COUNTS).groupBy("word", "packed").agg(F.sum("n").alias("n")))
    words, keys = counted.filter("word IS NOT NULL").select("word", "n"), counted.filter("packed IS NOT NULL").select("packed", "n")
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("word").alias("kinds")).first()
    ends = marked.filter("held = 0").count()
    tokens, kinds = seen.n + ends, seen.kinds + (1 if ends else 0)
    logs = cut(byte_logs(keys))

    often = words.filter(F.col("n") >= least_count(words, heavy_words)).toArrow()
    close = logs.filter(F.col("n") >= least_count(logs, heavy_keys)).select("packed", "log").toArrow()
    near = {"words": dict(zip(often.column("word").to_pylist(), np.log10(often.column("n").to_numpy() + 1.0).tolist(), strict=True)), "keys": close.column("packed").to_numpy().view(_U), "logs": close.column("log").to_numpy().astype(np.float32)}
    shared = spark.sparkContext.broadcast(near | {"mark": uuid.uuid4().hex})

    rows = told.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(_score(shared), ROWS)
    far = words.select("word", "n", F.lit(0.0).alias("log")).unionByName(logs.select(key_word(F.col("packed")).alias("word"), F.lit(0).cast("long").alias("n"), "log"))
    met = rows.join(far, "word", "left")
    n, log = F.coalesce("n", F.lit(0)), F.coalesce("log", F.lit(0.0))
    summed = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(n > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("tf") * F.log10(n + 1)).alias("base"), F.sum(F.col("score") + F.col("tf") * log).alias("score"),
    )
    base = F.col("base") + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(tokens + kinds + 1))
    return summed.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", (F.col("n_known") + (1 if ends else 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
