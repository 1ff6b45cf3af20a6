"""Benchmark decontamination by canonical templates.

Texts become template tokens (see ``templates``). Windows of the documents hash-join those of the benchmark, in up to three readings:
with no names, with those inside sentences, and with every capital as a name's. A name that opens a sentence of
a document stands for one that opens a sentence of the item; one inside a sentence stands for any name of the item. So a question asked again
with other numbers and names is caught, and so is a copy in other capitals. Where a document's capitals tell no names
(all small, all large), the items do: for each pattern of names that windows of the benchmark have, any words inside sentences may stand at its places.
A window with too few words besides its placeholders counts the signs between its tokens as words (``3 + 4 * 5``); with too few of both
it is hashed by its values: a copy of it is caught, any other filling is not.

What a document shares with an item along one diagonal is a run. Each slot of a run pairs a value of the item with one of
the document. A pair stands if it keeps the value, or else if it is the most frequent pair of both its values;
slots with other pairs clash, and cut the run. Windows without a clashing slot are reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import cut
from cardloom.llm.templates import PLACEHOLDER, NAME, mixed, tokens_of

#: Tokens of a window. Items with fewer tokens make one window of all of them.
WINDOW = 8
#: Words that a window needs besides its placeholders; with fewer it is looked for by its values.
LITERAL = 4
#: Bits of the screen for window hashes: 16 for each hash, up to 32 MB. The exact join follows, so a full screen costs time only.
SCREEN_BITS_EACH, SCREEN_BITS_MOST = 16, 1 << 28
#: Characters of text whose windows are found at a time.
BATCH_CHARS = 1 << 20

HITS = "key long, doc_id long, pos long, hash long, mask int, slots array<long>"
#: Keeps hashes of values, and of templates with signs, apart from those of templates.
_LITERAL_SALT, _SIGN_SALT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _hits(texts: list[str], sizes: list[int] | None, screen: np.ndarray | None, patterns: dict[int, list[int]] | None = None) -> tuple[np.ndarray, ...]:
    """Text number, first token, hash, slot bits and slot values (flat, with offsets) of the windows that ``screen`` lets through.

    Windows of each of ``sizes`` tokens; without ``sizes``, of WINDOW tokens or all tokens of a shorter text. ``patterns`` are
    the places of names in the benchmark's windows, by their size.
    """
    t = tokens_of(texts)
    n_tokens, place = len(t.value), np.arange(len(t.value))
    plain, inner, every = t.readings()
    kept: list[tuple] = []
    for n in range(1, WINDOW + 1) if sizes is None else sizes:
        if n > n_tokens:
            continue
        fits = place[: n_tokens + 1 - n] + n <= t.ends[: n_tokens + 1 - n]
        if sizes is None and n < WINDOW:
            fits &= (t.counts[t.text] == n)[: len(fits)]
        if not fits.any():
            continue

        def count(x: np.ndarray, n: int = n) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
            return sums[n:] - sums[:-n]

        slots = count(plain)
        readings = [(t.windows(t.template(plain), n), fits & (slots + LITERAL <= n), plain)]
        if (few := fits & (slots + LITERAL > n)).any():
            readings.append((t.windows(t.value, n) ^ _LITERAL_SALT, few, np.zeros(n_tokens, bool)))
            signed = few & (n - slots + count(t.n_signs, n - 1)[: len(few)] >= LITERAL) if n > 1 else few & False
            if signed.any():
                between = t.windows(mixed(t.signs + np.uint64(1)), n - 1)[: len(few)]
                readings.append((mixed(t.windows(t.template(plain), n) + between) ^ _SIGN_SALT, signed, plain))
        for reading, before, opening in ((inner, plain, False), (every, inner, True), *([(every, inner, False)] if sizes is None else [])):
            more = fits & (count(reading & ~before) > 0) & (count(reading) + LITERAL <= n)
            if more.any():
                readings.append((t.windows(t.template(reading, opening), n), more, reading))
        found = [(hashes, ok, slot, 0) for hashes, ok, slot in readings]
        for pattern in (patterns or {}).get(n, []):
            places = [k for k in range(n) if pattern >> k & 1]
            span = len(slots)
            words = np.logical_and.reduce([~(plain | t.initial)[k : k + span] for k in places])
            told = np.logical_and.reduce([inner[k : k + span] for k in places]) & (count(inner) == slots + len(places))  # capitals tell just these names: a reading above has them
            more = fits & words & ~told & (slots + len(places) + LITERAL <= n)
            if more.any():
                found.append((t.masked(t.template(plain), n, pattern, PLACEHOLDER[NAME]), more, plain, pattern))
        for hashes, ok, slot, pattern in found:
            at = np.flatnonzero(ok)
            h = hashes[at]
            if screen is not None:
                bit = h & np.uint64(len(screen) * 64 - 1)
                there = (screen[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                at, h = at[there], h[there]
            if len(at):
                cells = at[:, None] + np.arange(n)
                on = slot[cells] | ((pattern >> np.arange(n)) & 1).astype(bool)
                kept.append((at, h, (on << np.arange(n)).sum(axis=1), on.sum(axis=1), t.value[cells][on]))
    if not kept:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(1, np.int32), none
    at, h, mask, n_slots, values = (np.concatenate(k) for k in zip(*kept, strict=True))
    first = np.cumsum(t.counts) - t.counts
    return t.text[at], at - first[t.text[at]], h.view(np.int64), mask, np.concatenate([[0], np.cumsum(n_slots)]).astype(np.int32), values.view(np.int64)


def _windows(sizes: list[int] | None, screen: Callable[[], np.ndarray] | None, patterns: dict[int, list[int]] | None = None):
    """``key, doc_id, text`` rows to windows, as HITS."""

    def out(batch: pa.RecordBatch, a: int, texts: list[str]) -> pa.RecordBatch:
        text, pos, h, mask, offsets, values = _hits(texts, sizes, screen() if screen else None, patterns)
        rows = pa.array(text + a)
        slots = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("key").take(rows), batch.column("doc_id").take(rows), pa.array(pos, pa.int64()), pa.array(h, pa.int64()), pa.array(mask, pa.int32()), slots], ["key", "doc_id", "pos", "hash", "mask", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, a, chars = [], 0, 0
            for i, x in enumerate(batch.column("text")):
                texts.append(x.as_py())
                chars += len(texts[-1])
                if chars > BATCH_CHARS:
                    yield out(batch, a, texts)
                    texts, a, chars = [], i + 1, 0
            if texts:
                yield out(batch, a, texts)

    return run


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(F.xxhash64(F.coalesce(F.col(name), F.lit(-1)), text).alias("key"), F.col(name).cast("long").alias("doc_id"), text.alias("text"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``hash, text_id, item_pos, mask, item_slots`` of each distinct text of ``benchmark (item_id, text)``: every window of every text."""
    texts = benchmark.select(_text_id().alias("key"), _text_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])
    found = texts.mapInArrow(_windows(None, None), HITS)
    return found.select("hash", F.col("doc_id").alias("text_id"), F.col("pos").alias("item_pos"), "mask", F.col("slots").alias("item_slots")).distinct()


def _text_id() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def name_patterns(benchmark: DataFrame) -> dict[int, list[int]]:
    """Where names stand inside windows of the benchmark, as bits, by the windows' size: less than 2 ** WINDOW patterns a size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = tokens_of(batch.column("text").to_pylist())
            plain, inner, _ = t.readings()
            found = set()
            for n in range(1, min(WINDOW, len(t.value)) + 1):
                m = len(t.value) + 1 - n
                at = np.arange(m)
                fits = at + n <= t.ends[:m]
                if n < WINDOW:
                    fits &= t.counts[t.text[:m]] == n
                bits = sum(((inner & ~plain)[k : k + m].astype(np.int64) << k) for k in range(n))
                slots = sum(inner[k : k + m].astype(np.int64) for k in range(n))
                found |= {(n, b) for b in np.unique(bits[fits & (slots + LITERAL <= n)]).tolist() if b}
            yield pa.RecordBatch.from_pydict({"n": pa.array([x[0] for x in found], pa.int64()), "bits": pa.array([x[1] for x in found], pa.int64())})

    out: dict[int, list[int]] = {}
    for r in _keyed(benchmark, "item_id").select("text").mapInArrow(run, "n long, bits long").distinct().orderBy("n", "bits").collect():
        out.setdefault(r.n, []).append(r.bits)
    return out


def _screen(windows: DataFrame) -> np.ndarray:
    """Bits of the window hashes, or-ed together by Spark; at most SCREEN_BITS_MOST of them reach the driver."""
    bits = 1 << 16
    while bits < min(SCREEN_BITS_MOST, SCREEN_BITS_EACH * windows.select("hash").distinct().count()):
        bits *= 2
    bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
    words = windows.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, CAST(hash & 63L AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_pandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def standing_windows(windows: list[dict]) -> tuple[int, int]:
    """Of one run's windows (``pos``, slot bits ``mask``, ``item`` and ``doc`` values): how many have no clashing slot, and how many pairs these hold."""
    pairs: dict[tuple[int, int, int], None] = {}
    held = []
    for w in windows:
        at = [w["pos"] + k for k in range(WINDOW) if w["mask"] >> k & 1]
        held.append((w["pos"], list(zip(at, w["item"], w["doc"], strict=True))))
        pairs.update(dict.fromkeys(held[-1][1]))
    votes = Counter((i, d) for _, i, d in pairs)
    best: list[dict[int, tuple[int, int] | None]] = [{}, {}]
    for side, of in enumerate(best):
        most: Counter = Counter()
        for pair, n in votes.items():
            n = n if pair[0] != pair[1] else len(pairs) + 1
            if n > most[pair[side]]:
                most[pair[side]], of[pair[side]] = n, pair
            elif n == most[pair[side]]:
                of[pair[side]] = None
    stands = {pair for pair in votes if best[0][pair[0]] == pair and best[1][pair[1]] == pair}
    clean = [(pos, slots) for pos, slots in held if all((i, d) in stands for _, i, d in slots)]
    return len({pos for pos, _ in clean}), len({(i, d) for _, slots in clean for _, i, d in slots})


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [standing_windows(r) for r in batch.column("run").to_pylist()]
        counts = [pa.array([t[k] for t in told], pa.int64()) for k in (0, 1)]
        rows = pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "doc_id", "text_id")] + counts, ["key", "doc_id", "text_id", "windows", "slots"])
        yield rows.filter(pa.array([t[0] > 0 for t in told], pa.bool_()))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``key, doc_id, item_id, windows, slots``: documents that hold a passage of an item, whatever fills its slots.

    One row per document and item with at least one window that no slot clashes in. ``windows`` counts these
    windows by their places, ``slots`` the distinct pairs of slot values; ``key`` hashes id and text.

    * A passage counts from ``WINDOW`` tokens of an item on. Shorter items must be held whole. A window with fewer than ``LITERAL`` words
      besides placeholders, signs between tokens counted as words, must hold the item's own values, in any capitals. Items without a letter or digit are never found.
    * Every item that holds a window is compared and told of; items of one text are compared once.
    * Null texts are empty; null ids stay null. Rows that repeat an id and a text count as one document.
    * No documents or no items give no rows. Other columns are ignored. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    windows = cut(benchmark_windows(benchmark))
    sizes = sorted(r.n for r in _keyed(benchmark, "item_id").mapInArrow(_sizes, "n long").distinct().collect())
    shared = spark.sparkContext.broadcast(_screen(windows))
    found = _keyed(docs, "doc_id").mapInArrow(_windows(sizes, lambda: shared.value, name_patterns(benchmark)), HITS).join(windows, ["hash", "mask"])
    run = F.struct(F.col("item_pos").alias("pos"), "mask", F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    runs = found.groupBy("key", "doc_id", "text_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set(run).alias("run"))
    standing = runs.mapInArrow(_judged, "key long, doc_id long, text_id long, windows long, slots long")
    items = benchmark.select(_text_id().alias("text_id"), F.col("item_id").cast("long").alias("item_id")).distinct()
    return standing.join(items, "text_id").groupBy("key", "doc_id", "item_id").agg(F.sum("windows").alias("windows"), F.max("slots").alias("slots"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.unique(np.minimum(tokens_of(batch.column("text").to_pylist()).counts, WINDOW))
        yield pa.RecordBatch.from_pydict({"n": pa.array(counts[counts > 0].tolist(), pa.int64())})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with all their columns."""
    gone = contaminated(docs, benchmark).select(F.col("key").alias("_key")).distinct()
    key = F.xxhash64(F.coalesce(docs["doc_id"], F.lit(-1)), F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, key == gone["_key"], "left_anti")
