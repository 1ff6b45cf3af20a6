"""Near copies by true Jaccard similarity of word shingles, the pairs found by SimHash and by bands of min-hashes.

The covering masks of SimHash find the closest pairs. At a similarity of 0.8 the 64-bit fingerprints of two texts differ in about ten
bits, and covering masks for that radius would be 2 ** 11 or more; so what they miss is looked for in bands: two texts
whose shingle sets are alike to a share j agree in all ROWS minima of a band with probability j ** ROWS; with BANDS bands a pair
at 0.8 shares no bucket once in 190,000 pairs, a closer one more rarely still. Every pair of a bucket is
then either compared by its shingles or known to be in one component already: first all members meet their bucket's leader, then those that are
in different components meet each other, slice by slice inside the tasks, so that only links leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.components import components
from cardloom.llm.shared import cut
from cardloom.llm.simhash import fingerprints, near_links

#: Words of a shingle, and the Jaccard similarity from which texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64) | np.uint64(1)
#: Shingles hashed by all functions at a time.
_CHUNK = 512
#: Members of a bucket in one slice, and cells of the tables that two blocks of members are compared by.
SLICE, CELLS = 512, 1 << 23
#: Shingle sets that a worker remembers while it compares.
_REMEMBERED = 64


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; a text of fewer words is one shingle, a blank text the empty one."""
    words = text.encode().translate(_LOWER).split()
    grams = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(g, 42) for g in grams]), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(some: np.ndarray) -> list[int]:
    """A hash of each band's minima, as signed longs."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(some), _CHUNK):
        np.minimum(least, (some[at : at + _CHUNK] * _FACTORS[0] + _FACTORS[1]).min(axis=1), out=least)
    raw = least.tobytes()
    step = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[k * step : (k + 1) * step], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [k for t in batch.column("text") for k in band_keys(shingles(t.as_py()))]
        rid = np.repeat(batch.column("rid").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rid, pa.int64())], ["key", "rid"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, np.ndarray] = {}

    def of(rid: int, text: pa.Scalar) -> np.ndarray:
        if rid not in known:
            if len(known) >= _REMEMBERED:
                known.clear()
            known[rid] = shingles(text.as_py())
        return known[rid]

    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        near = [jaccard(of(x, s), of(y, t)) >= SIMILARITY for x, y, s, t in zip(a, b, batch.column("text_a"), batch.column("text_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def alike_members(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members whose sets are near copies, of different roots and, where there are two sides, of different sides. Block by block."""
    size = np.array([len(x) for x in sets])
    blocks, cells = [[]], 0
    for i, n in enumerate(size.tolist()):
        cells += n
        if blocks[-1] and cells * (len(blocks[-1]) + 1) > CELLS:
            blocks.append([])
            cells = n
        blocks[-1].append(i)
    two = side.min() != side.max()
    left, right = [], []
    for x, some in enumerate(blocks):
        names = np.unique(np.concatenate([sets[i] for i in some]))

        def table(members: list[int], names: np.ndarray = names) -> np.ndarray:
            out = np.zeros((len(members), len(names)), np.float32)
            for row, i in zip(out, members, strict=True):
                at = np.minimum(np.searchsorted(names, sets[i]), len(names) - 1)
                row[at[names[at] == sets[i]]] = 1
            return out

        mine = table(some)
        for others in blocks[x:]:
            both = mine @ (mine if others is some else table(others)).T
            i, j = np.array(some), np.array(others)
            near = both >= SIMILARITY * (size[i][:, None] + size[j][None, :] - both) - 1e-6
            near &= (root[i][:, None] != root[j][None, :]) & (i[:, None] < j[None, :])
            if two:
                near &= side[i][:, None] != side[j][None, :]
            a, b = np.nonzero(near)
            left.append(i[a])
            right.append(j[b])
    return np.concatenate(left), np.concatenate(right)


def _link_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket and pair of slices: links between near copies of different components. Holds one pair of slices at a time."""
    held: list[tuple] = []

    def links() -> pa.RecordBatch:
        rid, root = (np.array([h[k] for h in held]) for k in (1, 2))
        a, b = alike_members([np.frombuffer(h[4], "<u8") for h in held], root, np.array([h[3] for h in held]))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(rid[a], rid[b])), pa.array(np.minimum(rid[a], rid[b]))], ["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high")), strict=True))
        for row in zip(keys, *(batch.column(c).to_pylist() for c in ("rid", "root", "slice", "grams")), strict=True):
            if held and held[0][0] != row[0]:
                yield links()
                held.clear()
            held.append(row)
    if held:
        yield links()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("rid"), grams], ["rid", "grams"])


def _apart(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Links ``a, b`` between near copies of different components in the buckets of ``members (key, rid, root)``; large buckets are compared slice by slice."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("rid") / SLICE).alias("slices"))
    dealt = members.join(sizes, "key").withColumn("slice", F.pmod(F.xxhash64("rid", "key"), F.col("slices")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    grams = cut(rows.join(members.select("rid").distinct(), "rid", "left_semi").dropDuplicates(["rid"]).mapInArrow(_grams, "rid long, grams binary"))
    placed = met.select("key", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "rid", "root", "slice").join(grams, "rid")
    together = placed.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rid")
    return cut(together.mapInArrow(_link_slices, "a long, b long").distinct())


def _compared(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose texts are near copies, computed once."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    texts = cut(rows.join(needed, "rid", "left_semi").dropDuplicates(["rid"]))
    both = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
    return cut(both.mapInArrow(_alike, "a long, b long"))


def simhash_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``a > b`` of row keys whose SimHash fingerprints over SHINGLE words link: each row with the first of its fingerprint, and these along the links."""
    prints = cut(fingerprints(rows.select(F.col("rid").alias("doc_id"), "text"), SHINGLE))
    first = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    same = prints.join(first, "fp").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    links = near_links(first.select("fp"))
    low = first.select("fp", "low")
    across = links.join(low.withColumnsRenamed({"fp": "a", "low": "x"}), "a").join(low.withColumnsRenamed({"fp": "b", "low": "y"}), "b").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    return same.unionByName(across).filter("a <> b").distinct()


def row_key(docs: DataFrame) -> Column:
    """Hash of a row's doc_id and text."""
    return F.xxhash64(docs["doc_id"].cast("long"), F.coalesce(docs["text"], F.lit("")))


def near_copy_roots(rows: DataFrame) -> DataFrame:
    """``node, root`` for every row key of ``rows (rid, text)`` that has a near copy."""
    rows = rows.select("rid", "text")
    keyed = cut(rows.mapInArrow(_banded, "key long, rid long"))
    leaders = keyed.groupBy("key").agg(F.count("rid").alias("n"), F.min(F.struct(F.xxhash64("key", "rid").alias("o"), "rid"))["rid"].alias("leader")).filter("n > 1")
    shared = cut(keyed.join(leaders, "key"))
    stars = shared.filter("rid <> leader").select(F.greatest("rid", "leader").alias("a"), F.least("rid", "leader").alias("b"))
    links = _compared(cut(stars.unionByName(simhash_pairs(rows)).distinct()), rows)

    # What is still apart in a bucket of three or more.
    roots = components(links).withColumnRenamed("node", "rid")
    marked = shared.filter("n > 2").select("key", "rid").distinct().join(roots, "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("root"))
    mixed = marked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    return components(links.unionByName(_apart(cut(marked.join(mixed, "key")), rows)))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, that with the smallest doc_id, with all its columns.

    * A row is its doc_id and text: of rows that share a doc_id, each is judged by its own text.
    * Rows without a doc_id all stay, and so do rows that repeat the doc_id and text of one that stays.
    * Null and blank texts are copies of each other.
    """
    rows = docs.select(row_key(docs).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    roots = near_copy_roots(rows.select("rid", "text"))
    members = cut(roots.join(rows.select(F.col("rid").alias("node"), "doc_id").distinct(), "node").filter("doc_id IS NOT NULL"))
    first = members.groupBy("root").agg(F.min(F.struct("doc_id", "node"))["node"].alias("kept"))
    gone = members.join(first, "root").filter("node <> kept").select(F.col("node").alias("_rid")).distinct()
    return docs.join(gone, row_key(docs) == gone["_rid"], "left_anti")
