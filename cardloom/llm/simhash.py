"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Every bit of a fingerprint gets a vector of ``radius + 1`` bits; each nonzero vector v makes a table
whose mask keeps the bits with an odd inner product with v. A pair that differs in at most ``radius`` bits
has ``radius`` vectors at most to be orthogonal to, so some v is orthogonal to all of them, and in v's table the pair
agrees on every kept bit. No pair within the radius is missed.

A bucket with more fingerprints than ``bucket_rows`` is taken apart again: the bits that its mask
drops are cut into blocks, and since at most ``radius`` blocks differ in a linked pair, every choice
of blocks that may differ makes a bucket of its own, with no more members than these bits have values.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.components import components
from cardloom.llm.shared import cut

BITS = 64
RADIUS = 3
SHINGLE = 3
#: Distinct fingerprints compared directly in one bucket.
BUCKET_ROWS = 4096
#: Blocks that the open bits of a large bucket are cut into.
BLOCKS = 10


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is set if more than half of the shingles' XXH64 (seed 42) have it; zero without words."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    counts, n = np.zeros(BITS, np.int64), 0
    for at in range(0, max(1, len(words) - shingle + 1), 1 << 16):
        some = words[at : at + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*(some[k:] for k in range(shingle)), strict=False)) if len(some) >= shingle else [b" ".join(some)]
        digests = b"".join([xxhash.xxh64_digest(g, 42) for g in grams])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the 64 bits as a signed long. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- links


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2 ** (radius + 1) - 1 masks; any ``radius`` bits are all dropped by one of them."""
    vectors = [v for v in product((0, 1), repeat=radius + 1) if any(v)]
    of_bit = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i, p in enumerate(of_bit) if sum(a * b for a, b in zip(p, v, strict=True)) % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer_masks(mask: int, radius: int = RADIUS, blocks: int = BLOCKS, bits: int = BITS) -> list[int]:
    """Masks within ``mask``'s buckets: all bits but ``radius`` blocks of the dropped ones."""
    dropped = [i for i in range(bits) if not mask >> i & 1]
    parts = [sum(1 << i for i in dropped[k::blocks]) for k in range(min(blocks, len(dropped)))]
    if len(parts) <= radius:
        return [mask]
    full = (1 << bits) - 1
    return [full & ~sum(c) for c in combinations(parts, radius)]


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is within the radius, one fewer than members for each group that they join."""
    parent = np.arange(len(fps))
    bits = fps.view(np.uint64)
    out: list[tuple[int, int]] = []
    for i in range(len(fps) - 1):
        near = i + 1 + np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= radius)
        if not len(near):
            continue
        old = np.unique(parent[near])
        mine = parent[i]
        for p in old[old != mine].tolist():
            j = int(near[np.argmax(parent[near] == p)])
            out.append((int(fps[i]), int(fps[j])))
            parent[parent == p] = mine
    return out


def _link_sorted(radius: int):
    """Over rows sorted by bucket: links inside each bucket, joined into stars over all buckets of the task.

    Holds one bucket's rows at a time, and of the links one entry for each fingerprint that has any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def join(links: list[tuple[int, int]]) -> None:
            for a, b in links:
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)

        def take(parts: list, final: bool) -> list:
            tab, key, fp = (np.concatenate([p[k] for p in parts]) for k in range(3))
            starts = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[starts[1:], len(fp)]
            rest = [] if final else [(tab[starts[-1] :], key[starts[-1] :], fp[starts[-1] :])]
            if not final:
                starts, ends = starts[:-1], ends[:-1]
            size = ends - starts
            two = starts[size == 2]  # the common case, all at once
            close = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
            join(list(zip(fp[two][close].tolist(), fp[two + 1][close].tolist(), strict=True)))
            for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                join(_forest(fp[a:b], radius))
            return rest

        for batch in batches:
            if batch.num_rows:
                held = take([*held, tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("tab", "key", "fp"))], False)
        if held:
            take(held, True)
        stars = [(x, r) for x in list(parent) if (r := root(x)) != x]
        for at in range(0, len(stars), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars[at : at + 100_000]], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """``tab, key, fp`` rows, each bucket small, to links."""
    together = buckets.select("tab", "key", "fp").repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")
    return together.mapInArrow(_link_sorted(radius), "a long, b long")


def near_links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that connect exactly what pairs within ``radius`` connect."""
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    keyed = fps.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.tab").alias("tab"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    sizes = keyed.groupBy("tab", "key").agg(F.count("fp").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["tab", "key"]))
    links = _bucket_links(shared.filter(F.col("n") <= bucket_rows), radius)
    large = shared.filter(F.col("n") > bucket_rows)
    if large.isEmpty():
        return links
    finer = F.array(*[F.array(*[F.lit(_signed(m)) for m in finer_masks(mask, radius, blocks)]) for mask in masks])
    apart = large.select("fp", "tab", F.posexplode(F.element_at(finer, F.col("tab") + 1)).alias("k", "mask"))
    apart = apart.select((F.col("tab") * 1000 + F.col("k") + 1000).alias("tab"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return links.unionByName(_bucket_links(apart, radius))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs (doc_id, text, ...)``.

    Fingerprints link at ``radius`` or fewer differing bits; the component's id is the smallest doc_id reached.

    * A null, empty or blank text has the fingerprint zero, linked like any other.
    * Repeated rows all stay, with one component. A null doc_id stays null; a component of such rows alone has a null id.
    * An empty table gives no rows. Other columns are ignored. Texts of any length are read whole.
    """
    rows = cut(fingerprints(docs, shingle))
    known = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_links(known.select("fp"), radius, bucket_rows)).withColumnsRenamed({"node": "fp"})
    rooted = known.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(rooted.join(lowest, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
