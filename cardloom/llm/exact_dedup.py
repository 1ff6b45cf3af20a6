"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a set of digest groups with one filter per digest bucket; neither is ever updated. An
incoming batch is grouped on its own first, so copies inside the batch meet each other once. Only the
batch's distinct digests are screened; those that a filter lets through join the snapshot's exact
buckets, and the bytes of every group that would merge rows are compared before it does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import cut

#: Digests per filter: a filter of this size takes about 75 kB.
KEYS_PER_FILTER = 1 << 16
#: Digests of two rows or more, 8 bytes each, that are broadcast; more of them are joined.
BROADCAST_ROWS = 1 << 20


# ---------------------------------------------------------------- binary-fuse filter

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.view(np.uint64) + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


@dataclass
class FuseFilter:
    """An 8-bit three-wise binary-fuse filter: no false negatives, one false positive in about 256."""

    seed: int
    segment: int
    segments: int
    cells: np.ndarray

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.segment - 1)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments * self.segment)) >> np.uint64(32)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """From int64 keys; repeats count once."""
        keys = np.unique(np.asarray(keys, np.int64))
        n = max(len(keys), 2)
        segment = 1 << max(2, int(np.log(n) / np.log(3.33) + 2.25))
        capacity = int(np.ceil(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))))
        segments = max(1, -(-capacity // segment) - 2)
        for seed in range(1, 200):
            out = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if out._solve(keys):
                return out
        raise ValueError("no seed of 200 gives a peelable graph; for three-wise fuse graphs one in two does")

    def _solve(self, keys: np.ndarray) -> bool:
        h = _mixed(keys, self.seed)
        slots = np.stack(self._slots(h))
        degree = np.zeros(len(self.cells), np.int64)
        owner = np.zeros(len(self.cells), np.int64)  # xor of the keys that still hold a slot
        for s in slots:
            np.add.at(degree, s, 1)
            np.bitwise_xor.at(owner, s, np.arange(len(keys)))
        rounds, left, lone = [], len(keys), np.flatnonzero(degree == 1)
        while len(lone):
            key, where = np.unique(owner[lone], return_index=True)  # a key alone in two slots takes one
            rounds.append((key, lone[where]))
            left -= len(key)
            touched = slots[:, key]
            for s in touched:
                np.add.at(degree, s, -1)
                np.bitwise_xor.at(owner, s, key)
            near = np.unique(touched)
            lone = near[degree[near] == 1]
        if left:
            return False
        prints = self._print(h)
        for key, at in reversed(rounds):
            a, b, c = slots[:, key]
            self.cells[at] = 0
            self.cells[at] = prints[key] ^ self.cells[a] ^ self.cells[b] ^ self.cells[c]
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For each int64 key, false only if it was not built in."""
        h = _mixed(np.asarray(keys, np.int64), self.seed)
        a, b, c = self._slots(h)
        return self._print(h) == self.cells[a] ^ self.cells[b] ^ self.cells[c]


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(rows["key64"].to_numpy())
    return pd.DataFrame([(rows["bucket"].iloc[0], f.seed, f.segment, f.segments, f.cells.tobytes())], columns=["bucket", "seed", "segment", "segments", "cells"])


def _screen(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(incoming) or not len(filters):
        return incoming.iloc[:0][["digest"]]
    x = filters.iloc[0]
    f = FuseFilter(int(x["seed"]), int(x["segment"]), int(x["segments"]), np.frombuffer(x["cells"], np.uint8))
    return incoming[f.contains(incoming["key64"].to_numpy())][["digest"]]


# ---------------------------------------------------------------- operators


def with_digests(docs: DataFrame, digest_hex: int = 64) -> DataFrame:
    """``doc_id, text, text_sha256, digest``; a null text is empty. ``digest`` is the first ``digest_hex`` digits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("text_sha256")).withColumn("digest", F.substring("text_sha256", 1, digest_hex))


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row per digest: how many rows have it and the last of them. Partial counts meet a hot digest before the shuffle."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("last")).withColumn("key64", F.xxhash64("digest"))


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One binary-fuse filter for each bucket of a snapshot's digests."""
    keyed = groups.select("key64", F.pmod("key64", F.lit(buckets)).alias("bucket"))
    return keyed.groupBy("bucket").applyInPandas(_build, "bucket long, seed long, segment long, segments long, cells binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The incoming digests that some filter lets through: all that the snapshot has, and few others."""
    keyed = groups.select("digest", "key64", F.pmod("key64", F.lit(buckets)).alias("bucket"))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_screen, "digest string")


def exact_dedup(docs: DataFrame, digest_hex: int = 64, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """Groups of byte-identical texts over all rows of ``docs (doc_id, text, ...)``.

    The older half of the id range is the immutable snapshot, the newer half the incoming batch.
    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    * Of a group the row with the largest doc_id stays; of rows that share that id too, one stays.
    * A null text is the empty text; empty texts are one group. A null doc_id sorts below all others.
    * Rows whose digests agree but whose bytes differ are never grouped.
    * An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    hashed = with_digests(docs, digest_hex)
    rows = cut(hashed.select("doc_id", "text_sha256", "digest").withColumn("row", F.monotonically_increasing_id()))
    ends = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    middle = None if ends.lo is None else ends.lo + (ends.hi - ends.lo) // 2
    incoming = F.coalesce(F.col("doc_id") > F.lit(middle).cast("long"), F.lit(False))
    snapshot, batch = cut(digest_groups(rows.filter(~incoming))), cut(digest_groups(rows.filter(incoming)))
    buckets = 1 + max(snapshot.count(), batch.count()) // keys_per_filter

    passed = screen(batch, build_filters(snapshot, buckets), buckets)
    hits = cut(snapshot.select("digest", F.col("n").alias("old_n"), F.col("last").alias("old_last")).join(batch.select("digest", "n", "last").join(passed, "digest", "left_semi"), "digest"))
    grown = snapshot.select("digest", "n", "last").join(hits.select("digest", F.col("n").alias("new_n"), F.col("last").alias("new_last")), "digest", "left")
    merged = grown.select("digest", (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("n"), F.greatest("last", "new_last").alias("last"))
    groups = cut(merged.unionByName(batch.select("digest", "n", "last").join(hits.select("digest"), "digest", "left_anti")))

    # Only texts whose digest another row has are looked at. The least and the greatest text of a digest are equal exactly if
    # all its texts are; partial extremes meet a hot digest before the shuffle.
    again = groups.filter("n > 1").select(F.xxhash64("digest").alias("key64")).distinct()
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    suspects = hashed.withColumn("key64", F.xxhash64("digest")).join(again, "key64", "left_semi")
    mixed = cut(suspects.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same")).filter(~F.col("same")).select("digest"))

    out = rows.join(groups, "digest").join(mixed, "digest", "left_anti") if not mixed.isEmpty() else rows.join(groups, "digest")
    told = [F.col("last.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("last.row") == F.col("row")).alias("kept"), "text_sha256"]
    result = out.select("doc_id", *told)
    if mixed.isEmpty():
        return result
    apart = hashed.select("doc_id", "text", "text_sha256", "digest").withColumn("row", F.monotonically_increasing_id()).join(mixed, "digest", "left_semi")
    by_text = apart.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "row")).alias("last"))
    return result.unionByName(apart.join(by_text, ["digest", "text"]).select("doc_id", *told))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns."""
    stay = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    names, own = docs.columns, "_sha_of"
    while own in names:
        own += "_"
    keyed = docs.withColumn(own, sha)
    found = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed[own] == stay["_sha"]), "left_semi")
    return found.dropDuplicates(["doc_id", own]).select(*names)
