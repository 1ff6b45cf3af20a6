"""Best-fit packing of documents into token sequences, with a certificate from dual-feasible functions.

Pieces are dealt into groups of bounded size, and each group is packed by best-fit decreasing. A lower
bound on sequences certifies each group's packing: where its sequences meet the bound, the group alone can
save nothing. Groups with a gap between the two release every sequence that is not full; certified groups, which may
still lose what their bounds were rounded up by, release their least filled one. What is released is dealt into groups anew and
packed again. This ends when the whole packing meets the bound of all lengths, or when rounds in a row save nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import cut
from cardloom.llm.tokens import encoded

#: Pieces packed in one task's group.
GROUP_PIECES = 20_000
#: Exchanges in a row that may save nothing, each with other groups, before the packing counts as final.
PATIENCE = 3


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of these lengths (1 to capacity) has fewer sequences."""
    return histogram_bound(np.bincount(lengths, minlength=capacity + 1), capacity)


def length_bound(pieces: DataFrame, capacity: int) -> int:
    """The same over a table's ``length``: its histogram has ``capacity`` rows at most."""
    count = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return histogram_bound(count, capacity)


def histogram_bound(count: np.ndarray, capacity: int) -> int:
    """The bound for ``count[n]`` pieces of each length n.

    The largest of two families of dual-feasible functions, applied to the histogram of lengths: one
    rounds what is over ``capacity - e`` up and drops what is under ``e``; the other scales by k + 1 and
    rounds down.
    """
    size = np.arange(capacity + 1)
    some, tokens = np.cumsum(count), np.cumsum(count * size)
    e = np.arange(1, capacity // 2 + 1)
    kept = tokens[capacity - e] - tokens[e - 1] + capacity * (some[capacity] - some[capacity - e])
    best = int(max(-(-int(tokens[-1]) // capacity), *(-(-kept // capacity)))) if len(e) else -(-int(tokens[-1]) // capacity)
    for k in range(1, min(64, capacity)):
        grown = (k + 1) * size
        value = np.where(grown % capacity == 0, k * size, capacity * (grown // capacity))
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length its sequence and its place there, and the fill of each sequence. Equal lengths go in input order."""
    sequence, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if some sequence has room r
    fill: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = open_by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        sequence[i], place[i] = b, fill[b]
        fill[b] += n
        if room > n:
            left = open_by_room.setdefault(room - n, [])
            if not left:
                rooms |= 1 << (room - n)
            left.append(b)
    return sequence, place, np.array(fill, np.int64)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each text and the end id, cut only where they exceed ``capacity``; then only the first piece may be shorter."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids in encoded(batches, tokenizer_path, end_id):
            out: list[tuple] = []
            for doc, x in zip(doc_ids, ids, strict=True):
                head = len(x) % capacity or capacity
                for k, a in enumerate([0, *range(head, len(x), capacity)]):
                    to = min(head if k == 0 else a + capacity, len(x))
                    out.append((doc, k, a, to - a, zlib.crc32(x[a:to].tobytes())))
            doc, piece, start, length, crc = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


PACKED = "row long, length long, grp long, bin long, offset long, fill long, least long, bins long, bound long"


def _pack_groups(rows: DataFrame, groups: int, capacity: int, salt: int) -> DataFrame:
    """Deals ``row, length`` into groups and packs each."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", ignore_index=True)
        lengths = part["length"].to_numpy()
        sequence, place, fill = best_fit_decreasing(lengths, capacity)
        return part.assign(bin=sequence, offset=place, fill=fill[sequence], least=fill.min(), bins=len(fill), bound=lower_bound(lengths, capacity))[[c.split()[0] for c in PACKED.split(", ")]]

    dealt = rows.select("row", "length", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(groups)).alias("grp"))
    return dealt.groupBy("grp").applyInPandas(pack, PACKED)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity`` and a unique ``row``.

    Every piece is placed, every sequence is gapless from offset 0. An empty table gives no rows.
    """
    settled: DataFrame | None = None
    packed = cut(_pack_groups(pieces, 1 + pieces.count() // group_pieces, capacity, 0)).withColumn("turn", F.lit(0))
    used, fewest = packed.select("grp", "bin").distinct().count(), length_bound(pieces, capacity)
    turn = idle = 0
    loose = F.when(F.col("bins") > F.col("bound"), F.col("fill") < capacity).otherwise((F.col("fill") == F.col("least")) & (F.col("fill") < capacity))
    while used > fewest and idle < PATIENCE:
        turn += 1
        released = packed.filter(loose)
        seen = released.agg(F.count("row").alias("n"), F.countDistinct("grp", "bin").alias("bins"), F.countDistinct("grp").alias("groups")).first()
        if seen.groups < 2:
            break
        again = cut(_pack_groups(released, 1 + seen.n // group_pieces, capacity, turn)).withColumn("turn", F.lit(turn))
        saved = seen.bins - again.select("grp", "bin").distinct().count()
        idle = 0 if saved > 0 else idle + 1
        if saved > 0:
            used -= saved
            final = packed.filter(~loose)
            settled = final if settled is None else settled.unionByName(final)
            packed = again
    placed = packed if settled is None else settled.unionByName(packed)
    number = F.shiftleft(F.col("turn").cast("long"), 56) + F.shiftleft(F.col("grp"), 32) + F.col("bin")
    return pieces.join(placed.select("row", number.alias("sequence_id"), "offset"), "row")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every row of ``docs (doc_id, text, ...)`` into sequences of at most ``capacity`` tokens.

    Returns per piece ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    * A null or empty text is the end id alone. A null doc_id stays null. Repeated rows are packed each.
    * Texts of any length are cut into pieces of ``capacity`` tokens; the first piece may be shorter.
    * An empty table gives no rows. Other columns are ignored.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """Sequences used, and the fewest that any packing of all these pieces has."""
    return packed.select("sequence_id").distinct().count(), length_bound(packed, capacity)
