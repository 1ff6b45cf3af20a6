"""Pieces that several training-data operators need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster sets it.

    Only where it is unset on one machine, as in tests, a temporary folder is chosen and set; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, label: str) -> str:
    """A path, not yet made, in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once into a table in the shared folder, and read from there.

    Unlike a checkpoint, which carries on an estimate of its size that grows with every join before it, the table has the
    size of its files: many rounds of joins stay quick to plan, and small tables are known to be small.
    """
    path = new_folder(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key, written as text, leaves this remainder; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def scanned(rows: DataFrame, by: str, order: list[str], sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``at``, the place from 1 of each row among those of its ``by``, and makes the longs of ``sums`` and ``xors`` running values.

    Rows are sorted by ``by`` and ``order`` (nulls first) over range partitions, so a key of any size is spread over many
    tasks. A partition is scanned in batches; what it carries over to the next one is one row, and these rows, one a
    partition, are all that passes through the driver. Rows that are equal in all these columns are interchangeable.
    """
    added = ("_part", "_seq", "at")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, carry = TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, index = batch.column(by), np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[0] = True
            fresh[np.asarray(pc.run_end_encode(keys).run_ends)[:-1]] = True
            start = np.maximum.accumulate(np.where(fresh, index, 0))
            goes_on = (start == 0) if seen and keys[0].as_py() == last else np.zeros(n, bool)
            at = index - start + 1 + np.where(goes_on, carry.get("at", 0), 0)
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            for c in sums:
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(v)
                run = total - total[start] + v[start] + np.where(goes_on, carry.get(c, 0), 0)
                out[c], carry[c] = pa.array(run), run[-1]
            for c in xors:
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.bitwise_xor.accumulate(v)
                run = total ^ total[start] ^ v[start] ^ np.where(goes_on, carry.get(c, 0), 0)
                out[c], carry[c] = pa.array(run), run[-1]
            carry["at"], last = at[-1], keys[-1].as_py()
            out |= {"_part": pa.array(np.full(n, part, np.int32)), "_seq": pa.array(index + seen + 1), "at": pa.array(at)}
            seen += n
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "_part int, _seq long, at long"])
    local = written(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).mapInArrow(scan, schema))
    told = [*sums, *xors]
    ends = local.groupBy("_part").agg(F.max_by(F.struct("_seq", F.col(by).alias("_by"), "at", *told), "_seq").alias("e")).select("_part", "e.*").orderBy("_part").collect()
    before, key, total = [], None, None
    for e in ends:
        if total is not None:
            before.append((e["_part"], key, *total))
        mine = [e["at"], *(e[c] for c in told)]
        if total is not None and e["_by"] == key and e["at"] == e["_seq"]:  # the whole partition goes on with the key
            mine = [a + b for a, b in zip(mine[: 1 + len(sums)], total, strict=False)] + [a ^ b for a, b in zip(mine[1 + len(sums) :], total[1 + len(sums) :], strict=True)]
        key, total = e["_by"], mine
    if not before:
        return local.drop("_part", "_seq")
    kind = rows.schema[by].dataType.simpleString()
    offsets = rows.sparkSession.createDataFrame(before, f"_on int, _key {kind}, _at long" + "".join(f", _{c} long" for c in told))
    met = local.join(F.broadcast(offsets), (F.col("_part") == F.col("_on")) & F.col(by).eqNullSafe(F.col("_key")), "left")
    more = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("at", *sums)} | {c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) for c in xors}
    return met.withColumns(more).select(*rows.columns, added[-1])
