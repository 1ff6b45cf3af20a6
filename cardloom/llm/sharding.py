"""Shards by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents with equal texts are linked. Every document starts in the shard that a hash of its row names. In each round
the links of a text vote with the shards of their documents, and a linked document asks to move to the shard that most
of its neighbours are in, among those with room. A shard with less room than requests lets each in with the same
chance, so that it stays within its quota as far as chance goes. Documents without links are put in last and make the
counts even, so evenness costs no link; whoever is over a quota by chance then is dealt out with them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.llm.shared import written

SHARDS, ROUNDS = 16, 12
#: A shard that grants less of its requests is closed for the rounds to come.
LEAST_SHARE = 0.01
#: Rows of a text that keep together where a text has to be split, and rows that one task numbers.
CHUNK, NUMBERED = 1_000, 50_000
#: Texts with more than one row in so many are joined by broadcast: there are at most this many.
HEAVY = 1_024


def _unit(*of: Column | str) -> Column:
    """A fixed number from 0 to 1 for each value."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def _met(rows: DataFrame, texts: DataFrame, heavy: int) -> DataFrame:
    """``rows`` with the columns of ``texts``, one row a key: few heavy keys are broadcast, so no task gets all rows of one."""
    large = texts.filter(F.col("n") > heavy).drop("n")
    return rows.filter(F.col("n") > heavy).join(F.broadcast(large), "key").unionByName(rows.filter(F.col("n") <= heavy).join(texts.filter(F.col("n") <= heavy).drop("n"), "key"))


def linked_rows(docs: DataFrame) -> DataFrame:
    """``row, doc_id, size, text_crc32, key, n``: ``key`` is the text's SHA-256, ``n`` how many rows have it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    shared = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = rows.count()
    large = shared.filter(F.col("n") > max(1, total // HEAVY))
    hit = rows.join(F.broadcast(large), "key", "left")
    rest = hit.filter("n IS NULL").drop("n").join(shared.filter(F.col("n") <= max(1, total // HEAVY)), "key", "left")
    return written(hit.filter("n IS NOT NULL").unionByName(rest.withColumn("n", F.coalesce("n", F.lit(1)))))


def admitted(wants: dict[tuple[int, int], int], sizes: dict[int, int], quota: float) -> dict[int, float]:
    """The share of requests that each shard grants, from ``wants`` by (shard, wish): the largest under which no shard outgrows its quota.

    All begin at 1 and are lowered where what comes in is more than the room and what goes out, until nothing changes.
    """
    share = {j: 1.0 for _, j in wants}
    asked = {j: sum(n for (_, k), n in wants.items() if k == j) for j in share}
    for _ in range(1_000):
        leaves = {j: sum(n * share[k] for (i, k), n in wants.items() if i == j) for j in share}
        lower = {j: min(share[j], max(0.0, quota - sizes.get(j, 0) + leaves[j]) / asked[j]) for j in share}
        if all(share[j] - lower[j] < 1e-6 for j in share):
            return lower
        share = lower
    return share


def propagate(linked: DataFrame, quota: float, shards: int, rounds: int, heavy: int) -> DataFrame:
    """``linked (row, key, n, shard)`` after at most ``rounds`` rounds; it ends early once no document wants to move.

    To the driver go, each round, one number a shard and one a pair of shards.
    """
    closed: set[int] = set()
    for turn in range(rounds):
        tally = linked.groupBy("key", "n").agg(*[F.count_if(F.col("shard") == s).alias(f"s{s}") for s in range(shards)])
        # what a shard offers: its votes, then a number of the text's own, so that all its documents see the same order
        offer = [F.struct(F.col(f"s{s}").alias("votes"), F.xxhash64("key", F.lit(s)).alias("tie"), F.lit(s).alias("shard")) for s in range(shards)]
        votes = tally.select("key", "n", F.array(*offer).alias("offers"))
        own = F.element_at("offers", F.col("shard") + 1)
        best = F.array_max(F.filter("offers", lambda o: (o["votes"] > 0) & ~o["shard"].isin(*closed)))
        wish = F.when(best > own, best["shard"])
        asked = written(_met(linked, votes, heavy).select("row", "key", "n", "shard", wish.alias("wish")))
        counts = asked.groupBy("shard", "wish").agg(F.count(F.lit(1)).alias("k")).collect()
        wants = {(r.shard, r.wish): r.k for r in counts if r.wish is not None}
        if not wants:
            return linked
        sizes = {s: sum(r.k for r in counts if r.shard == s) for s in range(shards)}
        share = admitted(wants, sizes, quota)
        chance = F.element_at(F.array(*[F.lit(share.get(s, 0.0)) for s in range(shards)]), F.col("wish") + 1)
        moves = F.col("wish").isNotNull() & (_unit("row", F.lit(turn)) < chance)
        linked = written(asked.select("row", "key", "n", F.when(moves, F.col("wish")).otherwise(F.col("shard")).alias("shard")))
        closed |= {s for s, x in share.items() if x < LEAST_SHARE}
    return linked


def _ranked(rows: DataFrame, by: list[str], total: int) -> DataFrame:
    """Adds ``rank`` from 0 within ``by`` (at most as many values as shards), in the order of ``place``, a hash.

    Rows are numbered within buckets of ``place``, each of a bounded size as it is a hash of at most ``CHUNK`` rows; bases
    come from the buckets' counts.
    """
    bits = max(1, math.ceil(math.log2(max(2, total / NUMBERED))))
    bucketed = rows.withColumn("_bucket", F.shiftrightunsigned("place", 64 - bits))
    inner = W.partitionBy(*by, "_bucket").orderBy("place", "key", "row")
    counts = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_k"))
    outer = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.withColumn("_base", F.coalesce(F.sum("_k").over(outer), F.lit(0))).drop("_k")
    numbered = bucketed.withColumn("_at", F.row_number().over(inner) - 1).join(bases, [*by, "_bucket"])
    return numbered.withColumn("rank", F.col("_base") + F.col("_at")).drop("_bucket", "_at", "_base")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs (doc_id, text, ...)``.

    The law is ``rows``: the counts of two shards differ by one at most. ``size`` is the text's UTF-8 bytes and 1.

    * A text that fits into a shard is in one shard, unless it was let in by chance in part; larger ones are split.
    * A null text is an empty one, and empty texts are linked as any others. Null and repeated ids stand for themselves: rows are dealt, not ids.
    * Fewer documents than shards leave shards empty; an empty table gives no rows. Other columns are ignored.
    """
    rows = linked_rows(docs)
    total = rows.count()
    heavy = max(1, total // HEAVY)
    start = rows.filter("n > 1").select("row", "key", "n", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    linked = propagate(written(start), total / shards, shards, rounds, heavy)

    # A text's rows keep together in chunks where they are split: the place of a chunk is one hash.
    chunk = F.when(F.col("n") > CHUNK, F.pmod(F.xxhash64("row"), F.greatest(F.call_function("div", F.col("n"), F.lit(CHUNK)), F.lit(1)))).otherwise(0)
    placed = rows.join(linked.select("row", "shard"), "row", "left").withColumn("place", F.xxhash64("key", chunk))
    placed = written(placed)
    inside = _ranked(placed.filter("shard IS NOT NULL"), ["shard"], total)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    fits = F.col("rank") < F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("shard") + 1)
    inside = written(inside.withColumn("fits", fits))
    taken = {r.shard: r.k for r in inside.filter("fits").groupBy("shard").agg(F.count(F.lit(1)).alias("k")).collect()}
    stay = inside.filter("fits").withColumnRenamed("rank", "slot").drop("fits")

    spare = placed.filter("shard IS NULL").unionByName(inside.filter("NOT fits").drop("fits", "rank")).withColumn("_all", F.lit(0))
    spare = _ranked(spare, ["_all"], total)
    shard, slot, until = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        begins, until = until, until + quota[s] - taken.get(s, 0)
        here = (F.col("rank") >= begins) & (F.col("rank") < until)
        shard, slot = F.when(here, F.lit(s)).otherwise(shard), F.when(here, F.col("rank") - begins + taken.get(s, 0)).otherwise(slot)
    dealt = spare.withColumns({"shard": shard, "slot": slot})
    told = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    return stay.select(*told).unionByName(dealt.select(*told))


def cut_links(placed: DataFrame, key: str, shard: str = "shard") -> DataFrame:
    """One row: ``links`` between documents of one ``key``, and how many of these go from shard to shard. Pairs are counted, never made."""
    pairs = lambda n: n * (n - 1) / 2
    cells = placed.groupBy(key, shard).agg(F.count(F.lit(1)).alias("n"))
    texts = cells.groupBy(key).agg(pairs(F.sum("n")).alias("links"), F.sum(pairs(F.col("n"))).alias("kept"))
    return texts.agg(F.coalesce(F.sum("links"), F.lit(0.0)).cast("long").alias("links"), F.coalesce(F.sum(F.col("links") - F.col("kept")), F.lit(0.0)).cast("long").alias("cut_links"))
