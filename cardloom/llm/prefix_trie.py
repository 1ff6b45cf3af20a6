"""The prefix tree of conversations as a z-fast trie that is kept in tables.

A prefix is known by its depth and a 128-bit fingerprint, the exclusive or of a hash of each of its turns with its
place. The trie is compacted: a node is the root, the end of a conversation, or a prefix that goes on in more than one
way. Nodes are found by their handle, the prefix at the two-fattest depth of their edge (the depth with the most
trailing zeros), so that a fat binary search locates where a conversation leaves the trie in as many joins as its
length has bits. Conversations come in batches: a batch is located, edges are split where its conversations leave them,
and what is below is added. Sums over subtrees go along pointers that double their reach, and at last edges are
expanded to one row a depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.llm.shared import scanned, written

#: Conversations of a group share the first turns of its first one; so many at most, less one.
GROUP, MOST_SHARED = 5, 9
BATCHES = 2
#: Turns of one conversation, or ids of one node, that meet in a task where a key is dealt out in chunks.
CHUNK = 4_096
#: Prefixes with more than one turn row in so many are joined by broadcast: there are at most this many.
HEAVY = 1_024

KEY = ["depth", "a", "b"]
NODE = "depth long, a long, b long, rep long, up long, ua long, ub long, na long, nb long, hd long, ha long, hb long"


def two_fattest(low: Column, high: Column) -> Column:
    """The number over ``low`` and up to ``high`` with the most trailing zeros; null where there is none."""
    bits = (F.length(F.bin(low.bitwiseXOR(high))) - 1).cast("int")
    return F.when(low < high, F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits))


def _chunked(few: DataFrame, last: str) -> DataFrame:
    """A row for each chunk of 0 to ``last``, so that a long conversation's rows meet it in many tasks."""
    return few.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col(last), F.lit(CHUNK)))))


def _chunk_of(place: str) -> Column:
    return F.call_function("div", F.col(place), F.lit(CHUNK)).alias("_chunk")


def _met(rows: DataFrame, few: DataFrame, heavy: DataFrame, spread: str) -> DataFrame:
    """``rows`` left-joined with ``few`` by prefix. Heavy prefixes are broadcast, found or not, and their rows dealt out by ``spread``."""
    kept = [c for c in few.columns if c not in KEY]
    packed = few.select(*KEY, F.struct(*kept).alias("_v"))
    large = heavy.join(F.broadcast(packed.join(F.broadcast(heavy), KEY)), KEY, "left").select(*KEY, F.lit(True).alias("_large"), F.col("_v").alias("_w"))
    keyed = rows.join(F.broadcast(large), KEY, "left").withColumns({"_d": F.when(F.col("_large"), -1).otherwise(F.col("depth")), "_a": F.when(F.col("_large"), F.col(spread)).otherwise(F.col("a")), "_b": F.col("b")})
    found = keyed.join(packed.select(F.col("depth").alias("_d"), F.col("a").alias("_a"), F.col("b").alias("_b"), "_v"), ["_d", "_a", "_b"], "left")
    value = F.coalesce("_w", "_v")
    return found.select(*rows.columns, *(value[c].alias(c) for c in kept))


# ---------------------------------------------------------------- conversations as paths


def rebuilt_turns(conversations: DataFrame, group: int = GROUP, most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """``convs (conv_id)`` and ``turns (conv_id, depth, turn, size)``: each conversation behind the first turns of its group's first one."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    spelled = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", spelled.alias("key"), F.octet_length(text).cast("long").alias("size"))
    turns = scanned(rows, "conv_id", ["turn", "key"]).drop("turn")
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = written(counts.select("conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lengths, "base", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))).select("conv_id", "n", "h", "base", "k")
    first = turns.filter(F.col("at") < most).withColumnRenamed("conv_id", "base").join(convs.select("base", "conv_id", "h"), "base").filter("at <= h")
    own = turns.withColumn("_chunk", _chunk_of("at")).join(_chunked(convs, "n"), ["conv_id", "_chunk"]).filter("at > h")
    told = lambda depth: ["conv_id", depth.alias("depth"), "key", "size"]
    return convs.select("conv_id"), first.select(*told(F.col("at"))).unionByName(own.select(*told(F.col("k") + F.col("at") - F.col("h"))))


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, a, b, pa, pb, size, upto``: fingerprints of each prefix and of the one before, bytes of the last turn and of all."""
    mixed = turns.select("conv_id", "depth", "size", F.xxhash64("key", "depth").alias("ra"), F.xxhash64(F.lit(1), "key", "depth").alias("rb"))
    rows = scanned(mixed.withColumns({"a": F.col("ra"), "b": F.col("rb"), "upto": F.col("size")}), "conv_id", ["depth"], sums=("upto",), xors=("a", "b"))
    return rows.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ra")).alias("pa"), F.col("b").bitwiseXOR(F.col("rb")).alias("pb"), "size", "upto")


# ---------------------------------------------------------------- the trie


class Trie:
    """Nodes but the root, one row each: their extent (``depth, a, b``), a conversation ``rep`` through it, the extent ``up, ua, ub`` of
    the node above, the name ``na, nb`` (prefix one deeper than ``up``) and the handle ``hd, ha, hb``.

    ``steps (sid, depth, a, b, pa, pb, size, upto)``: the prefixes of each distinct conversation; ``heavy`` those of very many.
    """

    def __init__(self, steps: DataFrame, heavy: DataFrame, longest: int):
        self.steps, self.heavy, self.longest, self.nodes = steps, heavy, longest, None

    def _step(self, rows: DataFrame, sid: str, depth: Column, out: str) -> DataFrame:
        """Adds ``out``: the step of conversation ``sid`` at ``depth``, null where it has none."""
        at = self.steps.select(F.col("sid").alias("_sid"), F.col("depth").alias("_at"), F.struct("a", "b", "size", "upto").alias(out))
        keyed = rows.withColumns({"_sid": F.col(sid), "_at": depth})
        return keyed.join(at, ["_sid", "_at"], "left").drop("_sid", "_at")

    def locate(self, batch: DataFrame) -> DataFrame:
        """``sid, length, base, ba, bb``, and the edge below it that the conversation enters, if any: ``e_depth, e_a, e_b, e_rep, e_up, e_ua, e_ub``.

        ``base`` is the deepest node whose whole extent is a prefix of the conversation.
        """
        zero = F.lit(0).cast("long")
        state = batch.select("sid", "length", zero.alias("low"), F.col("length").alias("high"), F.struct(*(zero.alias(c) for c in ("x", "xa", "xb", "up", "ua", "ub"))).alias("node"))
        if self.nodes is None:
            none = [F.lit(None).cast("long").alias(f"e_{c}") for c in ("depth", "a", "b", "rep", "up", "ua", "ub")]
            return state.select("sid", "length", zero.alias("base"), zero.alias("ba"), zero.alias("bb"), *none)
        handles = self.nodes.select(F.col("hd").alias("depth"), F.col("ha").alias("a"), F.col("hb").alias("b"), F.struct(F.col("depth").alias("x"), F.col("a").alias("xa"), F.col("b").alias("xb"), "up", "ua", "ub").alias("hit"))
        for _ in range(self.longest.bit_length()):
            asked = self._step(state.withColumn("f", two_fattest(F.col("low"), F.col("high"))), "sid", F.col("f"), "s")
            done = F.col("f").isNull()
            keyed = asked.select("*", F.when(done, -1).otherwise(F.col("f")).alias("depth"), F.when(done, F.col("sid")).otherwise(F.col("s.a")).alias("a"), F.coalesce("s.b", zero).alias("b"))
            met = _met(keyed, handles, self.heavy, "sid")
            hit = F.col("hit").isNotNull()
            state = met.select("sid", "length", F.when(hit, F.col("hit.x")).otherwise(F.col("low")).alias("low"), F.when(done | hit, F.col("high")).otherwise(F.col("f") - 1).alias("high"), F.coalesce("hit", "node").alias("node"))
        # the last node found by handle either is a prefix of the conversation or is the node of the edge where it leaves
        x = F.col("node.x")
        known = self._step(written(state), "sid", x, "s")
        whole = (x == 0) | F.coalesce((F.col("s.a") == F.col("node.xa")) & (F.col("s.b") == F.col("node.xb")), F.lit(False))
        pick = lambda c, d: F.when(whole, F.col(f"node.{c}")).otherwise(F.col(f"node.{d}"))
        based = known.select("sid", "length", pick("x", "up").alias("base"), pick("xa", "ua").alias("ba"), pick("xb", "ub").alias("bb"))
        named = self._step(based, "sid", F.col("base") + 1, "s")
        none = F.col("s").isNull()
        keyed = named.select("sid", "length", "base", "ba", "bb", F.when(none, -1).otherwise(F.col("base") + 1).alias("depth"), F.when(none, F.col("sid")).otherwise(F.col("s.a")).alias("a"), F.coalesce("s.b", zero).alias("b"))
        names = self.nodes.select((F.col("up") + 1).alias("depth"), F.col("na").alias("a"), F.col("nb").alias("b"), *(F.col(c).alias(f"e_{c}") for c in ("depth", "a", "b", "rep", "up", "ua", "ub")))
        return _met(keyed, names, self.heavy, "sid").drop(*KEY)

    def insert(self, batch: DataFrame) -> None:
        """Adds the conversations of ``batch (sid, length, a, b)``, which are distinct."""
        located = written(self.locate(batch))
        below = self.steps.withColumn("_chunk", _chunk_of("depth")).join(_chunked(located.select("sid", "length", "base", "e_rep", "e_depth"), "length"), ["sid", "_chunk"]).filter("depth > base")
        below = written(below.select("sid", *KEY, "pa", "pb", "base", "length", "e_rep", "e_depth"))
        # what of the edge that it enters a conversation shares
        edge = below.filter("depth <= e_depth").select(F.col("e_rep").alias("sid"), *KEY).distinct().join(self.steps.select("sid", *KEY), ["sid", *KEY]).select(*KEY, F.lit(True).alias("held"))
        opened = written(_met(below, written(edge), self.heavy, "sid").withColumn("held", F.coalesce("held", F.lit(False))))
        deepest = F.max(F.when(F.col("held"), F.struct(*KEY))).alias("split")
        left = written(located.join(opened.groupBy("sid").agg(deepest), "sid", "left"))
        leaves_at = F.coalesce("split", F.struct(F.col("base").alias("depth"), F.col("ba").alias("a"), F.col("bb").alias("b")))

        # edges split where conversations leave them or end
        splits = left.filter("split IS NOT NULL").select("split", *(c for c in left.columns if c.startswith("e_"))).distinct()
        w = W.partitionBy("e_depth", "e_a", "e_b").orderBy("split.depth")
        above = F.coalesce(F.lag("split").over(w), F.struct(F.col("e_up").alias("depth"), F.col("e_ua").alias("a"), F.col("e_ub").alias("b")))
        pieces = splits.select("split.*", F.col("e_rep").alias("rep"), above.alias("above"))
        shorter = splits.groupBy("e_depth", "e_a", "e_b", "e_rep").agg(F.max("split").alias("above")).select(F.col("e_depth").alias("depth"), F.col("e_a").alias("a"), F.col("e_b").alias("b"), F.col("e_rep").alias("rep"), "above")

        # what no conversation had before: ends, and prefixes that go on in more than one way
        fresh = opened.filter("NOT held")
        one = fresh.groupBy(*KEY, "pa", "pb").agg(F.min("sid").alias("rep"), F.max(F.col("depth") == F.col("length")).alias("ends"))
        one = written(one)
        forks = one.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("ways")).filter("ways > 1")
        tails = written(one.join(forks, KEY, "left").filter("ends OR ways > 1").select(*KEY, "rep"))
        along = _met(fresh.select("sid", *KEY), tails, self.heavy, "sid").filter("rep IS NOT NULL")
        chained = along.withColumn("above", F.lag(F.struct(*KEY)).over(W.partitionBy("sid").orderBy("depth"))).filter("rep = sid")
        tops = chained.join(left.select("sid", leaves_at.alias("top")), "sid").select(*KEY, "rep", F.coalesce("above", "top").alias("above"))

        added = tops.unionByName(pieces).unionByName(shorter).select(*KEY, "rep", F.col("above.depth").alias("up"), F.col("above.a").alias("ua"), F.col("above.b").alias("ub"))
        added = self._step(self._step(written(added), "rep", F.col("up") + 1, "n"), "rep", two_fattest(F.col("up"), F.col("depth")), "h")
        added = added.select(*KEY, "rep", "up", "ua", "ub", F.col("n.a").alias("na"), F.col("n.b").alias("nb"), two_fattest(F.col("up"), F.col("depth")).alias("hd"), F.col("h.a").alias("ha"), F.col("h.b").alias("hb"))
        old = added if self.nodes is None else self.nodes.join(shorter.select(*KEY), KEY, "left_anti").unionByName(added)
        self.nodes = written(old)


def digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each prefix, ascending and joined by commas.

    A digest is taken byte after byte, so the ids of one prefix stream through one task in the end; they come there as
    texts of a range of ids each, made in parallel, and the task holds one of these at a time.
    """
    texts = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy(*KEY, F.floor(F.col("conv_id") / CHUNK).alias("part")).agg(texts.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in KEY), batch.column("ids").to_pylist(), strict=True):
                if now != key:
                    done += [(*key, state.hexdigest())] if state else []
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digest_batch(done)
        if state:
            yield _digest_batch([(*key, state.hexdigest())])

    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "part").select(*KEY, "ids").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [*KEY, "ends_sha256"])


SUMS = ("members", "member_bytes", "edge_bytes", "leaves")


def subtree_sums(nodes: DataFrame, heavy: DataFrame) -> DataFrame:
    """``SUMS`` and ``first`` of ``nodes`` (with ``up, ua, ub``) summed over each node's subtree, itself included.

    In each round a node adds what has been summed below those whose pointer meets it, and pointers jump to their
    pointer's pointer: as many rounds as the tree's height has bits.
    """
    top = F.col("up") == 0
    pointer = [F.when(~top, F.col(c)).alias(p) for c, p in zip(("up", "ua", "ub"), ("pd", "pa", "pb"), strict=True)]
    state = written(nodes.select(*KEY, *pointer, *SUMS, "first"))
    while not (moving := state.filter("pd IS NOT NULL")).isEmpty():
        adds = [F.sum(c).alias(f"_{c}") for c in SUMS] + [F.min("first").alias("_first")]
        given = moving.groupBy(F.col("pd").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(*adds)
        jumps = state.select(*KEY, F.struct("pd", "pa", "pb").alias("jump"))
        rows = state.withColumnsRenamed({"depth": "d0", "a": "a0", "b": "b0"}).withColumn("_spread", F.xxhash64("d0", "a0", "b0"))
        asked = rows.withColumns({"depth": F.coalesce("pd", F.lit(-1)), "a": F.coalesce("pa", "_spread"), "b": F.coalesce("pb", F.lit(0))}).drop("pd", "pa", "pb")
        jumped = _met(asked, jumps, heavy, "_spread").drop(*KEY, "_spread").withColumnsRenamed({"d0": "depth", "a0": "a", "b0": "b"})
        summed = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in SUMS} | {"first": F.least("first", "_first")}
        state = written(jumped.join(given, KEY, "left").withColumns(summed).select(*KEY, F.col("jump.pd"), F.col("jump.pa"), F.col("jump.pb"), *SUMS, "first"))
    return state.select(*KEY, *SUMS, "first")


def prefix_trie(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, the root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    * Turns stand in the order of ``turn`` (null first), ties in the order of the SHA-256 of their role's length, role and text; repeated rows are repeated turns.
    * Null role and text are empty strings. Rows without a conv_id belong to no conversation and are left out.
    * Texts of any length are read whole and become a hash each. A conversation of any length is spread over tasks.
    * An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    convs, turns = rebuilt_turns(conversations)
    convs, rows = written(convs), written(paths(turns))
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("depth", "a", "b", "upto"), "depth").alias("e"))
    ends = written(convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"e.{c}", F.lit(0)).alias(c) for c in (*KEY, "upto"))))
    whole = written(ends.groupBy(*KEY).agg(F.min("conv_id").alias("sid"), F.count(F.lit(1)).alias("members"), F.max("upto").alias("upto")))
    longest = whole.agg(F.max("depth").alias("d")).first().d
    distinct = whole.filter("depth > 0").select("sid", F.col("depth").alias("length"), "a", "b")
    kept = rows.withColumn("_chunk", _chunk_of("depth")).join(_chunked(distinct.select(F.col("sid").alias("conv_id"), "length"), "length"), ["conv_id", "_chunk"], "left_semi").drop("_chunk")
    steps = written(kept.withColumnRenamed("conv_id", "sid"))
    heavy = written(steps.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(1, steps.count() // HEAVY)).select(*KEY))

    trie = Trie(steps, heavy, longest or 0)
    for k in range(batches):
        part = distinct.filter(F.pmod(F.xxhash64("sid"), F.lit(batches)) == k)
        if not part.isEmpty():
            trie.insert(part)
    sha = digests(ends.select(*KEY, "conv_id"))
    empty = hashlib.sha256(b"").hexdigest()
    if trie.nodes is None:
        root = whole.select("sid", "depth", "members").join(sha.select("ends_sha256"))
        return root.select(F.col("sid").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends_sha256")

    below = trie.nodes.groupBy(F.col("up").alias("depth"), F.col("ua").alias("a"), F.col("ub").alias("b")).agg(F.count(F.lit(1)).alias("children"))
    told = whole.select(*KEY, "members", "upto", "sid").join(sha, KEY)
    valued = trie.nodes.select(*KEY, "rep", "up", "ua", "ub").join(told, KEY, "left").join(below, KEY, "left")
    valued = trie._step(trie._step(valued, "rep", F.col("up") + 1, "n"), "rep", F.col("depth"), "s")
    above = F.col("n.upto") - F.col("n.size")
    nodes = written(valued.select(
        *KEY, "rep", "up", "ua", "ub", above.alias("above"), (F.col("s.upto") - above).alias("edge_bytes"), F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("members", F.lit(0)).alias("members"),
        (F.coalesce("members", F.lit(0)) * F.coalesce("upto", F.lit(0))).alias("member_bytes"), F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("leaves"), F.col("sid").alias("first"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    ))
    sums = written(subtree_sums(nodes, heavy))
    parents = sums.select(*KEY, F.col("first").alias("parent_first"))
    facts = nodes.select(*KEY, "rep", "up", "ua", "ub", "above", "children", "ends_sha256").join(sums, KEY)
    asked = facts.withColumnsRenamed({"depth": "deep", "a": "a0", "b": "b0"}).withColumnsRenamed({"up": "depth", "ua": "a", "ub": "b"})
    facts = _met(asked.withColumn("_spread", F.xxhash64("deep", "a0", "b0")), parents, heavy, "_spread").withColumnRenamed("depth", "up")

    # edges expanded: a row for each depth, with the bytes up to there
    first_chunk, last_chunk = F.call_function("div", F.col("up") + 1, F.lit(CHUNK)), F.call_function("div", F.col("deep"), F.lit(CHUNK))
    spans = facts.withColumn("_chunk", F.explode(F.sequence(first_chunk, last_chunk)))
    spans = spans.withColumn("depth", F.explode(F.sequence(F.greatest(F.col("up") + 1, F.col("_chunk") * CHUNK), F.least(F.col("deep"), F.col("_chunk") * CHUNK + CHUNK - 1))))
    each = spans.join(steps.select(F.col("sid").alias("rep"), "depth", (F.col("upto") - F.col("size")).alias("before")), ["rep", "depth"])
    top = whole.agg(F.min("sid").alias("first"), F.sum("members").alias("members"))
    saved = F.col("member_bytes") - F.col("members") * F.col("before") - F.col("edge_bytes") + F.col("before") - F.col("above")
    end = F.col("depth") == F.col("deep")
    out = each.join(F.broadcast(top.select(F.col("first").alias("root_first"))), F.lit(True)).select(
        F.col("first").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("up") + 1, F.col("first")).otherwise(F.coalesce("parent_first", "root_first")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(end, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.when(end, F.col("ends_sha256")).otherwise(empty).alias("ends_sha256"),
    )
    of_all = sums.join(nodes.filter("up = 0").select(*KEY), KEY, "left_semi").agg(F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum(F.col("member_bytes") - F.col("edge_bytes")).alias("saved"))
    at_root = sha.filter("depth = 0").agg(F.max("ends_sha256").alias("ends_sha256"))
    root = top.join(of_all).join(at_root).select(F.col("first").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
    return out.unionByName(root)
