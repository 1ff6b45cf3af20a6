"""How far the sources of a language differ in their words, by hash-consed segment trees over term ids.

Each group (language, source) has a segment tree over the language's term ids: leaves hold counts, a node covers a
segment and has up to ``2 ** FAN_BITS`` children. Nodes are hash-consed: subtrees with the same counts are one node,
whichever group or segment they are from, and a subtree of zeros is no node at all. Two trees are priced in one
traversal from their roots, a level at a time: pairs of nodes that meet again are merged with a count of how often
they do, so that each is opened, and each pair of leaf counts priced, once a pair of groups.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cardloom.llm.shared import scanned, written

#: A term is kept in a language where so many of its documents have it.
LEAST_DOCS = 30
#: Added to each count.
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
FAN_BITS = 3
#: Distinct (group, term) counts that a worker holds before it gives them out.
HELD = 200_000

# A-Z to a-z, letters and bytes from 0x80 on as they are, all else to a space
_TERM_BYTES = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, repeats included. Only ASCII bytes separate, so each term is whole UTF-8."""
    return text.translate(_TERM_BYTES).split(b" ")


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, lang_n``: occurrences of the terms that at least ``least_docs`` documents of the language have, in the source and in the language; every group has one more row, with a null term.

    Each task adds up its own rows first, so a hot source or term is some few partial rows a task in the shuffle. Sums
    of the source and of the language come from the one exchange by language and term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            for (lang, source), (all_n, seen) in held.items():  # both counters got their keys in the same order
                found = pa.array(all_n, pa.binary()).cast(pa.string())
                names = [pa.array([x], pa.string()).take(pa.nulls(len(found), pa.int32()).fill_null(0)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, found, pa.array(all_n.values(), pa.int64()), pa.array(seen.values(), pa.int64())], ["lang", "source", "term", "n", "n_docs"])
            held.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
                all_n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                found = Counter(terms(text.as_py()))
                found[b""] = 1  # says that there is such a group
                was = len(all_n)
                all_n.update(found)
                seen.update(found.keys())
                size += len(all_n) - was
                if size > HELD:
                    yield from give()
                    size = 0
        yield from give()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = plain.mapInArrow(count, "lang string, source string, term string, n long, n_docs long").repartition("lang", "term")
    here = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    there = W.partitionBy("lang", "term")
    known = here.withColumns({"lang_n": F.sum("n").over(there), "n_docs": F.sum("n_docs").over(there)}).filter((F.col("term") == "") | (F.col("n_docs") >= least_docs))
    return known.select("lang", "source", F.nullif("term", F.lit("")).alias("term"), "n", "lang_n")


def scaled_share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTHING) / (total + SMOOTHING kept)), exact in decimals of 38 digits."""
    over = ((count + SMOOTHING).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")).cast("decimal(38,0)")
    return F.call_function("div", over, (total + kept * SMOOTHING).cast("decimal(38,0)")) + 1


class Trees:
    """``roots (g, lang, node)`` and, for each level from the leaves up, ``nodes (node, kids)``; ``kids`` has (slot, id) of children that are not all zeros."""

    def __init__(self, leaves: DataFrame, height: int, fan_bits: int = FAN_BITS):
        """``leaves (g, pos, n)``, n over 0. The id of a leaf is its count."""
        self.height, self.fan_bits, self.levels = height, fan_bits, []
        nodes = leaves.select("g", "pos", F.col("n").alias("id"))
        for _ in range(height):
            kid = F.struct(F.pmod("pos", F.lit(1 << fan_bits)).cast("int").alias("slot"), "id")
            above = written(nodes.groupBy("g", F.shiftright("pos", fan_bits).alias("pos")).agg(F.sort_array(F.collect_list(kid)).alias("kids")))
            nodes = self._consed(above)
        self.roots = nodes.select("g", F.col("id").alias("node"))

    def _consed(self, above: DataFrame) -> DataFrame:
        """Equal lists of children get one id: a hash of the list, under the first seed that keeps all different lists apart."""
        seed = 0
        while True:
            named = above.withColumn("id", F.xxhash64(F.lit(seed), "kids"))
            unique = written(named.groupBy("id").agg(F.min("kids").alias("kids"), F.max("kids").alias("other")))
            if unique.filter("kids <> other").isEmpty():
                self.levels.append(unique.select(F.col("id").alias("node"), "kids"))
                return named.select("g", "pos", "id")
            seed += 1


def _opened(pairs: DataFrame, nodes: DataFrame, fan_bits: int) -> DataFrame:
    """Children of each pair, slot by slot; a missing node or child is the subtree of zeros (null). Pairs of zeros come as pairs of nulls."""
    for node, kids in (("u", "a"), ("v", "b")):
        known = nodes.select(F.col("node").alias("_on"), F.lit(False).alias("_zero"), F.map_from_entries("kids").alias(kids))
        keyed = pairs.select("*", F.col(node).isNull().alias("_zero"), F.coalesce(node, F.xxhash64("g1", "g2", "u", "v")).alias("_on"))  # zeros match nothing and are dealt out by a hash of their row
        pairs = keyed.join(known, ["_on", "_zero"], "left").drop("_on", "_zero")
    slot = F.explode(F.sequence(F.lit(0), F.lit((1 << fan_bits) - 1))).alias("slot")
    kids = pairs.select("g1", "g2", "times", "a", "b", slot)
    return kids.select("g1", "g2", F.try_element_at("a", "slot").alias("u"), F.try_element_at("b", "slot").alias("v"), "times").groupBy("g1", "g2", "u", "v").agg(F.sum("times").alias("times"))


def pair_prices(trees: Trees, pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``g1, g2, value`` for ``pairs (g1, g2)``: the sum over all terms of |p - q|. ``groups``: g, total, kept.

    A pair of zero subtrees is not opened further: it is ``2 ** (fan_bits level)`` pairs of zero counts. Places beyond
    the language's last term are pairs of zero counts too and are taken off again.
    """
    met = pairs.join(trees.roots.select(F.col("g").alias("g1"), F.col("node").alias("u")), "g1", "left").join(trees.roots.select(F.col("g").alias("g2"), F.col("node").alias("v")), "g2", "left")
    level = met.select("g1", "g2", "u", "v", F.lit(1).cast("long").alias("times"))
    zeros = []
    for k in range(trees.height, 0, -1):
        none = F.col("u").isNull() & F.col("v").isNull()
        zeros.append(level.filter(none).select("g1", "g2", (F.col("times") * (1 << (trees.fan_bits * k))).alias("times")))
        level = written(_opened(level.filter(~none), trees.levels[k - 1], trees.fan_bits))
    counted = level.select("g1", "g2", F.coalesce("u", F.lit(0)).alias("c1"), F.coalesce("v", F.lit(0)).alias("c2"), "times")
    for z in zeros:
        counted = counted.unionByName(z.select("g1", "g2", F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"), "times"))
    one = groups.select(F.col("g").alias("g1"), F.col("total").alias("t1"), "kept")
    two = groups.select(F.col("g").alias("g2"), F.col("total").alias("t2"))
    pads = pairs.join(one, "g1").select("g1", "g2", F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"), (F.col("kept") - (1 << (trees.fan_bits * trees.height))).alias("times"))
    priced = counted.unionByName(pads).groupBy("g1", "g2", "c1", "c2").agg(F.sum("times").alias("times")).join(one, "g1").join(two, "g2")
    price = F.abs(scaled_share(F.col("c1"), F.col("t1"), F.col("kept")) - scaled_share(F.col("c2"), F.col("t2"), F.col("kept")))
    return priced.groupBy("g1", "g2").agg(F.sum(price * F.col("times")).alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, fan_bits: int = FAN_BITS) -> DataFrame:
    """``lang, source, part, item, value, rank`` over all rows of ``docs (text, lang, source, ...)``.

    * ``pair``: every other source of the language and how far it is away, the farthest first; all ranks.
    * ``term``: terms that the source has and that weigh more there than in the language, to rank ``top_terms``.
    * Null text, lang and source are empty strings. A group whose texts are empty or hold no kept term has counts of
      zero and takes part in ``pair``. A language without kept terms has pairs of value 0.
    * Ties stand in the order of the item's UTF-8 bytes. Repeated rows count each time. An empty table gives no rows.
    * Other columns are ignored, whatever their names.
    """
    counts = written(term_counts(docs, least_docs))
    known = counts.filter("term IS NOT NULL")
    ids = scanned(known.select("lang", "term", "lang_n").distinct(), "lang", ["term"]).withColumn("pos", F.col("at") - 1).drop("at")
    of_lang = written(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total")))
    kept = written(known.join(ids.drop("lang_n"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n", "pos"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = counts.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = written(every.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")), F.monotonically_increasing_id().alias("g")))

    most = groups.agg(F.max("kept").alias("m")).first().m or 0
    height = 1
    while 1 << (fan_bits * height) < most:
        height += 1
    trees = Trees(kept.join(groups.select("lang", "source", "g"), ["lang", "source"]).select("g", "pos", "n"), height, fan_bits)
    here, there = groups.select("lang", F.col("g").alias("g1")), groups.select("lang", F.col("g").alias("g2"))
    pairs = here.join(there, "lang").filter("g1 < g2").select("g1", "g2")  # the report's own rows: sources of one language
    open_pairs = pairs.join(groups.filter("kept > 0").select(F.col("g").alias("g1")), "g1", "left_semi")
    prices = pairs.join(pair_prices(trees, open_pairs, groups), ["g1", "g2"], "left").select("g1", "g2", F.coalesce("value", F.lit(0)).alias("value"))
    both = written(prices.unionByName(prices.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "value")))
    named = groups.select(F.col("g").alias("g1"), "lang", "source")
    pair_rows = both.join(named, "g1").join(groups.select(F.col("g").alias("g2"), F.col("source").alias("item")), "g2").select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    held = kept.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    p, q = scaled_share(F.col("n"), F.col("total"), F.col("kept")), scaled_share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    term_rows = held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair_rows.withColumn("rank", rank).unionByName(term_rows.withColumn("rank", rank).filter(F.col("rank") <= top_terms))
